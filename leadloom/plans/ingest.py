"""Acquisition jobs: award notices and registry companies into the prospects table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.operators.awards import (
    AWARD_FIELDS,
    aggregate_by_holder,
    filter_relevant,
    holder_awards,
    holder_evidence,
    merge_awards,
    top_holders,
)
from leadloom.operators.contacts import row_id
from leadloom.operators.evidence import upsert_evidence
from leadloom.operators.identity import discover_registry, rank_registry, upsert_outcomes, upsert_prospects
from leadloom.plays import Play
from leadloom.session import cut_lineage
from leadloom.sources.sinks import ledger, watched


@dataclass
class Ingested:
    """What one acquisition job yields; outcomes are written already, the other members are lazy frames over them."""

    prospects: DataFrame
    outcomes: DataFrame
    awards: DataFrame | None
    evidence: DataFrame
    ledger: DataFrame


def _evidence_rows(outcomes: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence items addressed to the prospects their companies became."""
    targets = outcomes.filter(F.col("target_id").isNotNull()).select(*keys, F.col("target_id").alias("prospect_id"))
    return items.join(targets, keys).select(
        row_id("evidence", *keys, "position").alias("id"),
        "prospect_id", "category", "signal_type", "label", "evidence_text",
        F.lit(None).cast("string").alias("evidence_url"),
        "source_type", "confidence", "strength",
        F.lit(False).alias("manually_confirmed"),
    )


def ingest_awards(
    awards: DataFrame,
    prospects: DataFrame,
    history: DataFrame,
    evidence: DataFrame,
    suppression: DataFrame,
    play: Play,
    as_of: str | datetime,
    days: int = 90,
    max_companies: int | None = None,
    stage: Callable[[DataFrame], DataFrame] = cut_lineage,
    observation: Observation | None = None,
) -> Ingested:
    """Award notices to prospects: filter, group by holder, cut, upsert, merge histories and evidence.

    ``stage`` writes the filtered notices, the holders and the outcomes once, so
    the notices are scanned once however many tables come out.

    ``history`` are the stored award rows per prospect.  The holders kept by the
    cut are few beside the notices; every relevant award of theirs is merged, as
    rows of any number, while texts about a holder need only its newest.
    ``observation`` takes the ledger's counts while the outcomes are written.
    """
    relevant = stage(filter_relevant(awards, play, as_of, days))
    holders = aggregate_by_holder(relevant)
    if max_companies:
        holders = top_holders(holders, max_companies)
    holders = stage(holders)
    details = F.concat(F.col("signal_details"), F.lit(" — "), F.col("objets_joined"))
    # Arrival order: as the holders are ranked; the key breaks ties.
    rank = F.struct(-F.col("award_count"), -F.col("total_cents"), F.col("holder_key"))
    incoming = holders.withColumns(
        {
            "signal_details": F.when(F.col("objets_joined") != "", details).otherwise(F.col("signal_details")),
            "ord": rank,
        }
    )
    blocked = suppression.filter(F.col("kind") == "siren")
    outcomes = stage(watched(upsert_outcomes(incoming, prospects, blocked), observation))
    snapshot = upsert_prospects(
        prospects, outcomes.drop("award_history"), "PUBLIC_AWARD", "DECP", fixed.DATA_SOURCE_AWARDS, play.code
    )
    targets = outcomes.filter(F.col("target_id").isNotNull()).select("holder_key", F.col("target_id").alias("prospect_id"))
    # stored amounts may be texts that are no numbers: new rows take the types of the history
    as_stored = [F.col(f).cast(history.schema[f].dataType).alias(f) for f in AWARD_FIELDS]
    fresh = targets.join(holder_awards(relevant), "holder_key").select("prospect_id", *as_stored)
    merged = merge_awards(history.select("prospect_id", *AWARD_FIELDS), fresh)
    items = _evidence_rows(outcomes, holder_evidence(holders).drop("siren", "siret"), ["holder_key"])
    return Ingested(
        prospects=snapshot,
        outcomes=outcomes,
        awards=merged,
        evidence=upsert_evidence(evidence, items, per_call=None),
        ledger=ledger(outcomes.withColumn("source", F.lit("decp"))),
    )


def registry_details() -> Column:
    return F.concat(
        F.lit("Field-service registry · NAF "), F.coalesce("naf_code", F.lit("None")), F.lit(" · "), F.col("company_size"),
        F.lit(" · "), F.coalesce("decision_maker_title", F.lit("")),
    )


def ingest_registry(
    companies: DataFrame,
    prospects: DataFrame,
    evidence: DataFrame,
    suppression: DataFrame,
    play: Play,
    max_companies: int | None = None,
    stage: Callable[[DataFrame], DataFrame] = cut_lineage,
    observation: Observation | None = None,
) -> Ingested:
    """Registry sightings to prospects: one per siren, ranked, cut, upserted, with structural evidence."""
    found = discover_registry(companies, play)
    if max_companies:
        found = rank_registry(found, play, max_companies)
    found = stage(found)
    incoming = found.withColumns({"signal_details": registry_details(), "ord": F.col("siren")})
    blocked = suppression.filter(F.col("kind") == "siren")
    outcomes = stage(watched(upsert_outcomes(incoming, prospects, blocked), observation))
    flat = outcomes.drop("evidence", "dirigeants")
    snapshot = upsert_prospects(
        prospects, flat, "REGISTRY_FIELD", "Annuaire", fixed.DATA_SOURCE_REGISTRY, play.code
    )
    items = found.select("siren", F.posexplode("evidence").alias("position", "item")).select("siren", "position", "item.*")
    rows = _evidence_rows(outcomes, items, ["siren"])
    return Ingested(
        prospects=snapshot,
        outcomes=outcomes,
        awards=None,
        evidence=upsert_evidence(evidence, rows, per_call=None),
        ledger=ledger(flat.withColumn("source", F.lit("registry"))),
    )
