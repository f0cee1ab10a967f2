"""The acquisition run: the sources a mode names, one after the other, with one ledger and a score for what changed."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leadloom.operators.awards import AWARD_FIELDS
from leadloom.operators.identity import first_events
from leadloom.plans.ingest import ingest_awards, ingest_registry
from leadloom.plans.rescore import Facts, rescore
from leadloom.plays import Play
from leadloom.session import cut_lineage
from leadloom.sources.sinks import run_record

MODES = {"full": ("decp", "registry"), "decp": ("decp",), "registry": ("registry",)}

@dataclass(frozen=True)
class Acquired:
    """After a run: its row for the runs table and, unless it failed, the tables it leaves (``None`` where it failed)."""

    run: DataFrame
    prospects: DataFrame | None = None
    awards: DataFrame | None = None
    evidence: DataFrame | None = None
    events: DataFrame | None = None


def acquire(
    mode: str,
    prospects: DataFrame,
    facts: Facts,
    play: Play,
    as_of: str,
    notices: DataFrame | None = None,
    registry: DataFrame | None = None,
    days: int = 90,
    max_companies: int | None = None,
) -> Acquired:
    """Award notices, then registry companies, into the prospects; created and updated ones are scored anew.

    The second source meets the prospects the first one left.  Counts are observed in the write of each source's
    outcomes.  A source that fails ends the run: its row tells the error and the counts so far, and no table is left,
    so a caller that switches snapshots keeps the old ones.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    spark, counts, written, touched, events = prospects.sparkSession, {}, facts, None, None
    stored = prospects.columns
    try:
        for source in MODES[mode]:
            observation = Observation(f"ledger-{source}")
            if source == "decp":
                step = ingest_awards(notices, prospects, written.awards, written.evidence, written.suppression, play, as_of, days, max_companies, observation=observation)
                written = replace(written, awards=cut_lineage(step.awards.select("prospect_id", *AWARD_FIELDS)))
            else:
                step = ingest_registry(registry, prospects, written.evidence, written.suppression, play, max_companies, observation=observation)
            after = cut_lineage(step.prospects)
            counts[source] = observation.get
            both = written.evidence.unionByName(step.evidence.drop("fingerprint"), allowMissingColumns=True)
            written = replace(written, evidence=cut_lineage(both))
            fresh, opened = after.filter(F.col("changed").isNotNull()).select("id"), first_events(after, source)
            touched = fresh if touched is None else touched.union(fresh)
            events = opened if events is None else events.unionByName(opened)
            prospects = after.select(*stored)
        scored = cut_lineage(rescore(prospects, touched, written, play, as_of))
    except Exception as error:  # noqa: BLE001  whatever ends a run is told in its row
        return Acquired(run_record(spark, mode, play.code, counts, as_of, f"{type(error).__name__}: {error}"))
    return Acquired(run_record(spark, mode, play.code, counts, as_of), scored, written.awards, written.evidence, events)
