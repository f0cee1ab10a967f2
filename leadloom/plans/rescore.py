"""Write jobs that end in a score: create, update, qualify, enrich, opt out, project contacts, log events.

A job touches few prospects.  Their ids become one staged key set, which is semi-joined into evidence, reviews and awards
before anything there is ranked or summed, and into the prospects themselves; all other rows pass through unread by the
scorer.  What the job has just written (reviews, evidence, suppression) is part of what it scores with.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.frames import when_is
from leadloom.operators import compliance, contacts, evidence, identity
from leadloom.operators.scoring import project_scores, score, score_inputs
from leadloom.plans.recompute import apply_reviews, create_prospects, created_events, review_tasks, update_prospects
from leadloom.plays import Play
from leadloom.session import cut_lineage

AsOf = str | date | datetime

#: Columns of a prospect the score writes.
SCORED_COLUMNS = (
    "fit_score", "pain_score", "trigger_score", "timing_score", "authority_score", "contactability_score", "value_score", "data_quality_score",
    "opportunity_score", "acquisition_score", "urgency_score", "priority_level", "readiness_state", "readiness_failures", "acquisition_stage",
    "needs_manual_review", "market_play_code", "suspected_pain", "why_now", "recommended_buyer_role", "recommended_offer", "personalization_brief",
)
#: Profile columns the scorer reads; a job that creates prospects may leave any of them out.
READ_COLUMNS = (
    "company_name", "company_size", "signal_type", "signal_details", "decision_maker_name", "decision_maker_title", "email", "phone", "website",
    "siren", "siret", "naf_code", "contact_confidence", "contact_discovery_state", "contact_source", "data_source", "source", "notes", "linkedin_url",
)


@dataclass(frozen=True)
class Facts:
    """The tables a score is made of: rows by ``prospect_id``, and the two that hold for all."""

    evidence: DataFrame
    reviews: DataFrame
    awards: DataFrame
    suppression: DataFrame
    assets: DataFrame

    def of(self, keys: DataFrame) -> Facts:
        """Only the rows of some prospects."""
        ids = keys.select(F.col("id").alias("prospect_id"))
        own = lambda rows: rows.join(ids, "prospect_id", "left_semi")
        return replace(self, evidence=own(self.evidence), reviews=own(self.reviews), awards=own(self.awards))


def rescore(
    prospects: DataFrame, changed: DataFrame, facts: Facts, play: Play, as_of: AsOf, stage: Callable[[DataFrame], DataFrame] = cut_lineage
) -> DataFrame:
    """``prospects`` with the rows whose ``id`` is in ``changed`` scored anew; the others as they are.

    Columns a score writes are added where missing, null in rows never scored; existing ones keep their type.
    """
    keys = stage(changed.select("id").filter(F.col("id").isNotNull()).distinct())
    own = facts.of(keys)
    touched = prospects.join(keys, "id", "left_semi")
    inputs = score_inputs(touched, own.evidence, own.reviews, own.suppression, own.assets, own.awards, as_of, stage)
    scored = project_scores(score(inputs, play), play)
    kept = dict(prospects.dtypes)
    fresh = scored.select(
        *[F.col(name).cast(kind).alias(name) if name in SCORED_COLUMNS else F.col(name) for name, kind in prospects.dtypes],
        *[F.col(name) for name in SCORED_COLUMNS if name not in kept],
    )
    return fresh.unionByName(prospects.join(keys, "id", "left_anti"), allowMissingColumns=True)


@dataclass(frozen=True)
class Written:
    """What a job leaves: the prospects, and rows to append to other tables."""

    prospects: DataFrame
    events: DataFrame | None = None
    tasks: DataFrame | None = None
    evidence: DataFrame | None = None
    suppression: DataFrame | None = None


def create(new: DataFrame, facts: Facts, play: Play, as_of: AsOf) -> Written:
    """New prospects with their first score and opening event; suppressed ones come back with ``created`` false and no score."""
    given = new.withColumns({name: F.lit(None).cast("string") for name in READ_COLUMNS if name not in new.columns})
    marked = cut_lineage(create_prospects(given, facts.suppression, play).drop("is_suppressed"))
    rows = rescore(marked, marked.filter("created"), facts, play, as_of)
    return Written(rows, events=created_events(marked, as_of))


def update(prospects: DataFrame, patch: DataFrame, facts: Facts, play: Play, as_of: AsOf) -> Written:
    """Prospects after a column patch (see ``update_prospects``), the patched ones scored anew."""
    return Written(rescore(update_prospects(prospects, patch), patch, facts, play, as_of))


def qualify(prospects: DataFrame, reviews: DataFrame, facts: Facts, play: Play, as_of: AsOf) -> Written:
    """Prospects after new decisions; the valid ones join the stored reviews before the score, and open tasks."""
    good = compliance.gate_reviews(reviews, prospects, facts.suppression).filter(F.col("error").isNull()).drop("error")
    good = cut_lineage(good)
    with_new = replace(facts, reviews=facts.reviews.unionByName(good, allowMissingColumns=True))
    reviewed = apply_reviews(prospects, good, facts.suppression)
    rows = rescore(reviewed, good.select(F.col("prospect_id").alias("id")), with_new, play, as_of)
    return Written(rows, tasks=review_tasks(prospects, good, facts.suppression, as_of))


def enrich(prospects: DataFrame, patch: DataFrame, found: DataFrame, facts: Facts, play: Play, as_of: AsOf) -> Written:
    """Prospects after enrichment: fields copied, evidence merged by fingerprint, scored, and stamped.

    ``patch`` has one row per prospect ``id``, ``found`` the evidence that came with it.
    """
    fresh = cut_lineage(evidence.upsert_evidence(facts.evidence, found))
    with_new = replace(facts, evidence=facts.evidence.unionByName(fresh.drop("fingerprint"), allowMissingColumns=True))
    keys = patch.select("id").distinct()
    filled_in = identity.apply_enrichment(prospects.join(keys, "id", "left_semi"), patch)
    rows = rescore(filled_in.unionByName(prospects.join(keys, "id", "left_anti")), keys, with_new, play, as_of)
    stamped = keys.withColumn("_now", when_is(as_of))
    kind = dict(prospects.dtypes).get("last_enriched_at", "timestamp_ntz")
    before = F.col("last_enriched_at") if "last_enriched_at" in rows.columns else F.lit(None)
    out = rows.join(stamped, "id", "left").withColumn("last_enriched_at", F.coalesce(F.col("_now").cast(kind), before)).drop("_now")
    return Written(out, evidence=fresh)


def log_events(prospects: DataFrame, events: DataFrame, facts: Facts, play: Play, as_of: AsOf) -> Written:
    """Prospects after new events: opt-outs set their flag and suppress mailbox and siren, and all with an event are scored.

    Events that the gate refuses change nothing.
    """
    good = cut_lineage(compliance.accepted(compliance.gate_events(events, prospects, facts.suppression)))
    fresh = cut_lineage(compliance.opt_out_suppression(prospects, good, facts.suppression))
    with_new = replace(facts, suppression=facts.suppression.unionByName(fresh, allowMissingColumns=True))
    flagged = compliance.apply_opt_outs(prospects, good)
    rows = rescore(flagged, good.select(F.col("prospect_id").alias("id")), with_new, play, as_of)
    return Written(rows, events=good, suppression=fresh)


def project_contacts(prospects: DataFrame, people: DataFrame, points: DataFrame, processed: DataFrame, facts: Facts, play: Play, as_of: AsOf) -> Written:
    """Prospects with the contact that stands for them written back; those in ``processed`` are projected and scored."""
    keys = cut_lineage(processed.select("id").distinct())
    mine = prospects.join(keys, "id", "left_semi")
    ids = keys.select(F.col("id").alias("prospect_id"))
    own = contacts.project_primary(mine, people.join(ids, "prospect_id", "left_semi"), points.join(ids, "prospect_id", "left_semi"))
    both = own.unionByName(prospects.join(keys, "id", "left_anti"), allowMissingColumns=True)
    return Written(rescore(both, keys, facts, play, as_of))


def apply_waterfall(prospects: DataFrame, outcome: DataFrame, facts: Facts, play: Play, as_of: AsOf) -> Written:
    """Prospects after a mailbox search (rows of ``contact_waterfall``): a sendable mailbox is set, its state copied, then scored.

    A search that found nothing to send to leaves the stored mailbox.
    """
    found = outcome.select(
        "id", F.col("email_to_set").alias("email"), "contact_source", "contact_confidence", "contact_discovery_state", "needs_manual_review",
        F.col("email_to_set").isNotNull().alias("set_email"),
    )
    return Written(rescore(update_prospects(prospects, found), found, facts, play, as_of))
