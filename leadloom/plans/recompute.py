"""Scoring jobs: recompute everything, create, update, review."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.frames import when_is
from leadloom.functions.rules import first_match, yes
from leadloom.operators.compliance import gate_reviews, mark_suppressed
from leadloom.operators.scoring import project_scores, score, score_inputs
from leadloom.plays import Play
from leadloom.session import cut_lineage

AsOf = str | date | datetime


def recompute(
    prospects: DataFrame,
    evidence: DataFrame,
    reviews: DataFrame,
    suppression: DataFrame,
    assets: DataFrame,
    awards: DataFrame,
    play: Play,
    as_of: AsOf,
    stage: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Score every prospect that is not anonymised in one plan and project the result onto its columns.

    Rows of anonymised prospects are no part of the result: they stay as they are.

    ``stage`` writes the deduplicated evidence once, which is read twice.
    """
    scored = prospects.filter(~yes(F.col("anonymized")))
    inputs = score_inputs(scored, evidence, reviews, suppression, assets, awards, as_of, stage)
    return project_scores(score(inputs, play), play)


def create_prospects(new: DataFrame, suppression: DataFrame, play: Play) -> DataFrame:
    """New prospects with their defaults and ``created`` = False for suppressed ones.

    ``new`` brings ``id`` and the validated profile columns.
    """
    marked = mark_suppressed(new, suppression)
    defaults = {
        "market_play_code": F.lit(play.code),
        "manual_review_state": F.lit("unreviewed"),
        "readiness_state": F.lit("research_required"),
        "opted_out": F.lit(False),
        "anonymized": F.lit(False),
        "needs_manual_review": F.lit(False),
    }
    return marked.withColumns({**defaults, "created": ~F.col("is_suppressed")})


def created_events(created: DataFrame, as_of: AsOf) -> DataFrame:
    """The opening event of every created prospect."""
    return created.filter("created").select(
        F.col("id").alias("prospect_id"),
        F.lit("Email").alias("channel"),
        F.lit("New").alias("event_type"),
        when_is(as_of).alias("event_date"),
        F.lit("Prospect created").alias("notes"),
        F.lit("research").alias("event_kind"),
    )


def update_prospects(prospects: DataFrame, patch: DataFrame) -> DataFrame:
    """Apply a column patch: a field changes when its ``set_<field>`` flag is true, also to NULL.

    A patch column without a flag column changes wherever the patch has a row.
    """
    fields = [n for n in patch.columns if n != "id" and not n.startswith("set_") and n in prospects.columns]
    renamed = patch.select("id", F.lit(True).alias("_patched"), *[
        F.col(name).alias(f"_patch_{name}") for name in fields
    ], *[
        (yes(F.col(f"set_{name}")) if f"set_{name}" in patch.columns else F.lit(True)).alias(f"_set_{name}") for name in fields
    ])
    joined = prospects.join(renamed, "id", "left")
    columns = [
        F.when(yes(F.col("_patched") & F.col(f"_set_{name}")), F.col(f"_patch_{name}")).otherwise(F.col(name)).alias(name)
        if name in fields else F.col(name)
        for name in prospects.columns
    ]
    return joined.select(*columns)


def newest_decisions(gated: DataFrame) -> DataFrame:
    """The last applicable decision per prospect."""
    fields = F.struct("decision", "notes", "created_at", *fixed.REVIEW_FLAGS)
    good = gated.filter(F.col("error").isNull())
    return good.groupBy("prospect_id").agg(F.max_by(fields, F.struct("created_at", "id")).alias("d"))


def apply_reviews(prospects: DataFrame, reviews: DataFrame, suppression: DataFrame) -> DataFrame:
    """Prospects after qualification: review state, stage, flag and decision of the newest valid review."""
    decided = newest_decisions(gate_reviews(reviews, prospects, suppression)).select(
        F.col("prospect_id").alias("id"), "d"
    )
    joined = prospects.join(decided, "id", "left")
    decision = F.col("d.decision")
    some = decision.isNotNull()
    keep = lambda fresh, name: F.when(some, fresh).otherwise(F.col(name))
    state = first_match([(decision == "accept", "accepted"), (decision == "reject", "rejected"), (decision == "park", "parked")],
                        "research_more")
    stage = F.when(decision.isin("reject", "park"), "parked").otherwise(F.col("acquisition_stage"))
    review = first_match([(decision.isin("accept", "reject"), False), (decision == "research_more", True)],
                         F.col("needs_manual_review"))
    out = joined.withColumns(
        {
            "manual_review_state": keep(state, "manual_review_state"),
            "acquisition_stage": keep(stage, "acquisition_stage"),
            "needs_manual_review": keep(review, "needs_manual_review"),
            "qualification_decision": keep(decision, "qualification_decision"),
            "reviewed_at": F.col("d.created_at"),
        }
    )
    return out.drop("d")


def review_tasks(prospects: DataFrame, reviews: DataFrame, suppression: DataFrame, as_of: AsOf) -> DataFrame:
    """Tasks that accept and research_more decisions open."""
    good = gate_reviews(reviews, prospects, suppression).filter(F.col("error").isNull())
    names = prospects.select(F.col("id").alias("prospect_id"), "company_name")
    rows = good.filter(F.col("decision").isin("accept", "research_more")).join(names, "prospect_id")
    accept = F.col("decision") == "accept"
    return rows.select(
        "prospect_id",
        F.when(accept, "first_outreach").otherwise("research").alias("task_type"),
        F.concat(F.when(accept, "Send first outreach — ").otherwise("Research more evidence — "), F.col("company_name")).alias("title"),
        F.when(accept, 80).otherwise(60).alias("priority"),
        F.lit("open").alias("status"),
        F.lit("qualification").alias("origin"),
        when_is(as_of).alias("due_date"),
        F.when(~accept, F.col("notes")).alias("notes"),
        F.col("id").alias("review_id"),
    )
