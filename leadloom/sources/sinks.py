"""Writers and reports: prospect export, dossiers, run ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.rules import filled, is_filled, text, yes
from leadloom.operators.activity import current_status

EXPORT_COLUMNS = ("id", "company_name", "sector", "company_size", "signal_type", "signal_details",
                  "decision_maker_name", "decision_maker_title", "linkedin_url", "email", "phone", "website",
                  "data_source", "source", "urgency_score", "priority_level", "current_status", "opted_out", "notes",
                  "created_at")
_BLANKABLE = ("signal_details", "decision_maker_name", "decision_maker_title", "linkedin_url", "email", "phone",
              "website", "notes")


def export_rows(prospects: DataFrame, events: DataFrame, limit: int | None = None) -> DataFrame:
    """The twenty exported columns of prospects that may be contacted; ``limit`` keeps the first by id."""
    open_rows = prospects.filter(~yes(F.col("opted_out")))
    if "is_suppressed" in prospects.columns:
        open_rows = open_rows.filter(~yes(F.col("is_suppressed")))
    rows = current_status(open_rows, events).withColumns(
        {
            **{name: text(F.col(name)) for name in _BLANKABLE},
            "created_at": text(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")),
        }
    ).select(*EXPORT_COLUMNS)
    return rows.orderBy("id").limit(limit) if limit else rows


def write_csv(rows: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """CSV files with a header, in order of the first column, each of about ``per_file`` rows."""
    in_ranges(rows, rows.columns[0], per_file).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def in_ranges(rows: DataFrame, key: str, per_file: int, *then: str) -> DataFrame:
    """Rows dealt by ranges of ``key``, about ``per_file`` in each, and sorted there: no key spans two, and no sort is global."""
    files = max(1, -(-rows.count() // per_file))
    return rows.repartitionByRange(files, key).sortWithinPartitions(key, *then)


def dossier_lines(
    prospects: DataFrame, awards: DataFrame, people: DataFrame, points: DataFrame, evidence: DataFrame, as_of: str,
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Every prospect's report as ordered lines: ``prospect_id``, ``section``, ``position``, ``line``.

    A report is its lines in (section, position) order.  Lines rather than one
    text per prospect: a prospect with very many people or evidence items is
    then no larger a row than any other.  ``awards`` are ranked rows
    (``position``), all of which are shown.

    Lines of people, points, awards and evidence are one union; which of them a
    prospect has is one row of flags, and all its other lines come from one
    explode.  ``stage`` may write the union, which is read twice.
    """
    show = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("None"))
    bold = lambda label, value: F.concat(F.lit(f"**{label}:** "), value)
    bullet = lambda label, name: F.when(is_filled(F.col(name).cast("string")), F.concat(F.lit(f"- **{label}:** "), F.col(name).cast("string")))
    paragraph = lambda label, name: F.when(is_filled(F.col(name)), F.concat(F.lit(f"**{label}:**\n"), F.col(name), F.lit("\n")))
    descending = lambda column: F.format_string("%09d", F.lit(999_999_999) - F.coalesce(column, F.lit(0)).cast("int"))
    number = lambda column: F.format_string("%019d", column.cast("long"))
    words = lambda column: F.replace(column, F.lit("_"), F.lit(" "))
    first = lambda flag: F.when(yes(F.col(flag)), "0").otherwise("1")

    def child(section: int, rows: DataFrame, position: Column, line: Column) -> DataFrame:
        return rows.select("prospect_id", F.lit(section).alias("section"), position.alias("position"), line.alias("line"))

    children = child(3, awards, F.format_string("%09d", "position"), F.concat(
        F.lit("- **"), F.coalesce("date", F.lit("—")), F.lit("**: "), F.coalesce("objet", F.lit("Award")),
        F.lit(" (Value: "), F.coalesce(F.col("montant").cast("string"), F.lit("—")), F.lit(")"),
    ))
    children = children.unionByName(child(6, people, F.concat_ws("|", first("is_primary_candidate"), descending(F.col("buyer_role_score")), number(F.col("id"))), F.concat(
        F.lit("- **"), F.col("full_name"), F.lit("** ("), F.coalesce(filled(F.col("job_title")), F.lit("Unknown role")),
        F.lit(") - Confidence: "), show("identity_confidence"), F.lit("/100"),
    )))
    children = children.unionByName(child(8, points, F.concat_ws("|", first("is_primary"), descending(F.col("confidence_score")), number(F.col("id"))), F.concat(
        F.lit("- **"), F.coalesce("value_display", "value_normalized"), F.lit("** ("), words(F.col("kind")),
        F.lit(") - Deliverability: "), show("deliverability_state"), F.lit(" - Utility: "), words(show("utility_state")),
    )))
    children = children.unionByName(child(11, evidence, number(F.col("id")), F.concat(
        F.lit("- **["), show("category"), F.lit("] "), text(F.col("label")), F.lit("**: "), text(F.col("evidence_text")),
        F.lit(" (Strength: "), show("strength"), F.lit("/100)"),
    )))
    children = stage(children)

    has = {3: "_awards", 6: "_people", 8: "_points", 11: "_evidence"}
    flags = children.groupBy(F.col("prospect_id").alias("id")).agg(*[F.bool_or(F.col("section") == n).alias(name) for n, name in has.items()])
    rows = prospects.join(flags, "id", "left")
    has_notes = is_filled(F.col("notes")) | is_filled(F.col("signal_details"))
    has_plan = is_filled(F.col("suspected_pain")) | is_filled(F.col("why_now")) | is_filled(F.col("recommended_offer"))
    either = lambda flag, some, none: F.when(yes(F.col(flag)), some).otherwise(F.lit(none).cast("string"))
    sections: dict[int, list[Column]] = {
        1: [
            F.concat(F.lit("# Intelligence Report: "), F.col("company_name")),
            F.lit(f"\n**Generated on:** {as_of} UTC"),
            F.concat_ws(" | ", bold("Priority", show("priority_level")), bold("Urgency", show("urgency_score")), bold("Opportunity", show("opportunity_score"))),
            F.concat_ws(" | ", bold("Status", show("current_status")), bold("Signal", show("signal_type"))),
            F.lit("\n## Company Profile"),
            F.concat(F.lit("- **Sector:** "), show("sector")),
            F.concat(F.lit("- **Size:** "), show("company_size")),
            bullet("SIREN", "siren"), bullet("SIRET", "siret"), bullet("NAF", "naf_code"), bullet("Website", "website"),
        ],
        2: [either("_awards", "\n## Award History", None)],
        4: [F.lit("\n## Contact Intelligence")],
        5: [either("_people", "### Key People", "*No specific people identified.*")],
        7: [either("_points", "\n### Contact Paths", "*No reliable contact paths discovered.*")],
        9: [F.lit("\n## Evidence & Triggers")],
        10: [either("_evidence", F.lit(None), "*No direct evidence logged.*")],
        12: [
            F.when(has_notes, F.lit("\n## Notes & Signal Details")),
            paragraph("Signal Details", "signal_details"),
            paragraph("Notes", "notes"),
            F.when(has_plan, F.lit("\n## Commercial Strategy")),
            F.when(has_plan, paragraph("Why Now (Trigger)", "why_now")),
            F.when(has_plan, paragraph("Suspected Pain", "suspected_pain")),
            F.when(has_plan, paragraph("Target Role", "recommended_buyer_role")),
            F.when(has_plan, paragraph("Recommended Offer", "recommended_offer")),
        ],
    }
    place = lambda section, k, line: F.struct(F.lit(section).alias("section"), F.lit(f"{k:09d}").alias("position"), line.cast("string").alias("line"))
    fixed_lines = F.array(*[place(section, k, line) for section, lines in sections.items() for k, line in enumerate(lines)])
    shown = F.filter(fixed_lines, lambda entry: entry["line"].isNotNull())
    return rows.select(F.col("id").alias("prospect_id"), F.inline(shown)).unionByName(children)


def write_dossiers(lines: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """Text files of about ``per_file`` lines holding the reports one after another; a report is in one file."""
    in_ranges(lines, "prospect_id", per_file, "section", "position").select("line").write.mode("overwrite").text(path)


LEDGER_COUNTS = {"created": "created", "updated": "updated", "skipped": "skipped", "error": "errors"}
LEDGER = ("awards", "companies", *LEDGER_COUNTS.values())


def _measures(outcomes: DataFrame) -> list[Column]:
    awards = F.coalesce(F.sum("award_count"), F.lit(0)) if "award_count" in outcomes.columns else F.max(F.lit(0))
    return [
        F.coalesce(awards, F.lit(0)).cast("long").alias("awards"),
        F.count(F.lit(1)).alias("companies"),
        *[F.count_if(F.col("outcome") == name).alias(column) for name, column in LEDGER_COUNTS.items()],
    ]


def ledger(outcomes: DataFrame) -> DataFrame:
    """Per source: awards, companies, and how many were created, updated, skipped or failed."""
    return outcomes.groupBy("source").agg(*_measures(outcomes))


def watched(outcomes: DataFrame, observation: Observation | None) -> DataFrame:
    """The outcomes, with the ledger's counts taken by whatever writes them: no second scan."""
    return outcomes.observe(observation, *_measures(outcomes)) if observation else outcomes


def run_record(
    spark: SparkSession, adapter: str, play_code: str, per_source: dict[str, dict[str, int]], finished_at: str, error: str | None = None
) -> DataFrame:
    """The row appended to the runs table: status, counts per source and of the whole run, and the error, if it failed."""
    total = {name: sum(counts[name] for counts in per_source.values()) for name in LEDGER}
    stats = [(source, *(counts[name] for name in LEDGER)) for source, counts in [*per_source.items(), ("total", total)]]
    counts = ", ".join(f"{name}: long" for name in LEDGER)
    schema = f"adapter string, market_play_code string, status string, stats array<struct<source: string, {counts}>>, finished_at string, error_summary string"
    row = (adapter, play_code, "failed" if error else "completed", stats, finished_at, error)
    return spark.createDataFrame([row], schema).withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz"))
