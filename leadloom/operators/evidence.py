"""Evidence: fingerprints, per-prospect facts, upserts, website taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.frames import bounded_list, first_per, top_per
from leadloom.functions.rules import compact, filled, first_match, is_filled, nonzero, text, yes
from leadloom.functions.text import evidence_fingerprint, strip

LABELS_SHOWN = 40
CACHE_FIELDS = ("category", "signal_type", "label", "evidence_text", "source_type", "confidence", "strength",
                "manually_confirmed")


def with_fingerprint(evidence: DataFrame) -> DataFrame:
    """Add the fingerprint where a row brings none."""
    computed = evidence_fingerprint(
        F.col("source_type"), F.col("signal_type"), F.col("evidence_text"), F.col("evidence_url")
    )
    if "fingerprint" in evidence.columns:
        computed = F.coalesce(filled(F.col("fingerprint")), computed)
    return evidence.withColumn("fingerprint", computed)


def normalize_signals(evidence: DataFrame) -> DataFrame:
    """Active evidence, the first row of each fingerprint per prospect."""
    active = evidence.filter(F.coalesce(F.col("is_active"), F.lit(True)))
    return first_per(with_fingerprint(active), ["prospect_id", "fingerprint"], ["id"])


def is_pain(category: Column, signal_type: Column) -> Column:
    kind = F.upper(text(signal_type))
    return (F.lower(text(category)) == "pain") | kind.startswith("PAIN_") | kind.isin(*fixed.PAIN_SIGNALS)


def source_name(source_type: Column) -> Column:
    """The independent source an evidence row stands for, NULL for none."""
    name = strip(F.lower(text(source_type)))
    return first_match(
        [(name.isin(*fixed.INDEPENDENT_SOURCES), name), (name.isin(*fixed.ANNUAIRE_ALIASES), "annuaire")]
    )


def evidence_facts(signals: DataFrame) -> DataFrame:
    """Everything the scorer needs from normalised evidence, in fixed size per prospect.

    All aggregates combine on the map side; the source set holds at most the
    dozen known sources.
    """
    pain = is_pain(F.col("category"), F.col("signal_type"))
    strength = F.coalesce(nonzero(F.col("strength")), F.lit(50))
    label = F.coalesce(filled(F.col("label")), F.upper(text(F.col("signal_type"))))
    return signals.groupBy("prospect_id").agg(
        F.count(F.lit(1)).alias("signal_count"),
        F.collect_set(source_name(F.col("source_type"))).alias("signal_sources"),
        F.count_if(F.col("category") == "structural_fit").alias("structural_count"),
        F.max(F.when(pain, F.least(F.lit(80), F.lit(40) + F.floor(strength / 5)))).cast("int").alias("pain_strength"),
        F.coalesce(F.bool_or(pain & yes(F.col("manually_confirmed"))), F.lit(False)).alias("pain_confirmed"),
        F.min_by(F.when(pain, label), F.when(pain, F.col("id"))).alias("pain_label"),
        F.bool_or(text(F.col("category")) == "trigger").alias("has_trigger"),
        F.bool_or(F.lower(text(F.col("source_type"))) == "decp").alias("has_award_evidence"),
    )


def trigger_labels(signals: DataFrame, keep: int = LABELS_SHOWN) -> DataFrame:
    """The first trigger labels per prospect, as many as an explanation shows."""
    triggers = signals.filter((F.col("category") == "trigger") & is_filled(F.col("label")))
    ranked = top_per(triggers, ["prospect_id"], ["id"], keep, rank="position")
    return bounded_list(ranked, ["prospect_id"], "position", F.col("label"), "trigger_labels")


def evidence_rows(evidence: DataFrame) -> DataFrame:
    """All active evidence with its ``position`` within the prospect; rows, so a prospect may have any number."""
    active = evidence.filter(F.coalesce(F.col("is_active"), F.lit(True)))
    return top_per(active, ["prospect_id"], ["id"], None, rank="position")


def evidence_lists(evidence: DataFrame, keep: int) -> DataFrame:
    """Active evidence per prospect as one row: its count and the first ``keep`` items as a list."""
    active = evidence.filter(F.coalesce(F.col("is_active"), F.lit(True)))
    counts = active.groupBy("prospect_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    ranked = top_per(active, ["prospect_id"], ["id"], keep, rank="position")
    lists = bounded_list(ranked, ["prospect_id"], "position", F.struct("id", *CACHE_FIELDS), "evidence_json")
    return counts.join(lists, "prospect_id")


def merge_evidence_cache(old: DataFrame, new: DataFrame, keep: int | None = None) -> DataFrame:
    """Old then new evidence, first of each fingerprint, numbered per prospect; ``keep`` asks for the first few only."""
    both = old.withColumn("is_new", F.lit(False)).unionByName(
        new.withColumn("is_new", F.lit(True)), allowMissingColumns=True
    )
    active = with_fingerprint(both.filter(F.coalesce(F.col("is_active"), F.lit(True))))
    unique = first_per(active, ["prospect_id", "fingerprint"], ["is_new", "id"])
    return top_per(unique, ["prospect_id"], ["is_new", "id"], keep, rank="position")


def upsert_evidence(old: DataFrame, new: DataFrame, per_call: int | None = None) -> DataFrame:
    """Rows to append: new evidence whose fingerprint is not among the prospect's active rows.

    All items are taken unless ``per_call`` says how many a call may bring per prospect.
    """
    if per_call:
        new = top_per(new, ["prospect_id"], ["id"], per_call)
    known = with_fingerprint(old.filter(F.coalesce(F.col("is_active"), F.lit(True)))).select(
        "prospect_id", "fingerprint"
    )
    fresh = first_per(with_fingerprint(new), ["prospect_id", "fingerprint"], ["id"])
    fresh = fresh.join(known.distinct(), ["prospect_id", "fingerprint"], "left_anti")
    return fresh.select(
        "id",
        "prospect_id",
        F.coalesce(filled(F.col("category")), F.lit("structural_fit")).alias("category"),
        F.coalesce(filled(F.col("signal_type")), F.lit("UNKNOWN")).alias("signal_type"),
        text(F.col("label")).alias("label"),
        text(F.col("evidence_text")).alias("evidence_text"),
        "evidence_url",
        "source_type",
        F.coalesce(nonzero(F.col("confidence")), F.lit(50)).cast("int").alias("confidence"),
        F.coalesce(nonzero(F.col("strength")), F.lit(50)).cast("int").alias("strength"),
        F.lit(True).alias("is_active"),
        yes(F.col("manually_confirmed")).alias("manually_confirmed"),
        "fingerprint",
    )


def source_types(signal_sources: Column, has_awards: Column, has_registry_id: Column) -> Column:
    """Independent sources of a prospect: evidence origins, awards, and the id itself when nothing richer exists."""
    empty = F.array().cast("array<string>")
    base = F.coalesce(signal_sources, empty)
    with_awards = F.array_distinct(F.concat(base, F.when(has_awards, F.array(F.lit("decp"))).otherwise(empty)))
    registered = F.array_contains(base, "annuaire") | F.array_contains(base, "sirene")
    extra = F.when(has_registry_id & ~registered, F.array(F.lit("sirene"))).otherwise(empty)
    return F.array_sort(F.concat(with_awards, extra))


def one_scan(keywords: list[str]) -> str:
    """All keywords as one pattern: a character that begins none is passed over at once, and those with one first character stand together."""
    groups: dict[tuple[bool, str], list[str]] = {}
    for word in dict.fromkeys(keywords):
        edge = word.startswith(r"\b")
        bare = word.removeprefix(r"\b")
        groups.setdefault((edge, bare[0]), []).append(bare[1:])
    parts = [(r"\b" if edge else "") + first + "(?:" + "|".join(rest) + ")" for (edge, first), rest in sorted(groups.items())]
    return "(?=[" + "".join(sorted({first for _, first in groups})) + "])(?:" + "|".join(parts) + ")"


def extract_evidence(pages: DataFrame, text_column: str = "text", before: int = 40, after: int = 60) -> DataFrame:
    """One row per page and taxonomy code found on it, with the text around the first hit.

    Keywords are tried in order; the first that occurs anywhere counts.  A text is scanned once for all keywords; only
    those that have one are looked at again, with patterns that are compiled once.
    """
    every = one_scan([word for _, _, _, keywords in fixed.EVIDENCE_TAXONOMY for word in keywords])
    low = F.col("_lower")
    hits = []
    for code, category, label, keywords in fixed.EVIDENCE_TAXONOMY:
        spot = lambda word: F.struct(F.regexp_instr(low, F.lit(word)).alias("start"), F.length(F.regexp_substr(low, F.lit(word))).alias("size"))
        place = first_match([(low.rlike(word), spot(word)) for word in keywords])
        named = F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), F.lit(label).alias("label"), place.alias("at"))
        hits.append(F.when(place.isNotNull(), named))
    found = pages.withColumn("_lower", F.lower(F.col(text_column))).filter(low.rlike(every))
    found = found.select(*pages.columns, F.explode(compact(hits)).alias("hit"))
    start = F.col("hit.at.start") - 1
    first = F.greatest(start - before, F.lit(0))
    snippet = strip(F.substring(F.col(text_column), first + 1, start + F.col("hit.at.size") + after - first))
    return found.select(
        *pages.columns,
        F.col("hit.code").alias("code"),
        F.col("hit.category").alias("category"),
        F.concat(F.lit("["), F.col("hit.label"), F.lit("] Snippet: ..."), snippet, F.lit("...")).alias("evidence_text"),
        F.lit(0.85).alias("confidence"),
    )


def evidence_codes(extracted: DataFrame, key: str) -> DataFrame:
    """The set of taxonomy codes per company; there are only five, so the set is small."""
    return extracted.groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"))
