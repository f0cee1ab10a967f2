"""Personal data: fixed patterns, and a bootstrapped search for identifiers they do not know.

Identifiers found by the fixed patterns are seeds.  Every identifier-like mention, seed or not, has lexical patterns: the
two words before it, and the words on both sides.  Patterns and mentions form a graph; in turn a pattern is as good as the
mentions it meets, and a mention as good as its patterns, in the sense of a noisy or.  Mentions that good patterns, backed
by several different seeds, meet become spans.

Everything is column expressions.  The texts are read once into narrow rows; graph rounds are combined sums and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import row_key, sha
from leadloom.session import stage

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. Possessive repeats and the look-behinds change no match: they only spare Java recursion and
# repeated attempts inside one run of letters or digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: What an unknown identifier may look like: something at something, a run of digits with separators, letters with digits.
MENTION = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]*[A-Za-z0-9]|[+(]?[0-9](?:[ ().-]{0,2}[0-9]){5,}+|(?<![A-Za-z0-9])[A-Za-z]{1,3}[0-9][A-Za-z0-9-]{4,}+"
ROUNDS = 3
GOOD = 0.8
SMOOTH = 1.0
MIN_SEEDS = 3
CONTEXT = 60

SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _located(text: Column, pattern: str, kind: Column, ok) -> Column:
    """Spans of all matches in order; ``ok`` decides on a match's text.

    Splitting gives the text between matches, so a match starts after all pieces and matches before it.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    pairs = F.zip_with(found, between, lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["m"])
        span = F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), pair["m"].alias("value"))
        return F.struct(end.alias("at"), F.when(ok(pair["m"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    matches = F.filter(pairs, lambda p: p["m"].isNotNull())  # the piece after the last match has none
    return F.when(F.size(found) > 0, F.aggregate(matches, empty, step, lambda s: s["spans"])).otherwise(empty["spans"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


ACCEPT = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & F.when(F.length(_digits(m)).between(16, 19), F.call_function("luhn_check", _digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by kind as listed, then start."""
    need = {"email": "%@%", "ip": "%.%", "card": None, "phone": "%+%"}
    none = F.array().cast(f"array<{SPAN}>")
    parts = []
    for kind in KINDS:
        spans = _located(text, PATTERNS[kind], F.lit(kind), ACCEPT[kind])
        parts.append(F.when(text.like(need[kind]), spans).otherwise(none) if need[kind] else spans)
    return F.concat(*parts)


def _context(text: Column, span: Column) -> Column:
    """The lexical patterns of a mention: words without case and marks, at most ``CONTEXT`` code points away."""
    low = lambda part: F.lower(F.regexp_replace(part, r"[^\p{L}\p{N}\s]+", ""))
    start = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = low(F.substring(text, start + 1, span["start"] - start))
    after = low(F.substring(text, span["end"] + 1, F.lit(CONTEXT)))
    two = F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1)
    one, following = F.regexp_extract(before, r"(\S+)\s*$", 1), F.regexp_extract(after, r"^\s*(\S+)", 1)
    return F.filter(
        F.array(
            F.when(two != "", F.concat(F.lit("before "), F.regexp_replace(two, r"\s+", " "))),
            F.when((one != "") & (following != ""), F.concat(F.lit("around "), one, F.lit(" _ "), following)),
        ),
        lambda p: p.isNotNull(),
    )


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, id, base, mentions`` per row; a mention adds its patterns to a span and has no kind unless it is a seed."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    based = read.select("id", "text", base_spans(F.col("text")).alias("base"))
    loose = based.select("id", "text", "base", F.when(F.col("text").rlike("[0-9@]"), _located(F.col("text"), MENTION, F.lit(None).cast("string"), lambda m: F.lit(True)))
                         .otherwise(F.array().cast(f"array<{SPAN}>")).alias("loose"))
    free = F.filter("loose", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    both = loose.select("id", "text", "base", F.concat("base", free).alias("found"))
    told = F.transform("found", lambda s: F.struct(s.alias("span"), _context(F.col("text"), s).alias("patterns")))
    return both.select(row_key(F.col("id"), F.hex(sha(F.col("text")))).alias("key"), "id", "base", told.alias("mentions"))


def _scores(edges: DataFrame, rounds: int, smooth: float) -> tuple[DataFrame, DataFrame]:
    """Pattern scores and mention scores per kind after so many rounds over the graph."""
    seeds = edges.filter(F.col("seed").isNotNull()).select("pattern", F.col("seed").alias("kind")).distinct()
    # a pattern is scored for the kinds of its seeds only
    used = stage(edges.join(stage(seeds, "pii-patterns"), "pattern").select("pattern", "kind", "value", "seed", "times"), "pii-graph")
    known = F.when(F.col("seed") == F.col("kind"), 1.0).when(F.col("seed").isNotNull(), 0.0)
    belief = used.select("kind", "value").distinct().withColumn("belief", F.lit(0.0))
    patterns = None
    for _ in range(rounds):
        joined = used.join(belief, ["kind", "value"])
        patterns = joined.groupBy("pattern", "kind").agg(
            (F.sum(F.coalesce(known, F.col("belief")) * F.col("times")) / (F.sum("times") + smooth)).alias("score"),
            F.approx_count_distinct(F.when(known == 1.0, F.col("value"))).alias("seeds"),
        )
        patterns = stage(patterns, "pii-pattern-scores")
        miss = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999))))
        strong = used.join(patterns.filter(F.col("seeds") >= MIN_SEEDS), ["pattern", "kind"])
        found = strong.select("kind", "value", "pattern", "score").distinct().groupBy("kind", "value").agg((1 - F.exp(miss)).alias("found"))
        belief = used.select("kind", "value").distinct().join(found, ["kind", "value"], "left").select("kind", "value", F.coalesce("found", F.lit(0.0)).alias("belief"))
        belief = stage(belief, "pii-mention-scores")
    return patterns, belief


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, good: float = GOOD, min_seeds: int = MIN_SEEDS, smooth: float = SMOOTH
) -> DataFrame:
    """One row per input row: ``id, base, spans``; spans by kind as listed, then start, in code points, end exclusive.

    ``spans`` are the base spans and the discovered ones, which touch no base span and carry the kind of their patterns.
    Null counts as empty and has no spans; texts are read whole; repeated rows get equal spans; an empty table gives none.
    """
    rows = stage(mentions(docs, id_col, text_col), "pii-rows")
    each = rows.select("key", F.explode("mentions").alias("m")).select("key", "m.span", F.explode("m.patterns").alias("pattern"))
    each = each.select("key", "span", "pattern", F.lower("span.value").alias("value"))
    edges = stage(each.groupBy("pattern", "value", F.col("span.kind").alias("seed")).agg(F.count("*").alias("times")), "pii-edges")
    patterns, belief = _scores(edges, rounds, smooth)
    strong = stage(patterns.filter((F.col("score") >= good) & (F.col("seeds") >= min_seeds)), "pii-strong")
    sure = stage(belief.filter(F.col("belief") >= good), "pii-sure")
    fresh = each.filter("span.kind IS NULL").join(strong, "pattern").join(sure, ["kind", "value"])
    best = fresh.groupBy("key", "span.start", "span.end").agg(F.max_by(F.struct("kind", "span.value"), F.struct("score", "kind")).alias("b"))
    added = best.groupBy("key").agg(F.collect_list(F.struct(F.col("b.kind").alias("kind"), "start", "end", F.col("b.value").alias("value"))).alias("added"))
    every = F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))
    place = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.sort_array(F.transform(every, lambda s: F.struct(F.array_position(place, s["kind"]).alias("rank"), s["start"].alias("start"), s.alias("span"))))
    joined = rows.select("key", "id", "base").join(stage(added, "pii-added"), "key", "left")
    return joined.select("id", "base", F.transform(ranked, lambda r: r["span"]).alias("spans"))
