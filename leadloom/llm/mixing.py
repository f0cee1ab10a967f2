"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight; sorted by key within its source, documents fill
the source's word budget.  A budget larger than the source takes whole epochs first and fills the rest by key.

The sort is cut into key buckets: one combined aggregate gives words per source and bucket, prefix sums over that
small table find the bucket in which a budget ends, and only the documents of that bucket are sorted.  A source with
a third of all documents is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import row_key, sha, word_count
from leadloom.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
KEY_BUCKETS = 4096


def quality_weight(text: Column) -> Column:
    """1 for plain prose, less the more symbols and digits a text holds, 1/16 at least."""
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[0-9#*$%&|<>]+", ""))
    return F.when(F.length(text) > 0, F.greatest(F.lit(0.0625), 1 - 4 * odd / F.length(text))).otherwise(F.lit(1.0))


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of an MD5, the same on every run and engine."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from one row per source.

    Sources in code-point order, null last, take the weights in turn and divide ``share`` of all words by them.  A
    target above ``most`` times its source stops there and the excess is shared anew by weight: in order of
    size per weight, a source is full exactly when its share, after all fuller ones are served, still exceeds it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    weighed = weighed.withColumn("most", most * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(whole) * share
    rest_words = total - F.coalesce(F.sum("most").over(earlier), F.lit(0))
    rest_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    full = weighed.withColumns({"total": total, "full": rest_words * F.col("weight") >= F.col("most") * rest_weight})
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    open_words = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(whole), F.lit(0))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(open_words * F.col("weight") / open_weight)
    return full.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED,
) -> DataFrame:
    """One row per input row: ``id, text_sha, size, source, source_size, target, epochs, taken``; ``taken`` counts repeats.

    ``epochs`` is how often a document enters the mix.  Whole epochs come first; then documents enter by key while the
    middle of their words lies within the rest of the budget, so a source misses its target by at most half a document.
    Null sources form one source, the last; null or empty texts have size 0 and enter with whole epochs only.  Rows that
    repeat id and text draw the same key and may enter in either order.  Reruns agree; an empty table gives no rows.
    """
    text = F.col(f"`{text_col}`")
    read = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.coalesce(text, F.lit("")).alias("text")
    )
    drawn = read.withColumns({"size": word_count(F.col("text")), "text_sha": F.sha2("text", 256)})
    key = -F.log(uniform(F.lit(seed), F.col("id"), F.col("text_sha"))) / quality_weight(F.col("text"))
    bucket = F.least(F.floor((1 - F.exp(-F.col("key"))) * KEY_BUCKETS), F.lit(KEY_BUCKETS - 1)).cast("int")
    rows = drawn.select("id", "source", F.unhex("text_sha").alias("text_sha"), "size", key.alias("key")).withColumn("bucket", bucket)
    rows = stage(rows, "mix")

    sums = stage(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = stage(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("upto", F.sum("words").over(upto)).join(budgets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    # the bucket in which the rest of the budget ends, and the words of the source before it
    cut = ends.filter("upto >= rest").groupBy("of", "source_size", "target", "whole", "rest").agg(
        F.min("bucket").alias("cut"), F.min_by(F.col("upto") - F.col("words"), F.col("bucket")).alias("before")
    )
    cut = stage(cut, "mix-cuts")
    placed = rows.join(cut, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    sure = placed.filter("bucket <> cut").withColumn("epochs", F.col("whole") + F.when(F.col("bucket") < F.col("cut"), 1).otherwise(0))
    run = Window.partitionBy("source").orderBy("key", "id", "text_sha").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0))
    enters = (F.col("size") > 0) & (2 * ahead + F.col("size") <= 2 * F.col("rest"))
    edge = placed.filter("bucket = cut").withColumn("epochs", F.col("whole") + F.when(enters, 1).otherwise(0))
    columns = ("id", "text_sha", "size", "source", "source_size", "target", "epochs")
    every = sure.select(*columns).unionByName(edge.select(*columns))
    return every.withColumn("taken", F.col("epochs") * F.col("size"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, repeated as often as they enter."""
    decided = mix(docs, id_col, text_col, source_col, **settings).filter("epochs > 0")
    key = lambda *parts: row_key(*parts[:2], F.hex(parts[2])).alias("_key")
    # rows that repeat id, source and text appear as often as all of them enter
    times = decided.groupBy(key(F.col("id"), F.col("source"), F.col("text_sha"))).agg(F.sum("epochs").alias("_mix_times"))
    keyed = docs.withColumn("_key", key(F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), sha(F.col(f"`{text_col}`"))))
    joined = keyed.dropDuplicates(["_key"]).join(times, "_key")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_times")))
    return joined.withColumn("_mix_copy", copies).select(*[F.col(f"`{c}`") for c in docs.columns])
