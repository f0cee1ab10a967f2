"""Exact duplicates by progressive refinement.

A text is compared by its length, then by a hash of its beginning, and only texts that share both with another text
are read in full for SHA-256.  The two cheap levels are one map-side combined count.  Which rows survive them is told
to the second scan by a bitmap-like set of at most ``2**20`` bucket numbers, so its size is bounded whatever the input:
no text is ever shuffled, and a full bucket set only means more hashing, never another result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import id_and_text, row_key, sha
from leadloom.session import stage

BUCKETS = 1 << 20


def _bucket() -> Column:
    return F.pmod(F.xxhash64("length", "prefix"), F.lit(BUCKETS)).cast("int")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, hash_all: bool = False
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, sha256`` (binary, null for texts no other row shares).

    Texts are equal when identical; null counts as empty.  The largest id of a group stays; of rows that repeat both
    id and text one is kept.  A null id never beats another id; a group of null ids keeps one of them.  An empty
    table gives no rows, extra columns are ignored.  ``hash_all`` also hashes the texts that dropped out early.
    """
    rows = id_and_text(docs, id_col, text_col)
    rows = rows.withColumns({"length": F.octet_length("text"), "prefix": F.xxhash64(F.substring("text", 1, prefix_chars))})
    shared = rows.groupBy("length", "prefix").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = shared.select(_bucket().alias("bucket")).distinct().withColumn("suspect", F.lit(True))
    marked = rows.withColumn("bucket", _bucket()).join(F.broadcast(buckets), "bucket", "left")
    suspect = F.col("suspect").isNotNull()
    full = sha(F.col("text"))
    hashed = stage(marked.select("id", suspect.alias("suspect"), (full if hash_all else F.when(suspect, full)).alias("sha256")), "exact")

    # repeated ids first, so a hot group reaches the next step as one row per id
    members = stage(hashed.filter("suspect").groupBy("sha256", "id").agg(F.count("*").alias("times")), "exact-members")
    groups = stage(members.groupBy("sha256").agg(F.max("id").alias("keep_id"), F.sum("times").alias("group_size")), "exact-groups")
    joined = members.join(groups, "sha256").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    stays = (F.col("copy") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))
    repeated = joined.select("id", "keep_id", "group_size", stays.alias("kept"), "sha256")
    alone = hashed.filter("NOT suspect").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha256"
    )
    return repeated.unionByName(alone)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text, any one.

    Decisions travel as a hash of id and text; each row's text is shuffled once, by that hash.
    """
    groups = exact_groups(docs, id_col, text_col, hash_all=True)
    stay = groups.filter("kept").select(row_key(F.col("id"), F.hex("sha256")).alias("_key"))
    keyed = docs.withColumn("_key", row_key(F.col(f"`{id_col}`"), F.hex(sha(F.col(f"`{text_col}`")))))
    return keyed.join(stay, "_key", "left_semi").dropDuplicates(["_key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
