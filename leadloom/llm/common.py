"""Column helpers the operators share.

Operators read an id and a text column by name and rename both at once, so extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, and words: fixed by the contracts.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``text``; a null text reads as empty."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.array_remove(F.split(text, GAP), "")


def word_count(text: Column) -> Column:
    """Number of words, without building them: what is left when every word becomes one letter."""
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "w"), GAP, "")).cast("long")


def sha(text: Column) -> Column:
    """SHA-256 of a whole text as bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def row_key(*parts: Column) -> Column:
    """One plain key for several values, nulls kept apart: joins on it need no null-safe comparison."""
    shown = [F.when(p.isNull(), "-").otherwise(F.concat(F.lit("+"), p.cast("string"))) for p in parts]
    return F.sha2(F.to_json(F.array(*shown)), 256)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so a task holds the Python objects of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_blocks(rows: DataFrame, key: str, size: int, weight: str = "n") -> Iterator[DataFrame]:
    """A set of queries cut into blocks by ``key``, each of at most about ``size`` in ``weight`` or a single row: a bound for what is sent to tasks."""
    blocks = -(-(rows.agg(F.sum(weight)).first()[0] or 0) // size)
    dealt = rows
    while blocks:
        dealt = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
        over = dealt.groupBy("_block").agg(F.sum(weight).alias("n"), F.count("*").alias("rows")).filter((F.col("n") > size) & (F.col("rows") > 1))
        if over.isEmpty():
            break
        blocks *= 2
    for block in range(blocks):
        yield dealt.filter(F.col("_block") == block).drop("_block")
