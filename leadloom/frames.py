"""Frame helpers shared by the operators.

They are written for skew: one key may own a third of all rows.  Ranking
always ends in a filter on the rank, so Spark drops surplus rows of a group
before the shuffle (WindowGroupLimit); grouping uses aggregates that combine
on the map side; nothing builds a list whose length is not bounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[Column | str]


def when_is(as_of: str | date | datetime) -> Column:
    """An ``as_of`` argument as a naive UTC timestamp."""
    if isinstance(as_of, (datetime, date)):
        as_of = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else as_of.isoformat()
    return F.lit(as_of).cast("timestamp_ntz")


def days_before(as_of: str | date | datetime, days: int) -> Column:
    return when_is(as_of) - F.expr(f"INTERVAL '{int(days)}' DAY")


def top_per(df: DataFrame, keys: Sequence[str | Column], order: Order, n: int | None, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every group under a total order; None numbers all of them."""
    position = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(position, F.row_number().over(window))
    kept = kept if n is None else kept.filter(F.col(position) <= n)
    return kept if rank else kept.drop(position)


def first_per(df: DataFrame, keys: Sequence[str | Column], order: Order) -> DataFrame:
    """One row per group: the first under a total order."""
    return top_per(df, keys, order, 1)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over the tasks by the hash of ``keys``, for steps that cost far more a row than a shuffle of it.

    A scan gives a task per row group at most, so a file that is small on disk is else worked on by a few tasks.
    """
    return df.repartition(*keys)


def bounded_list(df: DataFrame, keys: Sequence[str], rank: str, value: Column, into: str) -> DataFrame:
    """Lists of values in rank order; callers rank with ``top_per`` first, which bounds them."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(into))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def left_join_many(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Left join of unique parents to many children that survives a hot parent.

    Adaptive execution can split a hot partition of an inner join on either
    side but not the inner side of an outer join, so parents without children
    are added apart; finding them needs only the distinct child keys.
    """
    matched = parents.join(children, parents[parent_key] == children[child_key])
    keys = children.select(F.col(child_key).alias("_child_key")).distinct()
    lonely = parents.join(keys, parents[parent_key] == F.col("_child_key"), "left_anti")
    return matched.unionByName(lonely, allowMissingColumns=True)


def permille(part: Column, whole: Column) -> Column:
    """1000 · part / whole rounded half-even in integers, 0 for an empty whole."""
    scaled = part.cast("long") * 1000
    remainder = F.pmod(scaled, whole)
    base = ((scaled - remainder) / whole).cast("long")
    up = (remainder * 2 > whole) | ((remainder * 2 == whole) & (F.pmod(base, F.lit(2)) == 1))
    return F.when(whole > 0, base + F.when(up, 1).otherwise(0)).otherwise(F.lit(0).cast("long"))
