"""Small helpers that keep ordered business rules readable as lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """Fold ``(condition, value)`` pairs into one CASE; the first true condition wins."""
    chain = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if chain is None else chain.otherwise(default)


def filled(column: Column) -> Column:
    """NULL for an empty string, the value otherwise."""
    return F.when(column != "", column)


def is_filled(column: Column) -> Column:
    """True when a text is neither NULL nor empty; never NULL."""
    return F.coalesce(column != "", F.lit(False))


def nonzero(column: Column) -> Column:
    """NULL for zero, the value otherwise."""
    return F.when(column != 0, column)


def text(column: Column) -> Column:
    """Empty string for NULL."""
    return F.coalesce(column, F.lit(""))


def yes(column: Column) -> Column:
    """False for NULL."""
    return F.coalesce(column, F.lit(False))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(column: Column, terms: Iterable[str]) -> Column:
    """True when any literal term occurs in the column."""
    return any_of([column.contains(term) for term in terms])


def quoted(term: str) -> str:
    """A literal as a Java regular expression."""
    special = set("\\^$.|?*+()[]{}-")
    return "".join("\\" + ch if ch in special else ch for ch in term)


def literal_pattern(terms: Iterable[str]) -> str:
    """One alternation matching any of the literal terms."""
    return "|".join(quoted(term) for term in terms)


def compact(items: Sequence[Column]) -> Column:
    """An array of the non-NULL items in order."""
    return F.array_compact(F.array(*items))


def failures(rules: Iterable[tuple[Column, object]]) -> Column:
    """The labels of all true conditions, in order."""
    return compact([F.when(condition, label if isinstance(label, Column) else F.lit(label)) for condition, label in rules])


def python_slice(column: Column, length: int) -> Column:
    """The first ``length`` characters."""
    return F.substring(column, 1, length)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    Keeps expression trees small where a costly value is needed many times.
    It is a higher-order function, which Spark interprets; jobs that run over
    large tables add the value as a column of its own instead.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
