"""The registered queries: each runs an operator over whole tables, most beside an independent SQL statement of its rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

from leadloom.session import use_utc
from leadloom.standins import Tables, with_views


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    oracle: str | None


REGISTERED: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, whole: str = ""):
    """Register a query.  ``whole`` names the oracle's integer columns, compared as BIGINT."""

    def register(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        text = with_views(oracle) if oracle else None
        if text and whole:
            casts = ", ".join(f"CAST({column} AS BIGINT) AS {column}" for column in whole.split())
            text = f"SELECT * REPLACE ({casts}) FROM ({text}) whole_numbers"
        REGISTERED[name] = Query(run, text)
        return run

    return register


def _long_integers(df: DataFrame) -> DataFrame:
    small = [f.name for f in df.schema if isinstance(f.dataType, (ByteType, ShortType, IntegerType))]
    return df.withColumns({name: F.col(name).cast("long") for name in small}) if small else df


def load() -> dict[str, Query]:
    """All registered queries."""
    from leadloom.catalog import activity, contacts, functions, gates, identity, jobs, merges, reports, rescored, scores, scans  # noqa: F401

    return REGISTERED


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _long_integers(REGISTERED[name].run(Tables(use_utc(spark), folder)))

    return run


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def sql_regex(values) -> str:
    """Literal terms as one RE2 alternation inside an SQL string."""
    special = set("\\^$.|?*+()[]{}")
    return "|".join("".join("\\" + c if c in special else c for c in v) for v in values).replace("'", "''")
