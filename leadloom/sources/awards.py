"""Award notices: column aliases, tolerant types, date pushdown."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType

from leadloom.fixed import AWARD_ALIASES
from leadloom.frames import when_is

_ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def resolve_aliases(columns: list[str]) -> dict[str, str]:
    """Logical name to actual column: per alias the exact spelling, then any case."""
    by_lower = {name.lower(): name for name in columns}
    found = {}
    for logical, aliases in AWARD_ALIASES.items():
        for alias in aliases:
            actual = alias if alias in columns else by_lower.get(alias.lower())
            if actual:
                found[logical] = actual
                break
    return found


def parse_award_date(column: Column) -> Column:
    """ISO date or date-time, NULL for anything else."""
    return F.when(column.rlike(_ISO_DATE), column.try_cast("timestamp").cast("timestamp_ntz"))


def normalise_awards(raw: DataFrame, since: str | date | datetime | None = None) -> DataFrame:
    """The eight logical columns; missing ones are NULL, amounts double, the rest text.

    ``since`` becomes a predicate on the stored date column, which the parquet
    reader can use; the exact test on the parsed date stays with the filter.
    """
    found = resolve_aliases(raw.columns)
    if since is not None and "dateAttribution" in found:
        stored = found["dateAttribution"]
        if isinstance(raw.schema[stored].dataType, (DateType, TimestampType, TimestampNTZType)):
            raw = raw.filter(F.col(stored) >= when_is(since))
        else:  # text may carry an offset of up to a day, so the stored day may lie before the day in UTC
            day = date.fromisoformat(since[:10]) if isinstance(since, str) else since
            raw = raw.filter(F.col(stored) >= (day - timedelta(days=1)).strftime("%Y-%m-%d"))
    columns = []
    for logical in AWARD_ALIASES:
        kind = "double" if logical == "montant" else "string"
        source = F.col(f"`{found[logical]}`").try_cast(kind) if logical in found else F.lit(None).cast(kind)
        columns.append(source.alias(logical))
    return raw.select(*columns)


def deliveries(spark: SparkSession, path: str) -> list[tuple[StructType, list[str]]]:
    """The parquet files below a path, together where their headers agree.

    A file is a delivery of its own; the part files of one write stand in a folder and share a header, so only one of
    them is opened.
    """
    files = spark.read.option("recursiveFileLookup", "true").parquet(path).inputFiles()
    units = {name.rsplit("/", 1)[0] if name.rsplit("/", 1)[1].startswith("part-") else name for name in files}
    found: dict[str, tuple[StructType, list[str]]] = {}
    for unit in sorted(units):
        schema = spark.read.parquet(unit).schema
        found.setdefault(schema.json(), (schema, []))[1].append(unit)
    return list(found.values())


def read_awards(spark: SparkSession, path: str, since: str | date | datetime | None = None) -> DataFrame:
    """Award notices of all files below a path: each file's columns are found by its own header, and ``since`` reaches every scan."""
    out = None
    for schema, units in deliveries(spark, path):
        rows = normalise_awards(spark.read.schema(schema).parquet(*units), since)
        out = rows if out is None else out.unionByName(rows)
    return out
