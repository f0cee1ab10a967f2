"""Company lists as CSV: validated import and the looser list adapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions.rules import failures, filled, first_match, yes
from leadloom.functions.text import strip
from leadloom.session import stage

CSV_COLUMNS = ("company_name", "sector", "company_size", "signal_type", "signal_details", "decision_maker_name",
               "decision_maker_title", "linkedin_url", "email", "phone", "website", "data_source", "source", "notes")
REQUIRED = ("company_name", "sector", "company_size", "signal_type", "data_source", "source")
MAX_LENGTH = {"company_name": 200, "decision_maker_name": 150, "decision_maker_title": 150, "linkedin_url": 300,
              "email": 150, "phone": 50, "website": 300, "data_source": 200}
CHOICES = {"sector": fixed.SECTORS, "company_size": fixed.COMPANY_SIZES, "signal_type": fixed.SIGNAL_TYPES,
           "source": fixed.SOURCES}


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text.

    With ``multi_line`` quoted fields may span lines; each file is then one task, else large files are split.
    """
    reader = spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line)
    return reader.option("escape", '"').csv(path)


def with_line_numbers(df: DataFrame, first: int = 2) -> DataFrame:
    """Add ``row``: the record's number in its file, the header being line 1.

    Rows are counted per file block first; a block's start is the running sum of
    the counts before it.  Only one small row per block is ever ordered, so any
    number of rows is numbered without collecting them.  The tagged rows are
    staged, so both uses see the same blocks.
    """
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_order"),
    )
    tagged = stage(tagged, "csv-rows")
    blocks = tagged.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = tagged.join(starts, ["_file", "_block"])
    number = (F.col("_start") + F.col("_order") - F.col("_first") + first).cast("long")
    return joined.withColumn("row", number).drop("_file", "_block", "_order", "_first", "_start")


def field_errors() -> Column:
    rules = []
    for name in REQUIRED:
        rules.append((F.col(name).isNull(), f"{name}: Field required"))
    for name, size in MAX_LENGTH.items():
        rules.append((yes(F.length(name) > size), f"{name}: String should have at most {size} characters"))
    for name, choices in CHOICES.items():
        allowed = "(" + ", ".join(f"'{choice}'" for choice in choices) + ")"
        rules.append((yes(~F.col(name).isin(*choices)), f"{name}: Value error, {name} must be one of {allowed}"))
    return failures(rules)


def validate_rows(raw: DataFrame) -> DataFrame:
    """The fourteen known columns, trimmed, blanks as NULL, with ``errors`` (empty for good rows)."""
    cleaned = {name.strip().lower().replace(" ", "_"): name for name in reversed(raw.columns)}
    columns = [
        (filled(strip(F.col(f"`{cleaned[name]}`"))) if name in cleaned else F.lit(None).cast("string")).alias(name)
        for name in CSV_COLUMNS
    ]
    kept = [F.col("row")] if "row" in raw.columns else []
    return raw.select(*kept, *columns).withColumn("errors", field_errors())


def import_csv(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with line number and errors)."""
    rows = validate_rows(with_line_numbers(read_csv(spark, path, multi_line)))
    good = rows.filter(F.size("errors") == 0).drop("errors")
    return good, rows.filter(F.size("errors") > 0).select("row", "errors")


def _first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    present = [filled(F.col(f"`{name}`").cast("string")) for name in names if name in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def normalize_csv(df: DataFrame) -> DataFrame:
    """A list row as a company observation; several header spellings are understood."""
    number = _first_of(df, ("Company Number", "companies_house_number"))
    siren = _first_of(df, ("SIREN", "siren"))
    external = F.coalesce(
        _first_of(df, ("id", "Company Number", "SIREN")),
        F.concat(F.lit("csv_"), F.col("row").cast("string")) if "row" in df.columns else F.lit(None),
    )
    return df.select(
        F.lit("csv_import").alias("connector_code"),
        external.alias("external_id"),
        F.coalesce(
            _first_of(df, ("Company Name", "company_name", "Company", "Nom")), F.lit("Imported Entity")
        ).alias("company_name"),
        F.substring(F.upper(F.coalesce(_first_of(df, ("Country", "country_code")), F.lit("GB"))), 1, 2).alias("country_code"),
        first_match([(number.isNotNull(), "companies_house_number"), (siren.isNotNull(), "siren")]).alias("identifier_scheme"),
        F.coalesce(number, siren).alias("identifier_value"),
        _first_of(df, ("Website", "domain", "Site")).alias("domain"),
        _first_of(df, ("Full Name", "Contact Name")).alias("officer_name"),
        _first_of(df, ("Title", "Job Title")).alias("officer_title"),
    )


