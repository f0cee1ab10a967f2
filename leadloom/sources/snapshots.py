"""Snapshot tables: hash-bucketed folders, of which a write replaces the touched ones, and a version that is switched last.

A table folder holds ``data/<write>/bucket=b`` and ``versions/n``, a small JSON file that names the write every bucket is from,
and the schema.  A write reads and rewrites only buckets that hold a changed key, into a folder of its own, and becomes
visible when its version file is created; a run that is lost before that changes nothing, and its folder is never read.  Of two
writes that begin from the same version the later one fails.  Files are reached through Hadoop alone, so any store will do.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256


class VersionTaken(RuntimeError):
    """Another write has become the next version meanwhile."""


@dataclass(frozen=True)
class Version:
    number: int
    key: tuple[str, ...]
    buckets: int
    schema: StructType
    places: dict[int, str]

    def text(self) -> str:
        return json.dumps({"key": self.key, "buckets": self.buckets, "schema": self.schema.json(), "places": self.places})


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, folder: str) -> list[str]:
    store, at = _files(spark, folder)
    return [entry.getPath().getName() for entry in store.listStatus(at)] if store.exists(at) else []


def current(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The newest version of a table, or one of its earlier ones; None where there is no table."""
    found = sorted(int(name) for name in _names(spark, f"{path}/versions") if name.isdigit())
    if number is not None and number not in found:
        raise ValueError(f"no version {number} of {path}")
    if not found:
        return None
    number = found[-1] if number is None else number
    body = spark.read.text(f"{path}/versions/{number}", wholetext=True).first()[0]
    said = json.loads(body)
    return Version(number, tuple(said["key"]), said["buckets"], StructType.fromJson(json.loads(said["schema"])), {int(b): write for b, write in said["places"].items()})


def _switch(spark: SparkSession, path: str, version: Version) -> None:
    """Make a version visible: its file is created whole under its name, or not at all."""
    store, at = _files(spark, f"{path}/versions/{version.number}")
    _, draft = _files(spark, f"{path}/drafts/{version.number}-{uuid.uuid4().hex}")
    out = store.create(draft, True)
    out.write(bytearray(version.text().encode()))
    out.close()
    store.mkdirs(at.getParent())
    if store.exists(at) or not store.rename(draft, at):
        raise VersionTaken(f"version {version.number} of {path} exists already")


def _bucket(key: tuple[str, ...], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: tuple[str, ...], buckets: int) -> dict[int, str]:
    """Rows into a folder of their own; the buckets that have any, and its name."""
    name = uuid.uuid4().hex
    dealt = rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket")
    dealt.write.partitionBy("bucket").parquet(f"{path}/data/{name}")
    return {int(b.split("=")[1]): name for b in _names(rows.sparkSession, f"{path}/data/{name}") if b.startswith("bucket=")}


def _read(spark: SparkSession, path: str, version: Version, only: set[int] | None = None) -> DataFrame:
    paths = [f"{path}/data/{write}/bucket={b}" for b, write in sorted(version.places.items()) if only is None or b in only]
    return spark.read.schema(version.schema).parquet(*paths) if paths else spark.createDataFrame([], version.schema)


def create_table(rows: DataFrame, path: str, key: str | tuple[str, ...], buckets: int = BUCKETS) -> Version:
    """A new table of rows unique by ``key``; a table that exists already is an error."""
    key, spark = (key,) if isinstance(key, str) else tuple(key), rows.sparkSession
    if current(spark, path) is not None:
        raise VersionTaken(f"{path} exists already")
    version = Version(1, key, buckets, rows.schema, _write(rows, path, key, buckets))
    _switch(spark, path, version)
    return version


def read_table(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    version = current(spark, path, number)
    if version is None:
        raise ValueError(f"no table at {path}")
    return _read(spark, path, version)


def merge_rows(path: str, rows: DataFrame, gone: DataFrame | None = None) -> tuple[Version, set[int]]:
    """The next version with ``rows`` in place of those with their keys, and without the keys of ``gone``.

    ``rows`` are unique by the table's key and have its columns.  Gives the version and the buckets it rewrote; without
    rows the version stays.
    """
    spark = rows.sparkSession
    version = current(spark, path)
    if version is None:
        raise ValueError(f"no table at {path}")
    key = list(version.key)
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in version.schema])
    keys = rows.select(*key) if gone is None else rows.select(*key).unionByName(gone.select(*key))
    touched = {r[0] for r in keys.select(_bucket(version.key, version.buckets)).distinct().collect()}  # at most as many as buckets
    if not touched:
        return version, set()
    kept = _read(spark, path, version, touched).join(keys, key, "left_anti").select(*version.schema.names)
    written = _write(kept.unionByName(rows), path, version.key, version.buckets)
    places = {b: write for b, write in version.places.items() if b not in touched} | written
    after = Version(version.number + 1, version.key, version.buckets, version.schema, places)
    _switch(spark, path, after)
    return after, touched
