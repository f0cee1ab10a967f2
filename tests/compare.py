"""Run registered queries beside their SQL and compare names, types and values.

``python tests/compare.py <folder> [name …]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from leadloom import catalog, session
from leadloom.standins import DRIVER_TABLES

KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(rows, order) -> list[tuple[str, ...]]:
    def show(value) -> str:
        if value is None:
            return "\0"
        if isinstance(value, float):
            return repr(round(value, 9))
        return str(value)

    return sorted(tuple(show(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, name: str) -> tuple[bool | None, str]:
    """(equal or None without an oracle, a short report)."""
    entry = catalog.load()[name]
    started = time.time()
    df = catalog.runner(name)(spark, folder)
    rows = df.collect()
    took = time.time() - started
    if entry.oracle is None:
        return None, f"{len(rows)} rows, no SQL ({took:.1f} s)"
    result = con.execute(entry.oracle)
    theirs = result.fetchall()
    columns, kinds = [d[0] for d in result.description], [str(d[1]) for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    wanted = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    odd = [f"{c}: {wanted[c]} != {k}" for c, k in zip(columns, kinds) if wanted[c] != k]
    names = sorted(columns)
    mine = canonical(rows, [df.columns.index(c) for c in names])
    other = canonical(theirs, [columns.index(c) for c in names])
    note = f"{len(mine)} rows ({took:.1f} s)" + (f" TYPES {odd}" if odd else "")
    if mine == other:
        return not odd, note
    left, right = sorted(set(mine) - set(other))[:2], sorted(set(other) - set(mine))[:2]
    return False, f"{len(mine)} vs {len(other)} rows {names}\n   only Spark {left}\n   only SQL   {right} {odd}"


def main(folder: str, names: list[str]) -> int:
    spark = session.build(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(folder), 0
    for name in catalog.load():
        if names and not any(name == n or name.split("_")[0] == n for n in names):
            continue
        try:
            equal, note = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001 - a report line per query
            equal, note = False, f"ERROR {str(error)[:700]}"
        bad += equal is False
        print({True: "ok  ", False: "BAD ", None: "rows"}[equal], name, note, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
