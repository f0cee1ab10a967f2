"""List plan features worth a look: ``python tests/plans.py <folder>``.

Prints queries whose initial physical plan holds a nested-loop or Cartesian
join, a single-partition exchange, or Python.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from leadloom import catalog, session

MARKS = ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "ArrowEvalPython", "BatchEvalPython", "MapInPandas")


def main(folder: str) -> None:
    spark = session.build(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    for name in catalog.load():
        if name.startswith(("t", "d7")):
            continue
        plan = catalog.runner(name)(spark, folder)._jdf.queryExecution().executedPlan().toString()
        found = [f"{mark} x{plan.count(mark)}" for mark in MARKS if mark in plan]
        if found:
            print(name, ", ".join(found), flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
