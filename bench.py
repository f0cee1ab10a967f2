"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default: all)
choose data and cores.  Each query runs once to warm up the JVM's code and once
for the clock; results are written to the no-op sink, so every row is computed
and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from leadloom import catalog, session

HEADLINE = (
    "a1_awards_by_holder", "a3_headline_metrics", "w1_current_status", "w3_action_queue", "p1_relevant_awards", "p9_evidence_normalised",
    "p12_event_gate", "j2_suppression_check", "j3_identity_resolution", "j9_person_mailbox", "u2_award_history", "u3_evidence_upsert",
    "u5b_upsert_snapshot", "u6_people_merge", "u7_point_merge", "w6_page_selection", "f1_strip_accents", "f24_page_evidence",
    "h2_contact_facts", "d1_recompute", "d11_retention", "d13_contact_waterfall", "d15_award_ingest", "d7_contact_discovery", "s12_dossiers",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session.build(
        "leadloom-bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")},
    )
    spark.sparkContext.setLogLevel("OFF")
    catalog.load()
    run = lambda name: catalog.runner(name)(spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        run(name)
        started = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - started, 3)
    line = {"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus)}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
