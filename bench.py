"""Time the registered queries, after one untimed query: one JSON line on stdout.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated keys) choose the
data, the cores and the queries.
"""

from __future__ import annotations

import json
import os
import time

from checks.queries import QUERIES
from hiregrid.session import build_session

WARM_UP = "candidate_details"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k] or list(QUERIES)
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.log.level": "ERROR",
           "spark.ui.showConsoleProgress": "false"},
    )
    QUERIES[WARM_UP](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in chosen:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
