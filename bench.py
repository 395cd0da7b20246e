"""Time every query once: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the local cores. The stored tables that the serving queries read are
built first; their cost is listed under `setup`, and the queries that compute
them (canonical_telemetry, all_events, drive_metrics) are timed in full.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.derived import store  # noqa: E402
from checks.registry import queries  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wheeltrace-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="wheeltrace-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    setup = {}
    for table in ("telemetry", "events", "metrics"):
        started = time.perf_counter()
        store(spark, sf_dir, table)
        setup[table] = round(time.perf_counter() - started, 3)

    seconds = {}
    for name, query in queries().items():
        started = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "setup": setup,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
