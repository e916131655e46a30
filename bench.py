"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores (default 8).
All queries are run once to warm up, then each is timed, written to a no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sigspark.registry import QUERIES

HEADLINE = (
    "e7_index", "d1_moments", "e1_crossing", "e2_snap_peaks", "e3_minmax", "e8_rr_intervals",
    "c3_hold_asof", "c4_beat_expand", "f3_decimate", "d4_dft", "k5_dft_fast", "k1_plan_dataset",
    "k2_surrogate", "k3_annotate", "k4_hrv_features",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("sigspark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in HEADLINE:
        run(name)
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline queries, warm", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
