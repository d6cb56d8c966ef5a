"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the list below).
"""

from __future__ import annotations

import json
import os
import time

from tidemark.catalog import QUERIES
from tidemark.session import build_session

HEADLINE = [
    "time_histogram", "fare_histogram", "percentiles_long", "percentiles_raw", "histogram_two_grain", "car_summary",
    "car_thin_cells", "unit_ratio_guard", "month_ingest", "convolve_pair", "convolve_four_legs", "segment_leg_summary",
    "journeys_best", "mode_comparison", "default_zone", "quintile_shade", "cohort_medians", "company_profile",
    "hour_profile", "point_in_zone", "nearest_zone", "zone_path", "simplify_rings", "stream_histogram",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "tidemark-bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
