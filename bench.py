"""Time the headline queries: prints one JSON line.

``store_logs`` writes the log table that the others read; the CSV files are written before, outside the timed part. Each
other query runs once to warm up and then three times; the median counts.
``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the number of cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "ip_risk",
    "ip_profile",
    "ip_records",
    "ip_dst_ports",
    "dashboard_cube",
    "protocol_dist",
    "top_src_ips",
    "filter_logs",
    "keyword_search",
    "keyword_search_batch",
    "normalize_csv",
    "vector_records",
    "replace_source",
    "embed_messages",
    "knn_search",
    "knn_search_cells",
    "knn_lsh",
    "compare_search",
    "parse_reports",
]
RUNS = 3


def main() -> None:
    from flowlog.plans.registry import QUERIES, use_stored_logs, write_uploads

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # as in daily use, records are stored once and then queried
    use_stored_logs(spark, sf_dir)
    start = time.perf_counter()
    use_stored_logs(spark, sf_dir)
    seconds = {"store_logs": round(time.perf_counter() - start, 3)}
    write_uploads(spark, sf_dir)
    for name in sys.argv[1:] or HEADLINE:
        took = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median warm runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
