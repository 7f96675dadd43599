"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one JSON line.

Every query is written to the ``noop`` sink; after one warm-up run the median of three runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from gleanflow.plans.queries import QUERIES

# Query and the table whose rows it works through.
HEADLINE = {
    "page_text": "pages",
    "web_captures": "pages",
    "changed_files": "documents",
    "checkpoint_next": "documents",
    "enqueue": "documents",
    "outbox_state": "events",
    "outbox_summary": "events",
    "sync_limit": "documents",
    "frontmatter_leaves": "documents",
    "config_errors": "events",
    "capture_rejects": "events",
    "repo_captures": "documents",
}
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(HEADLINE)
    seconds, rates = {}, {}
    for name in names:
        times = []
        for attempt in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        if name in HEADLINE:
            rows = spark.read.parquet(f"{sf_dir}/{HEADLINE[name]}.parquet").count()
            rates[name] = round(rows / seconds[name])
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
