"""Time the headline queries on the tables in $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quire.plans.registry import queries

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

# Compiles the plans before anything is timed, on small tables if there are any.
WARM = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(FOLDER.rstrip("/")), "sf0.001"))

HEADLINE = [
    "chunk_documents",
    "top_k",
    "ask_extractive",
    "dense_top_k",
    "scan_extractive",
    "phrase_hits",
    "leak_verdict",
    "blocks",
    "merge_docs",
    "split_at",
    "delete_pages",
    "unique_names",
    "apply_fill",
    "keep_smaller",
    "traffic",
    "latest_versions",
    "stream_ingest",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    known = queries()
    times: dict[str, float] = {}
    wanted = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    for name in wanted:
        taken = []
        if os.path.isdir(WARM):
            known[name](spark, WARM).write.format("noop").mode("overwrite").save()
        for _ in range(REPEATS):
            begin = time.perf_counter()
            known[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
