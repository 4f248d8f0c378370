"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    cores (default 8)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")

from pyspark.sql import SparkSession

from checks.queries import REGISTRY

HEADLINE = [
    "tokenize",
    "contamination_matches",
    "contamination_summary",
    "match_details",
    "decontaminate",
    "decontamination_report",
    "verify_clean",
    "convert_training",
    "build_prompts",
    "position_index",
    "stratified_sample",
    "teacher_pairs",
    "sft_examples",
    "batch_complete",
    "prefix_truncate",
    "score_answers",
    "memorization_scores",
    "eval_metrics",
    "flatten_metrics",
    "difficulty_pivot",
    "summary_grid",
]


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    REGISTRY["contamination_summary"](spark, sf_dir).collect()  # start the engine
    seconds = {}
    for name in names:
        start = time.perf_counter()
        # every column of every row is computed, nothing is kept
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf.group(1)) if sf else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
