"""Time the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "src03_target_hourly_file",
    "dq01_keep_last_by_time",
    "spc05_regrid",
    "spc09_band_values",
    "aln02_exact_lead",
    "aln04_six_hour_blocks",
    "blk01_month_thresholds",
    "agg01_right_closed_hour",
    "rnk02_budgets",
    "evl02_regression_scores",
    "evl04_average_precision",
    "evl08_paired_gain",
    "evl08_paired_gain_ridge",
    "mdl05_penalty_sweep",
    "bst01_date_blocks",
    "bst05_reranked_interval",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from hourgrain.plans import catalog

    catalog.QUERIES["col06_season"](spark, sf_dir).count()  # start the JVM's and the workers' machinery once
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
