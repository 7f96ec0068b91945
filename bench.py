"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from panelwright.plans import load_plans

HEADLINE = [
    "e01_feature_columns",
    "e02_indicators_wide",
    "e33_detect",
    "d03_broker_score",
    "d09_smart_broker_score",
    "f03_coarse_filter",
    "f06_rank_and_enrich",
    "c16_forward_returns",
    "l03_limit_streaks",
    "a07_backfill_features",
    "i08_chip_momentum",
    "f09_candidate_pool",
    "i38_run_scan",
    "j01_factor_ic",
    "j32_quintile_study",
    "k01_compute_metrics",
    "k16_backfill_benchmark_alpha",
    "k27_strategy_rank",
    "h03_classify_concepts",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    plans = load_plans()
    spark.read.parquet(f"{root}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t = time.time()
        plans[n].run(spark, root).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(root.rstrip("/"))}))


if __name__ == "__main__":
    main()
