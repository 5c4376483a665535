"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local threads. Every query is computed in
full (all rows and columns) and discarded. The session is warmed up by one small aggregate that is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "flagship_ab_test", "moments_all_grains", "segment_effects", "guardrails", "winsorised_welch_test", "conditional_funnel",
    "growth_accounting", "rolling_anomalies", "rolling_forecast", "slice_and_dice", "numeric_summary", "correlations", "regression",
    "extreme_answers", "breakdown", "faithfulness", "cited_numbers", "relevancy", "similar_runs", "trailing_event_rate", "daily_spend",
)


def main() -> None:
    from registry.catalog import ENTRIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()
    timings = {}
    for name in names:
        start = time.perf_counter()
        ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
