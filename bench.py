"""Times the headline reports over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each report runs once to warm up and three times for the median, into a sink that discards rows;
each learned model runs twice and the second run counts. BENCH_ALL=1 times every report.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from ripecast.plans import catalog
from ripecast.session import build_session

HEADLINE = (
    "scan_sales", "canonical_sales", "csv_roundtrip", "filter_date_range",
    "kpi_overview", "daily_revenue", "category_revenue_share", "top_products", "data_profile",
    "category_metrics", "season_metrics", "product_kpis", "product_first_attrs", "stock_latest", "calendar_spine",
    "product_daily", "date_features", "label_encode", "train_test_split", "future_frame",
    "forecast_trend", "forecast_summary", "history_plus_forecast", "eval_holdout", "eval_metrics",
    "stock_projection", "reorder_plan", "price_optimization", "price_comparison",
    "forecast_linear", "forecast_rf", "trend_save_load", "model_save_load",
)
LEARNED = ("forecast_linear", "eval_linear", "forecast_rf", "eval_rf", "forest_trees", "trend_save_load", "model_save_load")
RUNS = 3


def timed(report, spark, root) -> float:
    start = time.perf_counter()
    report(spark, root).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "ripecast-bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name, report in catalog.reports().items():
        if name in HEADLINE or os.environ.get("BENCH_ALL") == "1":
            timed(report, spark, root)
            runs = 1 if name in LEARNED else RUNS
            seconds[name] = round(statistics.median(timed(report, spark, root) for _ in range(runs)), 3)
        else:
            continue
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total of warm medians",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
