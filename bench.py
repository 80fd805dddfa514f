"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "yoy_accuracy", "daily_traffic", "join_items_products_orders", "category_mix", "agg_named_multi", "complete_years",
    "denoise_target", "rolling_band", "lag_calendar", "exog_table", "future_safe_features", "spearman", "mann_whitney",
    "kruskal_wallis", "kruskal_wallis_orders", "average_rank", "ccf", "cointegration", "seasonal_decompose",
    "promo_event_study", "holiday_matrix", "structural_predict", "seasonal_profile_growth", "recursive_forecast",
    "recursive_forecast_boosted", "forecast_metrics", "backtest_naive", "safety_stock_tradeoff", "marketing_allocation",
    "early_warning_points", "quarter_plan", "stream_daily_rollup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidecast.plans import catalog
    from tidecast.session import build_session

    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if wanted == "all" else [q for q in wanted.split(",") if q] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["yoy_accuracy"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        begin = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
