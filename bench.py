"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quotemill import build_session  # noqa: E402
from quotemill.plans.registry import load_all  # noqa: E402

HEADLINES = [
    "daily_returns", "rolling_volatility_20", "rolling_volatility_20_sparse", "moving_averages_long",
    "weekly_returns", "price_range_252", "latest_price", "abnormal_moves_all",
    "latest_dates_per_code", "net_positions", "user_stock_summary", "daily_trade_summary",
    "running_positions", "snapshot_gaps", "within_listing", "prices_without_valuation",
    "series_completeness", "day_coverage", "latest_statement_version", "asof_or_latest_reports",
    "reconcile_statements", "margin_flow_merge", "duplicate_trade_ids", "upsert",
    "rules_prices", "rules_transactions", "quality_run_standard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [a for a in sys.argv[1:]] or HEADLINES
    spark = build_session(f"local[{cpus}]", "bench", shuffle_partitions=int(cpus), extra={
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    known = load_all()
    known["latest_price"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
