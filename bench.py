"""Headline benchmark: prints one JSON line with the seconds per query.

Each query runs once to warm up code generation and file listings, then is timed while its whole result is
consumed without being collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.catalog import QUERIES
from tidemark.session import build

HEADLINE = (
    "candles", "ema", "cascade_first_engine", "engine_b_reclaim_after_dump", "sustained_below", "rolling_drop", "threshold_hysteresis",
    "cooldown", "dedup_tokens", "filter_funnel", "discovery_scan", "daily_watchlist", "strategy_gates", "unified_alerts", "wallet_pnl",
    "holder_distribution", "counterparties", "cobuyers", "price_asof_trade", "agent_rollup", "evaluate_bets", "exposure_allocation",
    "sentiment", "scan_log_blocks", "launch_momentum", "stream_candles",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name].run(spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
