"""Timed headline queries; prints one JSON line.

BENCH_SF_DIR   data directory (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "feature_table", "back_adjust", "ema", "macd_long", "bollinger", "year_range", "volatility_regime", "index_context",
    "industry_context", "winsorized_labels", "information_coefficient", "topk_stats", "sequence_scores", "direct_signals",
    "validated_1day", "backtest_metrics", "upsert_replace", "payload_rows", "report_sector_momentum", "feature_label_corr",
)


def main() -> None:
    from barloom import catalog
    from barloom.session import builder

    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder("bench").master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    # One small query first, so that JVM start-up is not booked on the first headline.
    queries["date_range"](spark, path).collect()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(path.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
