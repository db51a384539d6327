"""Headline queries, timed.  Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a20_bars_h1", "d01_sma", "d03_rsi", "d34_feature_set", "e08_regime_as_of", "f01_momentum_fast", "g01_ledger", "g10_equity",
    "i01_trade_stats", "i08_streaks", "i10_all_metrics", "i11_dashboard_metrics", "j05_split_validation", "j08_split_backtests",
    "j09_aggregate_results", "k09_health_status", "l05_psi", "l06_ks_statistic", "h06_logistic",
    "h05_cross_validation", "h07_random_forest", "h12_predict", "j08_train_and_score",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("candela-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def minute_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete feature set on one-minute bars, which gives the most rows."""
    from candela.functions.series import bar_series
    from candela.operators.indicators import feature_set
    from candela.sources.driver_tables import event_bars

    return feature_set(event_bars(spark, sf_dir, "M1"), series=bar_series(60))


def main() -> None:
    from candela.plans.catalog import QUERIES
    from candela.sources.driver_tables import event_bars

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    jobs = {n: QUERIES[n] for n in HEADLINE} | {"feature_set_minute_bars": minute_features}
    run(QUERIES["a20_bars_h1"](spark, sf_dir))  # start-up is not part of any query
    times = {}
    for name, job in jobs.items():
        t0 = time.perf_counter()
        run(job(spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
    bars = event_bars(spark, sf_dir, "M1").count()
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "minute_bars": bars,
                "feature_bars_per_sec": round(bars / times["feature_set_minute_bars"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
