import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("candela-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_bars(spark, closes, symbol="X", highs=None, lows=None, opens=None, volumes=None, start="2024-01-01"):
    """Hourly bars from lists."""
    import pandas as pd

    n = len(closes)
    pdf = pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.date_range(start, periods=n, freq="h"),
            "open": opens or closes,
            "high": highs or closes,
            "low": lows or closes,
            "close": closes,
            "volume": volumes or [1] * n,
        }
    )
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint"
    for name in ("open", "high", "low", "close"):
        pdf[name] = pdf[name].astype(float)
    return spark.createDataFrame(pdf, schema)


@pytest.fixture(scope="session")
def bars_of():
    return make_bars
