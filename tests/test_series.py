import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from candela.functions.series import RN, Frame, Series, bar_series, day_cells, index, on_series, running, strip
from candela.operators import indicators as ind
from candela.operators import regimes as reg


def walk(n, seed=1):
    rng = np.random.default_rng(seed)
    return list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))))


def small(chunk=512):
    return bar_series(3600, chunk_rows=chunk)


def test_positions_are_dense_and_ordered(spark, bars_of):
    bars = bars_of(spark, walk(5000), "A").union(bars_of(spark, walk(30), "B")).repartition(7)
    pdf = index(bars, small()).toPandas().sort_values(["symbol", "ts"])
    for _, g in pdf.groupby("symbol"):
        assert list(g[RN]) == list(range(1, len(g) + 1))


def test_chunked_frames_equal_whole_series(spark, bars_of):
    closes = walk(2300)
    bars = bars_of(spark, closes)
    out = ind.beside(ind.sma((20, 200)), ind.ema((12, 50)), ind.rsi(14))(bars, small()).toPandas().sort_values("ts")
    s = pd.Series(closes)
    for n in (20, 200):
        np.testing.assert_allclose(out[f"sma_{n}"], s.rolling(n).mean(), rtol=1e-12)
    for n in (12, 50):
        np.testing.assert_allclose(out[f"ema_{n}"], s.ewm(span=n, adjust=False).mean(), rtol=1e-11)
    d = s.diff()
    up, down = d.where(d > 0, 0).rolling(14).mean(), (-d.where(d < 0, 0)).rolling(14).mean()
    np.testing.assert_allclose(out["rsi_14"], 100 - 100 / (1 + up / down), rtol=1e-9)


def test_means_with_long_memory_lose_no_history(spark, bars_of):
    """A span of 4,000 over chunks of 512 rows: the first rows still weigh at the end."""
    closes = [1e6] * 3 + walk(2600, 8)
    out = ind.beside(ind.ema((5, 4000)), ind.macd(700, 1500, 900))(bars_of(spark, closes), small()).toPandas().sort_values("ts")
    s = pd.Series(closes)
    for n in (5, 4000):
        np.testing.assert_allclose(out[f"ema_{n}"], s.ewm(span=n, adjust=False).mean(), rtol=1e-10)
    line = s.ewm(span=700, adjust=False).mean() - s.ewm(span=1500, adjust=False).mean()
    np.testing.assert_allclose(out["macd"], line, rtol=1e-7, atol=1e-7)
    np.testing.assert_allclose(out["macd_signal"], line.ewm(span=900, adjust=False).mean(), rtol=1e-6, atol=1e-6)


def test_chunk_size_does_not_change_the_feature_set(spark, bars_of):
    rng = np.random.default_rng(5)
    closes = walk(2100, 5)
    bars = bars_of(
        spark, closes, highs=[x * 1.01 for x in closes], lows=[x * 0.99 for x in closes],
        volumes=[int(v) for v in rng.integers(1, 50, len(closes))],
    )
    one = ind.feature_set(bars).toPandas().sort_values("ts")
    many = ind.feature_set(bars, series=small(1024)).toPandas().sort_values("ts")
    for name in ind.feature_columns():
        np.testing.assert_allclose(many[name].astype(float), one[name].astype(float), rtol=1e-7, atol=1e-9, err_msg=name)


def test_lookahead_crosses_chunks(spark, bars_of):
    closes = walk(1100)
    out = reg.add_targets(bars_of(spark, closes), 5, series=small()).toPandas().sort_values("ts")
    s = pd.Series(closes)
    np.testing.assert_allclose(out["future_return"], s.shift(-5) / s - 1, rtol=1e-9)
    assert out["target_binary"].isna().sum() == 5


def test_running_aggregates(spark, bars_of):
    closes = walk(1700, 3)
    bars = bars_of(spark, closes)
    df = index(bars, small())
    thin = F.when(F.col(RN) % 700 == 3, F.col("close"))
    out = running(
        df, small(), {"s": ("sum", F.col("close")), "m": ("max", F.col("close")), "n": ("min", F.col("close")), "l": ("last", thin)}
    )
    before = running(df, small(), {"p": ("max", F.col("close"))}, exclusive=True)
    pdf = out.toPandas().sort_values("ts")
    s = pd.Series(closes)
    np.testing.assert_allclose(pdf["s"], s.cumsum(), rtol=1e-12)
    np.testing.assert_allclose(pdf["m"], s.cummax())
    np.testing.assert_allclose(pdf["n"], s.cummin())
    at = np.arange(1, len(s) + 1)
    np.testing.assert_allclose(pdf["l"].to_numpy(), s.where(at % 700 == 3).ffill().to_numpy())
    np.testing.assert_allclose(before.toPandas().sort_values("ts")["p"], s.cummax().shift(1))


def test_hot_key_is_cut_into_chunks(spark, bars_of):
    """No window task of a long series sees more than a chunk and its lookback."""
    bars = bars_of(spark, walk(6000), "HOT").union(bars_of(spark, walk(10), "cold"))
    series = small()
    sizes = on_series(
        bars, series, lambda df, f: df.withColumn("_size", F.count(F.lit(1)).over(f.w.rowsBetween(-10**6, 10**6))), 200,
        keep_helpers=True,
    )
    assert sizes.agg(F.max("_size")).first()[0] <= 512 + 512


def test_ties_inside_a_cell_follow_the_whole_order(spark):
    rows = [("k", "2024-01-01", i % 3, i) for i in range(50)]
    df = spark.createDataFrame(rows, "key string, d string, a int, b int").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    series = Series(("key",), ("ts", "a", "b"), day_cells("ts", 1))
    got = [r.b for r in index(df, series).orderBy(RN).collect()]
    assert got == sorted(range(50), key=lambda i: (i % 3, i))


def test_strip_drops_helpers(spark, bars_of):
    df = bars_of(spark, walk(20))
    assert strip(index(df, small())).columns == df.columns
    assert isinstance(Frame(small()).keys, list)
