import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela.functions.quantiles import exact_percentiles, running_by_value
from candela.functions.series import Series, bar_series
from candela.operators import drift as dr
from candela.operators import evaluation as ev
from candela.operators import health as hl
from candela.operators import metrics as met
from candela.operators import ml
from candela.operators import tables as tab
from candela.operators import walkforward as wf

SF = "/root/testdata/sf0.001"


def test_percentiles_are_exact_for_skewed_and_tied_values(spark):
    rng = np.random.default_rng(4)
    data = {"skew": rng.lognormal(0, 3, 20000), "tied": np.repeat([1.0, 2.0, 7.0], [5000, 10, 3]), "two": np.array([1.0, 4.0])}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in data.items()])
    got = exact_percentiles(spark.createDataFrame(pdf), ["k"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).toPandas()
    for k, v in data.items():
        mine = got[got.k == k].sort_values("prob")
        np.testing.assert_allclose(mine.value, np.quantile(v, mine.prob), rtol=1e-12)


def test_percentiles_do_not_rest_on_the_sketch(spark):
    """A sketch far coarser than its brackets misses most ranks; the counts show it."""
    rng = np.random.default_rng(5)
    data = {"skew": rng.lognormal(0, 3, 5000), "few": np.array([3.0]), "tied": np.repeat([1.0, 2.0, 7.0], [2000, 10, 3])}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in data.items()]))
    probs = [0.0, 0.013, 0.5, 0.777, 1.0]
    got = exact_percentiles(df, ["k"], "v", probs, accuracy=10, slack=1e-5).toPandas()
    assert len(got) == 15
    for k, v in data.items():
        mine = got[got.k == k].sort_values("prob")
        np.testing.assert_allclose(mine.value, np.quantile(v, mine.prob), rtol=1e-12)
    whole = exact_percentiles(df, [], "v", probs, accuracy=10, slack=1e-5).toPandas().sort_values("prob")
    np.testing.assert_allclose(whole.value, np.quantile(np.concatenate(list(data.values())), probs), rtol=1e-12)
    assert exact_percentiles(df.limit(0), ["k"], "v", probs).count() == 0


def test_cells_follow_the_number_of_values(spark):
    values = np.concatenate([np.random.default_rng(6).lognormal(0, 4, 3000), np.full(500, 2.0)])
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": values}))
    got = running_by_value(df, ["k"], "v", {"n": F.count(F.lit(1))}, cell_values=4).toPandas().sort_values("v")
    seen, counts = np.unique(values, return_counts=True)
    np.testing.assert_array_equal(got.v, seen)
    np.testing.assert_array_equal(got.n, counts.cumsum())


def test_warm_up_rows_precede_each_test_part(spark):
    """Rows of both kinds by trying all rows and splits; a short series has no split."""
    sizes = {"a": 173, "b": 60}
    pdf = pd.DataFrame([(k, i) for k, n in sizes.items() for i in range(1, n + 1)], columns=["symbol", "rn"])
    lengths = spark.createDataFrame(list(sizes.items()), "symbol string, n long")
    for train, test, step, warmup in ((40, 30, 30, 0), (40, 30, 10, 21), (40, 30, 30, 40)):
        got = wf.assign_rows(spark.createDataFrame(pdf), lengths, train, test, step, warmup).collect()
        want = {
            ("a", rn, k + 1, "train" if rn <= k * step + train else "test")
            for k in range((173 - train - test) // step + 1)
            for rn in range(k * step + train - warmup + 1, k * step + train + test + 1)
        }
        assert len(got) == len(want) and {(r.symbol, r.rn, r.split_num, r.role) for r in got} == want
    with pytest.raises(ValueError):
        wf.assign_rows(spark.createDataFrame(pdf), lengths, 40, 30, 30, 41)


def test_psi_of_the_baseline_itself_is_nearly_zero(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": np.random.default_rng(0).normal(size=4000)}))
    assert dr.psi(df, dr.feature_profile(df, ["x"]), ["x"]).first().psi < 1e-4


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(0, 1, 700), 1), np.round(rng.normal(0.4, 1, 500), 1)
    make = lambda x: spark.createDataFrame(pd.DataFrame({"x": x}))
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert abs(dr.ks_statistic(make(a), make(b), ["x"]).first().ks - want) < 1e-12


def test_auc_with_ties(spark):
    y, s = [0, 0, 1, 1, 1, 0], [0.1, 0.4, 0.4, 0.8, 0.9, 0.9]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double").withColumn("k", F.lit(1))
    pairs = [(a, b) for a, i in zip(s, y) if i for b, j in zip(s, y) if not j]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert abs(ev.auc(df, ["k"], "y", "s").first().auc - want) < 1e-12
    assert abs(ev.auc(df, [], "y", "s").first().auc - want) < 1e-12


def test_binomial_p_value(spark):
    df = spark.createDataFrame([(1, 40, 10)], "k int, n int, hits int")
    from math import comb

    pmf = [comb(40, i) * 0.55**i * 0.45 ** (40 - i) for i in range(41)]
    want = sum(p for p in pmf if p <= pmf[10] * (1 + 1e-7))
    assert abs(dr.binomial_test(df, ["k"], "n", "hits", F.lit(0.55)).first().p_value - want) < 1e-10


def test_fill_gaps_both_ways_across_chunks(spark, bars_of):
    n = 1600
    closes = [float(i) for i in range(n)]
    holes = [None if i < 700 or i % 50 else float(i) for i in range(n)]
    bars = bars_of(spark, closes)
    df = bars.withColumn("x", F.when((F.col("close") >= 700) & (F.col("close") % 50 == 0), F.col("close")))
    got = tab.fill_gaps(df, bar_series(chunk_rows=512), ["x"]).toPandas().sort_values("ts").x
    np.testing.assert_allclose(got, pd.Series(holes).ffill().bfill())


def test_infinity_and_nan_become_null(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),)], "x double")
    assert [r.x for r in tab.zero_fill(df, ["x"]).collect()] == [1.0, 0.0, 0.0]


def test_negative_slices(spark, bars_of):
    bars = bars_of(spark, [float(i) for i in range(10)])
    got = lambda a, b=None: sorted(r.close for r in tab.positions(bars, bar_series(), a, b).collect())
    assert got(2, -3) == [2.0, 3.0, 4.0, 5.0, 6.0] and got(-2) == [8.0, 9.0]


def test_splits_never_overlap_and_cover_their_rows(spark, bars_of):
    bars = bars_of(spark, [1.0] * 173)
    lengths = wf.series_lengths(bars)
    splits = wf.row_splits(lengths, 40, 10, 25).collect()
    rows = wf.assign_rows(wf.number_rows(bars), lengths, 40, 10, 25).collect()
    for s in splits:
        train = sorted(r.rn for r in rows if r.split_num == s.split_num and r.role == "train")
        test = sorted(r.rn for r in rows if r.split_num == s.split_num and r.role == "test")
        assert train == list(range(s.train_from, s.train_to + 1)) and test == list(range(s.test_from, s.test_to + 1))
    assert len({r.split_num for r in rows}) == len(splits) == (173 - 50) // 25 + 1


def test_series_shorter_than_a_split_has_none(spark, bars_of):
    bars = bars_of(spark, [1.0] * 20)
    assert wf.week_splits(wf.series_lengths(bars)).count() == 0


def test_all_winning_and_all_losing_ledgers(spark):
    rows = [("w", 1.0), ("w", 2.0), ("l", -1.0), ("l", 0.0)]
    got = {r.k: r for r in met.trade_stats(spark.createDataFrame(rows, "k string, pnl double"), ["k"]).collect()}
    assert got["w"].profit_factor == 0.0 and got["w"].win_rate == 1.0 and got["w"].avg_loss == 0.0
    assert got["l"].gross_loss == 1.0 and got["l"].losing_trades == 2 and got["l"].profit_factor == 0.0


def test_health_ladder(spark):
    base = dict(win_rate_30=0.6, sharpe_30d=1.0, current_drawdown=0.0, consecutive_losses=0, prediction_confidence=0.7,
                model_drift_score=0.0, correlation_breakdown=0.0)
    cases = [({}, "healthy"), ({"consecutive_losses": 3}, "warning"), ({"sharpe_30d": -1.0}, "critical"),
             ({"consecutive_losses": 5}, "failed"), ({"prediction_confidence": 0.0}, "warning")]
    df = spark.createDataFrame(pd.DataFrame([{**base, **c} for c, _ in cases]))
    assert [r.status for r in hl.health_status(df).collect()] == [s for _, s in cases]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(8, 0.2, (200, 3))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(len(x))))
    got = ml.nearest_neighbours(df, ["a", "b", "c"], 4, pivots=9).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :4]
    mine = got.sort_values(["id", "rank"]).distance.to_numpy().reshape(len(x), 4)
    np.testing.assert_allclose(mine, want, rtol=1e-9)


def test_neighbours_of_equal_rows_are_ranked_by_key(spark):
    """Many copies of a row are at distance zero, whatever a matrix product makes of it, and the smallest keys come first."""
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(50, 1, (6, 5)), 20, axis=0)[rng.permutation(120)]
    names = list("abcde")
    pdf = pd.DataFrame(x, columns=names).assign(id=range(120)).sort_values("id", ascending=False)
    got = ml.nearest_neighbours(spark.createDataFrame(pdf), names, 4, pivots=3)
    rows = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in got.collect()}
    for i in range(120):
        same = [j for j in range(120) if j != i and (x[j] == x[i]).all()][:4]
        assert [rows[i, n + 1] for n in range(4)] == [(j, 0.0) for j in same]


def test_smote_balances_and_stays_between_neighbours(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.uniform(0, 1, (120, 2)), columns=["a", "b"]).assign(id=range(120), label=[1] * 20 + [0] * 100)
    out = ml.smote(spark.createDataFrame(pdf), ["a", "b"]).toPandas()
    made = out[out.synthetic]
    assert abs((out.label == 1).sum() - 100) <= 12 and len(made) > 0
    few = pdf[pdf.label == 1]
    assert made.a.between(few.a.min(), few.a.max()).all() and made.b.between(few.b.min(), few.b.max()).all()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Australia/Lord_Howe"])
def test_tick_order_does_not_depend_on_the_zone(spark, zone):
    """02:50 and 03:20 lie around an hour that New York skips; ties may be negative."""
    from candela.sources.bars import ticks_to_bars

    rows = [("X", "2024-03-10 02:50:00.000001", 2.0, 5), ("X", "2024-03-10 03:20:00", 3.0, 1), ("X", "2024-03-10 02:50:00.000001", 1.0, -(2**63)),
            ("X", "2024-03-10 03:20:00", 4.0, -7)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        ticks = spark.createDataFrame(rows, "symbol string, t string, price double, tick bigint").withColumn("ts", F.col("t").cast("timestamp_ntz"))
        bar = ticks_to_bars(ticks, "symbol", "ts", "price", "D", tie="tick").first()
        assert (bar.open, bar.close, bar.volume) == (1.0, 3.0, 4)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("levels", [1, 2])
def test_pnl_path_equals_a_walk_over_all_trades(spark, levels):
    """Cells laid end to end give what one pass over the whole series gives, with missing pnl and cells without any."""
    rng = np.random.default_rng(11)
    n = 400
    pdf = pd.DataFrame({"k": np.where(rng.uniform(size=n) < 0.7, "A", "B"), "day": np.sort(rng.integers(0, 9, n)), "no": np.arange(n),
                        "pnl": np.where(rng.uniform(size=n) < 0.1, np.nan, np.round(rng.normal(-0.05, 1, n), 2))})
    pdf.loc[pdf.day.isin((0, 4)), "pnl"] = np.nan
    df = spark.createDataFrame(pdf, "k string, day int, no int, pnl double").withColumn("pnl", F.nanvl("pnl", F.lit(None)))
    cells = [F.col("day"), F.expr("no div 16")][:levels]
    got = {r.k: r for r in met.pnl_path(df, Series(("k",), ("day", "no"), lambda: cells)).collect()}
    assert set(got) == {"A", "B"}
    for key, own in pdf.groupby("k"):
        run = own.pnl.fillna(0).cumsum()[own.pnl.notna().cummax()]
        row, top = got[key], run.cummax()
        assert row["rows"] == len(own) and row.last_win == np.flatnonzero(own.pnl > 0)[-1] + 1
        np.testing.assert_allclose(
            [row.cumulative, row.peak, row.low, row.drawdown], [run.iloc[-1], run.max(), run.min(), (run - top).min()], atol=1e-9)


def test_health_reads_the_order_lines_once(spark, monkeypatch):
    from candela.plans import monitor_queries
    from candela.sources import driver_tables

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    names, plain = [], driver_tables.table
    monkeypatch.setattr(driver_tables, "table", lambda s, d, name: names.append(name) or plain(s, d, name))
    assert monitor_queries.recovery(spark, SF).count() > 0
    assert names.count("lineitem") == 1


def test_win_rates_sort_the_newest_cells_only(spark):
    """Keys with fewer rows than asked for keep all of them; a key, time or pnl may be missing."""
    rng = np.random.default_rng(5)
    rows = [("A", int(d), k, float(p)) for k, (d, p) in enumerate(zip(rng.integers(0, 200, 3000), rng.normal(size=3000)))]
    rows += [("B", 7, k, 1.0) for k in range(12)] + [("C", None, 0, -1.0), ("C", 3, 1, 2.0), (None, 5, 0, 1.0), ("B", 8, 0, None)]
    df = spark.createDataFrame(rows, "k string, day int, no int, pnl double")
    few = met.newest_cells(df, ["k"], F.col("day"), 30)
    assert few.where("k = 'A'").count() < 100 and few.where("k = 'B'").count() == 13 and few.where("k = 'C'").count() == 2
    plain, cut = (hl.recent_win_rates(df, ["k"], ["day", "no"], (5, 30), cell).collect() for cell in (None, F.col("day")))
    assert sorted(map(str, plain)) == sorted(map(str, cut)) and len(cut) == 4


def test_saved_trades_hold_the_margin_once(spark):
    """pnl and pnl_percent are made again from it, equal to those of the joined lines."""
    from candela.sources.driver_tables import line_trades, pnl_trades

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    got, want = pnl_trades(spark, SF), line_trades(spark, SF)
    stored = spark.read.parquet(*got.inputFiles()).columns
    assert "margin" in stored and "pnl" not in stored and "margin" not in want.columns + got.columns
    assert got.select("order_key", "notional", "pnl", "pnl_percent").exceptAll(want.select("order_key", "notional", "pnl", "pnl_percent")).count() == 0


def test_lines_meet_their_orders_by_keys_only(spark):
    """Missing, repeated and null order keys as in the join, and no line is shuffled by its order."""
    from candela.sources.driver_tables import ordered

    lines = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30), (None, 40)], "l_orderkey long, l_partkey long")
    orders = spark.createDataFrame([(1,), (3,), (3,), (3,), (None,), (9,)], "o_orderkey long")
    want = lines.join(orders, lines.l_orderkey == orders.o_orderkey).drop("o_orderkey")
    got = ordered(lines, orders)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, 10), (1, 11), (3, 30), (3, 30), (3, 30)]
    assert "hashpartitioning" not in got._jdf.queryExecution().toString()
