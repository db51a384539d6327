"""The ledger against a plain loop over bars that follows the trading rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela.functions.series import bar_series
from candela.operators import ledger as led
from candela.operators import metrics as met


def market(n, seed, every=5, flags=False):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    high, low = close * (1 + rng.uniform(0, 0.01, n)), close * (1 - rng.uniform(0, 0.01, n))
    action = np.where(rng.uniform(size=n) < 1 / every, np.where(rng.uniform(size=n) < 0.5, "buy", "sell"), None)
    reach = rng.uniform(0.01, 0.08, n)
    sign = np.where(action == "buy", 1, -1)
    pdf = pd.DataFrame({"symbol": f"S{seed}", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "high": high, "low": low,
                        "close": close, "action": action, "stop_loss": close * (1 - sign * reach),
                        "take_profit": close * (1 + sign * 1.5 * reach), "reason": "r"})
    pdf["exit_long"] = (rng.uniform(size=n) < 0.05).astype(int) if flags else 0
    pdf["exit_short"] = (rng.uniform(size=n) < 0.05).astype(int) if flags else 0
    return pdf


SCHEMA = ("symbol string, ts timestamp_ntz, high double, low double, close double, action string, stop_loss double,"
          " take_profit double, reason string, exit_long int, exit_short int")


def bar_loop(pdf, cfg):
    """Trades and equity by walking the bars one by one."""
    h, slip, fee = cfg.half_spread, cfg.slippage_pct, cfg.commission_pct
    capital, position, trades, curve = cfg.initial_capital, None, [], []

    def close_position(i, reason):
        nonlocal capital, position
        mid, long = pdf.close[i], position["long"]
        price = mid * (1 - h) * (1 - slip) if long else mid * (1 + h) * (1 + slip)
        gain = (price - position["price"] if long else position["price"] - price) * position["size"]
        gain -= fee * position["size"] * (position["price"] + price)
        trades.append({**position, "exit": i, "reason": reason, "pnl": gain})
        capital += gain
        position = None

    for i in range(len(pdf)):
        if curve and (max(curve) - curve[-1]) / max(curve) > cfg.max_drawdown_pct:
            break
        left_by_signal = False
        if position:
            mark = pdf.close[i] * (1 - h) if position["long"] else pdf.close[i] * (1 + h)
            position["open"] = ((mark - position["price"]) if position["long"] else (position["price"] - mark)) * position["size"]
            position["mae"], position["mfe"] = min(position["mae"], position["open"]), max(position["mfe"], position["open"])
            lo, hi, s, t = pdf.low[i], pdf.high[i], position["stop"], position["target"]
            if (lo <= s) if position["long"] else (hi >= s):
                close_position(i, "stop_loss")
            elif (hi >= t) if position["long"] else (lo <= t):
                close_position(i, "take_profit")
            elif cfg.use_exit_signals and (pdf.exit_long[i] if position["long"] else pdf.exit_short[i]):
                close_position(i, "signal")
                left_by_signal = True
        if position is None and pdf.action[i] in ("buy", "sell") and not left_by_signal:
            long = pdf.action[i] == "buy"
            price = pdf.close[i] * (1 + h) * (1 + slip) if long else pdf.close[i] * (1 - h) * (1 - slip)
            risk = abs(price - pdf.stop_loss[i])
            size = min(capital * cfg.position_size_pct / risk, capital * cfg.max_position_value_pct / price)
            if cfg.position_sizing_method == "kelly":
                size = capital * cfg.max_position_value_pct / price
                if len(trades) > 20:
                    past = [t["pnl"] for t in trades[-100:]]
                    won, lost = [p for p in past if p > 0], [p for p in past if p < 0]
                    rate, pct = len(won) / len(past), 0.01
                    if lost and 0 < rate < 1:
                        ratio = np.mean(won) / abs(np.mean(lost))
                        pct = min(max((rate * ratio - (1 - rate)) / ratio / 2, 0.001), 0.05)
                    size = min(capital * pct / price, size)
            if size > 0:
                position = {"entry": i, "long": long, "price": price, "size": size, "stop": pdf.stop_loss[i],
                            "target": pdf.take_profit[i], "open": 0.0, "mae": 0.0, "mfe": 0.0}
        curve.append(capital + (position["open"] if position else 0.0))
    if position:
        close_position(len(pdf) - 1, "end_of_backtest")
    return trades, curve


@pytest.mark.parametrize(
    "changes", [{}, {"use_exit_signals": True}, {"max_drawdown_pct": 0.004}, {"use_exit_signals": True, "max_drawdown_pct": 0.004},
                {"position_sizing_method": "kelly"}]
)
def test_ledger_equals_bar_loop(spark, monkeypatch, changes):
    # small blocks and chunks, so that the search climbs several levels and chains cross chunks
    monkeypatch.setattr(led, "FAN_OUT", 4)
    monkeypatch.setattr(led, "LINK_ROWS", 8)
    monkeypatch.setattr(led, "KELLY_ROWS", 50)
    markets = [market(n, seed, every, True) for n, seed, every in ((700, 1, 3), (300, 2, 40), (90, 3, 2), (1, 4, 1))]
    cfg = led.sweep(led.BacktestConfig(position_size_pct=0.2, max_position_value_pct=0.5), **changes)
    bt = led.backtest(spark.createDataFrame(pd.concat(markets), SCHEMA), cfg, bar_series(chunk_rows=512))
    got, equity = bt.trades.toPandas(), bt.equity.toPandas()
    for pdf in markets:
        trades, curve = bar_loop(pdf, cfg)
        mine = got[got.symbol == pdf.symbol[0]].sort_values("entry_rn")
        assert list(mine.entry_rn - 1) == [t["entry"] for t in trades]
        assert list(mine.exit_reason) == [t["reason"] for t in trades]
        np.testing.assert_allclose(mine.pnl, [t["pnl"] for t in trades], rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(mine["size"], [t["size"] for t in trades], rtol=1e-9)
        np.testing.assert_allclose(mine.max_adverse_excursion, [t["mae"] for t in trades], atol=1e-9)
        np.testing.assert_allclose(mine.max_favorable_excursion, [t["mfe"] for t in trades], atol=1e-9)
        line = equity[equity.symbol == pdf.symbol[0]].sort_values("rn").equity
        np.testing.assert_allclose(line, curve, rtol=1e-12)


def test_exits_over_three_levels_of_blocks(spark):
    """200,000 bars: stops that are touched soon, only in one bar far away, or never."""
    n, crash = 200_000, 190_003
    low = np.random.default_rng(9).uniform(100, 101, n)
    low[crash - 1] = 50.0
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "A", "_rn": np.arange(1, n + 1), "low": low, "high": low + 1}))
    none = F.lit(0)
    bars = bars.select("*", none.alias("xl"), none.alias("xs"), F.col("low").alias("close"), F.col("_rn").alias("ts"), none.alias("_seen"), none.alias("_cand"))
    at = np.arange(1, n + 1, 101)
    stops = np.array([100.001, 60.0, 10.0])[np.arange(len(at)) % 3]
    asked = pd.DataFrame({"symbol": "A", "_rn": at, "_long": True, "stop_loss": stops, "take_profit": 1e9})
    found = led.find_exits(spark.createDataFrame(asked), bars, ["symbol"])
    got = found.select("_rn", F.col("hit.id").alias("exit")).toPandas().set_index("_rn").exit
    assert len(got) == len(at)
    for rn, stop in zip(at, stops):
        later = low[rn:] <= stop
        if later.any():
            assert got[rn] == rn + 1 + later.argmax()
        else:
            assert pd.isna(got[rn])
    plain = led.find_exits(spark.createDataFrame(asked).limit(0), bars.limit(0), ["symbol"])
    assert plain.count() == 0


def test_stop_wins_over_target_in_the_same_bar(spark):
    pdf = market(3, 9)
    pdf["action"] = ["buy", None, None]
    pdf["high"], pdf["low"], pdf["close"] = 200.0, 1.0, 100.0
    pdf["stop_loss"], pdf["take_profit"] = 90.0, 110.0
    got = led.ledger(spark.createDataFrame(pdf, SCHEMA)).collect()
    assert [(r.exit_rn, r.exit_reason) for r in got] == [(2, "stop_loss")]


def test_entry_on_the_last_bar_is_closed_there(spark):
    pdf = market(3, 9)
    pdf["action"] = [None, None, "sell"]
    got = led.backtest(spark.createDataFrame(pdf, SCHEMA)).trades.collect()
    assert len(got) == 1 and got[0].entry_time == got[0].exit_time and got[0].max_adverse_excursion == 0.0


def test_no_signals_give_zero_metrics(spark):
    pdf = market(5, 9)
    pdf["action"] = None
    bt = led.backtest(spark.createDataFrame(pdf, SCHEMA))
    row = met.backtest_metrics(bt.trades, bt.equity.select("symbol", "ts", "equity"), bar_series()).collect()
    assert len(row) == 1 and all(row[0][n] == 0 for n in met.METRICS)


def test_wins_and_losses_add_up_and_equity_ends_at_capital_plus_profit(spark):
    pdf = market(400, 11)
    cfg = led.BacktestConfig(max_drawdown_pct=1.0)
    bt = led.backtest(spark.createDataFrame(pdf, SCHEMA), cfg)
    m = met.backtest_metrics(bt.trades, bt.equity.select("symbol", "ts", "equity"), bar_series()).first()
    assert m.winning_trades + m.losing_trades == m.total_trades > 0
    done = bt.trades.where("exit_reason <> 'end_of_backtest'").agg({"pnl": "sum"}).first()[0]
    last = bt.trades.orderBy("entry_rn").collect()[-1]
    if last.exit_reason != "end_of_backtest":
        assert abs(m.final_equity - 10000 - done) < 1e-6


def test_long_chain_crosses_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(led, "LINK_ROWS", 16)
    rng = np.random.default_rng(0)
    n = 2000
    nxt = [min(i + int(rng.integers(1, 60)), led.NEVER) for i in range(1, n + 1)]
    nxt = [x if x <= n else led.NEVER for x in nxt]
    df = spark.createDataFrame([("k", i, nxt[i - 1]) for i in range(1, n + 1)], "key string, id bigint, next_id bigint")
    want, at = [], 1
    while at != led.NEVER:
        want.append(at)
        at = nxt[at - 1]
    assert sorted(r.id for r in led.walk_chain(df, ["key"]).collect()) == want


def test_far_exits_of_every_signal_do_not_meet_in_one_row(spark):
    """Every id leaves its chunk, so each is an exit of its own; the walk is still the plain chain."""
    from pyspark.sql import functions as F

    n, far = 60_000, 2_100
    df = spark.range(1, n + 1).select(F.lit("k").alias("key"), "id", (F.col("id") + far + F.col("id") % 7).alias("next_id"))
    df = df.withColumn("next_id", F.when(F.col("next_id") > n, F.lit(led.NEVER)).otherwise(F.col("next_id")))
    want, at = [], 1
    while at <= n:
        want.append(at)
        at += far + at % 7
    assert sorted(r.id for r in led.walk_chain(df, ["key"]).collect()) == want
