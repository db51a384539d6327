from candela.operators import indicators as ind
from candela.operators import regimes as reg
from candela.operators import signals as sig


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("ts").collect()]


def test_rising_closes_have_full_strength(spark, bars_of):
    out = rows(ind.rsi(14)(bars_of(spark, [float(i) for i in range(1, 31)])), "rsi_14")
    assert [x for (x,) in out[:13]] == [None] * 13
    assert all(x == 100.0 for (x,) in out[13:])


def test_constant_closes_have_no_strength_position_or_channel_width(spark, bars_of):
    bars = bars_of(spark, [5.0] * 40)
    parts = ind.beside(ind.rsi(14), ind.bollinger(20), ind.stochastic(), ind.williams_r(14), ind.cci(20))
    last = parts(bars).orderBy("ts").collect()[-1]
    assert last.rsi_14 is None and last.bb_position_20 is None and last.stoch_k_14 is None
    assert last.williams_r_14 is None and last.cci_20 is None and last.bb_width_20 == 0.0


def test_flat_bar_is_no_doji(spark, bars_of):
    assert rows(ind.candle_shapes()(bars_of(spark, [1.0, 2.0])), "doji", "hammer") == [(0, 0), (0, 0)]


def test_short_series_gives_nulls(spark, bars_of):
    out = ind.sma((20,))(bars_of(spark, [1.0])).collect()
    assert out[0].sma_20 is None


def test_first_true_range_is_the_bar_range(spark, bars_of):
    bars = bars_of(spark, [10.0, 11.0, 12.0], highs=[11.0, 12.0, 13.0], lows=[9.0, 10.0, 11.0])
    assert rows(ind.atr(2)(bars), "atr_2") == [(None,), (2.0,), (2.0,)]
    late = ind.momentum_80_20(1, 1, 1, 2)(bars)
    assert rows(late, "atr") == [(None,), (None,), (2.0,)]


def test_zero_volume_base_is_null(spark, bars_of):
    bars = bars_of(spark, [1.0] * 6, volumes=[0, 1, 1, 1, 1, 5])
    assert rows(ind.volume_features()(bars), "volume_momentum")[-1] == (None,)


def test_obv_counts_signed_volume_from_zero(spark, bars_of):
    bars = bars_of(spark, [1.0, 2.0, 2.0, 1.0], volumes=[5, 6, 7, 8])
    assert rows(ind.add_obv(bars), "obv") == [(0.0,), (6.0,), (6.0,), (-2.0,)]


def test_feature_names_are_unique_and_complete():
    assert len(ind.feature_columns()) == len(set(ind.feature_columns())) == 82
    assert len(ind.feature_columns(False)) == 76


def test_short_history_is_sideways(spark, bars_of):
    out = reg.regime_as_of(bars_of(spark, [float(i) for i in range(1, 50)]))
    assert {r.regime for r in out.collect()} == {reg.SIDEWAYS}


def test_crossover_needs_warm_up(spark, bars_of):
    closes = [100.0 - i for i in range(40)] + [60.0 + 3 * i for i in range(40)]
    out = sig.entries(sig.momentum_rule(5, 10)(bars_of(spark, closes)))
    got = out.collect()
    assert all(r.stop_loss < r.close < r.take_profit for r in got if r.action == "buy")


def test_custom_rule_must_return_signal_columns(spark, bars_of):
    import pytest

    with pytest.raises(ValueError, match="lacks columns"):
        sig.custom_rule(bars_of(spark, [1.0]), lambda df: df)
