"""Filter, join, evaluation and small-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.series import bar_series
from candela.operators import drift as dr
from candela.operators import evaluation as ev
from candela.operators import indicators as ind
from candela.operators import metrics as met
from candela.operators import ledger as led
from candela.operators import regimes as reg
from candela.operators import tables as tab
from candela.plans.ledger_queries import CFG, LEDGER, recursive
from candela.plans.monitor_queries import CLASSES, FEATURES, LABELLED, LONG, QUALITY, labelled
from candela.plans.registry import query
from candela.plans.regime_queries import FUT
from candela.plans.fitted_scores import scored_bars
from candela.plans.signal_queries import RULES_ALL, SCORED
from candela.plans.sqltext import BARS, OVER, TRADES, full, lag, lead, pct, r, rounded, stages
from candela.sources import bars as src
from candela.sources.driver_tables import embedding_features, event_bars, line_trades, table

# ---- B: filters and slices -------------------------------------------------------------


@query("b01_date_range", stages(TRADES) + "SELECT trade_id, exit_time FROM trades WHERE exit_time >= TIMESTAMP '1998-01-01' AND exit_time < TIMESTAMP '1998-07-01'")
def date_range(spark, sf_dir):
    df = tab.between(line_trades(spark, sf_dir), "exit_time", "1998-01-01 00:00:00", "1998-07-01 00:00:00", include_end=False)
    return df.select("trade_id", "exit_time")


NUM = f"nb AS (SELECT *, row_number() OVER ({OVER}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"


@query("b02_positional_slice", stages(BARS, NUM) + "SELECT symbol, ts, close FROM nb WHERE i >= 100 AND i < n - 5")
def slice_(spark, sf_dir):
    return tab.positions(event_bars(spark, sf_dir), bar_series(), 100, -5).select("symbol", "ts", "close")


@query("b02_tail", stages(BARS, NUM) + "SELECT symbol, ts, close FROM nb WHERE i >= n - 30")
def tail(spark, sf_dir):
    return tab.positions(event_bars(spark, sf_dir), bar_series(), -30).select("symbol", "ts", "close")


@query("b03_drop_nulls", stages(BARS, f"s AS (SELECT *, {full(50, 'close')} AS m FROM bars)") + f"SELECT symbol, ts, {r('m')} AS sma_50 FROM s WHERE m IS NOT NULL")
def drop_nulls(spark, sf_dir):
    return rounded(ind.sma((50,))(event_bars(spark, sf_dir)).dropna(subset=["sma_50"]).select("symbol", "ts", "sma_50"))


GAPPY = f"gp AS (SELECT symbol, ts, {lag('close', 3)} AS back, CASE WHEN volume > 2 THEN close END AS thin FROM bars)"
FILLED = (
    f"fl AS (SELECT symbol, ts, coalesce(last_value(back IGNORE NULLS) OVER ({OVER} ROWS UNBOUNDED PRECEDING),"
    f" first_value(back IGNORE NULLS) OVER ({OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS back,"
    f" coalesce(last_value(thin IGNORE NULLS) OVER ({OVER} ROWS UNBOUNDED PRECEDING),"
    f" first_value(thin IGNORE NULLS) OVER ({OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS thin FROM gp)"
)


def gappy(spark, sf_dir):
    shift = ind.indicator(3, lambda f: {"back": f.lag("close", 3)})
    df = shift(event_bars(spark, sf_dir))
    return df.select("symbol", "ts", "back", F.when(F.col("volume") > 2, F.col("close")).alias("thin"))


@query("b04_fill_gaps", stages(BARS, GAPPY, FILLED) + "SELECT symbol, ts, back, thin FROM fl WHERE back IS NOT NULL AND thin IS NOT NULL")
def fill(spark, sf_dir):
    return tab.fill_gaps(gappy(spark, sf_dir), bar_series(), ["back", "thin"])


@query("b05_zero_fill", stages(BARS, GAPPY) + "SELECT symbol, ts, coalesce(back, 0) AS back, coalesce(thin, 0) AS thin FROM gp")
def zeros(spark, sf_dir):
    return tab.zero_fill(gappy(spark, sf_dir), ["back", "thin"])


@query("b06_feature_columns", stages(BARS, FUT) + f"SELECT {r(pct('close', lag('close')))} AS returns FROM fut")
def feature_columns(spark, sf_dir):
    df = reg.add_targets(ind.returns()(event_bars(spark, sf_dir)).drop("log_returns"))
    return rounded(df.select(*ev.feature_names(df)))


COLUMN_CLASSES = [("symbol", "clean"), ("ts", "clean")] + [(n, "non_feature") for n in ev.NOT_FEATURES] + [(n, "leak") for n in ev.LEAKS]
FILLED_COLUMNS = " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", '{k}' AS class, "
    + (f"count(*) FILTER (WHERE fr IS NOT NULL)" if k == "leak" else "count(*)") + " AS filled FROM fut"
    for n, k in COLUMN_CLASSES)


@query("b07_leak_columns", stages(BARS, FUT) + FILLED_COLUMNS)
def leaks(spark, sf_dir):
    """Class of every column of the labelled bars, with the number of values it holds."""
    df = reg.add_targets(event_bars(spark, sf_dir))
    filled = df.agg(*[F.count(n).alias(n) for n in df.columns]).unpivot([], df.columns, "column", "filled")
    return filled.join(F.broadcast(ev.classify_columns(df)), "column").select("column", "class", "filled")


@query("b08_ledger_filter", stages(TRADES) + "SELECT trade_id, pnl FROM (SELECT trade_id, round(pnl, 4) + 0.0 AS pnl, direction, strategy FROM trades) WHERE direction = 'long' AND strategy = 'A'")
def ledger_filter(spark, sf_dir):
    return rounded(tab.filter_ledger(line_trades(spark, sf_dir), "All", "long", "A").select("trade_id", "pnl"), 4)


@query("b09_distinct_values", stages(TRADES) + "SELECT DISTINCT instrument FROM trades")
def distinct(spark, sf_dir):
    return tab.distinct_values(line_trades(spark, sf_dir), "instrument")


LEVELS = [0.5, 0.55, 0.6, 0.65, 0.7]


@query("b10_threshold_counts", stages(BARS, *SCORED) + "SELECT symbol, " + ", ".join(
    f"count(*) FILTER (WHERE greatest(prob_up, 1 - prob_up) >= {t}) AS at_{int(round(t * 100))}" for t in LEVELS) + " FROM sc GROUP BY symbol")
def thresholds(spark, sf_dir):
    p = F.col("prob_up")
    return ev.threshold_counts(scored_bars(spark, sf_dir), ["symbol"], F.greatest(p, 1 - p), LEVELS)


@query("b11_repair", stages(BARS, "sh AS (SELECT symbol, ts, open, close, high * 0.9 AS high, low * 1.1 AS low FROM bars)")
       + f"SELECT symbol, ts, {r('greatest(open, high, close)')} AS high, {r('least(open, low, close)')} AS low FROM sh")
def repair(spark, sf_dir):
    bars = event_bars(spark, sf_dir).withColumns({"high": F.col("high") * 0.9, "low": F.col("low") * 1.1})
    return rounded(src.repair(bars).select("symbol", "ts", "high", "low"))


@query("b12_sanity", stages(BARS) + "SELECT symbol, count(*) AS bars, bool_and(open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL) AS no_nulls,"
       " bool_and(high >= low) AS high_ge_low, bool_and(high >= open) AS high_ge_open, bool_and(high >= close) AS high_ge_close,"
       " bool_and(low <= open) AS low_le_open, bool_and(low <= close) AS low_le_close FROM bars GROUP BY symbol")
def sane(spark, sf_dir):
    return src.sanity(event_bars(spark, sf_dir))


@query("b13_display_ledger", stages(TRADES) + "SELECT trade_id, (CASE WHEN pnl >= 0 THEN '+' ELSE '-' END) || '$' ||"
       " CAST(CAST(round(CAST(abs(pnl) AS DECIMAL(28,6)), 2) AS DECIMAL(26,2)) AS VARCHAR) AS pnl_text,"
       " CAST(CAST(round(CAST(pnl_percent AS DECIMAL(28,6)), 2) AS DECIMAL(26,2)) AS VARCHAR) || '%' AS pnl_percent_text FROM trades")
def display(spark, sf_dir):
    return tab.display_ledger(line_trades(spark, sf_dir)).select("trade_id", "pnl_text", "pnl_percent_text")


# ---- C: joins ----------------------------------------------------------------------------


@query("c01_features_with_target", stages(BARS, f"j AS (SELECT symbol, ts, {pct('close', lag('close'))} AS rt, {lead('close')} AS nx, close FROM bars)")
       + f"SELECT symbol, ts, {r('rt')} AS returns, CASE WHEN nx > close THEN 1 ELSE 0 END AS target FROM j WHERE nx IS NOT NULL")
def aligned(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    df = tab.features_with_target(ind.returns()(bars).select("symbol", "ts", "returns"), reg.add_binary_target(bars))
    return rounded(df)


@query("c02_same_row_series", stages(BARS, f"t AS (SELECT symbol, ts, high - low AS a, abs(high - {lag('close')}) AS b, abs(low - {lag('close')}) AS c FROM bars)")
       + f"SELECT symbol, ts, {r('greatest(a, b, c)')} AS true_range FROM t")
def same_row(spark, sf_dir):
    part = ind.indicator(1, lambda f: {"true_range": ind.true_range(f)})
    return rounded(part(event_bars(spark, sf_dir)).select("symbol", "ts", "true_range"))


@query("c03_concat", stages(BARS, NUM) + "SELECT symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY symbol")
def concat(spark, sf_dir):
    """Train and test parts put together again are the whole series."""
    parts = ev.chronological_split(event_bars(spark, sf_dir), bar_series(), 0.2)
    both = parts.where("role = 'train'").unionByName(parts.where("role = 'test'"))
    return both.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("c07_first_touch", recursive(*LEDGER) + f"SELECT symbol, ts, exit_rn AS touch_rn, exit_reason AS reason FROM ex3 WHERE exit_reason <> 'end_of_backtest'")
def first_touch(spark, sf_dir):
    """First stop or target touch of every entry signal, before the choice of non-overlapping trades."""
    prepared = led._prepare(RULES_ALL(event_bars(spark, sf_dir), keep_helpers=True), bar_series(), CFG, None)
    entries = prepared.where("_cand = 1").select("symbol", "_rn", "ts", "_long", "stop_loss", "take_profit")
    found = led.find_exits(entries, prepared, ["symbol"]).where("hit IS NOT NULL")
    touch = led._Touch(F.col("_long"), F.col("stop_loss"), F.col("take_profit"))
    return found.select("symbol", "ts", F.col("hit.id").alias("touch_rn"),
                        F.when(touch.stopped(F.col("hit")), "stop_loss").otherwise("take_profit").alias("reason"))


@query("c05_missing_columns", stages(*QUALITY) + f"SELECT feature AS \"column\", true AS present, {r('missing_pct')} AS missing_pct FROM q"
       " UNION ALL SELECT 'l_comment', false, NULL")
def absent(spark, sf_dir):
    """Expected columns with their presence and share of missing values."""
    lines = table(spark, sf_dir, "lineitem")
    expected = [*FEATURES, "l_comment"]
    missing = dr.missing_columns(spark, expected, lines.columns).select("column", F.lit(False).alias("present"), F.lit(None).cast("double").alias("missing_pct"))
    held = dr.column_quality(lines, FEATURES).select(F.col("feature").alias("column"), F.lit(True).alias("present"), "missing_pct")
    return rounded(held.unionByName(missing))


# ---- H: feature tables and evaluation -------------------------------------------------------

EMB = [f"f{i}" for i in range(64)]
UNPIV = "em AS (SELECT vec_id, label, 'f' || (i - 1) AS feature, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) u(i))"


@query("h01_top_variance", stages(UNPIV, "vr AS (SELECT feature, var_samp(v) AS variance FROM em GROUP BY feature)")
       + f"SELECT feature, {r('variance', 8)} AS variance FROM vr ORDER BY variance DESC, feature LIMIT 10")
def variance(spark, sf_dir):
    return rounded(ev.top_features(ev.feature_variances(embedding_features(spark, sf_dir), EMB), "variance", 10), 8)


for _m, _sql in (("standard", ("avg(v)", "stddev_pop(v)")), ("minmax", ("min(v)", "max(v) - min(v)"))):
    def scaled(spark, sf_dir, method=_m):
        df = embedding_features(spark, sf_dir)
        out = ev.apply_scaler(df, ev.fit_scaler(df, EMB, method), EMB)
        return rounded(out.select("vec_id", *EMB))
    query(f"h02_{_m}_scaler", stages(UNPIV, f"sc_ AS (SELECT feature, {_sql[0]} AS o, {_sql[1]} AS s FROM em GROUP BY feature)",
          "z AS (SELECT vec_id, feature, (v - o) / (CASE WHEN s = 0 THEN 1 ELSE s END) AS z FROM em JOIN sc_ USING (feature))")
          + "SELECT vec_id, " + ", ".join(f"{r(chr(109) + 'ax(z) FILTER (WHERE feature = ' + chr(39) + n + chr(39) + ')')} AS {n}" for n in EMB)
          + " FROM z GROUP BY vec_id")(scaled)


@query("h03_chronological_split", stages(BARS, NUM) + "SELECT symbol, ts, CASE WHEN i + 1 <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS role FROM nb")
def chrono(spark, sf_dir):
    return ev.chronological_split(event_bars(spark, sf_dir), bar_series()).select("symbol", "ts", "role")


@query("h04_validation_split", stages(BARS, NUM) + "SELECT symbol, ts, CASE WHEN i + 1 <= floor(floor(n * 0.8) * 0.8) THEN 'train'"
       " WHEN i + 1 <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS role FROM nb")
def nested(spark, sf_dir):
    return ev.chronological_split(event_bars(spark, sf_dir), bar_series(), 0.2, 0.2).select("symbol", "ts", "role")


@query("h05_expanding_folds", stages(BARS, NUM, "fo AS (SELECT *, n - (6 - k) * (n // 6) AS s, n // 6 AS z FROM nb, unnest(range(1, 6)) u(k))")
       + "SELECT symbol, CAST(k AS INTEGER) AS fold, count(*) FILTER (WHERE i + 1 <= s) AS train_rows,"
       " count(*) FILTER (WHERE i + 1 > s AND i + 1 <= s + z) AS test_rows FROM fo GROUP BY symbol, k")
def folds(spark, sf_dir):
    from candela.operators import walkforward as wf

    bars = event_bars(spark, sf_dir)
    df = ev.expanding_folds(wf.number_rows(bars), wf.series_lengths(bars), 5)
    return df.groupBy("symbol", "fold").agg(F.count_if(F.col("role") == "train").alias("train_rows"),
                                            F.count_if(F.col("role") == "test").alias("test_rows"))


@query("h10_hard_vote", stages(BARS, *SCORED) + "SELECT symbol, ts, CAST((CAST(prob_up > 0.5 AS INTEGER) + CAST(prob_alt > 0.5 AS INTEGER)"
       " + CAST(prob_3 > 0.5 AS INTEGER) + CAST(prob_4 > 0.5 AS INTEGER)) >= 2 AS INTEGER) AS vote FROM sc")
def hard_vote(spark, sf_dir):
    from candela.operators import ml

    return ml.hard_vote(scored_bars(spark, sf_dir), ["prob_up", "prob_alt", "prob_3", "prob_4"], 2).select("symbol", "ts", "vote")


@query("h13_classifier_metrics", stages(*CLASSES) + f"SELECT samples, correct, {r('accuracy')} AS accuracy, {r('wp')} AS precision, {r('wr')} AS recall, {r('wf')} AS f1_score FROM ac")
def classifier(spark, sf_dir):
    return rounded(ev.weighted_metrics(labelled(spark, sf_dir), []))


@query("h13_confusion", stages(LABELLED) + "SELECT y AS label, p AS prediction, count(*) AS n FROM lb GROUP BY 1, 2")
def confused(spark, sf_dir):
    return ev.confusion(labelled(spark, sf_dir), [])


TARGETED = [*SCORED, f"tg AS (SELECT symbol, ts, prob_up, CASE WHEN {lead('close')} > close THEN 1 WHEN {lead('close')} IS NOT NULL THEN 0 END AS y FROM sc)"]


def targeted(spark, sf_dir):
    step = ind.indicator(0, lambda f: {"label": (f.lead("close") > F.col("close")).cast("int")})
    from candela.functions.series import on_series

    df = on_series(scored_bars(spark, sf_dir), bar_series(), step.stage, lookahead=1)
    return df.where("label IS NOT NULL")


@query("h13_auc", stages(BARS, *TARGETED, "rk AS (SELECT symbol, y, rank() OVER q + (count(*) OVER (PARTITION BY symbol, prob_up) - 1) / 2.0 AS k"
       " FROM tg WHERE y IS NOT NULL WINDOW q AS (PARTITION BY symbol ORDER BY prob_up))")
       + f"SELECT symbol, {r('(sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0))')} AS auc FROM rk GROUP BY symbol")
def area(spark, sf_dir):
    return rounded(ev.auc(targeted(spark, sf_dir), ["symbol"], "label", "prob_up"))


@query("h14_binary_metrics", stages(BARS, *TARGETED, "b AS (SELECT symbol, y, CAST(prob_up > 0.5 AS INTEGER) AS p FROM tg WHERE y IS NOT NULL)",
       "m AS (SELECT symbol, avg(CASE WHEN y = p THEN 1.0 ELSE 0 END) AS a, coalesce(count(*) FILTER (WHERE y = 1 AND p = 1) / nullif(count(*) FILTER (WHERE p = 1), 0), 0) AS pr,"
       " coalesce(count(*) FILTER (WHERE y = 1 AND p = 1) / nullif(count(*) FILTER (WHERE y = 1), 0), 0) AS rc FROM b GROUP BY symbol)")
       + f"SELECT symbol, {r('a')} AS accuracy, {r('pr')} AS precision, {r('rc')} AS recall, {r('coalesce(2 * pr * rc / nullif(pr + rc, 0), 0)')} AS f1_score FROM m")
def binary(spark, sf_dir):
    df = targeted(spark, sf_dir).withColumn("prediction", (F.col("prob_up") > 0.5).cast("int"))
    return rounded(ev.binary_metrics(df, ["symbol"]))


@query("h15_importance_table", stages(UNPIV, "vr AS (SELECT feature, var_samp(v) AS variance FROM em GROUP BY feature)")
       + f"SELECT feature, {r('variance', 8)} AS variance, CAST(row_number() OVER o AS INTEGER) AS rank, {r('100 * variance / sum(variance) OVER ()')} AS importance_pct,"
       f" {r('100 * sum(variance) OVER (o ROWS UNBOUNDED PRECEDING) / sum(variance) OVER ()')} AS cumulative_pct FROM vr WINDOW o AS (ORDER BY variance DESC, feature)")
def importance(spark, sf_dir):
    scores = ev.feature_variances(embedding_features(spark, sf_dir), EMB)
    return rounded(ev.importance_table(scores, "variance"), 6, variance=8)


@query("h17_class_weights", f"SELECT label, count(*) AS n, {r('sum(count(*)) OVER () / (count(*) OVER () * count(*))')} AS weight FROM embeddings GROUP BY label")
def weights(spark, sf_dir):
    return rounded(ev.class_weights(table(spark, sf_dir, "embeddings").select("label")))


@query("h20_probability_summary", stages(BARS, *SCORED) + f"SELECT symbol, count(prob_up) AS n, {r('avg(prob_up)')} AS mean, {r('stddev_samp(prob_up)')} AS std,"
       f" {r('min(prob_up)')} AS min, {r('max(prob_up)')} AS max, {r('quantile_cont(prob_up, 0.25)')} AS q25, {r('median(prob_up)')} AS median,"
       f" {r('quantile_cont(prob_up, 0.75)')} AS q75 FROM sc GROUP BY symbol")
def probabilities(spark, sf_dir):
    return rounded(ev.probability_summary(scored_bars(spark, sf_dir), ["symbol"], "prob_up"))


@query("h21_prediction_table", stages(BARS, *SCORED) + f"SELECT symbol, ts, {r('1 - prob_up', 4)} AS prob_sell, {r('prob_up', 4)} AS prob_buy,"
       " CAST(prob_up > 0.5 AS INTEGER) AS predicted_class, CASE WHEN prob_up > 0.5 THEN 'BUY' ELSE 'SELL' END AS predicted_label FROM sc")
def predictions(spark, sf_dir):
    return rounded(ev.prediction_table(scored_bars(spark, sf_dir)), 4)


@query("h22_extremes", stages(BARS, *SCORED, "q AS (SELECT symbol, ts, round(prob_up, 4) AS p FROM sc)")
       + "(SELECT symbol, ts, p AS prob_up, 'top' AS \"end\" FROM q ORDER BY p DESC, ts, symbol LIMIT 10) UNION ALL"
       " (SELECT symbol, ts, p, 'bottom' FROM q ORDER BY p, ts, symbol LIMIT 10)")
def ends(spark, sf_dir):
    q = rounded(scored_bars(spark, sf_dir).select("symbol", "ts", "prob_up"), 4).withColumn("tie", F.struct("ts", "symbol"))
    return ev.extremes(q, "prob_up", 10, "tie").drop("tie")


@query("h23_model_comparison", stages(BARS, *TARGETED, "mm AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, symbol, ts, CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS INTEGER) AS p, y FROM tg WHERE y IS NOT NULL"
    for m, cond in (("follow", "prob_up > 0.5"), ("fade", "prob_up <= 0.5"), ("always", "true"))) + ")",
    "ma AS (SELECT model, avg(CASE WHEN p = y THEN 1.0 ELSE 0 END) AS acc FROM mm GROUP BY model)")
    + f"SELECT model, {r('acc')} AS accuracy, model = (SELECT arg_max(model, acc) FROM ma) AS best FROM ma")
def compared(spark, sf_dir):
    from candela.operators import ml

    df = targeted(spark, sf_dir)
    up = F.col("prob_up") > 0.5
    models = {"follow": up.cast("int"), "fade": (~up).cast("int"), "always": F.lit(1)}
    return rounded(ml.compare_models(df, "label", models).select("model", "accuracy", "best"))


@query("h24_class_distribution", "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY label")
def classes(spark, sf_dir):
    return rounded(ev.class_distribution(table(spark, sf_dir, "embeddings"), "label"))


@query("h26_describe", stages(LONG) + f"SELECT feature, count(v) AS n, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS std, {r('min(v)')} AS min, {r('max(v)')} AS max,"
       f" {r('quantile_cont(v, 0.25)')} AS q25, {r('median(v)')} AS median, {r('quantile_cont(v, 0.75)')} AS q75 FROM lf GROUP BY feature")
def describe(spark, sf_dir):
    values = dr.long_features(table(spark, sf_dir, "lineitem"), FEATURES)
    return rounded(ev.probability_summary(values, ["feature"], "value"))


@query("h27_metric_deltas", stages(TRADES, "m AS (SELECT strategy AS model, avg(pnl) AS a, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS w FROM trades GROUP BY 1)")
       + f"SELECT {r('max(a) FILTER (WHERE model = ' + chr(39) + 'R' + chr(39) + ') - max(a) FILTER (WHERE model = ' + chr(39) + 'A' + chr(39) + ')')} AS pnl_mean_delta,"
       f" {r('max(w) FILTER (WHERE model = ' + chr(39) + 'R' + chr(39) + ') - max(w) FILTER (WHERE model = ' + chr(39) + 'A' + chr(39) + ')')} AS win_rate_delta FROM m")
def deltas(spark, sf_dir):
    m = line_trades(spark, sf_dir).groupBy(F.col("strategy").alias("model")).agg(
        F.avg("pnl").alias("pnl_mean"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))
    return rounded(ev.metric_deltas(m, "A", "R", ["pnl_mean", "win_rate"]))


# ---- N: sorts, sets, scalars ------------------------------------------------------------------


@query("n02_largest_trades", stages(TRADES) + "SELECT trade_id, round(pnl, 4) + 0.0 AS pnl FROM trades ORDER BY round(pnl, 4) DESC, trade_id LIMIT 20")
def largest(spark, sf_dir):
    return rounded(line_trades(spark, sf_dir).select("trade_id", "pnl"), 4).orderBy(F.desc("pnl"), "trade_id").limit(20)


@query("n03_best_day", stages(TRADES, "d AS (SELECT instrument, CAST(exit_time AS DATE) AS day, round(sum(pnl), 4) AS p FROM trades GROUP BY 1, 2)")
       + "SELECT instrument, arg_min(day, (-p, day)) AS best_day, max(p) AS pnl FROM d GROUP BY instrument")
def best_day(spark, sf_dir):
    d = rounded(met.daily_pnl(line_trades(spark, sf_dir), ["instrument"]), 4)
    return d.groupBy("instrument").agg(F.min_by("day", F.struct(-F.col("pnl"), F.col("day"))).alias("best_day"), F.max("pnl").alias("pnl"))


@query("n04_set_operations", "(SELECT 'both' AS kind, l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT 'both', l_partkey FROM lineitem WHERE l_returnflag = 'R')"
       " UNION ALL (SELECT 'only_a', l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT 'only_a', l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def sets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    a, b = (lines.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("k")) for x in "AR")
    name = lambda df, kind: df.select(F.lit(kind).alias("kind"), "k")
    return name(a.intersect(b), "both").unionByName(name(a.exceptAll(a.intersect(b)).distinct().subtract(b), "only_a"))


@query("n05_math", stages(BARS) + f"SELECT symbol, ts, {r('ln(close)')} AS ln_close, {r('sqrt(close)')} AS sqrt_close, {r('exp(-close / 100)')} AS decay,"
       f" {r('greatest(1, least(100, close))')} AS clipped, CAST(sign(close - open) AS DOUBLE) AS direction FROM bars")
def maths(spark, sf_dir):
    k = F.col("close")
    return rounded(event_bars(spark, sf_dir).select(
        "symbol", "ts", F.log(k).alias("ln_close"), F.sqrt(k).alias("sqrt_close"), F.exp(-k / 100).alias("decay"),
        F.greatest(F.lit(1.0), F.least(F.lit(100.0), k)).alias("clipped"), F.signum(k - F.col("open")).alias("direction")))


@query("n06_dates", "SELECT o_orderkey, dayname(o_orderdate) AS day_name, last_day(o_orderdate) AS month_end, CAST(week(o_orderdate) AS INTEGER) AS iso_week,"
       " o_orderdate + INTERVAL 7 DAY AS week_later FROM orders")
def dates(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(d, "EEEE").alias("day_name"), F.last_day(d).alias("month_end"), F.weekofyear(d).alias("iso_week"),
        (d + F.expr("INTERVAL 7 DAYS")).alias("week_later"))


@query("n07_strings", "SELECT p_partkey, lower(p_brand) AS brand, contains(lower(p_name), 'ring') AS has_ring, concat_ws('/', p_brand, p_type) AS path,"
       " printf('%s_%05d', p_type, p_size) AS code FROM part")
def strings(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.lower("p_brand").alias("brand"), F.lower("p_name").contains("ring").alias("has_ring"),
        F.concat_ws("/", "p_brand", "p_type").alias("path"), F.format_string("%s_%05d", "p_type", "p_size").alias("code"))


@query("n08_ranked_scores", stages(TRADES, "s AS (SELECT strategy, instrument, round(sum(pnl), 4) AS p FROM trades GROUP BY 1, 2)")
       + "SELECT strategy, string_agg(instrument, ',' ORDER BY p DESC, instrument) AS ranking FROM s GROUP BY strategy")
def ranked(spark, sf_dir):
    """Instruments by total pnl as an ordered list: one entry per instrument, not per trade."""
    s = rounded(line_trades(spark, sf_dir).groupBy("strategy", "instrument").agg(F.sum("pnl").alias("p")), 4)
    order = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("o"), "instrument")))
    return s.groupBy("strategy").agg(F.concat_ws(",", F.transform(order, lambda x: x["instrument"])).alias("ranking"))


@query("n09_json_report", stages(TRADES) + "SELECT instrument, CAST(to_json({'trades': count(*), 'wins': count(*) FILTER (WHERE pnl > 0)}) AS VARCHAR) AS report FROM trades GROUP BY 1")
def json_report(spark, sf_dir):
    m = met.trade_stats(line_trades(spark, sf_dir), ["instrument"])
    return m.select("instrument", F.to_json(F.struct(F.col("total_trades").alias("trades"), F.col("winning_trades").alias("wins"))).cast("string").alias("report"))
