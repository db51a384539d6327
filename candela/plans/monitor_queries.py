"""Health queries on trades per instrument; drift and quality queries on order lines and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import drift as dr
from candela.operators import health as hl
from candela.operators import metrics as met
from candela.plans.metric_queries import AS_OF, CUM, DASH, K, ORDER, RECENT
from candela.plans.registry import query
from candela.plans.fitted_scores import scored_bars
from candela.plans.signal_queries import CONF, SCORED
from candela.plans.sqltext import BARS, TRADE_ORDER, TRADES, r, rounded, stages
from candela.sources.driver_tables import pnl_trades, table, trade_series

END = f"TIMESTAMP '{AS_OF}'"
DESC = ", ".join(f"{n} DESC" for n in ORDER)
STATE = [
    TRADES,
    f"past AS (SELECT * FROM trades WHERE exit_time <= {END})",
    "h1 AS (SELECT *, sum(pnl) OVER w AS cum, row_number() OVER w AS rn FROM past"
    f" WINDOW w AS (PARTITION BY instrument ORDER BY {TRADE_ORDER} ROWS UNBOUNDED PRECEDING))",
    "h2 AS (SELECT *, max(cum) OVER (PARTITION BY instrument ORDER BY rn ROWS UNBOUNDED PRECEDING) AS peak,"
    f" row_number() OVER (PARTITION BY instrument ORDER BY {DESC}) AS rr FROM h1)",
    "h3 AS (SELECT instrument, count(*) AS trades,"
    f" count(*) FILTER (WHERE exit_time >= {END} - INTERVAL 30 DAY) AS nr,"
    f" coalesce(avg(pnl_percent) FILTER (WHERE exit_time >= {END} - INTERVAL 30 DAY) /"
    f" nullif(stddev_pop(pnl_percent) FILTER (WHERE exit_time >= {END} - INTERVAL 30 DAY), 0), 0) * sqrt(252) AS sh,"
    " abs((arg_max(cum, rn) - arg_max(peak, rn)) / nullif(abs(arg_max(peak, rn)), 0)) AS fall,"
    " max(rn) - coalesce(max(rn) FILTER (WHERE pnl > 0), 0) AS lost,"
    " avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE rr <= 30) AS wr30,"
    " avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE rr <= 100) AS wr100 FROM h2 GROUP BY instrument)",
    "h4 AS (SELECT *, CASE WHEN trades >= 20 AND nr >= 10 THEN sh ELSE 0 END AS sharpe FROM h3)",
    # the baseline is the record of the years before
    "b0 AS (SELECT instrument, avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) AS bwr,"
    " coalesce(avg(pnl_percent) / nullif(stddev_pop(pnl_percent), 0), 0) * sqrt(252) AS bsh,"
    " coalesce(sum(pnl) FILTER (WHERE pnl > 0) / nullif(abs(sum(pnl) FILTER (WHERE pnl <= 0)), 0), 0) AS bpf"
    " FROM trades WHERE exit_time < TIMESTAMP '1999-01-01' GROUP BY instrument)",
    "h5 AS (SELECT h4.*, bwr, bsh, CASE WHEN trades >= 50 THEN least(0.7 * abs(wr30 - bwr) / bwr + 0.3 * abs(wr100 - bwr) / bwr, 1) ELSE 0 END AS drift,"
    " CASE WHEN trades >= 30 AND bwr <> 0 AND bsh <> 0 THEN least((abs(wr30 - bwr) + abs(sharpe - bsh) / greatest(abs(bsh), 1)) / 2, 1) ELSE 0 END AS broken"
    " FROM h4 LEFT JOIN b0 USING (instrument))",
    "h6 AS (SELECT *, CASE WHEN lost >= 5 OR coalesce(fall, 0) > 0.15 OR wr30 < 0.3 THEN 'failed'"
    " WHEN sharpe < -0.5 OR wr30 < 0.35 OR drift > 0.5 THEN 'critical' ELSE 'warning' END AS status FROM h5)",
]


def baseline(trades):
    old = trades.where("exit_time < TIMESTAMP_NTZ '1999-01-01 00:00:00'")
    m = met.dashboard_metrics(old, trade_series(), saved=True).withColumn("win_rate", F.col("win_rate") / 100)
    return hl.baseline_from_metrics(m, K)


def health(trades):
    """``trades`` are saved: the baseline and each health figure read them again."""
    return hl.check_health(trades, trade_series(), AS_OF, baseline(trades))


ALERT = {
    "critical;Risk Limit;daily": "l < -0.05", "warning;Risk Warning;daily": "l < -0.05 * 0.7 AND l >= -0.05",
    "critical;Risk Limit;dd": "f > 0.15", "warning;Risk Warning;dd": "f > 0.15 * 0.8 AND f <= 0.15",
    "warning;Performance;wr": "total_trades >= 5 AND win_rate < 30", "warning;Performance;sh": "total_trades >= 20 AND sharpe_ratio < 0",
}
TEXT = {
    "daily": {"critical": "'Daily loss limit exceeded: ' || printf('%.2f%%', l * 100) || ' (Limit: -5.00%)'",
              "warning": "'Approaching daily loss limit: ' || printf('%.2f%%', l * 100)"},
    "dd": {"critical": "'Maximum drawdown exceeded: ' || printf('%.2f%%', f * 100) || ' (Limit: 15.00%)'",
           "warning": "'Approaching max drawdown: ' || printf('%.2f%%', f * 100)"},
    "wr": {"warning": "'Low win rate detected: ' || printf('%.1f%%', win_rate)"},
    "sh": {"warning": "'Negative Sharpe ratio: ' || printf('%.2f', sharpe_ratio)"},
}


@query("k01_risk_alerts", stages(
    *CUM, "m AS (SELECT instrument, count(*) AS total_trades, " + ", ".join(f"{e} AS {n}" for n, e in DASH.items())
    + f", {RECENT} AS daily FROM c2 GROUP BY instrument)", "a AS (SELECT *, daily / 10000 AS l, current_drawdown / 10000 AS f FROM m)")
    + " UNION ALL ".join(f"SELECT instrument, '{k.split(';')[0]}' AS level, '{k.split(';')[1]}' AS category,"
                         f" {TEXT[k.split(';')[2]][k.split(';')[0]]} AS message FROM a WHERE {cond}" for k, cond in ALERT.items()))
def alerts(spark, sf_dir):
    trades = pnl_trades(spark, sf_dir, entry=False)
    m = met.dashboard_metrics(trades, trade_series(), saved=True).join(met.recent_pnl(trades, K, AS_OF), K)
    return hl.risk_alerts(m, K, F.col("recent_pnl"), F.lit(10000.0))


def state_query(name, cols, pick):
    @query(name, stages(*STATE) + f"SELECT instrument, {cols} FROM h6")
    def run(spark, sf_dir):
        return rounded(health(pnl_trades(spark, sf_dir, entry=False)).select(*K, *pick))


state_query("k02_recent_win_rates", f"{r('wr30')} AS win_rate_30, {r('wr100')} AS win_rate_100", ["win_rate_30", "win_rate_100"])
state_query("k03_rolling_sharpe", f"{r('sharpe')} AS sharpe_30d", ["sharpe_30d"])
state_query("k04_current_drawdown", f"{r('fall')} AS current_drawdown", ["current_drawdown"])
state_query("k05_losing_streak", "lost AS consecutive_losses", ["consecutive_losses"])
state_query("k06_win_rate_drift", f"{r('drift')} AS model_drift_score", ["model_drift_score"])
state_query("k07_correlation_breakdown", f"{r('broken')} AS correlation_breakdown", ["correlation_breakdown"])


@query("k08_prediction_confidence", stages(
    BARS, *SCORED, f"p AS (SELECT symbol, {CONF} AS cf, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rr FROM sc)")
    + f"SELECT symbol, {r('avg(cf)')} AS prediction_confidence FROM p WHERE rr <= 20 GROUP BY symbol")
def confidence(spark, sf_dir):
    p = F.col("prob_up")
    scored = scored_bars(spark, sf_dir).withColumn("confidence", F.greatest(p, 1 - p))
    return rounded(hl.prediction_confidence(scored, ["symbol"], ["ts"]))


NOTES = [
    ("wr30 < 0.45", "'Win rate dropped to ' || printf('%.1f%%', wr30 * 100) || ' (threshold: 45.0%)'"),
    ("sharpe < 0.5", "'Sharpe ratio at ' || printf('%.2f', sharpe) || ' (threshold: 0.50)'"),
    ("lost >= 5", "'Consecutive losses: ' || lost || ' (threshold: 5)'"),
    ("coalesce(fall, 0) > 0.15", "'Drawdown at ' || printf('%.1f%%', fall * 100) || ' (threshold: 15.0%)'"),
    ("drift > 0.3", "'Model drift detected: ' || printf('%.2f', drift)"),
    ("broken > 0.5", "'Correlation breakdown: ' || printf('%.2f', broken)"),
]
ACTION = "CASE status WHEN 'failed' THEN 'stop_trading' WHEN 'critical' THEN 'close_positions' WHEN 'healthy' THEN 'continue' ELSE 'reduce_size' END"


@query("k09_health_status", stages(*STATE) + f"SELECT instrument, status, {ACTION} AS recommended_action, concat_ws(' | ', "
       + ", ".join(f"CASE WHEN {a} THEN {b} END" for a, b in NOTES) + ") AS warnings FROM h6")
def status(spark, sf_dir):
    return health(pnl_trades(spark, sf_dir, entry=False)).select(*K, "status", "recommended_action", F.concat_ws(" | ", "warnings").alias("warnings"))


@query("k10_baseline", stages(*STATE) + f"SELECT instrument, {r('bwr')} AS baseline_win_rate, {r('bsh')} AS baseline_sharpe,"
       f" {r('bpf')} AS baseline_profit_factor FROM b0")
def base(spark, sf_dir):
    return rounded(baseline(pnl_trades(spark, sf_dir, entry=False)))


@query("k11_recovery_plan", stages(
    *STATE, f"op AS (SELECT instrument, count(*) AS n FROM trades WHERE entry_time <= {END} AND exit_time > {END} GROUP BY 1)")
    + f"SELECT instrument, status, {ACTION} AS recommended_action, CAST(CASE WHEN status IN ('failed', 'critical') THEN 0 WHEN status = 'healthy' THEN 1 ELSE 0.5 END AS DOUBLE) AS size_multiplier,"
    " status IN ('failed', 'critical') AS pause_trading, CASE WHEN status IN ('failed', 'critical') THEN coalesce(n, 0) ELSE 0 END AS positions_to_close,"
    " status = 'healthy' AND coalesce(wr30 > 0.52 AND sharpe > 1.0, false) AS restore_size FROM h6 LEFT JOIN op USING (instrument)")
def recovery(spark, sf_dir):
    end = F.lit(AS_OF).cast("timestamp_ntz")
    trades = pnl_trades(spark, sf_dir)
    open_ = trades.where((F.col("entry_time") <= end) & (F.col("exit_time") > end))
    return hl.recovery_plan(health(trades), open_, K)


# ---- drift and quality -----------------------------------------------------------------

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CUT = "1999-01-01 00:00:00"
LONG = "lf AS (UNPIVOT (SELECT l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE v)"
SIDES = [LONG, f"bs AS (SELECT * FROM lf WHERE l_shipdate < TIMESTAMP '{CUT}')", f"cu AS (SELECT * FROM lf WHERE l_shipdate >= TIMESTAMP '{CUT}')"]
PROFILE = ("pf AS (SELECT feature, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q25,"
           " quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75 FROM bs GROUP BY feature)")
SHARES = [
    ("s_ AS (SELECT feature, avg(CASE WHEN v < q25 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN v >= q25 AND v < q50 THEN 1.0 ELSE 0 END) AS b,"
     " avg(CASE WHEN v >= q50 AND v < q75 THEN 1.0 ELSE 0 END) AS c, avg(CASE WHEN v >= q75 THEN 1.0 ELSE 0 END) AS d FROM cu JOIN pf USING (feature) GROUP BY feature)"),
    "psi_ AS (SELECT feature, " + " + ".join(f"((CASE WHEN {x} = 0 THEN 0.0001 ELSE {x} END) - 0.25) * ln((CASE WHEN {x} = 0 THEN 0.0001 ELSE {x} END) / 0.25)" for x in "abcd") + " AS psi FROM s_)",
]


def sides(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", *FEATURES)
    cut = F.lit(CUT).cast("timestamp_ntz")
    return lines.where(F.col("l_shipdate") < cut), lines.where(F.col("l_shipdate") >= cut)


LABELLED = "lb AS (SELECT doc_id, quality AS y, toxic AS p FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"
CLASSES = [
    LABELLED,
    "cm AS (SELECT c.cls, count(*) FILTER (WHERE y = cls AND p = cls) AS hit, count(*) FILTER (WHERE p = cls) AS said, count(*) FILTER (WHERE y = cls) AS real"
    " FROM lb, (SELECT DISTINCT y AS cls FROM lb UNION SELECT DISTINCT p FROM lb) c GROUP BY c.cls)",
    "c2 AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS pr, coalesce(hit / nullif(real, 0), 0) AS rc FROM cm)",
    "c3 AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f FROM c2)",
    "ac AS (SELECT CAST(sum(real) AS BIGINT) AS samples, CAST(sum(hit) AS BIGINT) AS correct, sum(hit) / sum(real) AS accuracy,"
    " sum(pr * real) / sum(real) AS wp, sum(rc * real) / sum(real) AS wr, sum(f * real) / sum(real) AS wf FROM c3)",
]
PMF = "exp(lgamma(samples + 1) - lgamma({k} + 1) - lgamma(samples - {k} + 1) + {k} * ln(0.55) + (samples - {k}) * ln(0.45))"
BINOM = [
    f"pm AS (SELECT i, {PMF.format(k='i')} AS q, {PMF.format(k='correct')} AS o FROM ac, unnest(range(samples + 1)) u(i))",
    "pv AS (SELECT least(1, sum(q) FILTER (WHERE q <= o * (1 + 1e-7))) AS p_value FROM pm)",
]
PDRIFT = [
    "dn AS (SELECT p, row_number() OVER (ORDER BY doc_id DESC) AS rr FROM lb)",
    "pd AS (SELECT CASE WHEN count(*) >= 200 THEN abs(avg(p) FILTER (WHERE rr <= 100) - avg(p) FILTER (WHERE rr > 100 AND rr <= 500)) ELSE 0 END AS drift FROM dn)",
]


def labelled(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
    return df.dropna(subset=["label", "prediction"])


def accuracy(spark, sf_dir):
    return dr.check_accuracy(labelled(spark, sf_dir), "doc_id")


ACC = [*CLASSES, *BINOM, *PDRIFT,
       "rp AS (SELECT *, (0.55 - accuracy) / 0.55 AS loss, samples >= 30 AND p_value < 0.05 AS sig FROM ac, pv, pd)"]
ACC_SELECT = (f"{r('accuracy')} AS accuracy, {r('wf')} AS f1_score, {r('loss')} AS accuracy_degradation, sig AS significant,"
              " CASE WHEN loss > 0.15 OR drift > 0.3 THEN 'retrain_immediately' WHEN loss > 0.1 OR drift > 0.2 THEN 'schedule_retraining'"
              " WHEN loss > 0.05 THEN 'monitor_closely' ELSE 'continue_monitoring' END AS recommended_action, sig AND loss > 0.1 AS concept_drift_detected")


@query("l01_accuracy_report", stages(*ACC) + f"SELECT {ACC_SELECT} FROM rp")
def accuracy_report(spark, sf_dir):
    return rounded(accuracy(spark, sf_dir).select(
        "accuracy", "f1_score", "accuracy_degradation", "significant", "recommended_action", "concept_drift_detected"))


@query("l02_binomial_test", stages(*CLASSES, *BINOM) + f"SELECT {r('p_value')} AS p_value FROM pv")
def binomial(spark, sf_dir):
    return rounded(accuracy(spark, sf_dir).select("p_value"))


@query("l03_prediction_drift", stages(LABELLED, *PDRIFT) + f"SELECT {r('drift')} AS prediction_drift FROM pd")
def pdrift(spark, sf_dir):
    return rounded(dr.prediction_drift(labelled(spark, sf_dir), "doc_id"))


@query("l04_feature_profile", stages(*SIDES, PROFILE) + f"SELECT feature, {r('mean')} AS mean, {r('std')} AS std, {r('lo')} AS min, {r('hi')} AS max,"
       f" {r('q25')} AS q25, {r('q50')} AS q50, {r('q75')} AS q75 FROM pf")
def profile(spark, sf_dir):
    return rounded(dr.feature_profile(sides(spark, sf_dir)[0], FEATURES))


@query("l05_psi", stages(*SIDES, PROFILE, *SHARES) + f"SELECT feature, {r('psi')} AS psi FROM psi_")
def stability(spark, sf_dir):
    base_, cur = sides(spark, sf_dir)
    return rounded(dr.psi(cur, dr.feature_profile(base_, FEATURES), FEATURES))


KS = [
    "u AS (SELECT feature, v, count(*) FILTER (WHERE l_shipdate < TIMESTAMP '" + CUT + "') AS b, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '" + CUT + "') AS c FROM lf GROUP BY 1, 2)",
    "k AS (SELECT feature, sum(b) OVER w AS cb, sum(c) OVER w AS cc, sum(b) OVER (PARTITION BY feature) AS nb, sum(c) OVER (PARTITION BY feature) AS nc"
    " FROM u WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING))",
]


@query("l06_ks_statistic", stages(LONG, *KS) + f"SELECT feature, {r('max(abs(cb / nb - cc / nc))')} AS ks FROM k GROUP BY feature")
def ks(spark, sf_dir):
    return rounded(dr.ks_statistic(*sides(spark, sf_dir), FEATURES))


DSUM = "ds AS (SELECT avg(psi) AS overall, count(*) FILTER (WHERE psi > 0.0001) AS nd, count(*) AS nf FROM psi_)"


@query("l07_drift_summary", stages(*SIDES, PROFILE, *SHARES, DSUM) + f"SELECT {r('overall')} AS overall_drift_score,"
       " (SELECT string_agg(feature, ',' ORDER BY psi DESC) FROM psi_ WHERE psi > 0.0001) AS drifted_features, nf AS total_features,"
       " nd AS features_drifted, overall > 0.0001 AS needs_attention FROM ds")
def summary(spark, sf_dir):
    base_, cur = sides(spark, sf_dir)
    out = dr.drift_summary(dr.psi(cur, dr.feature_profile(base_, FEATURES), FEATURES), threshold=0.0001)
    return rounded(out.withColumn("drifted_features", F.concat_ws(",", "drifted_features")))


QUALITY = [
    LONG,
    "mo AS (SELECT feature, avg(v) AS m, stddev_samp(v) AS sd FROM lf GROUP BY feature)",
    "q AS (SELECT feature, 1 - count(v) / (SELECT count(*) FROM lineitem) AS missing_pct, any_value(sd) AS sd,"
    " avg(CASE WHEN sd > 0 AND abs(v - m) > 5 * sd THEN 1.0 ELSE 0 END) AS outlier_pct FROM lf JOIN mo USING (feature) GROUP BY feature)",
]
for _n, _c in (("l08_missing_share", "{r} AS missing_pct, missing_pct > 0.05 AS high_missing"),
               ("l09_constant_columns", "{s} AS std, coalesce(sd = 0, false) AS constant"),
               ("l10_outlier_share", "{o} AS outlier_pct, outlier_pct > 0.01 AS high_outliers")):
    def make(names):
        def run(spark, sf_dir):
            q = dr.column_quality(table(spark, sf_dir, "lineitem"), FEATURES)
            return rounded(q.select("feature", *names))
        return run
    _names = {"l08": ["missing_pct", "high_missing"], "l09": ["std", "constant"], "l10": ["outlier_pct", "high_outliers"]}[_n[:3]]
    query(_n, stages(*QUALITY) + "SELECT feature, " + _c.format(r=r("missing_pct"), s=r("sd"), o=r("outlier_pct")) + " FROM q")(make(_names))


@query("l11_recency", "SELECT CAST(floor(date_diff('second', max(ts), TIMESTAMP '2024-03-01') / 86400) AS BIGINT) AS days_since_update,"
       " floor(date_diff('second', max(ts), TIMESTAMP '2024-03-01') / 86400) > 7 AS stale FROM events")
def fresh(spark, sf_dir):
    return dr.recency(table(spark, sf_dir, "events"), "ts", "2024-03-01 00:00:00")


SCORE = ("qs AS (SELECT greatest(0, 1 - 0.1 - least(avg(missing_pct), 0.3) - 0.05 * count(*) FILTER (WHERE coalesce(sd = 0, false))) AS score,"
         " avg(missing_pct) AS miss, count(*) FILTER (WHERE coalesce(sd = 0, false)) AS cf, bool_or(coalesce(sd = 0, false)) AS bad FROM q)")


def quality(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return dr.quality_score(dr.column_quality(lines, FEATURES), missing=1)  # one expected column is absent


@query("l12_quality_score", stages(*QUALITY, SCORE) + f"SELECT {r('score')} AS quality_score, {r('miss')} AS missing_pct, cf AS constant_features, 1 > 0 OR bad AS has_issues FROM qs")
def score(spark, sf_dir):
    return rounded(quality(spark, sf_dir))


def parts(spark, sf_dir):
    base_, cur = sides(spark, sf_dir)
    drift = dr.drift_summary(dr.psi(cur, dr.feature_profile(base_, FEATURES), FEATURES))
    return accuracy(spark, sf_dir), drift, quality(spark, sf_dir)


ALL = [*SIDES, PROFILE, *SHARES, DSUM, *ACC, *QUALITY[1:], SCORE]


@query("l13_retrain_decision", stages(*ALL, "dc AS (SELECT concat_ws('; ', CASE WHEN accuracy < 0.45 THEN 'Accuracy below threshold: ' || printf('%.1f%%', accuracy * 100) || ' < 45.0%' END,"
       " CASE WHEN loss > 0.15 THEN 'Significant accuracy degradation: ' || printf('%.1f%%', loss * 100) END,"
       " CASE WHEN overall > 0.15 THEN 'High feature drift: ' || printf('%.2f', overall) END,"
       " CASE WHEN sig AND loss > 0.1 THEN 'Concept drift detected (significant performance change)' END,"
       " CASE WHEN DATE '2024-03-01' - DATE '2024-01-01' >= 30 THEN 'Scheduled retraining (' || (DATE '2024-03-01' - DATE '2024-01-01') || ' days since last retrain)' END) AS why, score FROM rp, ds, qs)")
       + "SELECT score >= 0.7 AS should_retrain, CASE WHEN score < 0.7 THEN 'Data quality too low for retraining' ELSE why END AS reason FROM dc")
def decision(spark, sf_dir):
    return dr.retrain_decision(*parts(spark, sf_dir), "2024-01-01", "2024-03-01")


@query("l14_retrain_window", f"SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 14 DAY"
       " AND ts <= TIMESTAMP '2024-01-25' GROUP BY event_type")
def window(spark, sf_dir):
    df = dr.retrain_window(table(spark, sf_dir, "events"), "ts", "2024-01-25 00:00:00", 14)
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("l15_overall_status", stages(*ALL) + f"SELECT CASE WHEN loss > 0.15 OR overall > 0.3 OR score < 0.5 THEN 'CRITICAL' WHEN loss > 0.1 OR overall > 0.2 OR score < 0.7 THEN 'WARNING'"
       f" WHEN loss > 0.05 THEN 'MONITOR' ELSE 'HEALTHY' END AS overall_status, {r('accuracy')} AS accuracy, {r('overall')} AS drift, {r('score')} AS quality FROM rp, ds, qs")
def full_status(spark, sf_dir):
    df = dr.overall_status(*parts(spark, sf_dir))
    return rounded(df.select("overall_status", F.col("model_health.accuracy").alias("accuracy"),
                             F.col("drift_analysis.overall_drift_score").alias("drift"), F.col("data_quality.quality_score").alias("quality")))
