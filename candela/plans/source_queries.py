"""Source, sink, streaming and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.durable import materialize, scratch_path
from candela.functions.series import bar_series
from candela.operators import evaluation as ev
from candela.operators import indicators as ind
from candela.operators import ledger as led
from candela.operators import metrics as met
from candela.operators import ml
from candela.operators import regimes as reg
from candela.operators import signals as sig
from candela.operators import tables as tab
from candela.operators import walkforward as wf
from candela.plans.monitor_queries import AS_OF
from candela.plans.registry import query
from candela.plans.sqltext import BARS, LINE_BARS, TRADES, full, r, rounded, stages
from candela.plans.walkforward_queries import ASG, FREE, assigned, keyed_series, table_of
from candela.sources import bars as src
from candela.sources import broker, keyed_table, sinks
from candela.sources.driver_tables import embedding_features, event_bars, line_bars, line_trades, table
from candela.streaming import jobs

BAR_COLS = ["symbol", "ts", "open", "high", "low", "close", "volume"]
ALL_BARS = "SELECT symbol, ts, open, high, low, close, volume FROM bars"


# ---- A: scans ------------------------------------------------------------------------------


@query("a01_csv_bars", stages(BARS) + ALL_BARS)
def csv_bars(spark, sf_dir):
    """Bars written as CSV per symbol and scanned back with an explicit schema."""
    path = scratch_path(spark, "bars-csv")
    out = event_bars(spark, sf_dir).select(F.col("ts").alias("Date"), "close", "high", "low", "open", "volume", "symbol")
    sinks.write_csv(out, path, ("symbol",))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.CSV_BARS)
    raw = spark.read.schema(f"{fields}, symbol string").option("header", True).csv(path)
    return raw.select("symbol", F.col("Date").alias("ts"), "open", "high", "low", "close", "volume")


@query("a02_normalize_columns", stages(BARS) + ALL_BARS)
def normalize(spark, sf_dir):
    wide = event_bars(spark, sf_dir).toDF("Symbol", "TS", "Open_SPX", "('High', 'SPX')", "LOW", "Close", "Volume_SPX")
    return src.normalize_columns(wide)


@query("a03_candle_json", stages(BARS) + ALL_BARS + " WHERE volume > 1")
def candles(spark, sf_dir):
    """Candle documents of one day each, incomplete where the bar has a single tick, parsed back."""
    bars = event_bars(spark, sf_dir)
    text = lambda n: F.col(n).cast("string")
    candle = F.struct(
        text("ts").alias("time"), (F.col("volume") > 1).alias("complete"), "volume",
        F.struct(text("open").alias("o"), text("high").alias("h"), text("low").alias("l"), text("close").alias("c")).alias("mid"),
    )
    docs = bars.groupBy(F.col("symbol").alias("instrument"), F.to_date("ts").alias("day")).agg(F.collect_list(candle).alias("candles"))
    path = scratch_path(spark, "candles")
    sinks.write_json(docs.drop("day"), path)
    return src.read_candles_json(spark, path).select(*BAR_COLS)


@query("a04_combine_chunks", stages(BARS) + ALL_BARS)
def chunks(spark, sf_dir):
    """Two overlapping downloads; the first one wins where both have a bar."""
    bars = event_bars(spark, sf_dir)
    first = bars.where("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'").withColumn("chunk", F.lit(0))
    second = bars.where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'").withColumn("chunk", F.lit(1))
    later = second.withColumn("close", F.when(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"), -F.col("close")).otherwise(F.col("close")))
    return src.combine_chunks(first.unionByName(later)).select(*BAR_COLS)


TEXT_NUM = lambda n: F.col(n).cast("string")


@query("a05_closed_trades_json", stages(TRADES) + f"SELECT trade_id, instrument, direction, entry_time, exit_time, size, {r('pnl', 4)} AS pnl,"
       f" {r('100 * pnl / (size * entry_price)', 4)} AS pnl_percent, 'closed' AS status FROM trades")
def trades_json(spark, sf_dir):
    t = line_trades(spark, sf_dir)
    units = F.when(F.col("direction") == "long", F.col("size")).otherwise(-F.col("size"))
    doc = F.struct(
        F.col("trade_id").alias("id"), "instrument", units.cast("string").alias("initialUnits"), TEXT_NUM("entry_price").alias("price"),
        TEXT_NUM("pnl").alias("realizedPL"), TEXT_NUM("entry_time").alias("openTime"), TEXT_NUM("exit_time").alias("closeTime"),
    )
    text = t.select(F.to_json(F.struct(F.array(doc).alias("trades"))).alias("value"))
    docs = text.select(F.from_json("value", broker.TRADES).alias("d")).select("d.*")
    out = broker.closed_trades(docs)
    return rounded(out.select("trade_id", "instrument", "direction", "entry_time", "exit_time", "size", "pnl", "pnl_percent", "status"), 4)


OPEN_SQL = f"op AS (SELECT * FROM trades WHERE entry_time <= TIMESTAMP '{AS_OF}' AND exit_time > TIMESTAMP '{AS_OF}')"


@query("a06_positions_json", stages(TRADES, OPEN_SQL) + f"SELECT instrument || '_' || direction AS position_id, size,"
       f" {r('entry_price + pnl / size', 9)} AS current_price, {r('pnl', 4)} AS unrealized_pnl FROM op")
def positions_json(spark, sf_dir):
    end = F.lit(AS_OF).cast("timestamp_ntz")
    t = line_trades(spark, sf_dir).where((F.col("entry_time") <= end) & (F.col("exit_time") > end))

    def side(name):
        mine = F.col("direction") == name
        return F.struct(
            F.when(mine, TEXT_NUM("size")).otherwise("0").alias("units"), TEXT_NUM("entry_price").alias("averagePrice"),
            TEXT_NUM("pnl").alias("unrealizedPL"),
        ).alias(name)

    doc = F.struct("instrument", side("long"), side("short"))
    text = t.select(F.to_json(F.struct(F.array(doc).alias("positions"))).alias("value"))
    docs = text.select(F.from_json("value", broker.POSITIONS).alias("d")).select("d.*")
    return rounded(broker.open_positions(docs, AS_OF).select("position_id", "size", "current_price", "unrealized_pnl"), 4, current_price=9)


@query("a07_quotes_json", stages(BARS) + f"SELECT symbol AS instrument, ts, low AS bid, high AS ask, {r('high - low')} AS spread FROM bars")
def quotes(spark, sf_dir):
    level = lambda n: F.array(F.struct(TEXT_NUM(n).alias("price")))
    doc = F.struct(F.col("symbol").alias("instrument"), TEXT_NUM("ts").alias("time"), level("low").alias("bids"), level("high").alias("asks"))
    text = event_bars(spark, sf_dir).select(F.to_json(F.struct(F.array(doc).alias("prices"))).alias("value"))
    docs = text.select(F.from_json("value", broker.QUOTES).alias("d")).select("d.*")
    return rounded(broker.quotes(docs).select("instrument", "ts", "bid", "ask", "spread"))


@query("a08_recent_trades", stages(TRADES) + f"SELECT trade_id, exit_time FROM trades WHERE exit_time >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND exit_time <= TIMESTAMP '{AS_OF}'")
def recent_trades(spark, sf_dir):
    return tab.recent(line_trades(spark, sf_dir), "exit_time", AS_OF, "30 DAYS").select("trade_id", "exit_time")


@query("a09_all_trades", stages(TRADES) + "SELECT trade_id, instrument, direction, entry_time, exit_time, size FROM trades")
def all_trades(spark, sf_dir):
    return line_trades(spark, sf_dir).select("trade_id", "instrument", "direction", "entry_time", "exit_time", "size").orderBy(F.desc("exit_time"))


ALERT_SQL = "SELECT event_id, ts FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-20'"


@query("a10_recent_alerts", ALERT_SQL)
def recent_alerts(spark, sf_dir):
    alerts = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "ts")
    return tab.recent(alerts, "ts", "2024-01-20 00:00:00", "24 HOURS")


@query("a11_open_positions", stages(TRADES, OPEN_SQL) + "SELECT trade_id, instrument, direction, entry_time, size FROM op")
def positions(spark, sf_dir):
    end = F.lit(AS_OF).cast("timestamp_ntz")
    t = line_trades(spark, sf_dir)
    return t.where((F.col("entry_time") <= end) & (F.col("exit_time") > end)).select("trade_id", "instrument", "direction", "entry_time", "size")


VERSIONS = (
    "SELECT o_orderkey, o_orderstatus, arrival FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,"
    " CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS arrival FROM orders)"
)


def order_versions(spark, sf_dir):
    """Orders as a keyed table, and an update that closes the open ones."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(0).alias("arrival"))
    new = old.where("o_orderstatus = 'O'").withColumns({"o_orderstatus": F.lit("F"), "arrival": F.lit(1)})
    return old, new


@query("a12_upsert", VERSIONS)
def upserted(spark, sf_dir):
    old, new = order_versions(spark, sf_dir)
    root = scratch_path(spark, "orders")
    keyed_table.create(old, root, "o_orderkey")
    keyed_table.upsert_rows(spark, root, 1, new, "o_orderkey", "arrival")
    return keyed_table.read(spark, root, old.schema)


@query("a13_append_alerts", "SELECT event_id, ts FROM events WHERE event_type IN ('error', 'click')")
def appended(spark, sf_dir):
    path = scratch_path(spark, "alerts")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    for kind in ("error", "click"):
        sinks.append_alerts(events.where(F.col("event_type") == kind).drop("event_type"), path)
    return spark.read.parquet(path)


@query("a14_delete", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'")
def deleted(spark, sf_dir):
    old, new = order_versions(spark, sf_dir)
    root = scratch_path(spark, "positions")
    old = old.drop("arrival")
    keyed_table.create(old, root, "o_orderkey")
    keyed_table.delete_keys(spark, root, 1, new, "o_orderkey", old.schema)
    return keyed_table.read(spark, root, old.schema)


@query("a15_csv_sink", stages(*ASG) + "SELECT symbol, ts, close, split_num FROM asg WHERE role = 'test'")
def csv_sink(spark, sf_dir):
    path = scratch_path(spark, "splits-csv")
    rows = assigned(spark, sf_dir).where("role = 'test'").select("symbol", "ts", "close", "split_num")
    sinks.write_csv(rows, path, ("split_num",))
    return spark.read.schema("symbol string, ts timestamp_ntz, close double, split_num bigint").option("header", True).csv(path)


@query("a16_json_summary", stages(TRADES) + f"SELECT count(*) AS total_trades, {r('sum(pnl)', 4)} AS total_pnl FROM trades")
def json_summary(spark, sf_dir):
    path = scratch_path(spark, "summary")
    stats = line_trades(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_trades"), F.sum("pnl").alias("total_pnl"))
    sinks.write_json(rounded(stats, 4), path)
    return spark.read.schema("total_trades bigint, total_pnl double").json(path)


@query("a17_markdown_report", stages(TRADES, "g AS (SELECT instrument, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS w FROM trades GROUP BY 1)")
       + "SELECT 4 AS part, instrument AS sort_key, '| ' || instrument || ' | ' || n || ' | ' || w || ' |' AS line FROM g UNION ALL"
       " SELECT * FROM (VALUES (0, '', '# Instruments'), (1, '', ''), (2, '', '| instrument | total_trades | winning_trades |'), (3, '', '|---|---|---|'))")
def markdown(spark, sf_dir):
    m = met.trade_stats(line_trades(spark, sf_dir), ["instrument"])
    return sinks.markdown_report(m, ["instrument", "total_trades", "winning_trades"], "instrument", "Instruments")


@query("a19_split_dataset", stages(*ASG) + "SELECT symbol, ts, close, (SELECT count(DISTINCT split_num) FROM asg) AS splits FROM asg WHERE split_num = 2 AND role = 'train'")
def split_dataset(spark, sf_dir):
    path = scratch_path(spark, "splits")
    sinks.write_splits(assigned(spark, sf_dir).select("symbol", "ts", "close", "split_num", "role"), path)
    one = sinks.read_split(spark, path, 2, "train").select("symbol", "ts", "close")
    return one.crossJoin(F.broadcast(sinks.count_splits(spark, path)))


for _g, _sql in (("H1", "date_trunc('hour', e.ts)"), ("M15", "time_bucket(INTERVAL 15 MINUTE, e.ts)"), ("H4", "time_bucket(INTERVAL 4 HOUR, e.ts, TIMESTAMP '2000-01-01')"),
                 ("D", "date_trunc('day', e.ts)"), ("W", "date_trunc('week', e.ts)")):
    def ticks(spark, sf_dir, g=_g):
        return event_bars(spark, sf_dir, g).select(*BAR_COLS)
    query(f"a20_bars_{_g.lower()}", stages(BARS.replace("date_trunc('hour', e.ts) AS ts", f"CAST({_sql} AS TIMESTAMP) AS ts")) + ALL_BARS)(ticks)


@query("a20_daily_line_bars", stages(LINE_BARS) + f"SELECT symbol, ts, {r('open', 8)} AS open, {r('high', 8)} AS high, {r('low', 8)} AS low, {r('close', 8)} AS close, volume FROM dbars")
def daily_bars(spark, sf_dir):
    return rounded(line_bars(spark, sf_dir).select(*BAR_COLS), 8)


# ---- M: streams, run to the end of what is there ----------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def run_stream(query_) -> None:
    query_.awaitTermination()
    if query_.exception():
        raise query_.exception()


@query("m01_live_bars", stages(BARS) + ALL_BARS
       + " WHERE ts + INTERVAL 1 HOUR <= (SELECT max(e2.ts) FROM events e2) - INTERVAL 10 MINUTE")
def live(spark, sf_dir):
    path, mark = scratch_path(spark, "live"), scratch_path(spark, "live-mark")
    run_stream(jobs.start(jobs.live_bars(event_stream(spark, sf_dir), "event_type", "ts", "value", tie="event_id"), path, mark))
    return spark.read.schema("symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint").parquet(path)


@query("m02_sync_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def sync(spark, sf_dir):
    root, mark = scratch_path(spark, "sync"), scratch_path(spark, "sync-mark")
    rows = event_stream(spark, sf_dir).select("user_id", "event_type", "ts", F.struct("ts", "event_id").alias("arrival"))
    run_stream(jobs.per_batch(rows, jobs.sync_handler(root, "user_id", "arrival"), mark))
    return keyed_table.read(spark, root, rows.schema).drop("arrival")


@query("m03_periodic_health", "SELECT event_type AS instrument, count(*) AS total_trades, count(*) FILTER (WHERE value > 50) AS winning_trades FROM events GROUP BY 1")
def periodic(spark, sf_dir):
    """Each batch adds its counts to those before it; the report on all trades so far is written per batch."""
    states, path, mark = (scratch_path(spark, n) for n in ("health-states", "health", "health-mark"))
    rows = event_stream(spark, sf_dir).select(F.col("event_type").alias("instrument"), "ts", (F.col("value") - 50).alias("pnl"))
    counts = lambda df: met.trade_stats(df, ["instrument"]).select("instrument", "total_trades", "winning_trades")
    run_stream(jobs.per_batch(rows, jobs.report_handler(states, path, ["instrument"], counts, lambda state: state), mark))
    out = spark.read.parquet(path)
    newest = out.agg(F.max("report").alias("_last"))
    return out.join(F.broadcast(newest), out.report == F.col("_last")).select("instrument", "total_trades", "winning_trades")


@query("m04_stream_dedupe", "SELECT event_id, ts, event_type FROM events")
def dedupe(spark, sf_dir):
    path, mark = scratch_path(spark, "dedupe"), scratch_path(spark, "dedupe-mark")
    once = event_stream(spark, sf_dir).select("event_id", "ts", "event_type")
    run_stream(jobs.start(jobs.without_repeats(once.union(once), ["event_id"], "ts"), path, mark))
    return spark.read.schema("event_id bigint, ts timestamp_ntz, event_type string").parquet(path)


@query("m05_live_indicators", stages(BARS) + f"SELECT symbol, ts, {r(full(20, 'close'))} AS sma_20 FROM bars")
def live_indicators(spark, sf_dir):
    """Bars arrive as a stream of files; each batch computes its indicators over the trailing history."""
    feed, history, path, mark = (scratch_path(spark, n) for n in ("feed", "bar-history", "indicators", "indicator-mark"))
    event_bars(spark, sf_dir).write.parquet(feed)
    bars = spark.readStream.schema(spark.read.parquet(feed).schema).parquet(feed)
    handle = jobs.indicator_handler(history, path, ind.sma((20,)), 20, ["symbol"], "ts")
    run_stream(jobs.per_batch(bars, handle, mark))
    return rounded(spark.read.parquet(path).select("symbol", "ts", "sma_20"))
