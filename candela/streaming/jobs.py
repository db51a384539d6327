"""Live bars, table sync, health checks and indicators as streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candela.sources import keyed_table
from candela.sources.bars import GRANULARITY_MINUTES, clock_micros, tick_rank


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need instants: a plain timestamp is taken as that of a clock without a zone."""
    return df.withColumn(ts, F.timestamp_micros(clock_micros(ts, dict(df.dtypes)[ts])))


def _clock_time(instant: Column) -> Column:
    """The plain timestamp of an instant made by :func:`_event_time`."""
    seconds = (F.unix_micros(instant) / F.lit(1_000_000).cast("decimal(18,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def live_bars(
    ticks: DataFrame, symbol: str, ts: str, price: str, granularity="H1", delay="10 minutes", tie: str | None = None
) -> DataFrame:
    """Bars of a tick stream.  In append mode a bar appears once the watermark has passed its end, so it is complete."""
    p = F.col(price)
    plain = dict(ticks.dtypes)[ts] == "timestamp_ntz"
    ticks = _event_time(ticks, ts)
    rank = tick_rank(ts, tie, "timestamp") if tie else F.col(ts)
    start_ = _clock_time(F.col("_w.start")) if plain else F.col("_w.start")
    span = F.window(ts, f"{GRANULARITY_MINUTES[granularity]} minutes")
    return (
        ticks.withWatermark(ts, delay)
        .groupBy(F.col(symbol).alias("symbol"), span.alias("_w"))
        .agg(
            F.min_by(p, rank).alias("open"),
            F.max(p).alias("high"),
            F.min(p).alias("low"),
            F.max_by(p, rank).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .select("symbol", start_.alias("ts"), "open", "high", "low", "close", "volume")
    )


def without_repeats(candles: DataFrame, keys: list[str], ts: str, delay="1 hour") -> DataFrame:
    """Drop candles fetched more than once while the first copy is within the watermark."""
    plain = dict(candles.dtypes)[ts] == "timestamp_ntz"
    once = _event_time(candles, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    return once.withColumn(ts, _clock_time(F.col(ts))) if plain else once


def start(
    df: DataFrame, path: str, checkpoint: str, once: bool = True, every: str = "1 minute"
) -> StreamingQuery:
    """Append a stream to a parquet table; ``once`` processes what is there and stops."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def per_batch(
    df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "1 minute"
) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    return keyed_table.read(spark, root)


def sync_handler(root: str, key: str, arrival: str) -> Callable[[DataFrame, int], None]:
    """Latest row per key, as a keyed table of which each batch rewrites the buckets that it touches.

    The version is the batch number, so a batch that runs again after a failure writes its own version again, from the
    one before it.
    """
    def handle(batch: DataFrame, number: int) -> None:
        keyed_table.upsert_rows(batch.sparkSession, root, number, batch, key, arrival)

    return handle


def report_handler(
    states: str, path: str, keys: list[str], partial: Callable[[DataFrame], DataFrame], report: Callable[[DataFrame], DataFrame]
) -> Callable[[DataFrame, int], None]:
    """Report on all rows so far after each batch, from counts and sums that add up.

    ``partial`` gives one row per key with numbers; they are added to those of the batch before and written under the
    batch number, and ``report`` reads nothing else.  A batch costs the same however long the history is, and one that
    runs again writes the same.
    """
    def handle(batch: DataFrame, number: int) -> None:
        part = partial(batch)
        schema, numbers = part.schema, [n for n in part.columns if n not in keys]
        if number > 0:
            both = part.unionByName(batch.sparkSession.read.schema(schema).parquet(f"{states}/state={number - 1}"))
            part = both.groupBy(*keys).agg(*[F.sum(n).cast(schema[n].dataType).alias(n) for n in numbers])
        part.write.mode("overwrite").parquet(f"{states}/state={number}")
        state = batch.sparkSession.read.schema(schema).parquet(f"{states}/state={number}")
        report(state).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/report={number}")

    return handle


def indicator_handler(
    history: str, path: str, compute: Callable[[DataFrame], DataFrame], lookback_rows: int, keys: list[str], ts: str
) -> Callable[[DataFrame, int], None]:
    """Indicators of the new bars, computed over the last ``lookback_rows`` bars of each key before them plus the batch.

    Those last bars are kept in a table of their own, written anew by each batch, so a batch costs the same however long
    the history is.  A batch that runs again reads the tail of the one before it and gives the same rows.
    """
    from candela.operators.metrics import last_rows

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_new", F.lit(True))
        if number > 0:
            tail = batch.sparkSession.read.schema(batch.schema).parquet(f"{history}/tail={number - 1}")
            rows = rows.unionByName(tail.withColumn("_new", F.lit(False)))
        compute(rows).where("_new").drop("_new").write.mode("overwrite").parquet(f"{path}/batch={number}")
        last_rows(rows.drop("_new"), keys, [ts], lookback_rows).write.mode("overwrite").parquet(f"{history}/tail={number}")

    return handle
