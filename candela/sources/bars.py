"""OHLCV bars: file scans, candle JSON, chunk merging and building bars from ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_BARS = T.StructType(
    [
        T.StructField("Date", T.TimestampNTZType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)

CANDLES = T.StructType(
    [
        T.StructField("instrument", T.StringType()),
        T.StructField(
            "candles",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("time", T.StringType()),
                        T.StructField("complete", T.BooleanType()),
                        T.StructField("volume", T.LongType()),
                        T.StructField(
                            "mid",
                            T.StructType([T.StructField(k, T.StringType()) for k in ("o", "h", "l", "c")]),
                        ),
                    ]
                )
            ),
        ),
    ]
)

# Bar granularities in minutes.
GRANULARITY_MINUTES = {
    "M1": 1, "M5": 5, "M15": 15, "M30": 30,
    "H1": 60, "H4": 240, "D": 1440, "W": 10080,
}

REQUIRED = ("open", "high", "low", "close")


def read_bars_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars from CSV files with a header and a date column; the symbol defaults to the file name."""
    raw = spark.read.schema(CSV_BARS).option("header", True).option("enforceSchema", False).csv(path)
    name = F.lit(symbol) if symbol else F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1)
    return raw.select(name.alias("symbol"), F.col("Date").alias("ts"), "open", "high", "low", "close", "volume")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names and keep the first level of names such as ``Close_SPX`` or ``('Close', 'SPX')``."""
    def simple(name: str) -> str:
        text = name.strip("()").split(",")[0].strip().strip("'\"")
        head = text.lower()
        for field in ("open", "high", "low", "close", "volume"):
            if head == field or head.startswith(field + "_"):
                return field
        return head

    return df.toDF(*[simple(n) for n in df.columns])


def require_ohlc(df: DataFrame) -> DataFrame:
    missing = [n for n in REQUIRED if n not in df.columns]
    if missing:
        raise ValueError(f"bars lack columns: {', '.join(missing)}")
    return df


def candles_to_bars(documents: DataFrame) -> DataFrame:
    """Candle documents to bars: complete candles only, prices cast from text."""
    candle = F.col("c")
    return (
        documents.select(F.col("instrument").alias("symbol"), F.explode("candles").alias("c"))
        .where(candle["complete"])
        .select(
            "symbol",
            candle["time"].cast("timestamp_ntz").alias("ts"),
            *[candle["mid"][k].cast("double").alias(n) for k, n in zip("ohlc", ("open", "high", "low", "close"))],
            candle["volume"].cast("long").alias("volume"),
        )
    )


def read_candles_json(spark: SparkSession, path: str) -> DataFrame:
    return candles_to_bars(spark.read.schema(CANDLES).json(path))


def combine_chunks(chunks: DataFrame, chunk: str = "chunk", tie: tuple[str, ...] = ()) -> DataFrame:
    """One row per (symbol, ts) out of overlapping downloads: the earliest chunk wins.

    The rank filter lets Spark drop all but the first row per key before the shuffle.
    """
    first = Window.partitionBy("symbol", "ts").orderBy(chunk, *tie)
    return chunks.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", chunk)


def clock_micros(ts: str, kind: str) -> Column:
    """Microseconds since 1970 that order ``ts`` whatever the session's zone; ``kind`` is its type.

    A plain timestamp is read off its calendar fields: cast to an instant, hours that a zone skips would move.
    """
    if kind != "timestamp_ntz":
        return F.unix_micros(F.col(ts).cast("timestamp"))
    whole = F.expr(f"(datediff(to_date(`{ts}`), DATE'1970-01-01') * 24L + hour(`{ts}`)) * 60L + minute(`{ts}`)")
    return (whole * 60_000_000 + F.expr(f"extract(SECOND FROM `{ts}`) * 1000000").cast("bigint")).cast("bigint")


def tick_rank(ts: str, tie: str, kind: str) -> Column:
    """(ts, tie) as one number that sorts alike.

    A number lives in the fixed-width buffer of a hash aggregate, while a
    struct would force a sort of all ticks before the partial aggregation.
    """
    micros = clock_micros(ts, kind).cast("decimal(18,0)")
    # ties are moved to start at zero, so that negative ones stay inside their microsecond
    moved = F.col(tie).cast("decimal(19,0)") + F.lit("9223372036854775808").cast("decimal(19,0)")
    return (micros * F.lit("20000000000000000000").cast("decimal(20,0)") + moved).cast("decimal(38,0)")


def ticks_to_bars(
    ticks: DataFrame,
    symbol: str,
    ts: str,
    price: str,
    granularity: str = "H1",
    tie: str | tuple[str, ...] | None = None,
    extra_keys: tuple[str, ...] = (),
) -> DataFrame:
    """Bars of a granularity from ticks; volume is the tick count.

    One aggregation with map-side partials: a symbol that owns most ticks
    shrinks to its bars before anything is shuffled.
    """
    minutes = GRANULARITY_MINUTES[granularity]
    # weeks start on Monday; the epoch was a Thursday
    start = F.window(ts, f"{minutes} minutes", None, "4 days" if granularity == "W" else "0 minutes")["start"]
    if isinstance(tie, tuple):
        rank = F.struct(ts, *tie)  # several columns: sorted partial aggregation
    else:
        rank = tick_rank(ts, tie, dict(ticks.dtypes)[ts]) if tie else F.col(ts)
    p = F.col(price)
    return (
        ticks.where(p.isNotNull())
        .groupBy(*[F.col(k) for k in extra_keys], F.col(symbol).alias("symbol"), start.alias("ts"))
        .agg(
            F.min_by(p, rank).alias("open"),
            F.max(p).alias("high"),
            F.min(p).alias("low"),
            F.max_by(p, rank).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def repair(bars: DataFrame) -> DataFrame:
    """Stretch high and low so that they cover open and close."""
    return bars.withColumns(
        {"high": F.greatest("open", "high", "close"), "low": F.least("open", "low", "close")}
    )


def sanity(bars: DataFrame) -> DataFrame:
    """Per symbol: do nulls occur, and do high and low bound open and close everywhere?"""
    holds = lambda cond: F.bool_and(F.coalesce(cond, F.lit(False)))
    o, h, l, c = (F.col(n) for n in REQUIRED)
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        F.bool_and(o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull()).alias("no_nulls"),
        holds(h >= l).alias("high_ge_low"),
        holds(h >= o).alias("high_ge_open"),
        holds(h >= c).alias("high_ge_close"),
        holds(l <= o).alias("low_le_open"),
        holds(l <= c).alias("low_le_close"),
    )
