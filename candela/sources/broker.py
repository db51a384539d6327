"""Broker documents: closed trades, open positions and quotes as JSON, to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.functions.guards import c, div


def _fields(**types) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


S = T.StringType()
SIDE = _fields(units=S, averagePrice=S, unrealizedPL=S)
TRADES = _fields(
    trades=T.ArrayType(
        _fields(
            id=S, instrument=S, initialUnits=S, price=S, averageClosePrice=S, realizedPL=S, financing=S, openTime=S,
            closeTime=S,
        )
    )
)
POSITIONS = _fields(positions=T.ArrayType(_fields(instrument=S, long=SIDE, short=SIDE)))
LEVEL = T.ArrayType(_fields(price=S))
QUOTES = _fields(prices=T.ArrayType(_fields(instrument=S, time=S, bids=LEVEL, asks=LEVEL)))


def _num(column) -> Column:
    return c(column).cast("double")


def closed_trades(documents: DataFrame) -> DataFrame:
    """Ledger rows from closed-trade documents: direction from the sign of the units."""
    t = documents.select(F.explode("trades").alias("t")).select("t.*")
    units, price, pnl = _num("initialUnits"), F.coalesce(_num("price"), F.lit(0.0)), F.coalesce(_num("realizedPL"), F.lit(0.0))
    return t.select(
        F.col("id").alias("trade_id"),
        "instrument",
        F.when(units > 0, "long").otherwise("short").alias("direction"),
        F.col("openTime").cast("timestamp_ntz").alias("entry_time"),
        F.col("closeTime").cast("timestamp_ntz").alias("exit_time"),
        price.alias("entry_price"),
        F.coalesce(_num("averageClosePrice"), F.lit(0.0)).alias("exit_price"),
        F.abs(units).alias("size"),
        pnl.alias("pnl"),
        (100 * div(pnl, F.abs(units) * price)).alias("pnl_percent"),
        F.coalesce(_num("financing"), F.lit(0.0)).alias("commission"),
        F.lit(0.0).alias("slippage"),
        F.lit("manual").alias("strategy"),
        F.lit("closed").alias("status"),
    )


def open_positions(documents: DataFrame, as_of: str) -> DataFrame:
    """Position rows: the long side if it has units, else the short side; empty ones are left out."""
    p = documents.select(F.explode("positions").alias("p")).select("p.*")
    has = lambda side: _num(f"{side}.units") != 0
    side = F.when(has("long"), "long").when(has("short"), "short")
    pick = lambda field: F.when(has("long"), _num(f"long.{field}")).otherwise(_num(f"short.{field}"))
    units, price, gain = pick("units"), pick("averagePrice"), pick("unrealizedPL")
    return p.where(side.isNotNull()).select(
        F.concat_ws("_", "instrument", side).alias("position_id"),
        "instrument",
        side.alias("direction"),
        F.lit(as_of).cast("timestamp_ntz").alias("entry_time"),
        price.alias("entry_price"),
        F.abs(units).alias("size"),
        (price + div(gain, F.abs(units))).alias("current_price"),
        gain.alias("unrealized_pnl"),
        F.lit(None).cast("double").alias("stop_loss"),
        F.lit(None).cast("double").alias("take_profit"),
    )


def quotes(documents: DataFrame) -> DataFrame:
    """Best bid, best ask and spread."""
    q = documents.select(F.explode("prices").alias("q")).select("q.*")
    bid, ask = F.get("bids", F.lit(0))["price"].cast("double"), F.get("asks", F.lit(0))["price"].cast("double")
    return q.select(
        "instrument", bid.alias("bid"), ask.alias("ask"), (ask - bid).alias("spread"),
        F.col("time").cast("timestamp_ntz").alias("ts"),
    )
