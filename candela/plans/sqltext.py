"""Text helpers for the SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BARS = """bars AS (
  SELECT e.event_type AS symbol, date_trunc('hour', e.ts) AS ts,
         first(e.value ORDER BY e.ts, e.event_id) AS open, max(e.value) AS high, min(e.value) AS low,
         last(e.value ORDER BY e.ts, e.event_id) AS close, count(*) AS volume
  FROM events e WHERE e.value IS NOT NULL GROUP BY 1, 2)"""

TRADES = """trades AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2))) AS trade_id,
         p_brand AS instrument, CASE WHEN l_linestatus = 'O' THEN 'long' ELSE 'short' END AS direction,
         o_orderdate AS entry_time, l_shipdate AS exit_time, l_extendedprice / l_quantity AS entry_price,
         l_quantity AS size, l_extendedprice * (l_discount - l_tax) AS pnl,
         100 * (l_discount - l_tax) AS pnl_percent, l_returnflag AS strategy,
         l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS part_key, l_suppkey AS supp_key,
         l_extendedprice AS notional
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
LINE_BARS = """dbars AS (
  SELECT l.l_returnflag AS symbol, l.l_shipdate AS ts,
         first(l.l_extendedprice / l.l_quantity ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS open,
         max(l.l_extendedprice / l.l_quantity) AS high, min(l.l_extendedprice / l.l_quantity) AS low,
         last(l.l_extendedprice / l.l_quantity ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS close,
         count(*) AS volume
  FROM lineitem l GROUP BY 1, 2)"""
TRADE_ORDER = "exit_time, order_key, line_no, part_key, supp_key, notional"

OVER = "PARTITION BY symbol ORDER BY ts"


def full(n: int, expr: str, agg: str = "avg", need: int | None = None, over: str = OVER) -> str:
    frame = f"({over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({expr}) OVER {frame} >= {need or n} THEN {agg}({expr}) OVER {frame} END)"


def lag(expr: str, k: int = 1, over: str = OVER) -> str:
    return f"(lag({expr}, {k}) OVER ({over}))"


def lead(expr: str, k: int = 1, over: str = OVER) -> str:
    return f"(lead({expr}, {k}) OVER ({over}))"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def pct(now: str, before: str) -> str:
    return div(f"({now} - {before})", before)


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def ema(span: int, expr: str, over: str = OVER) -> str:
    a, d = 2.0 / (span + 1), (span - 1.0) / (span + 1)
    return (
        f"list_reduce(list({expr}) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
        f" lambda acc, v: acc * {d!r}::DOUBLE + v * {a!r}::DOUBLE)"
    )


def r(expr: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def stages(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Round every double column, so that results compare by value; ``other`` names columns with other digits."""
    return df.select(
        *[F.round(n, other.get(n, digits)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    )


def pick(ctes: list[str], source: str, keys: list[str], cols: dict[str, str], digits: int = 6, where: str = "") -> str:
    """SELECT keys and columns; ``d:expr`` is a double to round, ``d3:expr`` one to round to 3 digits."""
    parts = list(keys)
    for name, expr in cols.items():
        kind, mark, rest = expr.partition(":")
        if mark and kind[:1] == "d" and (kind == "d" or kind[1:].isdigit()):
            expr = r(rest, int(kind[1:] or digits))
        parts.append(f"{expr} AS {name}")
    return stages(*ctes) + "SELECT " + ",\n  ".join(parts) + f"\nFROM {source}" + (f" WHERE {where}" if where else "")
