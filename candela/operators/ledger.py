"""Trade ledger, sizing and equity from bars that carry signals.

The ledger is not simulated bar by bar.  Each entry signal finds its exit by a
search in a tree of bar blocks; the trades that really happen are the chain
that starts at the first signal and jumps from each exit to the next signal;
fills and sizes are closed formulas; capital compounds as a running product.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.keytables import per_key
from candela.functions.durable import materialize
from candela.functions.guards import c, div, div0
from candela.functions.series import BLOCK, CHUNK, HELPERS, RN, Series, bar_series, index, running

FAN_OUT = 256  # bars per block, and blocks per block of the next level
LINK_ROWS = 2048  # signals per chunk of the chain walk
KELLY_ROWS = 65536  # signals per key and round of the Kelly recursion
NEVER = 1 << 60


@dataclass(frozen=True)
class BacktestConfig:
    """Trading assumptions; shares of capital are fractions."""

    initial_capital: float = 10000.0
    commission_pct: float = 0.0001
    slippage_pct: float = 0.0001
    position_size_pct: float = 0.02
    max_position_value_pct: float = 0.02
    risk_free_rate: float = 0.02
    position_sizing_method: str = "fixed_pct"  # or "volatility", "kelly"
    atr_col: str | None = None
    atr_multiplier: float = 2.0
    max_drawdown_pct: float = 0.20
    use_bid_ask_spread: bool = True
    spread_pips: float = 1.0
    use_exit_signals: bool = False
    use_size_multiplier: bool = False
    halt_close: str = "last_bar"  # or "halt_bar"
    max_daily_loss_pct: float = 0.05

    @property
    def half_spread(self) -> float:
        return self.spread_pips * 0.0001 / 2 if self.use_bid_ask_spread else 0.0


# ---- fills and sizes ------------------------------------------------------------


def bid(price: Column, cfg: BacktestConfig) -> Column:
    return price * (1 - cfg.half_spread)


def ask(price: Column, cfg: BacktestConfig) -> Column:
    return price * (1 + cfg.half_spread)


def entry_fill(price: Column, long: Column, cfg: BacktestConfig) -> Column:
    return F.when(long, ask(price, cfg) * (1 + cfg.slippage_pct)).otherwise(bid(price, cfg) * (1 - cfg.slippage_pct))


def exit_fill(price: Column, long: Column, cfg: BacktestConfig) -> Column:
    return F.when(long, bid(price, cfg) * (1 - cfg.slippage_pct)).otherwise(ask(price, cfg) * (1 + cfg.slippage_pct))


def exit_slippage(price: Column, long: Column, cfg: BacktestConfig) -> Column:
    return F.when(long, bid(price, cfg)).otherwise(ask(price, cfg)) * cfg.slippage_pct


def unit_pnl(entry: Column, exit_: Column, long: Column, cfg: BacktestConfig) -> Column:
    """Net profit per unit, commission on both sides."""
    move = F.when(long, exit_ - entry).otherwise(entry - exit_)
    return move - cfg.commission_pct * (entry + exit_)


def fixed_risk_share(entry: Column, stop: Column, cfg: BacktestConfig) -> Column:
    """Units per unit of capital that risk a fixed share, capped by position value; the cap alone without a stop."""
    cap = F.lit(cfg.max_position_value_pct) / entry
    stop = F.nullif(stop, F.lit(0.0))
    risk = F.abs(entry - stop)
    return F.when(stop.isNull(), cap).when(risk == 0, 0.0).otherwise(
        F.least(F.try_divide(F.lit(cfg.position_size_pct), risk), cap)
    )


def atr_risk_share(entry: Column, atr: Column, cfg: BacktestConfig) -> Column:
    """Like :func:`fixed_risk_share` with a distance of some mean ranges; the cap alone without a range."""
    cap = F.lit(cfg.max_position_value_pct) / entry
    atr = F.nullif(atr, F.lit(0.0))
    distance = atr * cfg.atr_multiplier
    return F.when(atr.isNull(), cap).otherwise(
        F.least(F.try_divide(F.lit(cfg.position_size_pct), distance), cap)
    )


def size_share(df: DataFrame, entry: Column, cfg: BacktestConfig) -> Column:
    if cfg.position_sizing_method == "volatility" and cfg.atr_col in df.columns:
        share = atr_risk_share(entry, c(cfg.atr_col), cfg)
    elif cfg.position_sizing_method == "fixed_pct":
        share = fixed_risk_share(entry, c("stop_loss"), cfg)
    else:
        share = F.lit(cfg.max_position_value_pct) / entry
    return share * c("size_mult") if cfg.use_size_multiplier and "size_mult" in df.columns else share


def kelly_fraction(win_rate: Column, avg_win: Column, avg_loss: Column, fraction: float = 0.5) -> Column:
    """Half Kelly within 0.1% and 5%; 1% where it is undefined."""
    ratio = div(avg_win, avg_loss)
    raw = div(win_rate * ratio - (1 - win_rate), ratio) * fraction
    usable = (avg_loss != 0) & (win_rate > 0) & (win_rate < 1)
    return F.when(usable, F.greatest(F.lit(0.001), F.least(F.lit(0.05), raw))).otherwise(0.01)


# ---- exits ------------------------------------------------------------------------


class _Touch:
    """Does a bar, or a block of bars, reach the stop, the target or an exit flag of an entry?"""

    def __init__(self, long: Column, stop: Column, target: Column):
        self.long, self.stop, self.target = long, F.nullif(stop, F.lit(0.0)), F.nullif(target, F.lit(0.0))

    def stopped(self, k: Column) -> Column:
        return F.coalesce(F.when(self.long, k["lo"] <= self.stop).otherwise(k["hi"] >= self.stop), F.lit(False))

    def reached(self, k: Column) -> Column:
        return F.coalesce(F.when(self.long, k["hi"] >= self.target).otherwise(k["lo"] <= self.target), F.lit(False))

    def flagged(self, k: Column) -> Column:
        return F.when(self.long, k["xl"]).otherwise(k["xs"]) == 1

    def any(self, k: Column) -> Column:
        return self.stopped(k) | self.reached(k) | self.flagged(k)


def _block_tree(bars: DataFrame, keys: list[str], levels: int) -> list[DataFrame]:
    """Bars in blocks of 256, blocks in blocks of 256, and so on for ``levels`` levels: columns ``keys, id, kids``.

    A block keeps its children as an array of at most 256 entries with their extremes, at every level.
    """
    fields = ["lo", "hi", "xl", "xs"]
    extremes = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("xl").alias("xl"), F.max("xs").alias("xs")]
    kids = bars.select(
        *keys,
        F.expr(f"{RN} - 1").alias("place"),
        F.col(RN).alias("id"),
        F.col("low").alias("lo"),
        F.col("high").alias("hi"),
        "xl", "xs", "close", "ts", "_seen", "_cand",
    )
    tree, kept = [], ["id", *fields, "close", "ts", "_seen", "_cand"]
    for _ in range(levels):
        block = F.expr(f"place div {FAN_OUT}").alias("block")
        blocks = kids.groupBy(*keys, block).agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("kids"), *extremes)
        tree.append(blocks.select(*keys, F.col("block").alias("id"), "kids"))
        kids, kept = blocks.select(*keys, F.col("block").alias("place"), F.col("block").alias("id"), *fields), ["id", *fields]
    return tree


def find_exits(entries: DataFrame, bars: DataFrame, keys: list[str], longest: int | None = None) -> DataFrame:
    """First later bar that touches each entry, as struct ``hit`` (null where none does).

    The search climbs the block tree from the entry bar until some block is
    touched and descends to the bar.  Every step is an equality join of the
    entries with one row per block, so no pairs of entries and bars arise and
    the holding time has no limit.  ``longest`` is the number of bars of the
    longest series; short series need fewer levels.

    Above the second level a block has one row for each 65,536 bars below it,
    and entries look up that of their own bar.  So entries that are never
    touched meet in no key of a whole series, however long it is.
    """
    if longest is None:
        longest = bars.agg(F.max(RN)).first()[0] or 0  # one number
    levels = 1
    while FAN_OUT**levels < longest:
        levels += 1
    tree = _block_tree(bars, keys, levels)
    touch = _Touch(c("_long"), c("stop_loss"), c("take_profit"))
    first = lambda kids, after: F.get(
        F.filter(kids, lambda k: (k["id"] > after if after is not None else F.lit(True)) & touch.any(k)), F.lit(0)
    )
    # entries that need no lookup get scattered keys that match nothing
    nowhere = -1 - F.pmod(F.col(RN), F.lit(100000))
    only = lambda needed, key: F.when(needed, key).otherwise(nowhere)
    own = lambda level: F.expr(f"({RN} - 1) div {FAN_OUT ** level}")

    def step(df, table, key, after, out):
        side = table.select(*keys, F.col("id").alias("_key"), F.col("kids").alias("_kids"))
        return (
            df.withColumn("_key", key).join(side, [*keys, "_key"], "left")
            .withColumn(out, first(F.col("_kids"), after)).drop("_key", "_kids")
        )

    df = step(entries, tree[0], own(1), F.col(RN), "_up0")
    for level in range(1, levels):
        table = tree[level]
        if level > 1:
            below = FAN_OUT ** (level - 2)
            places = lambda k: F.sequence(k["id"] * below, (k["id"] + 1) * below - 1)  # noqa: B023, E731
            # under the last child there is nothing later to be found
            spread = F.flatten(F.transform(F.slice("kids", F.lit(1), F.size("kids") - 1), places))
            table = table.select(*keys, F.explode(spread).alias("id"), "kids")
        missed = F.lit(True)
        for lower in range(level):
            missed = missed & c(f"_up{lower}").isNull()
        df = step(df, table, only(missed, own(2)), own(level), f"_up{level}")
    target, down = None, []
    for level in range(levels - 1, 0, -1):
        up = c(f"_up{level}.id")
        target = up if target is None else F.coalesce(up, target)
        df = step(df, tree[level - 1], only(target.isNotNull(), target), None, f"_down{level}")
        target = c(f"_down{level}.id")
        down.append(f"_down{level}")
    hit = F.coalesce("_up0", "_down1") if levels > 1 else c("_up0")
    return df.withColumn("hit", hit).drop(*[f"_up{level}" for level in range(levels)], *down)


# ---- the chain of trades -------------------------------------------------------------


def walk_chain(links: DataFrame, keys: list[str], longest: int | None = None) -> DataFrame:
    """Ids on the chain that starts at id 1 of each key and follows ``next_id``.

    Ids are dense.  Inside a chunk of 2,048 ids one fold finds where a walk from
    any id leaves the chunk.  The ids where a chunk can be entered form a shorter
    chain; which of them lie on the walk follows by doubling jumps, whatever the
    number of chunks or of exits.  Then each chunk marks its own part from its entry.
    Where even the ``longest`` key fits one chunk, one fold does it all.
    """
    one = F.lit(1).cast("bigint")
    chunk = F.expr(f"(id - 1) div {LINK_ROWS}")
    chunks = links.groupBy(*keys, chunk.alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("id", "next_id"))).alias("arr")
    )
    if (longest or NEVER) <= LINK_ROWS:
        return chunks.select(*keys, F.explode(_follow("arr", one)).alias("id"))
    last = F.element_at("arr", -1)["id"]
    chunks = chunks.withColumn("lo", F.element_at("arr", 1)["id"]).withColumn("hi", last)
    leave = F.aggregate(
        F.reverse("arr"),
        F.array().cast("array<bigint>"),
        lambda s, v: F.concat(
            F.array(F.when(v["next_id"] <= F.col("hi"), F.get(s, v["next_id"] - v["id"] - 1)).otherwise(v["next_id"])), s
        ),
    )
    exits = materialize(chunks.withColumn("leave", leave))
    starts = exits.select(*keys, F.explode(F.array_distinct("leave")).alias("id")).where(c("id") < NEVER)
    starts = starts.union(exits.select(*keys, one.alias("id")).distinct()).distinct()
    hops = (
        starts.withColumn("chunk", chunk)
        .join(exits.select(*keys, "chunk", "lo", "leave"), [*keys, "chunk"])
        .select(*keys, "id", F.get("leave", c("id") - c("lo")).alias("next_id"))
    )
    entry = _reached(hops, keys).withColumnRenamed("id", "start")
    entry = entry.withColumn("chunk", F.expr(f"(start - 1) div {LINK_ROWS}"))
    return exits.join(entry, [*keys, "chunk"]).select(*keys, F.explode(_follow("arr", c("start"))).alias("id"))


def _reached(hops: DataFrame, keys: list[str]) -> DataFrame:
    """Ids on the chain from id 1 of each key over ``hops`` (id, next_id), by pointer doubling.

    After round k the first 2^k ids of the chain are known and jumps are 2^k long.
    No task sees more of a key than its hash share.
    """
    jumps = materialize(hops.where(c("next_id") < NEVER))
    found = materialize(hops.where("id = 1").select(*keys, "id").distinct())
    while True:
        ahead = found.join(jumps, [*keys, "id"]).select(*keys, c("next_id").alias("id"))
        ahead = materialize(ahead.join(found, [*keys, "id"], "left_anti").distinct())
        if ahead.isEmpty():
            return found
        found = materialize(found.unionByName(ahead))
        beyond = jumps.select(*keys, c("id").alias("next_id"), c("next_id").alias("_far"))
        jumps = materialize(jumps.join(beyond, [*keys, "next_id"]).select(*keys, "id", c("_far").alias("next_id")))


def _follow(arr: str, start: Column) -> Column:
    """Ids met when walking a sorted array of (id, next_id) from ``start``."""
    zero = F.struct(start.alias("next"), F.array().cast("array<bigint>").alias("ids"))
    return F.aggregate(
        arr,
        zero,
        lambda s, v: F.when(
            v["id"] == s["next"],
            F.struct(v["next_id"].alias("next"), F.concat(s["ids"], F.array(v["id"])).alias("ids")),
        ).otherwise(s),
        lambda s: s["ids"],
    )


# ---- ledger ---------------------------------------------------------------------------


class Backtest(NamedTuple):
    """Ledger and equity curve, plus the indexed bars they were made from."""

    trades: DataFrame
    equity: DataFrame


LEDGER_COLUMNS = (
    "entry_rn", "exit_rn", "entry_time", "exit_time", "direction", "entry_price", "exit_price", "size", "pnl",
    "pnl_percent", "commission", "slippage", "entry_reason", "exit_reason", "capital_before", "capital_after",
)


def _prepare(signals: DataFrame, series: Series, cfg: BacktestConfig, start: str | None) -> DataFrame:
    """Indexed bars with numbered entry candidates, saved because several steps read them."""
    df = signals if RN in signals.columns else index(signals, series)
    ok = c("action").isin("buy", "sell")
    if start is not None:
        ok = ok & (c("ts") >= F.lit(start).cast("timestamp_ntz"))
    df = df.withColumn("_long", c("action") == "buy")
    df = df.withColumn("_entry", entry_fill(c("close"), c("_long"), cfg))
    df = df.withColumn("_share", size_share(df, c("_entry"), cfg))
    flags = {"xl": "exit_long", "xs": "exit_short"}
    used = cfg.use_exit_signals
    df = df.withColumns(
        {
            "_cand": F.coalesce(ok & (c("_share") > 0), F.lit(False)).cast("int"),
            **{k: c(v) if used and v in df.columns else F.lit(0) for k, v in flags.items()},
        }
    )
    keep = [*series.keys, "ts", "high", "low", "close", "stop_loss", "take_profit", "reason"]
    # saved before the running count reads it twice, so the indicators are computed once
    df = materialize(df.select(*keep, RN, CHUNK, BLOCK, "_long", "_entry", "_share", "_cand", "xl", "xs"))
    df = running(df, series, {"_seen": ("sum", F.col("_cand").cast("bigint"))}, exclusive=True, saved=True)
    return materialize(df.withColumn("_seen", F.coalesce("_seen", F.lit(0))))


def _trades(prepared: DataFrame, series: Series, cfg: BacktestConfig) -> DataFrame:
    keys = list(series.keys)
    entries = prepared.where("_cand = 1").select(
        *keys, RN, "ts", "close", "_long", "_entry", "_share", "stop_loss", "take_profit", "reason",
        (c("_seen") + 1).alias("id"),
    )
    ends = per_key(
        prepared.groupBy(*keys).agg(
            F.max(RN).alias("_last_rn"), F.max_by("ts", RN).alias("_last_ts"), F.max_by("close", RN).alias("_last_close")
        )
    )
    # sizes decide how many levels the searches need; the answer is the same
    bars, signals = prepared.agg(F.max(RN), F.max(F.when(c("_cand") == 1, c("_seen") + 1))).first()
    found = find_exits(entries, prepared, keys, bars).join(ends, keys)
    touch = _Touch(c("_long"), c("stop_loss"), c("take_profit"))
    hit = c("hit")
    by_signal = ~touch.stopped(hit) & ~touch.reached(hit)
    following = F.when(by_signal, c("hit._seen") + c("hit._cand")).otherwise(c("hit._seen")) + 1
    found = materialize(
        found.select(
            *keys,
            "id",
            F.col(RN).alias("entry_rn"),
            F.col("ts").alias("entry_time"),
            "_long",
            F.col("_entry").alias("entry_price"),
            "_share",
            F.col("reason").alias("entry_reason"),
            F.coalesce(c("hit.id"), c("_last_rn") + 1).alias("exit_rn"),
            F.coalesce(c("hit.ts"), c("_last_ts")).alias("exit_time"),
            F.coalesce(c("hit.close"), c("_last_close")).alias("_exit_mid"),
            F.when(hit.isNull(), "end_of_backtest").when(touch.stopped(hit), "stop_loss")
            .when(touch.reached(hit), "take_profit").otherwise("signal").alias("exit_reason"),
            F.coalesce(following, F.lit(NEVER)).alias("next_id"),
        )
    )
    taken = found.join(walk_chain(found.select(*keys, "id", "next_id"), keys, signals), [*keys, "id"])
    if cfg.position_sizing_method == "kelly":
        return _kelly_account(taken, series, cfg, signals or 0)
    return _account(taken, series, cfg)


def _account(taken: DataFrame, series: Series, cfg: BacktestConfig) -> DataFrame:
    """Fills, profits and compounding capital of the chosen trades.

    Size is proportional to capital, so a trade multiplies capital by ``1 + f``
    and capital is a running product.  Trading ends when capital is used up.
    """
    keys = list(series.keys)
    long, entry = c("_long"), c("entry_price")
    df = taken.withColumn("exit_price", exit_fill(c("_exit_mid"), long, cfg))
    df = df.withColumn("_unit", unit_pnl(entry, c("exit_price"), long, cfg))
    df = df.withColumn("_f", c("_share") * c("_unit"))
    chunk = F.expr(f"(id - 1) div {LINK_ROWS}")
    df = df.withColumns({RN: c("id"), CHUNK: chunk, BLOCK: chunk})
    df = running(
        df,
        series,
        {
            "_log": ("sum", F.when(c("_f") > -1, F.log1p("_f"))),
            "_ruined": ("max", (c("_f") <= -1).cast("int")),
        },
        exclusive=True,
    ).where(F.coalesce(c("_ruined"), F.lit(0)) == 0)
    capital = cfg.initial_capital * F.exp(F.coalesce(c("_log"), F.lit(0.0)))
    df = df.withColumn("capital_before", capital).withColumn("size", c("_share") * c("capital_before"))
    return _ledger_rows(df, keys, cfg)


def _kelly_account(taken: DataFrame, series: Series, cfg: BacktestConfig, longest: int) -> DataFrame:
    """Accounts for Kelly sizes, which feed back: each depends on the last 100 profits before it.

    The recursion runs in rounds of 65,536 signals per key.  A round handles
    all keys side by side and hands capital and the last profits to the next.
    """
    keys = list(series.keys)
    long, entry = c("_long"), c("entry_price")
    df = taken.withColumn("exit_price", exit_fill(c("_exit_mid"), long, cfg))
    df = materialize(df.withColumn("_unit", unit_pnl(entry, c("exit_price"), long, cfg)))
    types = dict(df.dtypes)
    slim = df.select(*keys, "id", "entry_price", "_unit")
    out_schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", id bigint, capital_before double, size double, _pnl double, _done int"
    state = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, F.lit(cfg.initial_capital).alias("capital"), F.lit(0).alias("done"), F.array().cast("array<double>").alias("past")
    )
    parts = None
    for number in range(-(-longest // KELLY_ROWS)):
        part = slim.where(F.expr(f"(id - 1) div {KELLY_ROWS}") == number)
        fold = _kelly_fold(keys, cfg.max_position_value_pct)
        sized = materialize(
            part.groupBy(*keys).cogroup(
                state.toDF(*[f"_k_{k}" for k in keys], "capital", "done", "past").groupBy(*[f"_k_{k}" for k in keys])
            ).applyInPandas(fold, out_schema)
        )
        parts = sized if parts is None else parts.unionByName(sized)
        newest = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("id", "_pnl")))), 1, 100)
        from candela.operators.metrics import last_rows

        recent = last_rows(parts, keys, ["id"], 100).groupBy(*keys).agg(
            F.reverse(F.transform(newest, lambda x: x["_pnl"])).alias("_past"),
            F.max_by(c("capital_before") + c("_pnl"), "id").alias("_cap"), F.max("_done").alias("_d"),
        )
        state = state.join(recent, keys, "left").select(
            *keys, F.coalesce("_cap", "capital").alias("capital"), F.coalesce("_d", "done").alias("done"),
            F.coalesce("_past", "past").alias("past"),
        )
    if parts is None:
        return _ledger_rows(df.withColumns({"capital_before": F.lit(0.0), "size": F.lit(0.0)}).limit(0), keys, cfg)
    return _ledger_rows(df.join(parts.select(*keys, "id", "capital_before", "size"), [*keys, "id"]), keys, cfg)


def _kelly_fold(keys: list[str], cap: float):
    """Sizes of one key's trades of a round, from the state before it."""
    import numpy as np
    import pandas as pd

    def fold(trades, state):
        rows = []
        if len(trades):
            capital, done, past = float(state["capital"].iloc[0]), int(state["done"].iloc[0]), list(state["past"].iloc[0])
            for r in trades.sort_values("id").itertuples(index=False):
                share = cap
                if done > 20:
                    recent = np.array(past[-100:])
                    won, lost = recent[recent > 0], recent[recent < 0]
                    pct = 0.01
                    if len(won) and len(lost) and len(won) < len(recent):
                        rate, ratio = len(won) / len(recent), won.mean() / abs(lost.mean())
                        pct = min(max((rate * ratio - (1 - rate)) / ratio * 0.5, 0.001), 0.05)
                    share = min(pct, cap)
                if capital <= 0:
                    break
                size = capital * share / r.entry_price
                pnl = size * r[-1]
                done += 1
                rows.append((*[getattr(r, k) for k in keys], r.id, capital, size, pnl, done))
                past.append(pnl)
                capital += pnl
        return pd.DataFrame(rows, columns=[*keys, "id", "capital_before", "size", "_pnl", "_done"])

    return fold


def _ledger_rows(df: DataFrame, keys: list[str], cfg: BacktestConfig) -> DataFrame:
    long, entry, size = c("_long"), c("entry_price"), c("size")
    return df.select(
        *keys,
        "entry_rn",
        "exit_rn",
        "entry_time",
        "exit_time",
        F.when(long, "long").otherwise("short").alias("direction"),
        "entry_price",
        "exit_price",
        "size",
        (size * c("_unit")).alias("pnl"),
        (100 * div(c("_unit"), entry)).alias("pnl_percent"),
        (size * cfg.commission_pct * (entry + c("exit_price"))).alias("commission"),
        (size * exit_slippage(c("_exit_mid"), long, cfg)).alias("slippage"),
        "entry_reason",
        "exit_reason",
        "capital_before",
        (c("capital_before") + size * c("_unit")).alias("capital_after"),
    )


def marks(prepared: DataFrame, trades: DataFrame, series: Series, cfg: BacktestConfig) -> DataFrame:
    """Bars with the latest trade entered before them, its unrealised profit, and equity."""
    keys = list(series.keys)
    fields = ["entry_rn", "exit_rn", "direction", "entry_price", "size", "capital_before", "capital_after"]
    at_entry = trades.select(*keys, F.col("entry_rn").alias(RN), F.struct(*fields).alias("_trade"))
    df = prepared.select(*keys, "ts", "close", RN, CHUNK, BLOCK).join(at_entry, [*keys, RN], "left")
    df = running(df, series, {"_t": ("last", c("_trade"))}, exclusive=True)
    long = c("_t.direction") == "long"
    gain = F.when(long, bid(c("close"), cfg) - c("_t.entry_price")).otherwise(c("_t.entry_price") - ask(c("close"), cfg))
    df = df.withColumn("_gain", gain * c("_t.size"))
    equity = (
        F.when(c("_t").isNull(), F.lit(cfg.initial_capital))
        .when(c(RN) < c("_t.exit_rn"), c("_t.capital_before") + c("_gain"))
        .otherwise(c("_t.capital_after"))
    )
    return df.withColumn("equity", equity)


def excursions(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Worst and best unrealised profit per trade over the bars after entry up to the exit."""
    held = marked.where(c(RN) <= c("_t.exit_rn"))
    return held.groupBy(*keys, c("_t.entry_rn").alias("entry_rn")).agg(
        F.least(F.lit(0.0), F.min("_gain")).alias("max_adverse_excursion"),
        F.greatest(F.lit(0.0), F.max("_gain")).alias("max_favorable_excursion"),
    )


def with_excursions(trades: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """A trade entered on the last bar has no later bar: its excursions are 0."""
    both = trades.join(excursions(marked, keys), [*keys, "entry_rn"], "left")
    return both.fillna(0.0, ["max_adverse_excursion", "max_favorable_excursion"])


def drawdown_breach(marked: DataFrame, series: Series, limit: float) -> DataFrame:
    """First bar per series whose equity is more than ``limit`` below its running maximum."""
    peaks = running(marked, series, {"_peak": ("max", c("equity"))}, saved=True)
    fallen = div(c("_peak") - c("equity"), c("_peak")) > limit
    return peaks.where(fallen).groupBy(*series.keys).agg(F.min(RN).alias("halt_rn"))


def ledger(
    signals: DataFrame, cfg: BacktestConfig = BacktestConfig(), series: Series | None = None, start: str | None = None
) -> DataFrame:
    """Trades of one position at a time per series, without the drawdown halt."""
    series = series or bar_series()
    return _trades(_prepare(signals, series, cfg, start), series, cfg)


def backtest(
    signals: DataFrame, cfg: BacktestConfig = BacktestConfig(), series: Series | None = None, start: str | None = None
) -> Backtest:
    """Ledger with excursions and equity curve, cut at the drawdown limit.

    After a breach no bar is recorded and no trade is entered; a trade still
    open is closed at the last bar of the data (or at the halt bar).
    """
    series = series or bar_series()
    keys = list(series.keys)
    prepared = _prepare(signals, series, cfg, start)
    trades = materialize(_trades(prepared, series, cfg))
    marked = materialize(marks(prepared, trades, series, cfg))
    halts = per_key(drawdown_breach(marked, series, cfg.max_drawdown_pct))
    alive = marked
    if not halts.isEmpty():
        alive = marked.join(halts, keys, "left").where(c("halt_rn").isNull() | (c(RN) <= c("halt_rn")))
        trades = cut_at_halt(trades, prepared, halts, keys, cfg)
    return Backtest(
        materialize(with_excursions(trades, alive, keys)),
        alive.select(*keys, "ts", F.col(RN).alias("rn"), "equity"),
    )


def cut_at_halt(
    trades: DataFrame, prepared: DataFrame, halts: DataFrame, keys: list[str], cfg: BacktestConfig
) -> DataFrame:
    """Drop trades entered after the halt and re-close the one that was open."""
    where = prepared.join(halts, keys).where(c(RN) == c("halt_rn")) if cfg.halt_close == "halt_bar" else prepared.join(
        halts, keys
    )
    closes = where.groupBy(*keys).agg(
        F.first("halt_rn").alias("halt_rn"), F.max_by("close", RN).alias("_mid"), F.max_by("ts", RN).alias("_ts"),
        F.max(RN).alias("_rn"),
    )
    df = trades.join(per_key(closes), keys, "left").where(c("halt_rn").isNull() | (c("entry_rn") <= c("halt_rn")))
    cut = F.coalesce(c("exit_rn") > c("halt_rn"), F.lit(False))
    long, size, entry = c("direction") == "long", c("size"), c("entry_price")
    price = exit_fill(c("_mid"), long, cfg)
    unit = unit_pnl(entry, price, long, cfg)
    new = {
        "exit_rn": c("_rn") if cfg.halt_close == "halt_bar" else c("_rn") + 1,
        "exit_time": c("_ts"),
        "exit_price": price,
        "pnl": size * unit,
        "pnl_percent": 100 * div(unit, entry),
        "commission": size * cfg.commission_pct * (entry + price),
        "slippage": size * exit_slippage(c("_mid"), long, cfg),
        "exit_reason": F.lit("end_of_backtest"),
        "capital_after": c("capital_before") + size * unit,
    }
    return df.withColumns({k: F.when(cut, v).otherwise(c(k)) for k, v in new.items()}).select(*keys, *LEDGER_COLUMNS)


# ---- tables over a finished ledger ---------------------------------------------------------


def kelly_sizes(trades: DataFrame, series: Series, lookback=100, after=20) -> DataFrame:
    """Kelly share before each trade, from the ``lookback`` trades before it once more than ``after`` exist."""
    from candela.functions.series import on_series

    def stage(df, f):
        past = f.w.rowsBetween(-lookback, -1)
        won = F.when(c("pnl") > 0, c("pnl"))
        lost = F.when(c("pnl") < 0, c("pnl"))
        n = F.count("pnl").over(past)
        df = df.withColumns(
            {
                "_wr": div(F.count(won).over(past), n),
                "_aw": F.avg(won).over(past),
                "_al": F.abs(F.avg(lost).over(past)),
            }
        )
        usable = (c(RN) - 1 > after) & c("_aw").isNotNull() & c("_al").isNotNull()
        return df.withColumn(
            "kelly_fraction", F.when(usable, kelly_fraction(c("_wr"), c("_aw"), c("_al")))
        ).drop("_wr", "_aw", "_al")

    return on_series(trades, series, stage, lookback)


def ledger_equity(trades: DataFrame, series: Series, capital: float = 10000.0) -> DataFrame:
    """Equity after each exit, with a start row at the first entry."""
    keys = list(series.keys)
    slim = trades.select(*keys, *series.order, "pnl")
    steps = running(index(slim, series), series, {"_cum": ("sum", c("pnl"))})
    steps = steps.select(*keys, c("exit_time").alias("ts"), F.col(RN).alias("step"), (capital + c("_cum")).alias("equity"))
    start = trades.groupBy(*keys).agg(F.min("entry_time").alias("ts")).select(
        *keys, "ts", F.lit(0).cast("bigint").alias("step"), F.lit(float(capital)).alias("equity")
    )
    return start.unionByName(steps)


# Win rate and Sharpe levels with the size multiplier they earn.
SIZE_LADDER = [(0.60, 1.5, 1.5), (0.55, 1.0, 1.2), (0.50, 0.5, 1.0), (0.45, 0.0, 0.75), (0.40, None, 0.5)]


def size_multiplier(win_rate: Column, sharpe: Column, trades: Column) -> Column:
    """0.25 to 1.5 by recent performance; 0.5 below 20 trades."""
    out = F.when(trades < 20, 0.5)
    for rate, ratio, multiplier in SIZE_LADDER:
        out = out.when((win_rate > rate) & (F.lit(True) if ratio is None else sharpe > ratio), multiplier)
    return out.otherwise(0.25)


def performance_multiplier(trades: DataFrame, keys: list[str], order: list[str], last: int = 20) -> DataFrame:
    """Size multiplier per key from its last 20 trades."""
    from candela.operators.metrics import last_rows

    counts = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"))
    recent = last_rows(trades, keys, order, last).groupBy(*keys).agg(
        (F.count_if(c("pnl") > 0) / last).alias("win_rate"),
        (div0(F.avg("pnl_percent"), F.stddev_pop("pnl_percent")) * 252**0.5).alias("sharpe"),
    )
    both = counts.join(recent, keys)
    return both.withColumn("size_multiplier", size_multiplier(c("win_rate"), c("sharpe"), c("trades")))


def orders_intent(
    entries: DataFrame, multipliers: DataFrame, keys: list[str], capital: float = 10000.0, risk=0.02,
    recovery: Column | None = None,
) -> DataFrame:
    """Signed whole units per entry signal: base size times the performance and recovery multipliers."""
    df = entries.join(multipliers.select(*keys, "size_multiplier"), keys, "left")
    base = div(F.lit(capital * risk), F.abs(c("close") - c("stop_loss")))
    units = F.floor(base * F.coalesce(c("size_multiplier"), F.lit(0.5)) * (recovery if recovery is not None else F.lit(1.0)))
    return df.withColumn("units", F.when(c("action") == "buy", units).otherwise(-units).cast("bigint"))


def compounding(trades: DataFrame, cfg: BacktestConfig, series: Series, share: str = "_f") -> DataFrame:
    """Capital before and after each trade of an ordered table of relative results."""
    df = running(index(trades, series), series, {"_log": ("sum", F.log1p(share))})
    df = df.withColumn("capital_after", cfg.initial_capital * F.exp("_log"))
    return df.withColumn("capital_before", c("capital_after") / (1 + c(share))).drop("_log", *HELPERS)


def sweep(cfg: BacktestConfig, **changes) -> BacktestConfig:
    return replace(cfg, **changes)
