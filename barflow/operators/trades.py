"""Joins in time, fills, outcomes, lots, equity and performance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import KEY, SERIES, hours_between, new_york, ratio, running, series
from ..functions.groups import groups
from ..functions.shipping import ship


def asof_daily(bars: DataFrame, daily: DataFrame, cols: list[str], lag_rows: int = 1) -> DataFrame:
    """``cols`` of the last daily row at or before each bar, ``lag_rows`` daily rows earlier (1: no look-ahead).

    Both sides share one ordered window by symbol; a matched null stays null.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    day = daily.select("symbol", "ts", F.struct(*cols).alias("_v")).withColumn("_v", F.lag("_v", lag_rows).over(w) if lag_rows else F.col("_v"))
    tagged = bars.withColumns({"_v": F.lit(None).cast(day.schema["_v"].dataType), "_own": F.lit(1)})
    both = tagged.unionByName(day.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("ts", "_own").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_v", ignorenulls=True).over(order)).filter("_own = 1").select(*bars.columns, "_last.*")


def bars_after(signals: DataFrame, bars: DataFrame, hours: int) -> DataFrame:
    """Each signal with the bars in (ts, ts + hours]: an equal join on symbol and a time bucket as wide as the horizon."""
    step = F.floor(hours_between(F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / hours)
    s = signals.withColumn("_b", F.explode(F.array(step, step + 1)))
    b = bars.select("symbol", "timeframe", F.col("ts").alias("bar_ts"), *[F.col(c).alias(f"bar_{c}") for c in bars.columns if c not in KEY], step.alias("_b"))
    inside = (F.col("bar_ts") > F.col("ts")) & (F.col("bar_ts") <= F.col("ts") + F.make_dt_interval(hours=F.lit(hours)))
    return s.join(b, [*SERIES, "_b"]).filter(inside).drop("_b")


def first_bar_from(signals: DataFrame, bars: DataFrame, hours: int) -> DataFrame:
    """Each signal with the first bar at or after ts + hours, however late; signals without one are left out.

    Both sides share one window by series, ordered from the far end, as in ``asof_daily``.
    """
    cols = [F.col("ts").alias("bar_ts"), *[F.col(c).alias(f"bar_{c}") for c in bars.columns if c not in KEY]]
    b = bars.select(*SERIES, F.struct(*cols).alias("_v"), F.col("ts").alias("_at"), F.lit(0).alias("_own"))
    s = signals.withColumns({"_at": F.col("ts") + F.make_dt_interval(hours=F.lit(hours)), "_own": F.lit(1)})
    ahead = Window.partitionBy(*SERIES).orderBy(F.col("_at").desc(), "_own").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(b, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(ahead))
    return both.filter("_own = 1 and _v is not null").select(*signals.columns, "_v.*")


def compare_sources(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Keys only on one side, or on both with values that differ."""
    left, right = a.select(*keys, F.struct(*cols).alias("l")), b.select(*keys, F.struct(*cols).alias("r"))
    status = F.when(F.col("r").isNull(), "ONLY_LEFT").when(F.col("l").isNull(), "ONLY_RIGHT").when(F.col("l").eqNullSafe(F.col("r")), "SAME").otherwise("DIFFERENT")
    return left.join(right, keys, "full_outer").withColumn("status", status).select(*keys, "status")


def key_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of the intersection, both differences and the union of the keys."""
    x, y = a.select(*keys).distinct().withColumn("l", F.lit(1)), b.select(*keys).distinct().withColumn("r", F.lit(1))
    both = x.join(y, keys, "full_outer")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count("*").alias("all_keys"))


def active_positions(executions: DataFrame) -> DataFrame:
    """Symbols whose filled entries are more than their filled exits."""
    filled = F.col("status") == "FILLED"
    q = lambda kinds: F.sum(F.when(filled & F.col("execution_type").isin(*kinds), F.col("quantity")).otherwise(0.0))
    return executions.groupBy("symbol").agg(q(["ENTRY"]).alias("entered"), q(["EXIT", "STOP_LOSS"]).alias("exited")).filter("entered > exited")


def variant_delta(metrics: DataFrame, keys: list[str], variant: str, value: str, base: str, other: str) -> DataFrame:
    """A metric of two variants side by side, their difference and the reduction in %."""
    wide = metrics.groupBy(*keys).pivot(variant, [base, other]).agg(F.first(value))
    return wide.select(*keys, F.col(base).alias("base"), F.col(other).alias("variant"), (F.col(other) - F.col(base)).alias("delta"), (100 * ratio(F.col(base) - F.col(other), F.col(base))).alias("reduction_pct"))


def with_params(df: DataFrame, params: DataFrame, limit: int = 10_000) -> DataFrame:
    """Every row with every parameter set; the sets are a driver-side input of bounded number."""
    if params.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} parameter sets")
    return df.crossJoin(F.broadcast(params))


# Fills and outcomes.

def next_bar_fills(signals: DataFrame, bars: DataFrame, slippage: float = 0.0005, commission: float = 0.001) -> DataFrame:
    """Fill at the next bar's open, moved against the side, with commission on the value."""
    nxt = bars.select(*KEY, F.lead("ts").over(series()).alias("fill_ts"), F.lead("open").over(series()).alias("next_open"))
    way = F.when(F.col("side") == "LONG", 1 + slippage).otherwise(1 - slippage)
    return signals.join(nxt, KEY).filter("fill_ts is not null").withColumn("fill_price", F.col("next_open") * way).withColumn("fee", F.col("fill_price") * commission)


#: Bars are summed up by days, and SPAN of a level by one of the next; TOP is the last level, LAST_DAY that of the year 9999.
SPAN, TOP, LAST_DAY = 32, 4, 3_652_058


def order_fills(orders: DataFrame, bars: DataFrame) -> DataFrame:
    """First later bar, however late, that reaches a limit or stop order (order_id, side BUY/SELL, kind, level); a gap fills at the open.

    Lows and highs of days, of SPAN days and so on are a tree.  Going up it from the order's
    day, the later siblings of each level cover the rest of the series; the first that
    reaches the level is followed down to its day.  An order meets at most SPAN nodes
    a level on either way, however long it waits.
    """
    ids = [*KEY, "order_id", "side", "kind", "level"]
    below = ((F.col("side") == "BUY") & (F.col("kind") == "LIMIT")) | ((F.col("side") == "SELL") & (F.col("kind") == "STOP"))
    reached = lambda low, high: F.when(below, F.col(low) <= F.col("level")).otherwise(F.col(high) >= F.col("level"))
    day = lambda at: F.datediff(at, F.lit("0001-01-01").cast("date")).cast("bigint")
    up = lambda d, k: F.floor(d / F.lit(SPAN**k))

    days = bars.groupBy(*SERIES, day(F.col("ts")).alias("_d")).agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), up(F.col("_d"), k).alias("_b")) for k in range(TOP + 1)]))
    tree = days.select(*SERIES, levels.alias("_n"), "_lo", "_hi").groupBy(*SERIES, "_n._k", "_n._b").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))

    def later(k: int) -> Column:
        own = up(F.col("_d"), k)
        last = (up(F.col("_d"), k + 1) + 1) * SPAN - 1 if k < TOP else F.lit(LAST_DAY // SPAN**TOP).cast("bigint")
        made = F.transform(F.sequence(own + 1, last), lambda b: F.struct(F.lit(k).alias("_k"), b.alias("_b")))
        return F.when(own < last, made).otherwise(F.array().cast("array<struct<_k:int,_b:bigint>>"))

    o = orders.select(*ids).withColumn("_d", day(F.col("ts")))
    nodes = o.withColumn("_n", F.explode(F.concat(*[later(k) for k in range(TOP + 1)]))).select(*ids, "_n.*")
    found = nodes.join(tree, [*SERIES, "_k", "_b"]).filter(reached("_lo", "_hi")).groupBy(*ids).agg(F.min(F.struct("_k", "_b")).alias("_n")).select(*ids, "_n.*")  # lower levels come first
    for k in range(TOP, 0, -1):
        child = tree.select(*SERIES, (F.col("_k") + 1).alias("_k"), up(F.col("_b"), 1).alias("_b"), F.col("_b").alias("_child"), "_lo", "_hi")
        down = found.filter(F.col("_k") == k).join(child, [*SERIES, "_k", "_b"]).filter(reached("_lo", "_hi"))
        found = found.filter(F.col("_k") < k).unionByName(down.groupBy(*ids).agg(F.min("_child").alias("_b")).withColumn("_k", F.lit(k - 1)))

    b = bars.select(*SERIES, day(F.col("ts")).alias("_b"), F.col("ts").alias("bar_ts"), *[F.col(c).alias(f"bar_{c}") for c in ("open", "low", "high")])
    own = o.select(*ids, F.col("_d").alias("_b"))
    hits = own.unionByName(found.select(*ids, "_b")).join(b, [*SERIES, "_b"]).filter((F.col("bar_ts") > F.col("ts")) & reached("bar_low", "bar_high"))
    price = F.when(below, F.least("bar_open", "level")).otherwise(F.greatest("bar_open", "level"))
    return hits.groupBy("order_id", "symbol", "side", "kind", "level").agg(F.min("bar_ts").alias("fill_ts"), F.min_by(price, "bar_ts").alias("fill_price"))


def bracket_outcomes(signals: DataFrame, bars: DataFrame, hours: int = 8, touch: str = "range", keys: tuple[str, ...] = ()) -> DataFrame:
    """How each signal (side, entry, sl, tp) ended: first of stop, target, close across the VWAP, time stop, session close.

    The stop wins a bar that reaches both.  ``touch='close'`` tests closes only.  The time stop
    ends at the first bar at or after ts + ``hours``, however late, unless another rule does there
    or earlier; only signals that the series ends before stay open and are not in the result.
    Risk is at least 0.1 % of the entry.
    """
    ids = [*KEY, "side", "entry", "sl", "tp", *keys]
    s = signals.select(*ids)
    early_bars = bars_after(s, bars, hours).filter(F.col("bar_ts") < F.col("ts") + F.make_dt_interval(hours=F.lit(hours)))
    b = early_bars.unionByName(first_bar_from(s, bars, hours))
    lo, hi = (F.col("bar_low"), F.col("bar_high")) if touch == "range" else (F.col("bar_close"), F.col("bar_close"))
    long = F.col("side") == "LONG"
    sl, tp = F.when(long, lo <= F.col("sl")).otherwise(hi >= F.col("sl")), F.when(long, hi >= F.col("tp")).otherwise(lo <= F.col("tp"))
    early = F.when(long, F.col("bar_close") < F.col("bar_vwap")).otherwise(F.col("bar_close") > F.col("bar_vwap"))
    ny = new_york(F.col("bar_ts"))
    closing = (F.weekday(ny) < 5) & (F.hour(ny) * 60 + F.minute(ny) >= 950) & (F.hour(ny) < 16)
    reason = F.when(sl, "SL").when(tp, "TP").when(early, "EARLY_EXIT").when(hours_between(F.col("ts"), F.col("bar_ts")) >= hours, "TIME_STOP").when(closing, "SESSION_CLOSE")
    price = F.when(F.col("reason") == "SL", F.col("sl")).when(F.col("reason") == "TP", F.col("tp")).otherwise(F.col("bar_close"))
    ended = b.withColumn("reason", reason).filter("reason is not null").withColumn("exit_price", price)
    first = ended.groupBy(*ids).agg(F.min_by(F.struct("bar_ts", "reason", "exit_price"), "bar_ts").alias("x")).select(*ids, F.col("x.bar_ts").alias("exit_ts"), "x.reason", "x.exit_price")
    way = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    risk = F.greatest(F.abs(F.col("entry") - F.col("sl")), F.abs(F.col("entry")) * 0.001)
    pnl = way * (F.col("exit_price") - F.col("entry"))
    return first.withColumns({"pnl": pnl, "r_multiple": ratio(pnl, risk), "minutes": hours_between(F.col("ts"), F.col("exit_ts")) * 60})


def excursions(trades: DataFrame, bars: DataFrame, hours: int = 8) -> DataFrame:
    """Largest favourable and adverse moves in % between entry and exit (ts, exit_ts, side, entry), over time buckets of ``hours``."""
    ids = [*KEY, "side", "entry", "exit_ts"]
    step = lambda at: F.floor(hours_between(F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at)) / hours)
    t = trades.select(*ids).filter("exit_ts > ts").withColumn("_b", F.explode(F.sequence(step("ts"), step("exit_ts"))))
    made = bars.select(*SERIES, F.col("ts").alias("bar_ts"), F.col("high").alias("bar_high"), F.col("low").alias("bar_low"), step("ts").alias("_b"))
    b = t.join(made, [*SERIES, "_b"]).filter((F.col("bar_ts") > F.col("ts")) & (F.col("bar_ts") <= F.col("exit_ts")))
    up, down = 100 * ratio(F.max("bar_high") - F.first("entry"), F.first("entry")), 100 * ratio(F.min("bar_low") - F.first("entry"), F.first("entry"))
    g = b.groupBy(*ids).agg(up.alias("u"), down.alias("d"))
    long = F.col("side") == "LONG"
    return g.select(*ids, F.when(long, F.col("u")).otherwise(-F.col("d")).alias("mfe_pct"), F.when(long, F.col("d")).otherwise(-F.col("u")).alias("mae_pct"))


BLOCK_DAYS = 90.0


def _micros(df: DataFrame, name: str) -> Column:
    """A time as a number, of either kind of timestamp."""
    if dict(df.dtypes)[name] == "timestamp":
        return F.unix_micros(name)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name))


def _next_starts(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each trade of a sorted run, the first that starts after its exit; the length of the run if none does."""
    return np.maximum(starts.searchsorted(ends, "right"), np.arange(1, len(starts) + 1))


def _block_map(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """What a sorted run of trades does to the time from which one may start: (last start, time it is free from) by runs of starts.

    A time lets the first run enter whose last start is later.  Every trade points to the one
    that would follow it; doubling these pointers gives the last one of each chain.
    """
    n = len(starts)
    to, last = np.r_[_next_starts(starts, ends), n], np.arange(n + 1)
    while (to < n).any():
        last, to = np.where(to < n, last[to], last), to[to]
    first = np.flatnonzero(np.r_[True, starts[1:] != starts[:-1]])  # of equal starts the first enters
    free = ends[last[first]]
    run_ends = np.flatnonzero(np.r_[free[1:] != free[:-1], True])
    return starts[first][run_ends].tolist(), free[run_ends].tolist()


def one_position(trades: DataFrame, keys: list[str], block_days: float = BLOCK_DAYS) -> DataFrame:
    """Trades kept if they start after the exit of the last kept one, by ``keys``; equal starts by exit.

    A trade without an exit lets none follow; one without a start is not kept.  A series is cut
    into blocks of ``block_days``.  What a block does to the time from which a trade may start is
    a short map; only the maps meet by series, and then each block finds its kept trades from
    the time that is carried into it.
    """
    big, columns = 1 << 62, trades.columns
    block = F.floor(F.col("_start") / F.lit(int(block_days * 86_400_000_000)))
    rows = trades.withColumn("_start", _micros(trades, "ts")).filter("_start is not null").withColumns({"_end": F.coalesce(_micros(trades, "exit_ts"), F.lit(big)), "_block": block})
    places = [*keys, "_block"]
    kinds = [f for k in places for f in rows.schema if f.name == k]
    lists = T.ArrayType(T.LongType())

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a block: its keys and what it does to the time that one may start from."""
        for g in groups(batches, places):
            until, free = _block_map(g["_start"].to_numpy(), g["_end"].to_numpy())
            yield pa.RecordBatch.from_arrays([*[g[k].slice(0, 1).combine_chunks() for k in places], pa.array([until], pa.list_(pa.int64())), pa.array([free], pa.list_(pa.int64()))], names=[*places, "until", "free"])

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The time from which a trade may start in each block; a series has a row a block here."""
        for g in groups(batches, keys):
            free, got = -big, []
            for until, after in zip(g["until"].to_pylist(), g["free"].to_pylist(), strict=True):
                got.append(free)
                i = int(np.array(until).searchsorted(free, "right"))
                free = after[i] if i < len(after) else free
            yield pa.RecordBatch.from_arrays([*[g[k].combine_chunks() for k in places], pa.array(got, pa.int64())], names=[*places, "_from"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, places):  # the first row is the block's carried time
            starts, ends = g["_start"].to_numpy()[1:], g["_end"].to_numpy()[1:]
            after = _next_starts(starts, ends)
            kept, at = [], int(starts.searchsorted(g["_from"][0].as_py(), "right"))
            while at < len(starts):
                kept.append(at + 1)
                at = int(after[at])
            yield from g.take(pa.array(kept, pa.int64())).select(columns).combine_chunks().to_batches()

    order = ["_start", "_end"]
    short = rows.select(*places, *order).repartition(*places).sortWithinPartitions(*places, *order)
    heads = short.mapInArrow(maps, T.StructType([*kinds, T.StructField("until", lists), T.StructField("free", lists)]))
    heads = heads.repartition(*keys).sortWithinPartitions(*places).mapInArrow(carried, T.StructType([*kinds, T.StructField("_from", T.LongType())]))
    led = rows.unionByName(heads.withColumns({"_start": F.lit(0).cast("bigint"), "_end": F.lit(0).cast("bigint")}), allowMissingColumns=True)
    return led.repartition(*places).sortWithinPartitions(*places, F.col("_from").asc_nulls_last(), *order).mapInArrow(scan, trades.schema)


def match_fifo(fills: DataFrame) -> DataFrame:
    """First-in-first-out lots of fills (symbol, ts, seq, side, qty, price, commission), reversals included.

    The k-th unit bought meets the k-th unit sold: both sides' cumulative quantities cut
    the quantity axis into segments, and each segment takes the next row of either side.
    Two window passes, no join of rows with rows.  Quantities add up as decimals of nine
    digits, so that equal sums meet.
    """
    upto = Window.partitionBy("symbol", "side").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    row = F.struct("ts", "seq", "price", (F.col("commission") / F.col("qty")).alias("fee"))
    cuts = fills.withColumn("x", F.sum(F.col("qty").cast("decimal(28,9)")).over(upto)).groupBy("symbol", "x").agg(F.max(F.when(F.col("side") == "BUY", row)).alias("b"), F.max(F.when(F.col("side") == "SELL", row)).alias("s"))
    ahead = Window.partitionBy("symbol").orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, 0)  # from the far end: each row sees those after it
    made = cuts.select("symbol", "x", F.last("b", ignorenulls=True).over(ahead).alias("b"), F.last("s", ignorenulls=True).over(ahead).alias("s"), (F.col("x") - F.coalesce(F.lead("x").over(Window.partitionBy("symbol").orderBy(F.col("x").desc())), F.lit(0))).cast("double").alias("qty"))
    lots = made.filter("b is not null and s is not null")
    long = F.struct("b.ts", "b.seq") < F.struct("s.ts", "s.seq")
    pick = lambda f: (F.when(long, F.col(f"b.{f}")).otherwise(F.col(f"s.{f}")), F.when(long, F.col(f"s.{f}")).otherwise(F.col(f"b.{f}")))
    ts, price = pick("ts"), pick("price")
    pnl = (F.col("s.price") - F.col("b.price")) * F.col("qty") - (F.col("b.fee") + F.col("s.fee")) * F.col("qty")
    return lots.select("symbol", F.when(long, "LONG").otherwise("SHORT").alias("side"), ts[0].alias("entry_ts"), ts[1].alias("exit_ts"), price[0].alias("entry_price"), price[1].alias("exit_price"), "qty", pnl.alias("pnl"))


def running_position(fills: DataFrame) -> DataFrame:
    """Position and cash after each fill."""
    way = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    w = Window.partitionBy("symbol").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return fills.withColumns({"position": F.sum(way * F.col("qty")).over(w), "cash": F.sum(-way * F.col("qty") * F.col("price") - F.col("commission")).over(w)})


def equity_curve(fills: DataFrame, closes: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """At every close (symbol, ts, close): cash, position value, equity, peak and drawdown in %.

    Cash adds up as decimals, so it does not depend on the order of additions.
    """
    way = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    moves = fills.groupBy("symbol", "ts").agg(F.sum(way * F.col("qty")).alias("q"), F.sum((-way * F.col("qty") * F.col("price") - F.col("commission")).cast("decimal(28,7)")).alias("m"))
    w = running("symbol")
    both = closes.select("symbol", "ts", "close").join(moves, ["symbol", "ts"], "full_outer")
    made = both.withColumns({"qty": F.coalesce(F.sum("q").over(w), F.lit(0.0)), "cash": capital + F.coalesce(F.sum("m").over(w).cast("double"), F.lit(0.0)), "last": F.last("close", ignorenulls=True).over(w)})
    made = made.withColumn("equity", F.col("cash") + F.col("qty") * F.coalesce("last", F.lit(0.0))).withColumn("peak", F.max("equity").over(w))
    return made.filter("close is not null").select("symbol", "ts", "cash", "qty", "equity", "peak", (100 * ratio(F.col("equity") - F.col("peak"), F.col("peak"))).alias("drawdown_pct"))


def return_metrics(equity: DataFrame) -> DataFrame:
    """Total return, worst drawdown and when, Sharpe of step returns over 252 steps."""
    w = Window.partitionBy("symbol").orderBy("ts")
    r = equity.withColumn("r", ratio(F.col("equity") - F.lag("equity").over(w), F.lag("equity").over(w)))
    g = r.groupBy("symbol").agg(
        F.min_by("equity", "ts").alias("first"), F.max_by("equity", "ts").alias("last"), F.min("drawdown_pct").alias("max_drawdown_pct"), F.min_by("ts", F.struct("drawdown_pct", "ts")).alias("drawdown_ts"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    return g.select("symbol", (100 * ratio(F.col("last") - F.col("first"), F.col("first"))).alias("total_return_pct"), "max_drawdown_pct", "drawdown_ts", (ratio(F.col("m"), F.col("s")) * F.sqrt(F.lit(252.0))).alias("sharpe"))


def round_trips(fills: DataFrame) -> DataFrame:
    """Episodes from flat to flat: entry average, quantity and result."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    made = running_position(fills).withColumn("flat", (F.abs(F.col("position")) < 1e-9).cast("int"))
    made = made.withColumn("episode", F.coalesce(F.sum("flat").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    way = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    side = F.min_by("side", F.struct("ts", "seq"))
    g = made.groupBy("symbol", "episode").agg(side.alias("first_side"), F.sum(F.when(F.col("side") == "BUY", F.col("qty"))).alias("bought"), F.sum(F.when(F.col("side") == "SELL", F.col("qty"))).alias("sold"), F.sum(-way * F.col("qty") * F.col("price") - F.col("commission")).alias("pnl"), F.max("flat").alias("closed"), F.count("*").alias("fills"))
    return g.filter("closed = 1").drop("closed")


# Performance.

def _summary(pnl: Column) -> list[Column]:
    win, lose = F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl <= 0, pnl))
    return [F.count("*").alias("trades"), (100 * ratio(F.count_if(pnl > 0), F.count("*"))).alias("win_rate"), ratio(win, F.abs(lose)).alias("profit_factor"), F.sum(pnl).alias("total_pnl")]


def metric_summary(trades: DataFrame, run: str = "symbol") -> DataFrame:
    """Trades, win rate, profit factor (null without losses) and profit for all, LONG and SHORT, in one pass."""
    g = trades.groupingSets([[F.col(run)], [F.col(run), F.col("side")]], F.col(run), F.col("side")).agg(*_summary(F.col("pnl")))
    return g.withColumn("side", F.coalesce("side", F.lit("ALL")))


def symbol_stats(trades: DataFrame) -> DataFrame:
    p = F.col("pnl")
    return trades.groupBy("symbol").agg(F.count("*").alias("trades"), F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p < 0, p)).alias("avg_loss"), F.max(p).alias("largest_win"), F.min(p).alias("largest_loss"))


def by_exit_reason(trades: DataFrame) -> DataFrame:
    return trades.groupBy("exit_reason").agg(F.count("*").alias("n"), F.avg("pnl").alias("mean_pnl"), F.sum("pnl").alias("sum_pnl"), F.min("pnl").alias("min_pnl"), F.max("pnl").alias("max_pnl"))


def bucketed(trades: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """Counts and results by right-closed buckets (a, b], empty ones included."""
    names = [f"({a:g}, {b:g}]" for a, b in zip(edges, edges[1:], strict=False)]
    which = F.lit(None).cast("string")
    for n, a, b in zip(names, edges, edges[1:], strict=False):
        which = F.when((F.col(col) > a) & (F.col(col) <= b), n).otherwise(which)
    every = trades.sparkSession.createDataFrame([(n,) for n in names], "bucket string")
    g = trades.withColumn("bucket", which).groupBy("bucket").agg(F.count("*").alias("n"), F.avg("pnl").alias("mean_pnl"), (100 * ratio(F.count_if(F.col("pnl") > 0), F.count("*"))).alias("win_rate"))
    return every.join(g, "bucket", "left").fillna({"n": 0})


def correlations(df: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
    one = df.agg(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.corr(x, y).alias("r")) for x in xs for y in ys]).alias("a"))
    return one.select(F.explode("a").alias("a")).select("a.*")


def winners_vs_losers(trades: DataFrame, cols: list[str]) -> DataFrame:
    win = F.col("pnl") > 0
    one = trades.agg(F.array(*[F.struct(F.lit(c).alias("metric"), F.avg(F.when(win, F.col(c))).alias("winners"), F.avg(F.when(~win, F.col(c))).alias("losers")) for c in cols]).alias("a"))
    return one.select(F.explode("a").alias("a")).select("a.*").withColumn("delta_pct", 100 * ratio(F.col("winners") - F.col("losers"), F.abs("losers")))


def relabel_exits(trades: DataFrame, tol: float = 0.005) -> DataFrame:
    """Unknown exits near the target or the stop get its name."""
    near = lambda c: F.abs(ratio(F.col("exit_price") - F.col(c), F.col(c))) < tol
    return trades.withColumn("exit_reason", F.when(F.col("exit_reason") != "UNKNOWN", F.col("exit_reason")).when(near("tp"), "TP").when(near("sl"), "SL").otherwise("UNKNOWN"))


def cost_impact(trades: DataFrame) -> DataFrame:
    gross = F.col("pnl") + F.col("commission")
    return trades.agg(F.sum(gross).alias("gross"), F.sum("pnl").alias("net"), F.sum("commission").alias("commissions"), (100 * ratio(F.sum("commission"), F.sum(F.when(gross > 0, gross)))).alias("commission_pct"), F.count_if((gross > 0) & (F.col("pnl") <= 0)).alias("turned_losers"))


def top_k(df: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *ties).limit(k)


def adaptive_slippage(fills: DataFrame) -> DataFrame:
    """Slippage grows with volatility and with thin volume; at most 0.2 %."""
    base = F.lit(0.0005) * F.when(F.col("atr_pct") > 3, 2.0).when(F.col("atr_pct") > 2, 1.5).otherwise(1.0) * F.when(F.col("vol_ratio") < 0.5, 2.0).when(F.col("vol_ratio") < 1, 1.5).otherwise(1.0)
    return fills.withColumn("slippage", F.least(base, F.lit(0.002)))


def sweep(bars: DataFrame, params: DataFrame, entries, hours: int = 8) -> DataFrame:
    """Entry rule, outcome, one position at a time and summary for every parameter set: ``entries(bars x params)`` gives planned signals."""
    planned = entries(with_params(bars, params))
    ended = bracket_outcomes(planned, bars, hours, keys=("param_id",))
    kept = one_position(ended, [*SERIES, "param_id"])
    return kept.groupBy("symbol", "param_id").agg(*_summary(F.col("pnl")))


def position_summary(executions: DataFrame) -> DataFrame:
    is_ = lambda s: F.col("status") == s
    entry, out = F.col("execution_type") == "ENTRY", F.col("execution_type") != "ENTRY"
    value = F.col("quantity") * F.col("executed_price")
    g = executions.groupBy("symbol", "position_id").agg(
        F.count_if(is_("FILLED")).alias("filled"), F.count_if(is_("PENDING")).alias("pending"), F.count_if(is_("CANCELLED")).alias("cancelled"),
        F.sum(F.when(is_("FILLED") & entry, F.col("quantity")).otherwise(0.0)).alias("shares"), F.sum(F.when(is_("FILLED") & entry, value).otherwise(0.0)).alias("invested"), F.sum(F.when(is_("FILLED") & out, value).otherwise(0.0)).alias("proceeds"), F.count("*").alias("levels"))
    return g.withColumn("progress_pct", 100 * ratio(F.col("filled"), F.col("levels")))


def execution_stats(executions: DataFrame, since=None) -> DataFrame:
    e = executions if since is None else executions.filter(F.col("created_at") >= F.lit(since))
    is_ = lambda s: F.count_if(F.col("status") == s)
    kind = lambda s: F.count_if(F.col("execution_type") == s)
    return e.agg(
        F.count("*").alias("total"), is_("FILLED").alias("filled"), is_("PENDING").alias("pending"), is_("CANCELLED").alias("cancelled"), kind("ENTRY").alias("entries"), kind("EXIT").alias("exits"),
        (100 * ratio(is_("FILLED"), F.count("*"))).alias("fill_rate"), (100 * ratio(is_("CANCELLED"), F.count("*"))).alias("cancel_rate"), F.countDistinct("symbol").alias("symbols"))


def execution_top(executions: DataFrame, since=None, k: int = 10) -> DataFrame:
    """The ``k`` symbols with most executions: total, filled and mean price of filled ones; equal ones by name."""
    e = executions if since is None else executions.filter(F.col("created_at") >= F.lit(since))
    filled = F.col("status") == "FILLED"
    by = e.groupBy("symbol").agg(F.count("*").alias("total"), F.count_if(filled).alias("filled"), F.avg(F.when(filled, F.col("executed_price"))).alias("avg_price"))
    return top_k(by, "total", k, ["symbol"])


def position_status(levels: DataFrame) -> DataFrame:
    filled = F.col("status") == "FILLED"
    n = lambda kind, f=None: F.count_if((F.col("execution_type") == kind) & (filled if f else F.lit(True)))
    avg = ratio(F.sum(F.when(filled & (F.col("execution_type") == "ENTRY"), F.col("quantity") * F.col("executed_price"))), F.sum(F.when(filled & (F.col("execution_type") == "ENTRY"), F.col("quantity"))))
    g = levels.groupBy("symbol", "position_id").agg(n("ENTRY").alias("e"), n("ENTRY", 1).alias("ef"), n("EXIT").alias("x"), n("EXIT", 1).alias("xf"), n("STOP_LOSS", 1).alias("sf"), avg.alias("avg_entry"))
    s = F.when(F.col("sf") > 0, "STOPPED").when((F.col("x") > 0) & (F.col("xf") == F.col("x")), "CLOSED").when(F.col("xf") > 0, "EXITING").when(F.col("ef") == 0, "PENDING").when(F.col("ef") < F.col("e"), "PARTIAL").otherwise("OPEN")
    return g.select("symbol", "position_id", s.alias("position_status"), "avg_entry")


def level_touches(levels: DataFrame, bars: DataFrame, tol: float = 0.001) -> DataFrame:
    """Levels (symbol, level_id, side, level) that the latest bar reaches within ``tol``; price and slippage in %."""
    hit = F.when(F.col("side") == "BUY", F.col("low") <= F.col("level") * (1 + tol)).otherwise(F.col("high") >= F.col("level") * (1 - tol))
    price = F.when(F.col("side") == "BUY", F.least("level", "high")).otherwise(F.greatest("level", "low"))
    return levels.join(bars.select("symbol", "high", "low"), "symbol").withColumns({"touched": hit, "executed_price": F.when(hit, price)}).withColumn("slippage_pct", 100 * ratio(F.col("executed_price") - F.col("level"), F.col("level")))



def join_indicators(bars: DataFrame, indicators: DataFrame) -> DataFrame:
    return bars.join(indicators, KEY)


def alerts_with_performance(alerts: DataFrame, performance: DataFrame) -> DataFrame:
    """Alerts (alert_id, ..., price) with their outcome if any; a closed alert takes its entry price from the alert."""
    p = performance.select("alert_id", "outcome", "pnl_r", F.col("entry_price").alias("_entry"))
    return alerts.join(p, "alert_id", "left").withColumn("entry_price", F.when(F.col("outcome").isNotNull(), F.col("price")).otherwise(F.col("_entry"))).drop("_entry")


ship(__name__)
