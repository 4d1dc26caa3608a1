"""Structured Streaming forms of collecting, signalling and monitoring.

State is kept by symbol in RocksDB and does not grow with the past: watermarks drop what is too
late, and timers in event time close alerts and free symbols that have gone silent.  A symbol's
rows of one trigger meet in its task, so sources should bound the rows of a trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.shipping import ship
from ..sources import store

LATE, STALE_DAYS, DAY_US = "24 hours", 90.0, 24 * 3600 * 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def ingest_stream(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Rows once for each key within the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def upsert_batches(stream: DataFrame, path: str, keys: list[str], checkpoint: str, name: str = "upserts", order: list[str] | None = None) -> StreamingQuery:
    """A query whose rows replace stored rows of the same key: each batch is one version of the store at ``path``.

    The store notes the batch with the version, so a batch that comes again after a failure
    changes nothing.  ``read_store`` gives the newest row of a key, ``compact`` merges versions.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.commit(batch, path, keys, order, stream=name, batch=number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bars_stream(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Closed OHLCV bars of events (ts, event_id, event_type, value, k)."""
    order = F.struct("ts", "event_id")
    g = timed(events).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol"))
    made = g.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("k").alias("volume"))
    return made.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def activity_stream(events: DataFrame, back: str = "24 hours", every: str = "1 hour", late: str = LATE) -> DataFrame:
    """Events and distinct-ish users of the last ``back``, every ``every``."""
    g = timed(events).withWatermark("ts", late).groupBy(F.window("ts", back, every).alias("w"), F.col("event_type").alias("symbol"))
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("avg_value")).select("symbol", F.col("w.end").alias("until"), "n", "avg_value")


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Runs of events of a user with no pause longer than ``gap``."""
    g = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def with_state(df: DataFrame, processor: StatefulProcessor, out: str, late: str = LATE) -> DataFrame:
    """``processor`` over the rows of each symbol, in event time; times pass as microseconds (``at``), so the session's zone does not matter.

    Columns of ``out`` whose names end in ``_us`` become times without that ending.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # state on local disk, its changes in the checkpoint
    rows = timed(df).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    made = rows.groupBy("symbol").transformWithStateInPandas(processor, out, "append", "eventTime")
    return made.select(*[F.timestamp_micros(c).alias(c.removesuffix("_us")) if c.endswith("_us") else F.col(c) for c in made.columns])


class Keeper(StatefulProcessor):
    """One value a symbol, freed by a timer ``stale_us`` after the symbol's last row in event time.

    A value that old counts as none also where its timer has not fired yet, so results do not
    depend on how rows are cut into triggers.
    """

    schema: T.StructType

    def __init__(self, stale_us: int):
        self.stale_us = stale_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("at", T.LongType())]))

    def held(self, first: int) -> tuple | None:
        """The value for rows from time ``first`` on."""
        return self.value.get() if self.value.exists() and first - self.seen.get()[0] < self.stale_us else None

    def keep(self, value: tuple, at: int) -> None:
        if self.seen.exists():
            at = max(at, self.seen.get()[0])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.value.update(value)
        self.seen.update((at,))
        self.handle.registerTimer(-(-(at + self.stale_us) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def gathered(rows: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """Columns of a symbol's rows of one trigger; only what the processor needs is held."""
    parts = [[pdf[c].to_numpy() for c in columns] for pdf in rows]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


class GapProcessor(Keeper):
    """State: the last time of a symbol."""

    schema = T.StructType([T.StructField("last", T.LongType())])

    def __init__(self, minutes: float, stale_us: int):
        super().__init__(stale_us)
        self.minutes = minutes

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = np.unique(gathered(rows, "at")[0])
        held = self.held(int(at[-1])) and self.value.get()
        line = np.r_[held[0], at[at > held[0]]] if held else at
        if len(line):
            self.keep((int(line[-1]),), int(line[-1]))
        wide = np.diff(line) / 60e6
        gap = (wide > self.minutes) & (np.diff(line) < self.stale_us)
        yield pd.DataFrame({"symbol": key[0], "gap_start_us": line[:-1][gap], "gap_end_us": line[1:][gap], "minutes": wide[gap]})


def gap_stream(bars: DataFrame, minutes: float = 90.0, stale_days: float = STALE_DAYS) -> DataFrame:
    """Gap rows as bars arrive; a symbol without bars for ``stale_days`` counts as new when it comes back."""
    return with_state(bars, GapProcessor(minutes, int(stale_days * DAY_US)), "symbol string, gap_start_us bigint, gap_end_us bigint, minutes double")


class ThrottleProcessor(Keeper):
    """State: time, strength and direction of the last signal sent."""

    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("strength", T.DoubleType()), T.StructField("direction", T.StringType())])

    def __init__(self, minutes: float, step: float, stale_us: int):
        super().__init__(stale_us)
        self.pause_us, self.step = int(minutes * 60e6), step

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, strength, direction = gathered(rows, "at", "strength", "direction")
        order = np.lexsort((strength, at))
        at, strength, direction = at[order], strength[order].astype(float), direction[order]
        sent = self.value.get() if self.value.exists() else None
        kept = []
        for i, (t, x, way) in enumerate(zip(at.tolist(), strength.tolist(), direction, strict=True)):  # each row once: what is sent depends on what was sent before
            if sent is None or way != sent[2] or (t - sent[0] >= self.pause_us and x >= sent[1] + self.step) or t - sent[0] >= self.stale_us:
                kept.append(i)
                sent = (t, x, way)
        self.keep(sent, sent[0])
        yield pd.DataFrame({"symbol": key[0], "ts_us": at[kept], "strength": strength[kept], "direction": direction[kept]})


def throttle_stream(signals: DataFrame, minutes: float = 30.0, step: float = 10.0, stale_days: float = STALE_DAYS) -> DataFrame:
    """Signals (symbol, ts, strength, direction) worth sending: the first, a change of direction, later and stronger by ``step``, or ``stale_days`` after the last sent."""
    return with_state(signals, ThrottleProcessor(minutes, step, int(stale_days * DAY_US)), "symbol string, ts_us bigint, strength double, direction string")


class SignalProcessor(Keeper):
    """State: last time, the day's sums for the VWAP and the last volumes of a symbol."""

    schema = T.StructType([
        T.StructField("last", T.LongType()), T.StructField("day", T.StringType()), T.StructField("value_sum", T.DoubleType()), T.StructField("volume_sum", T.DoubleType()),
        T.StructField("volumes", T.ArrayType(T.DoubleType())),
    ])

    def __init__(self, wick_ratio: float, vol_mult: float, mean_bars: int, stale_us: int):
        super().__init__(stale_us)
        self.wick_ratio, self.vol_mult, self.mean_bars = wick_ratio, vol_mult, mean_bars

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["at", "open", "high", "low", "close", "volume"]
        new = pd.DataFrame(dict(zip(names, gathered(rows, *names), strict=True))).drop_duplicates("at").sort_values("at")
        held = self.held(int(new["at"].iloc[0]))
        last, day, value_sum, volume_sum, volumes = held or (None, None, 0.0, 0.0, [])
        if last is not None:
            new = new[new["at"] > last]
        new = new.reset_index(drop=True)
        if new.empty:
            return
        ny = pd.to_datetime(new["at"], unit="us", utc=True).dt.tz_convert("America/New_York").dt.date.astype(str)
        value, same = (new["high"] + new["low"] + new["close"]) / 3 * new["volume"], ny == day
        values, sums = value.groupby(ny).cumsum() + same * value_sum, new["volume"].groupby(ny).cumsum() + same * volume_sum
        vwap = values / sums.replace(0, float("nan"))
        longer = pd.concat([pd.Series(list(volumes), dtype=float), new["volume"]], ignore_index=True)
        mean = longer.rolling(self.mean_bars).mean().iloc[len(volumes):].reset_index(drop=True)
        body = (new["close"] - new["open"]).abs()
        lower, upper = new[["open", "close"]].min(axis=1) - new["low"], new["high"] - new[["open", "close"]].max(axis=1)
        loud = (new["volume"] > mean * self.vol_mult) & (mean != 0)
        side = pd.Series(None, index=new.index, dtype=object)
        side[loud & (new["high"] >= vwap) & (new["close"] < vwap) & (upper > self.wick_ratio * body)] = "SHORT"
        side[loud & (new["low"] <= vwap) & (new["close"] > vwap) & (lower > self.wick_ratio * body)] = "LONG"
        at = int(new["at"].iloc[-1])
        self.keep((at, ny.iloc[-1], float(values.iloc[-1]), float(sums.iloc[-1]), longer.tail(self.mean_bars - 1).astype(float).tolist()), at)
        yield new.assign(side=side, symbol=key[0], ts_us=new["at"])[side.notna()][["symbol", "ts_us", "side", "close"]]


def signal_stream(bars: DataFrame, wick_ratio: float = 1.0, vol_mult: float = 1.0, mean_bars: int = 20, stale_days: float = STALE_DAYS) -> DataFrame:
    """Entries on closed bars of any width; a symbol without bars for ``stale_days`` starts anew."""
    return with_state(bars, SignalProcessor(wick_ratio, vol_mult, mean_bars, int(stale_days * DAY_US)), "symbol string, ts_us bigint, side string, close double")


class AlertProcessor(StatefulProcessor):
    """State: the open alerts of a symbol as a map by their time, each with a timer for its time stop."""

    def __init__(self, span_us: int, grace_us: int):
        self.span_us, self.grace_us = span_us, grace_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held = [T.StructField("side", T.StringType()), T.StructField("sl", T.DoubleType()), T.StructField("tp", T.DoubleType())]
        self.open = handle.getMapState("open", T.StructType([T.StructField("at", T.LongType())]), T.StructType(held))

    def timer(self, at: int) -> int:
        return -(-(at + self.span_us + self.grace_us) // 1000)

    def frame(self, key, ended: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *e) for e in ended], columns=["symbol", "alert_ts_us", "ts_us", "reason"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, low, high, entry, side, sl, tp = gathered(rows, "at", "low", "high", "entry", "side", "sl", "tp")
        bar = pd.isna(entry)
        order = np.argsort(at[bar], kind="stable")
        ts, lows, highs = at[bar][order], low[bar][order].astype(float), high[bar][order].astype(float)
        opened = {int(k[0]): tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        new = {int(a): (s, float(x), float(y)) for a, s, x, y in zip(at[~bar], side[~bar], sl[~bar], tp[~bar], strict=True)}
        ended = []
        for start, (way, stop_at, target_at) in {**new, **opened}.items():
            due = start + self.span_us
            a, b = ts.searchsorted(start, "right"), ts.searchsorted(due, "left") + 1  # up to the first bar at or after the time stop
            stop, target = (lows[a:b] <= stop_at, highs[a:b] >= target_at) if way == "LONG" else (highs[a:b] >= stop_at, lows[a:b] <= target_at)
            timely = ts[a:b] <= due + self.grace_us
            hit = (stop | target | (ts[a:b] >= due)) & timely
            if hit.any():
                i = int(hit.argmax())
                ended.append((start, int(ts[a + i]), "SL" if stop[i] else "TP" if target[i] else "TIME_STOP"))
            elif not timely.all():  # the first bar since comes too late to matter
                ended.append((start, due, "TIME_STOP"))
            elif start not in opened:
                self.open.updateValue((start,), (way, stop_at, target_at))
                self.handle.registerTimer(self.timer(start))
        for start, _, _ in ended:
            if start in opened:
                self.open.removeKey((start,))
        for timer in {self.timer(start) for start, _, _ in ended if start in opened} - {self.timer(s) for s in {**new, **opened}.keys() - {e[0] for e in ended}}:
            self.handle.deleteTimer(timer)
        yield self.frame(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        done = [int(k[0]) for k, _ in self.open.iterator() if self.timer(int(k[0])) <= now] if self.open.exists() else []
        for start in done:
            self.open.removeKey((start,))
        yield self.frame(key, [(start, start + self.span_us, "TIME_STOP") for start in done])

    def close(self) -> None:
        pass


def alert_stream(rows: DataFrame, hours: float = 8, grace_hours: float = 720) -> DataFrame:
    """First exit of each alert.  One stream holds bars (symbol, ts, high, low) and alerts (symbol, ts, side, entry, sl, tp; bars have no entry).

    An alert comes no later than the bars after it.  It ends by its stop or target (the stop
    wins a bar that reaches both), else by the first bar from its time stop on, if that comes
    within ``grace_hours``, else at its time stop: by a timer, without any later bar of the symbol.
    State is the open alerts.
    """
    hour = 3600 * 1_000_000
    return with_state(rows, AlertProcessor(int(hours * hour), int(grace_hours * hour)), "symbol string, alert_ts_us bigint, ts_us bigint, reason string")


def confirm_stream(forming: DataFrame, closed: DataFrame, late: str = LATE) -> DataFrame:
    """Signals of forming bars with those of the closed bar of the same symbol and time."""
    f = forming.select("symbol", F.col("ts").alias("f_ts"), F.col("side").alias("forming_side")).withWatermark("f_ts", late)
    c = closed.select(F.col("symbol").alias("c_symbol"), F.col("ts").alias("c_ts"), F.col("side").alias("closed_side")).withWatermark("c_ts", late)
    j = f.join(c, (F.col("symbol") == F.col("c_symbol")) & (F.col("f_ts") == F.col("c_ts")), "inner")
    return j.select("symbol", F.col("f_ts").alias("ts"), "forming_side", "closed_side", (F.col("forming_side") == F.col("closed_side")).alias("confirmed"))


ship(__name__)
