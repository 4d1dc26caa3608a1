"""Streams with state: timers, what is left in the state, and runs that go on from a checkpoint."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest

from barflow.plans.stream_queries import drained, streamed
from barflow.streaming import jobs as R

T0 = dt.datetime(2024, 3, 4, 10)
ALERTS = "symbol string, ts timestamp, high double, low double, side string, entry double, sl double, tp double"
hour = lambda h: T0 + dt.timedelta(hours=h)


class Run:
    """A stream over a folder that gets a file a step; each step goes on from the checkpoint."""

    def __init__(self, spark, folder, schema, job):
        self.spark, self.folder, self.schema, self.job, self.steps = spark, folder, schema, job, itertools.count()

    def step(self, rows):
        """Rows out of this step, and the rows that the state holds after it."""
        n = next(self.steps)
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        before = self.out().collect() if n else []
        stream = self.job(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in"))
        self.kind = stream.schema
        query = stream.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
        last = [p for p in query.recentProgress if p.stateOperators]
        held = last[-1].stateOperators[0].numRowsTotal if last else None
        after = self.out().collect()
        [after.remove(r) for r in before]
        return sorted(tuple(r) for r in after), held

    def out(self):
        return self.spark.read.schema(self.kind).parquet(f"{self.folder}/out")


def bar(symbol, h, high=10.5, low=9.5):
    return (symbol, hour(h), high, low, None, None, None, None)


def alert(symbol, h, side="LONG"):
    return (symbol, hour(h), None, None, side, 10.0, 9.0, 12.0) if side == "LONG" else (symbol, hour(h), None, None, side, 10.0, 12.0, 9.0)


def test_alerts_close_by_a_timer_and_the_state_empties(spark, tmp_path):
    run = Run(spark, str(tmp_path), ALERTS, lambda rows: R.alert_stream(rows, grace_hours=24))
    out, held = run.step([alert("A", 0), alert("B", 0, "SHORT"), bar("B", 1), alert("C", 0), bar("C", 1, high=12.5)])
    assert out == [("C", hour(0), hour(1), "TP")] and held > 0
    # Only B goes on: its bar at the time stop ends its alert, A's is still open.
    out, _ = run.step([bar("B", 9)])
    assert out == [("B", hour(0), hour(9), "TIME_STOP")]
    # Another symbol moves the watermark beyond A's time stop and grace: a timer ends A's alert, without a bar of A.
    out, held = run.step([bar("D", 80)])
    assert out == [("A", hour(0), hour(8), "TIME_STOP")] and held == 0


def test_a_bar_after_the_grace_is_as_good_as_none(spark, tmp_path):
    """Whether the late bar or the timer comes first, the alert ends at its time stop."""
    run = Run(spark, str(tmp_path), ALERTS, lambda rows: R.alert_stream(rows, hours=8, grace_hours=2))
    out, held = run.step([alert("A", 0), alert("A", 1), bar("A", 2), bar("A", 9.5, low=8.0), bar("A", 30)])
    assert out == [("A", hour(0), hour(9.5), "SL"), ("A", hour(1), hour(9.5), "SL")] and held == 0
    out, held = run.step([alert("A", 40), bar("A", 41), bar("A", 52)])
    assert out == [("A", hour(40), hour(48), "TIME_STOP")] and held == 0


@pytest.mark.parametrize("cuts", [1, 4])
def test_runs_from_a_checkpoint_as_in_one(spark, tmp_path, cuts):
    """Gaps and throttled signals do not depend on how rows are cut into runs."""
    times = [0, 1, 2, 5, 6, 30, 31, 32, 40, 41]
    rows = [(s, hour(t), 50.0 + 7 * (t % 5), "LONG" if t % 3 else "SHORT") for s in ("A", "B") for t in times]
    rows.sort(key=lambda r: r[1])
    size = -(-len(rows) // cuts)
    schema = "symbol string, ts timestamp, strength double, direction string"
    gaps = Run(spark, str(tmp_path / "gaps"), schema, lambda x: R.gap_stream(x.select("symbol", "ts")))
    sent = Run(spark, str(tmp_path / "sent"), schema, R.throttle_stream)
    found, signals = [], []
    for k in range(cuts):
        found += gaps.step(rows[k * size : (k + 1) * size])[0]
        out, held = sent.step(rows[k * size : (k + 1) * size])
        signals += out
    assert held <= 2 * 4  # two values and a timer (kept twice) of each symbol
    assert sorted(found) == sorted((s, hour(a), hour(b), (b - a) * 60.0) for s in ("A", "B") for a, b in ((2, 5), (6, 30), (32, 40)))
    last, want = {}, []
    for s, t, strength, way in rows:
        if s not in last or way != last[s][2] or (t - last[s][0] >= dt.timedelta(minutes=30) and strength >= last[s][1] + 10):
            last[s] = (t, strength, way)
            want.append((s, t, strength, way))
    assert sorted(signals) == sorted(want)


def test_silent_symbols_are_freed(spark, tmp_path):
    run = Run(spark, str(tmp_path), "symbol string, ts timestamp", lambda x: R.gap_stream(x, stale_days=5))
    _, held = run.step([("A", hour(0)), ("B", hour(0))])
    both = held
    _, held = run.step([("B", hour(24 * 4)), ("B", hour(24 * 8))])
    assert held < both  # the watermark is at day 7: A went silent more than five days ago
    out, _ = run.step([("A", hour(24 * 9)), ("A", hour(24 * 9 + 3))])
    assert [(s, a) for s, a, _, _ in out] == [("A", hour(24 * 9))]  # A starts anew: no gap from its first time


def test_entries_go_on_from_a_checkpoint(spark, tmp_path):
    """The day's VWAP and the last volumes carry over a restart."""
    import random

    rnd = random.Random(3)
    rows, price = [], 100.0
    for t in range(120):
        close = price + rnd.uniform(-1, 1)
        rows.append(("A", hour(t), price, max(price, close) + rnd.uniform(0, 2), min(price, close) - rnd.uniform(0, 2), close, rnd.uniform(50, 150)))
        price = close
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    whole, parts = (Run(spark, str(tmp_path / x), schema, lambda s: R.signal_stream(s, wick_ratio=0.5)) for x in ("whole", "parts"))
    want = whole.step(rows)[0]
    got = [r for k in range(0, 120, 40) for r in parts.step(rows[k : k + 40])[0]]
    assert len(want) > 2 and got == want


def throttled(rows):
    """What is sent of (symbol, ts, strength, direction) in order of time and strength."""
    last, sent = {}, []
    for s, t, strength, way in sorted(rows, key=lambda r: (r[1], r[2])):
        if s not in last or way != last[s][2] or (t - last[s][0] >= dt.timedelta(minutes=30) and strength >= last[s][1] + 10) or t - last[s][0] >= dt.timedelta(days=90):
            last[s] = (t, strength, way)
            sent.append((s, t, strength, way))
    return sorted(sent)


@pytest.mark.parametrize("dealt", [lambda df: df.coalesce(1), lambda df: df.repartition(3), lambda df: df.repartitionByRange(3, "direction")], ids=["one", "three", "by direction"])
def test_a_trigger_is_one_part_however_rows_are_dealt_out(spark, dealt):
    """Where a part has few files, the next part's first files do not join its trigger: their watermark would drop the rest of that part."""
    rows = [("AB"[t % 2], hour(t), float(37 * t % 90), "LONG" if t * t % 7 < 3 else "SHORT") for t in range(300)]
    df = dealt(spark.createDataFrame(rows, "symbol string, ts timestamp, strength double, direction string"))
    got = drained(R.throttle_stream(streamed(df))).select("symbol", "ts", "strength", "direction").collect()
    assert sorted(tuple(r) for r in got) == throttled(rows)
    query = streamed(df).writeStream.format("noop").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [100, 100, 100]


class Way(str):
    """A direction that counts how often it is compared."""

    compared = 0

    def __eq__(self, other):
        Way.compared += 1
        return str(self) == str(other)

    def __ne__(self, other):
        Way.compared += 1
        return str(self) != str(other)

    __hash__ = str.__hash__


@pytest.mark.parametrize("way", [lambda t: "SL"[t % 2], lambda t: "L", lambda t: "SL"[t // 40 % 2]])
def test_throttling_looks_at_a_row_once(way):
    """Many rows of a symbol in one trigger, nearly all sent or nearly none: the work is in proportion to the rows."""
    rows = [("A", hour(0) + dt.timedelta(minutes=t // 2), float(t * 13 % 100), way(t)) for t in range(3000)]
    processor = R.ThrottleProcessor(30, 10, int(90 * R.DAY_US))
    processor.value, processor.keep = type("None_", (), {"exists": lambda self: False})(), lambda *_: None
    at = np.array([r[1].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6 for r in rows]).astype("int64")
    pdf = pd.DataFrame({"at": at, "strength": [r[2] for r in rows], "direction": [Way(r[3]) for r in rows]}).sample(frac=1, random_state=1)
    Way.compared = 0
    out = pd.concat(processor.handleInputRows(("A",), iter([pdf[:1100], pdf[1100:]]), None))
    assert Way.compared <= 2 * len(rows)
    got = [("A", dt.datetime.fromtimestamp(t / 1e6, dt.timezone.utc).replace(tzinfo=None), x, str(w)) for t, x, w in zip(out["ts_us"], out["strength"], out["direction"], strict=True)]
    assert sorted(got) == throttled(rows)
