"""One open position at a time, by blocks, against a scan of the whole series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barflow.operators import trades as T

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, n bigint, ts timestamp_ntz, exit_ts timestamp_ntz, parts array<int>"


def scan(rows):
    """Kept rows of one series, one after another."""
    kept, free = [], None
    for r in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[3] or dt.datetime.max)):
        if free is None or r[2] > free:
            kept.append(r[:4])
            free = r[3] or dt.datetime.max
    return kept


@pytest.mark.parametrize("days", [0.01, 1, 5, 400])
def test_blocks_against_a_scan(spark, days):
    rnd = random.Random(int(days * 100))
    rows, n = [], 2**60
    for symbol in ("A", "B", "C", None):
        for _ in range(150 if symbol != "C" else 3):
            n += 1
            start = T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 20))
            long = rnd.choice([0, 1, 30, 60 * 5, 60 * 24 * 3])
            rows.append((symbol, n, start, start + dt.timedelta(minutes=long), [n % 7]))
        rows.append((symbol, n + 1000, None, T0, [1]))
    rows.append(("A", 5, T0 + dt.timedelta(days=19), None, [2]))  # no exit: nothing follows
    got = T.one_position(spark.createDataFrame(rows, SCHEMA).repartition(3), ["symbol"], days)
    assert got.columns == ["symbol", "n", "ts", "exit_ts", "parts"]
    found = got.collect()
    for symbol in ("A", "B", "C", None):
        want = scan([r for r in rows if r[0] == symbol])
        mine = sorted((tuple(r)[:4] for r in found if r.symbol == symbol), key=lambda r: r[2])
        assert [r[2:] for r in mine] == [r[2:] for r in want] and set(mine) <= set(r[:4] for r in rows)  # of equal trades either may stay
    assert T.one_position(spark.createDataFrame([], SCHEMA), ["symbol"], days).count() == 0


def test_a_long_series_spreads_over_tasks(spark):
    """A million signals of one symbol: no task sees all of them, and the chain is that of a scan."""
    n = 1_000_000
    made = spark.range(n).select(F.lit("A").alias("symbol"), "id", F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("ts"))
    trades = made.withColumn("exit_ts", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.pmod(F.xxhash64("id"), F.lit(9000))).cast("int")))
    got = T.one_position(trades, ["symbol"], 30)
    rows = trades.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), F.unix_micros(F.col("exit_ts").cast("timestamp")).alias("e")).toPandas().sort_values("s")
    starts, ends = rows["s"].to_numpy(), rows["e"].to_numpy()
    want, at = [], 0
    while at < n:
        want.append(at)
        at = max(at + 1, int(starts.searchsorted(ends[at], "right")))
    assert [r.id for r in got.select("id").orderBy("id").collect()] == want
    shares = trades.groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (30 * 86_400_000_000))).count().agg(F.max("count"), F.count("*")).first()
    assert shares[0] < n / 100 and shares[1] > 100
