"""Exponential means over chunks against the recursion itself, and workers without the package."""

import datetime as dt
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barflow.functions.ema import chunk_of, ema, step_seconds

REPO = Path(__file__).resolve().parents[1]
T0 = dt.datetime(2024, 3, 4, 10)
SCHEMA = "symbol string, timeframe string, ts timestamp_ntz, close double, note string, days array<int>"


def recursion(xs, span):
    y, out = None, []
    for x in xs:
        if x is not None:
            y = x if y is None else y + 2 / (span + 1) * (x - y)
        out.append(y)
    return out


@pytest.mark.parametrize("chunk", [1, 3, 10, 50_000])
def test_chunks_against_the_recursion(spark, chunk):
    """Nulls at the start, at chunk ends and through whole chunks; several series; wide gaps; times before 1970."""
    rnd = random.Random(chunk)
    series = {}
    for symbol in ("A", "B", None):
        at, line = (-3 if symbol == "B" else 0), []
        for _ in range(60):
            at += rnd.choice([1, 1, 1, 2, 40])
            line.append((at, None if at % 30 < 12 or rnd.random() < 0.2 else rnd.uniform(1, 9)))
        series[symbol] = line
    start = lambda s: dt.datetime(1969, 12, 30) if s == "B" else T0
    rows = [(s, "1h", start(s) + dt.timedelta(hours=h), x, None, [h]) for s, line in series.items() for h, x in line]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = ema(df, {"e9": ("close", 9), "e3": ("close", 3)}, chunk=chunk)
    assert got.columns == [*df.columns, "e9", "e3"]
    for s, line in series.items():
        mine = sorted((r for r in got.collect() if r.symbol == s), key=lambda r: r.ts)
        assert [r.days for r in mine] == [[h] for h, _ in line]
        for name, span in (("e9", 9), ("e3", 3)):
            want = recursion([x for _, x in line], span)
            assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip([getattr(r, name) for r in mine], want, strict=True))
    assert ema(df.limit(0), {"e": ("close", 5)}).count() == 0
    assert ema(df.withColumn("ts", F.lit(None).cast("timestamp_ntz")), {"e": ("close", 5)}, chunk=chunk).count() == len(rows)


def test_no_pass_over_a_whole_series(spark):
    """Rows meet by chunk; only one row a chunk meets by series."""
    b = spark.createDataFrame([("A", "1h", T0, 1.0, None, [1])], SCHEMA)
    plan = ema(b, {"e": ("close", 5)})._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    steps = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert any("_chunk" in line for line in steps)
    below = plan[plan.index("FlatMapGroupsInPandas") :]
    assert "_m" in below.split("hashpartitioning")[0] or "first" in below.split("hashpartitioning")[0]


def test_steps(spark):
    names = ["1m", "15m", "1h", "4h", "1d", "1w", "30s", "odd", None, "0h"]
    df = spark.createDataFrame([(n,) for n in names], "timeframe string")
    assert [r.s for r in df.select(step_seconds(F.col("timeframe")).alias("s")).collect()] == [60, 900, 3600, 14400, 86400, 604800, 30, 60, 60, 1]
    hours = spark.createDataFrame([(T0 + dt.timedelta(hours=h),) for h in range(200)], "ts timestamp_ntz")
    sizes = [r["count"] for r in hours.groupBy(chunk_of(F.col("ts"), F.lit("1h"), 50)).count().collect()]
    assert max(sizes) == 50 and sum(sizes) == 200


def test_workers_need_not_have_the_package(tmp_path):
    """Means, one position and a stream with state from another folder, where workers cannot import the package."""
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
from barflow import registry
q = registry.queries()
for name in ("i02_ema", "t05_one_position", "t20_sweep", "m05_split", "p19_exit_scores", "r07_throttle_stream"):
    n = q[name](spark, "/root/testdata/sf0.001").count()
    assert n > 0, name
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-1500:]
