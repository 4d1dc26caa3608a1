"""Rules with state, snapshots, small helpers, and the scores of sessions, weekdays and readiness by hand."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.functions import columns as H
from barflow.functions import snapshots as N
from barflow.operators import quality as Q
from barflow.operators import rules as R

T0 = dt.datetime(2024, 3, 4, 10)
BARS = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double, enter boolean"


def walk(symbol, n, seed):
    rnd, price, rows = random.Random(seed), 100.0, []
    for t in range(n):
        close = price * (1 + rnd.uniform(-0.02, 0.02))
        rows.append((symbol, "1h", T0 + dt.timedelta(hours=t), price, max(price, close) * 1.003, min(price, close) * 0.997, close, 1.0, rnd.random() < 0.1))
        price = close
    return rows


def by_hand(rows, trail):
    peak, out = None, []
    for r in rows:
        _, _, ts, o, h, low, c, _, enter = r
        if peak is None:
            if enter:
                peak = c
                out.append((ts, "BUY", c))
        elif low <= peak * (1 - trail):
            out.append((ts, "SELL", min(o, peak * (1 - trail))))
            peak = None
        else:
            peak = max(peak, h)
    return out


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_a_rule_does_not_see_where_batches_end(spark, batch):
    """Trailing stops over several series and parameter sets, in batches of one row to all rows."""
    series = {s: walk(s, 150, k) for k, s in enumerate(("A", "B", None))}
    df = spark.createDataFrame([r for rows in series.values() for r in rows], BARS).repartition(3)
    sets = {1: 0.02, 2: 0.05, 3: 0.9}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = R.apply_rule(df, R.TrailingStop, spark.createDataFrame(list(sets.items()), "param_id bigint, trail double")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s, rows in series.items():
        for p, trail in sets.items():
            mine = [(r.ts, r.action, r.price) for r in sorted((r for r in got if (r.symbol, r.param_id) == (s, p)), key=lambda r: r.ts)]
            assert [(a, b, round(c, 9)) for a, b, c in mine] == [(a, b, round(c, 9)) for a, b, c in by_hand(rows, trail)]


def test_rules_of_ones_own_and_empty_input(spark):
    class Every:
        """Acts on every ``step``-th bar of a series."""

        columns = ["close"]

        def __init__(self, step):
            self.step = step

        def start(self):
            return 0

        def on_bars(self, seen, bars):
            n = len(bars["close"])
            return seen + n, [(i, "MARK", float(bars["close"][i]), str(seen + i)) for i in range(n) if (seen + i) % self.step == 0]

    df = spark.createDataFrame(walk("A", 25, 1), BARS)
    params = spark.createDataFrame([(7, 10)], "param_id bigint, step int")
    assert [r.tag for r in R.apply_rule(df, Every, params).orderBy("ts").collect()] == ["0", "10", "20"]
    assert R.apply_rule(df.limit(0), Every, params).count() == 0
    assert R.apply_rule(df, Every, params.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.apply_rule(df, Every, spark.range(R.MOST_SETS + 5).select(F.col("id").alias("param_id"), F.lit(1).alias("step")))


def test_snapshots_lose_nothing(spark):
    odd = [0.1 + 0.2, 1e-300, -1.7976931348623157e308, None, float("nan"), 5e-324, 123456789.123456789]
    rows = [("A_\"x\"", "1h", T0 + dt.timedelta(hours=i, microseconds=i), x, x, x, x, x, True) for i, x in enumerate(odd)] + [("é", "1d", T0, 1.0, 1.0, 1.0, 1.0, None, True)]
    bars = spark.createDataFrame(rows, BARS)
    gaps = spark.createDataFrame([("é", "1d", "SMALL_GAP", "LOW"), ("é", "1d", "SMALL_GAP", None), ("é", "1d", "WEEKEND", "HIGH")], "symbol string, timeframe string, gap_type string, severity string")
    made = N.to_snapshot(bars, gaps)
    back = N.snapshot_rows(made).collect()
    want = [(r[0], r[1], r[2], r[6]) for r in rows[2:]]
    key = lambda r: (r[0], r[2])
    same = lambda a, b: (a is None) == (b is None) and (a is None or a == b or (np.isnan(a) and np.isnan(b)))
    for r, w in zip(sorted(((r.symbol, r.timeframe, r.ts, r.close) for r in back), key=key), sorted(want, key=key), strict=True):
        assert r[:3] == w[:3] and same(r[3], w[3])
    by = {r.symbol: r for r in N.from_snapshot(made).collect()}
    assert by["é"].gaps_by_type == {"SMALL_GAP": 2, "WEEKEND": 1} and by["é"].gaps_by_severity == {"LOW": 1, "HIGH": 1} and by["é"].reasons == ["HAS_GAPS", "FEW_ROWS"]
    assert by["A_\"x\""].gaps_by_type == {} and "NULL_PRICES" in by["A_\"x\""].reasons and len(by["A_\"x\""].rows) == 5
    assert N.from_snapshot(spark.createDataFrame([("no json",), (None,)], "snapshot string")).filter("symbol is not null").count() == 0
    assert N.to_snapshot(bars.limit(0), gaps).count() == 0


def test_closing_keys_and_numbers(spark):
    utc = lambda *a: dt.datetime(*a)
    cases = [(utc(2024, 3, 4, 20, 49), False), (utc(2024, 3, 4, 20, 50), True), (utc(2024, 3, 4, 23, 0), True), (utc(2024, 3, 9, 20, 55), False), (utc(2024, 7, 1, 19, 50), True), (utc(2024, 7, 1, 19, 49), False), (None, False)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "ts timestamp_ntz")
    assert [r[0] for r in df.select(H.closing_soon(F.col("ts"))).collect()] == [x for _, x in cases]
    names = spark.createDataFrame([(" /a/b/spy_1H_20240101_0930.csv",), ("QQQ_15m.csv",), ("plain.csv",), (None,)], "n string")
    assert [tuple(r) for r in names.select(*H.file_parts(F.col("n"))).collect()] == [("SPY", "1h"), ("QQQ", "15m"), (None, None), (None, None)]
    tags = spark.createDataFrame([("ENTRY",), ("SL_HIT",), ("TP2",), ("EXIT",), ("",), (None,)], "t string")
    assert [r[0] for r in tags.select(H.is_exit_tag(F.col("t"))).collect()] == [False, True, True, True, True, True]
    xs = spark.createDataFrame([(5.0, 4.0), (-5.0, 0.0), (float("nan"), 1.0), (None, None), (0.5, -2.0)], "x double, y double")
    assert [tuple(r) for r in xs.select(H.clamp(F.col("x"), 0, 1), H.pct_change(F.col("x"), F.col("y"))).collect()][:2] == [(1.0, 25.0), (0.0, None)]
    assert [r[0] for r in xs.select(H.clamp(F.col("x"), 0, 1)).collect()] == [1.0, 0.0, None, None, 0.5]
    key = spark.createDataFrame([("A", "1h", T0)], "s string, f string, t timestamp_ntz").select(H.feature_key(F.col("s"), F.col("f"), F.col("t"))).first()[0]
    assert key == "A_1h_2024-03-04T10:00:00"


def at(symbol, days_hours):
    """Bars at New York hours of days from Monday 2024-01-08 (UTC-5)."""
    return [(symbol, "1h", dt.datetime(2024, 1, 8) + dt.timedelta(days=d, hours=h + 5), 10.0, 11.0, 9.0, 10.0, 5.0, False) for d, h in days_hours]


def test_extended_hours_by_hand(spark):
    rows = at("all", [(0, h) for h in range(24)])  # 7 of 24 bars are regular: 70.8 % extended
    rows += at("night", [(0, h) for h in (1, 5, 6, 17, 18, 2, 3, 21, 22, 10)])  # 90 %
    rows += at("day", [(0, h) for h in (9, 10, 11, 12)])  # none
    by = {r.symbol: r for r in Q.extended_hours(spark.createDataFrame(rows, BARS)).collect()}
    share = 100 * 17 / 24
    assert by["all"].score == pytest.approx(share * 0.9) and (by["all"].status, by["all"].issues, by["all"].advice) == ("WARNING", "EXTENDED_LIMITED", "")
    assert by["night"].score == pytest.approx(90.0) and (by["night"].status, by["night"].issues) == ("PASSED", "")
    assert by["day"].score == 0 and by["day"].status == "FAILED" and by["day"].issues == "EXTENDED_INSUFFICIENT,PRE_MARKET_THIN,POST_MARKET_THIN,OVERNIGHT_THIN" and by["day"].advice == "COLLECT_EXTENDED_HOURS,COLLECT_OVERNIGHT"


def test_weekdays_by_hand(spark):
    week = [(d, 10) for d in range(5)]
    rows = at("good", week * 2) + at("some", week + [(5, 10)]) + at("much", week + [(5, 10), (5, 11), (6, 12)]) + at("gap", week[:4]) + at("end", [(5, 10)]) + at("both", [(0, 10), (5, 10)])
    rows += at("late", [(d, 23) for d in range(5)])  # already the next day in UTC
    by = {r.symbol: (r.score, r.status, r.issues) for r in Q.weekday_balance(spark.createDataFrame(rows, BARS)).collect()}
    assert by["good"] == (90.0, "PASSED", "") and by["late"] == by["good"]
    assert by["some"] == (75.0, "WARNING", "WEEKEND_HIGH") and by["much"] == (60.0, "WARNING", "WEEKEND_VERY_HIGH")
    assert by["gap"] == (72.0, "PASSED", "WEEKDAYS_MISSING") and by["both"] == (48.0, "WARNING", "WEEKEND_VERY_HIGH,WEEKDAYS_MISSING")
    assert by["end"] == (0.0, "FAILED", "NO_WEEKDAYS,WEEKDAYS_MISSING")


def test_readiness_by_hand(spark):
    hours = lambda symbol, hs, **k: [(symbol, "1h", T0 + dt.timedelta(hours=h), k.get("o", 10.0), 11.0, 9.0, k.get("c", 10.0), k.get("v", 5.0), False) for h in hs]
    rows = hours("good", range(200)) + hours("gap", [*range(150), *range(250, 300)]) + hours("few", range(50)) + hours("zero", range(180)) + hours("zero", range(180, 200), v=0.0)
    rows += hours("wrong", range(192)) + hours("wrong", range(192, 200), c=12.0) + hours("minus", range(199)) + hours("minus", [199], o=-1.0) + hours("twice", [*range(200), 7])
    df = spark.createDataFrame(rows, BARS)
    by = {r.symbol: r for r in Q.backtest_readiness(df, df.withColumn("sma", F.lit(1.0)), ["sma"]).collect()}
    assert by["good"].ready and by["good"].score == 100 and by["good"].reasons == ""
    assert by["gap"].gaps_score == pytest.approx((100 - 1 / 10 * 20) * 0.7) and by["gap"].reasons == "CRITICAL,LONG_GAP"  # 101 hours without a bar
    assert by["few"].reasons == "FEW_ROWS"
    assert by["zero"].volume_score == pytest.approx(100 - 200 * 20 / 200) and by["zero"].ready
    assert by["wrong"].ohlc_score == pytest.approx(100 - 1000 * 8 / 200) and by["wrong"].reasons == "OHLC"
    assert by["minus"].reasons == "CRITICAL" and by["minus"].ohlc_score == pytest.approx(100 - 1000 * 2 / 200)  # also low > open
    assert by["twice"].consistency_score == 70 and by["twice"].ready
    lacking = Q.backtest_readiness(df, df, ["a", "b", "c"]).filter("symbol = 'good'").first()
    assert lacking.indicators_score == 0 and lacking.reasons == "CRITICAL,INDICATORS" and lacking.score == 75.0
