"""Hand values, invariants and SQL twins of the market-bar library."""

import datetime as dt
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow import registry
from barflow.functions import indicators as I
from barflow.functions.ema import ema
from barflow.operators import clean as C
from barflow.operators import ml as M
from barflow.operators import quality as Q
from barflow.operators import signals as S
from barflow.operators import trades as T
from barflow.sources import files

DATA = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 8, 15)
BAR = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def make(spark, rows, minutes=60):
    """Bars from (step, open, high, low, close, volume)."""
    return spark.createDataFrame([("X", "1h", T0 + dt.timedelta(minutes=minutes * r[0]), *map(float, r[1:])) for r in rows], BAR)


def flat(spark, closes, minutes=60):
    return make(spark, [(i, c, c, c, c, 100) for i, c in enumerate(closes)], minutes)


def test_session_vwap_and_reset(spark):
    rows = [(0, 100, 100, 100, 100, 100), (1, 110, 110, 110, 110, 200), (2, 105, 105, 105, 105, 100), (24, 200, 200, 200, 200, 5)]
    got = [r.vwap for r in I.session_vwap(make(spark, rows)).orderBy("ts").collect()]
    assert [round(x, 4) for x in got] == [100, 106.6667, 106.25, 200]


def test_streak_counts_runs(spark):
    got = [r.streak for r in I.streak(flat(spark, [100, 101, 102, 103, 102, 101, 100, 99, 100, 102])).orderBy("ts").collect()]
    assert got == [0, 1, 2, 3, -1, -2, -3, -4, 1, 2]


def test_warm_up_and_bounds(spark):
    rnd = random.Random(1)
    rows, c = [], 100.0
    for i in range(150):
        o, c = c, c + rnd.uniform(-2, 2)
        rows.append((i, o, max(o, c) + 1, min(o, c) - 1, c, rnd.randint(1, 9)))
    got = I.connors_rsi(I.adx(I.rsi(make(spark, rows)))).orderBy("ts").collect()
    assert [r.rsi is None for r in got[:15]] == [True] * 13 + [False] * 2
    assert got[25].adx is None and got[26].adx is not None
    assert all(0 <= r.rsi <= 100 for r in got if r.rsi is not None) and all(0 <= r.crsi <= 100 for r in got if r.crsi is not None)


def test_no_look_ahead(spark):
    rnd = random.Random(2)
    closes = [100 + rnd.uniform(-5, 5) for _ in range(60)]
    cols = ["ts", "rsi", "sma_20", "vwap", "ema_20"]
    make_all = lambda n: I.distances(I.session_vwap(I.sma(I.rsi(flat(spark, closes[:n])), 20)), (20,)).select(cols).orderBy("ts").collect()
    assert make_all(40) == make_all(60)[:40]


def test_ema_chunks_agree(spark):
    rnd = random.Random(3)
    b = flat(spark, [rnd.uniform(1, 9) for _ in range(50)])
    whole = {r.ts: r.e for r in I.ema(b, {"e": ("close", 5)}).collect()}
    parts = {r.ts: r.e for r in I.ema(b, {"e": ("close", 5)}, chunk=7).collect()}
    assert all(math.isclose(whole[k], parts[k], rel_tol=1e-12) for k in whole)


def test_gap_of_ninety_minutes(spark):
    b = flat(spark, [1, 1, 1], 15).unionByName(make(spark, [(8, 1, 1, 1, 1, 1), (9, 1, 1, 1, 1, 1)], 15))
    got = C.classify_gaps(C.detect_gaps(b, 30.0), 15.0).collect()
    assert [(r.minutes, r.gap_type) for r in got] == [(90.0, "SMALL_GAP")]


def test_interpolation_and_forward_fill(spark):
    b = make(spark, [(0, 10, 10, 10, 10, 1), (1, 20, 20, 20, 20, 1), (4, 50, 50, 50, 50, 1), (12, 60, 60, 60, 60, 1)])
    got = {r.ts: r for r in C.fill_gaps(b).collect()}
    assert got[T0 + dt.timedelta(hours=2)].close == 30.0 and got[T0 + dt.timedelta(hours=2)].fill == "INTERPOLATED"
    assert got[T0 + dt.timedelta(hours=7)].close == 50.0 and got[T0 + dt.timedelta(hours=7)].volume == 0.0
    assert C.flat_fill(b).count() == 2 + 7


@pytest.mark.parametrize("bar, bull, bear, way", [((100, 107, 95, 102), 100, -100, 1), ((100, 107, 99, 102), 0, -100, -1)])
def test_wicks(spark, bar, bull, bear, way):
    r = S.reversal_flags(make(spark, [(0, *bar, 1)])).first()
    assert (r.pat_wick_bull, r.pat_wick_bear, r.wick_direction) == (bull, bear, way)


def test_hammer_and_star(spark):
    r = S.single_bar_patterns(make(spark, [(0, 100, 101.1, 95, 101, 1), (1, 202, 212, 201.9, 203, 1)])).orderBy("ts").collect()
    assert r[0].pat_hammer > 0 and r[1].pat_shooting_star != 0


def test_parity_bar_is_long(spark):
    b = make(spark, [(0, 101, 102, 99, 101.5, 2000)]).withColumns({"vwap": F.lit(100.0), "volume_sma_20": F.lit(500.0)})
    assert [r.side for r in S.vwap_bounce(b, {"wick_ratio": 1.0}).collect()] == ["LONG"]
    assert S.vwap_bounce(b.withColumn("vwap", F.lit(None).cast("double")), {}).count() == 0


def test_sizes(spark):
    b = make(spark, [(0, 100, 100, 100, 100, 1)]).withColumn("atr", F.lit(5.0))
    assert S.position_size(b, 10_000.0, 0.015).first().qty == 15 and S.position_size(b, 10_000.0, 0.02).first().qty == 20
    f = b.withColumn("atr_avg", F.explode(F.array(F.lit(5.0), F.lit(5 / 1.6), F.lit(5 / 2.1))))
    assert [r.size_factor for r in S.volatility_multiplier(f).orderBy(F.desc("atr_avg")).collect()] == [1.0, 0.75, 0.5]


def fill_rows(spark, rows):
    return spark.createDataFrame([("X", T0 + dt.timedelta(hours=i), i, s, float(q), float(p), 0.0) for i, (s, q, p) in enumerate(rows)], "symbol string, ts timestamp_ntz, seq int, side string, qty double, price double, commission double")


def test_fifo_hand_values(spark):
    got = T.match_fifo(fill_rows(spark, [("BUY", 10, 100), ("SELL", 20, 110)])).collect()
    assert [(r.side, r.qty, r.pnl) for r in got] == [("LONG", 10, 100)]
    got = T.match_fifo(fill_rows(spark, [("SELL", 10, 100), ("BUY", 20, 90)])).collect()
    assert [(r.side, r.qty, r.pnl) for r in got] == [("SHORT", 10, 100)]


def test_fifo_against_a_queue(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["BUY", "SELL"]), rnd.randint(1, 9), rnd.randint(90, 110)) for _ in range(120)]
    lots, want = [], []
    for i, (s, q, p) in enumerate(rows):
        while q and lots and lots[0][0] != s:
            os_, oq, op, oi = lots[0]
            n = min(q, oq)
            want.append(("LONG" if os_ == "BUY" else "SHORT", oi, i, n, (p - op) * n * (1 if os_ == "BUY" else -1)))
            q -= n
            lots[0] = (os_, oq - n, op, oi)
            if oq == n:
                lots.pop(0)
        if q:
            lots.append((s, q, p, i))
    hour = lambda t: int((t - T0).total_seconds() / 3600)
    got = [(r.side, hour(r.entry_ts), hour(r.exit_ts), r.qty, r.pnl) for r in T.match_fifo(fill_rows(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


def test_stop_wins_a_tie(spark):
    b = make(spark, [(0, 100, 100, 100, 100, 1), (1, 100, 120, 80, 100, 1)]).withColumn("vwap", F.lit(None).cast("double"))
    s = b.limit(1).select("symbol", "timeframe", "ts").withColumns({"side": F.lit("LONG"), "entry": F.lit(100.0), "sl": F.lit(90.0), "tp": F.lit(110.0)})
    r = T.bracket_outcomes(s, b).first()
    assert (r.reason, r.exit_price, r.r_multiple) == ("SL", 90.0, -1.0)


def test_one_position_is_greedy(spark):
    rows = [("X", T0 + dt.timedelta(hours=a), T0 + dt.timedelta(hours=b)) for a, b in ((0, 3), (1, 2), (3, 4), (4, 6), (7, 8))]
    got = T.one_position(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, exit_ts timestamp_ntz"), ["symbol"]).collect()
    assert sorted(int((r.ts - T0).total_seconds() / 3600) for r in got) == [0, 4, 7]


def test_validation_of_clean_and_bad_bars(spark):
    good = flat(spark, [100 + i * 0.1 for i in range(50)])
    assert {r.status for r in Q.check_ohlc(good).collect()} == {"PASSED"}
    bad = good.withColumn("low", F.col("high") + 1)
    assert {r.status for r in Q.check_ohlc(bad).collect()} == {"FAILED"}


def test_result_does_not_depend_on_partitions(spark):
    rnd = random.Random(5)
    b = flat(spark, [rnd.uniform(1, 9) for _ in range(80)])
    one = I.all_indicators(b.coalesce(1)).orderBy("ts").collect()
    many = I.all_indicators(b.repartition(7, "close")).orderBy("ts").collect()
    assert one == many


def test_csv_intake_and_stores(spark, tmp_path):
    (tmp_path / "SPY_1h_20240101_000000.csv").write_text("Datetime,Open,High,Low,Close,Volume\n2024-01-01 10:00:00,1,2,0.5,1.5,10\n2024-01-01 11:00:00,x,2,1,1,1\n2024-01-01 12:00:00,1,1,2,1,1\n")
    got = files.read_candle_csv(spark, str(tmp_path)).collect()
    assert [(r.symbol, r.timeframe, r.close) for r in got] == [("SPY", "1h", 1.5)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"metadata": {"symbol": "S", "timeframe": "1h"}, "bars": [{"timestamp": "2024-01-01 10:00:00", "close": 1.0, "indicators": {"rsi": 50.0}}], "trades": [{"timestamp": "2024-01-01 10:00:00", "side": "BUY", "price": 1.0, "quantity": 2, "tag": "ENTRY"}]}')
    bars, trades = files.read_audit(spark, str(tmp_path / "a"))
    assert bars.first().indicators == {"rsi": 50.0} and trades.first().qty == 2


def test_candle_files_of_two_headers(spark, tmp_path):
    (tmp_path / "SPY_1h_1_1.csv").write_text("Datetime,Open,High,Low,Close,Volume\n2024-01-01 10:00:00,1,2,0.5,1.5,10\n")
    (tmp_path / "QQQ_1d_1_1.csv").write_text("close,high,low,open,time\n1.5,2,0.5,1,2024-01-01 10:00:00\n")
    got = {(r.symbol, r.timeframe, r.open, r.close, r.volume) for r in files.read_candle_csv(spark, str(tmp_path)).collect()}
    assert got == {("SPY", "1h", 1.0, 1.5, 10.0), ("QQQ", "1d", 1.0, 1.5, None)}


def test_stores_keep_what_they_hold(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(s, "1h", T0 + dt.timedelta(hours=k), float(k)) for s in "AB" for k in range(100)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz, x double")
    files.write_indicators(df, path, ["x"])
    files.write_indicators(df.filter("symbol = 'A' and x >= 52").withColumn("x", F.lit(-1.0)), path, ["x"])
    got = spark.read.parquet(path).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("x") == -1).alias("new")).collect()
    assert {(r.symbol, r.n, r.new) for r in got} == {("A", 100, 48), ("B", 100, 0)}
    old = spark.createDataFrame([("A", 1, 0)], "symbol string, k int, n int")
    new = spark.createDataFrame([("A", 1, 1), ("A", 2, 1), ("A", 2, 2)], "symbol string, k int, n int")
    assert sorted(tuple(r) for r in files.append_new(old, new, ["symbol", "k"], ["n"]).collect()) == [("A", 1, 0), ("A", 2, 1)]
    assert sorted(tuple(r) for r in files.upsert_bars(old, new, ["symbol", "k"], ["n"]).collect()) == [("A", 1, 1), ("A", 2, 2)]


def test_fifo_quantities_meet_as_decimals(spark):
    rows = [("A", T0 + dt.timedelta(hours=k), k, side, q, 10.0, 0.0) for k, (side, q) in enumerate([("BUY", 0.1), ("BUY", 0.2), ("BUY", 0.1), ("SELL", 0.3), ("SELL", 0.1)])]
    got = T.match_fifo(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq int, side string, qty double, price double, commission double")).collect()
    assert sorted(r.qty for r in got) == [0.1, 0.1, 0.2]


def test_exit_rules_of_both_sides(spark):
    from barflow.operators import signals as S

    positions = spark.createDataFrame([("A", "LONG", 100.0), ("A", "SHORT", 100.0)], "symbol string, side string, entry_price double")
    now = spark.createDataFrame([("A", 97.0, 82.0, -0.02, "BEARISH", 3.5, -3.0, 0.95, 60.0)], "symbol string, close double, rsi double, macd_hist double, macd_cross string, vwap_dev double, roc double, bb_pct double, vol_osc double")
    got = {r.side: r for r in S.exit_urgency(S.exit_scores(positions, now)).collect()}
    assert (got["LONG"].exit_score, got["LONG"].urgency, got["LONG"].exit_pct, got["LONG"].trend_reversal, got["LONG"].volume_divergence) == (130, "EXIT_URGENT", 100, True, True)
    assert (got["SHORT"].exit_score, got["SHORT"].urgency, got["SHORT"].trend_reversal) == (0, "HOLD", False)
    calm = now.select("symbol", "close", F.lit(50.0).alias("rsi"), F.lit(0.0).alias("macd_hist"), F.lit("NONE").alias("macd_cross"), F.lit(0.5).alias("vwap_dev"), F.lit(0.0).alias("roc"), F.lit(0.5).alias("bb_pct"), F.lit(0.0).alias("vol_osc"))
    got = {r.side: (r.exit_score, r.reasons) for r in S.exit_scores(positions, calm).collect()}
    assert got == {"LONG": (0, ""), "SHORT": (20, "VWAP_RETURN")}


def test_layered_plan_and_targets(spark):
    from barflow.operators import signals as S

    one = spark.createDataFrame([("A", "1h", T0, "LONG", 100.0, 2.0, "HIGH", 20.0, 90.0, 0.0, 104.0, 103.0, 97.0)], "symbol string, timeframe string, ts timestamp_ntz, side string, close double, atr double, volatility string, rsi double, strength double, roc double, cum_vwap double, bb_upper double, bb_lower double")
    plan = S.layered_plan(one).orderBy("level").collect()
    assert [(r.strategy, r.level, round(r.level_price, 6), r.share_pct) for r in plan] == [("SCALP", 1, 100.0, 70.0), ("SCALP", 2, 98.75, 30.0)]
    assert abs(plan[0].stop_price - (100 - 2 * 2.5 * 0.75 * 1.15 * 1.1)) < 1e-9
    bars = one.select("symbol", "timeframe", "ts", F.lit(110.0).alias("high"), F.lit(90.0).alias("low"))
    found = S.candidate_targets(S.layered_plan(one).filter("level = 1"), bars)
    kinds = {k: sorted(round(r.target, 4) for r in found.collect() if r.kind == k) for k in ("FIBONACCI", "BOLLINGER", "VWAP", "PSYCHOLOGICAL", "ATR_EXTENSION")}
    assert kinds == {"FIBONACCI": [114.72, 117.64, 122.36, 142.36], "BOLLINGER": [103.0], "VWAP": [104.0], "PSYCHOLOGICAL": [102.5, 105.0, 105.0, 107.5, 110.0, 110.0, 112.5, 115.0, 115.0], "ATR_EXTENSION": [104.0, 106.0, 108.0, 112.0]}
    best = S.rank_targets(found).orderBy("place").collect()
    assert len(best) == 4 and [r.exit_pct for r in best] == [70, 30, 0, 0] and best[0].score == max(r.score for r in best)


TWINS = ["i03_rsi", "i07_session_vwap", "d09_patch_merge", "g03_classify_gaps", "g10_flat_fill", "q08_check_ohlc", "q24_source_overview", "p05_vwap_bounce", "j06_compare_sources", "t03_bracket_outcomes", "t11_metric_summary", "a09_collector_performance", "m07_evaluate", "s01_candle_csv", "s04_upsert_bars", "s06_write_indicators", "t06_match_fifo", "p18_rank_targets", "p20_exit_urgency", "r04_gap_stream", "r05_signal_stream", "r06_alert_stream", "m07c_rank_models", "m08_probability_profile"]


@pytest.mark.parametrize("name", TWINS)
def test_sql_twins(spark, name):
    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    df = registry.queries()[name](spark, DATA)
    found = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda x: repr(round(x, 5) + 0.0 if isinstance(x, float) else x)
    want = sorted([tuple(show(r[i]) for i in order) for r in found.fetchall()])
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(show(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_every_query_has_a_name_once():
    assert len(registry.queries()) > 100 and set(registry.oracle_sql()) <= set(registry.queries())


def signal(spark, step=0, side="LONG", entry=100.0, sl=50.0, tp=200.0):
    return flat(spark, [entry] * (step + 1)).orderBy(F.desc("ts")).limit(1).select("symbol", "timeframe", "ts").withColumns({"side": F.lit(side), "entry": F.lit(entry), "sl": F.lit(sl), "tp": F.lit(tp)})


@pytest.mark.parametrize("late, want", [((60, 101, 101, 101, 101, 1), ("TIME_STOP", 101.0)), ((60, 101, 101, 40, 101, 1), ("SL", 50.0)), ((60, 101, 250, 101, 101, 1), ("TP", 200.0)), ((60, 99, 99, 99, 99, 1), ("EARLY_EXIT", 99.0))])
def test_time_stop_at_a_bar_after_a_gap(spark, late, want):
    b = make(spark, [(0, 100, 100, 100, 100, 1), (2, 100, 100, 100, 100, 1), late, (61, 1, 300, 1, 1, 1)]).withColumn("vwap", F.lit(100.0))
    got = T.bracket_outcomes(signal(spark), b).collect()
    assert [(r.reason, r.exit_price, r.minutes) for r in got] == [(*want, 3600.0)]


def test_signals_stay_open_only_at_the_end_of_the_series(spark):
    b = make(spark, [(i, 100, 100, 100, 100, 1) for i in (0, 2, 8)]).withColumn("vwap", F.lit(100.0))
    assert [(r.reason, r.minutes) for r in T.bracket_outcomes(signal(spark), b).collect()] == [("TIME_STOP", 480.0)]
    assert T.bracket_outcomes(signal(spark), b.limit(2)).count() == 0


def test_every_signal_with_a_later_bar_ends(spark):
    """Against a scan of each signal's later bars on the given events."""
    from barflow.plans import trade_queries as P

    b = P.hourly(spark, DATA).cache()
    plans = S.trade_plan(S.vwap_bounce(b, P.PARAMS)).collect()
    later = {}
    for r in b.orderBy("ts").collect():
        later.setdefault((r.symbol, r.timeframe), []).append(r)
    from zoneinfo import ZoneInfo

    def end(p):
        up = p.side == "LONG"
        for r in later[p.symbol, p.timeframe]:
            if r.ts <= p.ts:
                continue
            ny = r.ts.replace(tzinfo=dt.UTC).astimezone(ZoneInfo("America/New_York"))
            if r.low <= p.sl if up else r.high >= p.sl:
                return r.ts, "SL"
            if r.high >= p.tp if up else r.low <= p.tp:
                return r.ts, "TP"
            if r.vwap is not None and (r.close < r.vwap if up else r.close > r.vwap):
                return r.ts, "EARLY_EXIT"
            if r.ts - p.ts >= dt.timedelta(hours=8):
                return r.ts, "TIME_STOP"
            if ny.weekday() < 5 and ny.hour * 60 + ny.minute >= 950 and ny.hour < 16:
                return r.ts, "SESSION_CLOSE"
        return None

    want = {(p.symbol, p.ts, *e) for p in plans if (e := end(p))}
    got = [(r.symbol, r.ts, r.exit_ts, r.reason) for r in P.outcomes(spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_alert_stream_time_stop_after_a_gap(spark):
    from barflow.plans.stream_queries import drained, streamed
    from barflow.streaming import jobs

    b = make(spark, [(0, 100, 100, 100, 100, 1), (2, 100, 100, 100, 100, 1), (60, 101, 101, 101, 101, 1), (61, 1, 300, 1, 1, 1)])
    rows = b.unionByName(signal(spark), allowMissingColumns=True).withColumn("ts", F.col("ts").cast("timestamp"))
    got = drained(jobs.alert_stream(streamed(rows.select("symbol", "ts", "high", "low", "side", "entry", "sl", "tp")))).select(F.col("ts").cast("timestamp_ntz"), "reason").collect()
    assert [(r.ts, r.reason) for r in got] == [(T0 + dt.timedelta(hours=60), "TIME_STOP")]


def test_order_fills_however_late(spark):
    """Against a scan, with bars from hours to decades after the orders."""
    rnd = random.Random(9)
    steps = sorted({*range(0, 60), *(rnd.randint(60, 24 * 400) for _ in range(150)), *(rnd.randint(0, 24 * 365 * 60) for _ in range(150))})
    rows = []
    for k, i in enumerate(steps):
        c = 100 + k / 20 * rnd.uniform(-1, 1)
        rows.append((i, c, c + rnd.random(), c - rnd.random(), c, 1))
    b = make(spark, rows)
    orders = [("X", "1h", T0 + dt.timedelta(hours=rnd.choice(steps)), str(n), rnd.choice(["BUY", "SELL"]), rnd.choice(["LIMIT", "STOP"]), rnd.uniform(80, 120)) for n in range(300)]
    want = set()
    for o in orders:
        for i, op, hi, lo, *_ in rows:
            below = (o[4] == "BUY") == (o[5] == "LIMIT")
            at = T0 + dt.timedelta(hours=i)
            if at > o[2] and (lo <= o[6] if below else hi >= o[6]):
                want.add((o[3], at, min(op, o[6]) if below else max(op, o[6])))
                break
    df = spark.createDataFrame(orders, "symbol string, timeframe string, ts timestamp_ntz, order_id string, side string, kind string, level double")
    got = [(r.order_id, r.fill_ts, r.fill_price) for r in T.order_fills(df, b).collect()]
    assert len(got) == len(want) and set(got) == want
    start = {o[3]: o[2] for o in orders}
    assert len({(t - start[n]).days.bit_length() for n, t, _ in want}) > 6


def test_excursions_cover_the_whole_trade(spark):
    b = make(spark, [(0, 100, 100, 100, 100, 1), (5, 100, 101, 99, 100, 1), (30, 100, 120, 90, 100, 1), (50, 100, 100, 70, 100, 1), (51, 100, 999, 1, 100, 1)])
    t = signal(spark).withColumn("exit_ts", F.lit(T0 + dt.timedelta(hours=50)).cast("timestamp_ntz"))
    assert [(round(r.mfe_pct, 6), round(r.mae_pct, 6)) for r in T.excursions(t, b).collect()] == [(20.0, -30.0)]


def test_ema_over_chunks_and_nulls(spark):
    rnd = random.Random(5)
    closes = [None if rnd.random() < 0.2 else 100 + rnd.uniform(-5, 5) for _ in range(60)]
    rows = [("X", "1h", T0 + dt.timedelta(hours=i), c) for i, c in enumerate([None, *closes])]
    got = [r.e for r in ema(spark.createDataFrame(rows, "symbol string, timeframe string, ts timestamp_ntz, close double"), {"e": ("close", 9)}, chunk=7).orderBy("ts").collect()]
    y, want = None, []
    for r in rows:
        if r[3] is not None:
            y = r[3] if y is None else y + 0.2 * (r[3] - y)
        want.append(y)
    assert got[0] is None or math.isnan(got[0])
    assert got[1:] == pytest.approx([w if w is not None else math.nan for w in want[1:]], nan_ok=True)


def test_one_position_over_batches(spark):
    rnd = random.Random(6)
    rows = []
    for k in ("a", "b", None):
        for _ in range(80):
            at = T0 + dt.timedelta(minutes=rnd.randint(0, 3000))
            rows.append((k, at, at + dt.timedelta(minutes=rnd.randint(-5, 90))))
    rows += [("c", T0, None), ("c", T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=2)), ("c", None, T0)]
    want = []
    for k in ("a", "b", None):
        free = dt.datetime.min
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]):
            if r[1] > free:
                want.append(r)
                free = r[2]
    want.append(("c", T0, None))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = T.one_position(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, exit_ts timestamp_ntz"), ["symbol"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_profile_and_ranking_of_models(spark):
    rnd = random.Random(7)
    probs = [round(rnd.random(), 3) for _ in range(501)]
    rows = [("good", float(p > 0.5), p) for p in probs] + [("bad", float(p <= 0.5), p) for p in probs] + [("bad", 1.0, None)]
    df = spark.createDataFrame(rows, "model string, label double, prob double")
    one = M.probability_profile(df.filter("model = 'good'"), [0.5]).first()
    assert [one.median_prob, one.p75_prob, one.p90_prob, one.p95_prob] == pytest.approx(list(np.percentile(probs, [50, 75, 90, 95])))
    got = [(r.model, r.place, round(r.auc, 6)) for r in M.rank_models(df).orderBy("place").collect()]
    assert got == [("good", 1, 1.0), ("bad", 2, 0.0)]
    assert M.probability_profile(df.filter("false"), [0.5]).first().median_prob is None


def test_models_by_symbol(spark):
    rows = [("big", float(i % 2), float(i % 2) + i / 1000) for i in range(60)] + [("small", float(i % 2), 1.0) for i in range(10)] + [("one", 1.0, 1.0)] * 60 + [(None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, label double, x double")
    models = M.train_by_symbol(df, ["x"])
    assert sorted(models) == ["big"]
    scored = M.score_by_symbol(models, df, ["x"]).collect()
    assert len(scored) == len(rows) and all(r.prob == 1.0 for r in scored if r.symbol != "big")
    assert all((r.prob > 0.5) == (r.label == 1) for r in scored if r.symbol == "big")
    with pytest.raises(ValueError):
        M.train_by_symbol(df, ["x"], min_samples=5, most=1)


def test_label_balance_has_its_total_without_samples(spark):
    """As ROLLUP in SQL: the empty grouping set is one row for no input; null keys stay groups of their own."""
    rows = [("A", T0, 1.0), ("A", T0, 0.0), (None, T0, 1.0), ("A", None, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, label double")
    got = sorted((tuple(r) for r in M.label_balance(df).collect()), key=str)
    want = [(2024, "A", 2, 0.5), (2024, None, 1, 1.0), (2024, None, 3, 2 / 3), (None, "A", 1, 0.0), (None, None, 1, 0.0), (None, None, 4, 0.5)]
    assert got == sorted(want, key=str)
    assert [tuple(r) for r in M.label_balance(df.limit(0)).collect()] == [(None, None, 0, None)]
