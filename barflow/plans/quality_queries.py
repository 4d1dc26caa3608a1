"""Queries Q1 to Q24, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as I
from ..functions.columns import KEY, SERIES, rounded
from ..functions.indicators import _full_sql
from ..operators import clean as C
from ..operators import quality as Q
from ..sources.fixtures import BAD_SQL, bad_bars, bars_sql
from .clean_queries import GAPS, TWO_SQL, gappy, two
from .trade_queries import r6

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, make, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
    SQL[name] = sql


def clean(s, d) -> DataFrame:
    """Bars with planted faults, one row a key."""
    return C.dedupe(bad_bars(s, d), KEY, ["seq"]).drop("seq")


B = f"with {BAD_SQL}, b as (select * exclude seq from bad qualify row_number() over (partition by symbol, timeframe, ts order by seq desc) = 1)"
G = f"with {bars_sql('b', 1, True)}"
W = "partition by symbol, timeframe order by ts"
COMPLETE = "cp as (select symbol, timeframe, count(*) as n, min(ts) as first_ts, max(ts) as last_ts, least(100.0, 100.0 * count(*) / greatest(floor(date_diff('second', min(ts), max(ts)) / 3600.0), 1)) as completeness_pct from b group by all)"
_query("q01_completeness", lambda s, d: Q.completeness(gappy(s, d)), f"{G}, {COMPLETE} select symbol, timeframe, n, first_ts, last_ts, {r6('completeness_pct')} from cp")
_query("q02_calendar_completeness", lambda s, d: Q.calendar_completeness(gappy(s, d)),
       f"{G}, c as (select symbol, timeframe, count(*) as n, floor(date_diff('second', min(ts), max(ts)) / 86400.0)::bigint as days from b group by all), e as (select *, floor(floor(days * 5.0 / 7) * 6.5)::bigint as expected from c) select symbol, timeframe, n, days, expected, {r6('case when expected = 0 then 100.0 else least(100.0, 100.0 * n / expected) end as completeness_pct')} from e")
TYPED = f"{GAPS}, gt as (select *, case when minutes > 2880 then 'WEEKEND' when minutes < 240 then 'SMALL_GAP' when hour(gap_start) >= 20 or hour(gap_start) < 4 then 'OVERNIGHT' else 'UNKNOWN' end as gap_type, case when minutes / 60 < 4 then 'LOW' when minutes / 60 > 24 then 'HIGH' else 'MEDIUM' end as severity from g0 where minutes > 90)"
REPORT = f"""{TYPED}, rp0 as (select symbol, timeframe, count(*) as bars from b group by all), rp1 as (select symbol, timeframe, count(*) as gaps, max(minutes) / 60 as mg, avg(minutes) as ag,
  count(*) filter (gap_type = 'SMALL_GAP') as small, count(*) filter (gap_type = 'OVERNIGHT') as night, count(*) filter (severity = 'MEDIUM') as medium from gt group by all),
rp as (select symbol, timeframe, bars, coalesce(gaps, 0) as gaps, coalesce(mg, 0) as max_gap_hours, coalesce(ag, 0) as avg_gap_minutes, coalesce(small, 0) as small, coalesce(night, 0) as night, coalesce(medium, 0) as medium from rp0 left join rp1 using (symbol, timeframe)),
rs as (select *, greatest(0.0, 100 - 2 * gaps - 5 * max_gap_hours / 24) as score from rp)"""


def report(s, d) -> DataFrame:
    return Q.quality_report(gappy(s, d))


_m = lambda m, k, n: F.coalesce(F.col(m)[k], F.lit(0)).alias(n)
_query("q03_quality_report", lambda s, d: report(s, d).select(*SERIES, "bars", "gaps", "max_gap_hours", "avg_gap_minutes", "score", "suitable", _m("by_type", "SMALL_GAP", "small"), _m("by_type", "OVERNIGHT", "night"), _m("by_severity", "MEDIUM", "medium")),
       f"{G}, {REPORT} select symbol, timeframe, bars, gaps, {r6('max_gap_hours', 'avg_gap_minutes', 'score')}, score > 85 as suitable, small, night, medium from rs")
_query("q05_recommended_actions", lambda s, d: Q.recommended_actions(report(s, d)).select(*SERIES, F.array_join("actions", ",").alias("actions")),
       f"{G}, {REPORT} select symbol, timeframe, array_to_string(list_filter([case when gaps > 0 then 'FILL_GAPS' end, case when max_gap_hours > 24 then 'CHECK_LONG_GAPS' end, case when avg_gap_minutes > 240 then 'CHECK_SOURCE' end, case when score < 50 then 'EXCLUDE' end, case when score between 50 and 85 then 'REVIEW' end, case when bars < 100 then 'COLLECT_MORE' end], lambda x: x is not null)[1:5], ',') as actions from rs")
JUMP = f"jp as (select *, abs((close - lag(close) over ({W})) / nullif(lag(close) over ({W}), 0)) > 0.2 as j from b)"
PRICE = f"{JUMP}, pr as (select symbol, timeframe, count(*) filter (high < low or high < greatest(open, close) or low > least(open, close)) as order_violations, count(*) filter (j) as jumps from jp group by all)"
_query("q06_price_anomalies", lambda s, d: Q.price_anomalies(clean(s, d)), f"{B}, {PRICE} select * from pr")
MEDIAN = "md as (select b.*, m from b join (select symbol, timeframe, median(volume) as m from b group by all) using (symbol, timeframe))"
_query("q07_volume_anomalies", lambda s, d: Q.volume_anomalies(clean(s, d)), f"{B}, {MEDIAN} select symbol, timeframe, count(*) filter (volume < 0) as negative, count(*) filter (m > 0 and volume > 10 * m) as spikes, count(*) filter (m = 0 and volume = 0) as zeros from md group by all")
NY = "(ts at time zone 'UTC' at time zone 'America/New_York')"
CHECK_SQL = {
    "completeness": f"{COMPLETE}, ck_completeness as (select symbol, 'completeness' as \"check\", completeness_pct as score, case when completeness_pct >= 95 then 'PASSED' when completeness_pct >= 80 then 'WARNING' else 'FAILED' end as status from cp)",
    "gaps": f"{TYPED}, hg as (select s.symbol, coalesce(n, 0) as n from (select distinct symbol from b) s left join (select symbol, count(*) filter (severity = 'HIGH') as n from gt group by 1) using (symbol)), ck_gaps as (select symbol, 'gaps' as \"check\", greatest(0.0, 100.0 - 20 * n)::double as score, case when n = 0 then 'PASSED' when n <= 2 then 'WARNING' else 'FAILED' end as status from hg)",
    "ohlc": "oc as (select symbol, 100 * (1 - count(*) filter (high < low or high < open or high < close or low > open or low > close or least(open, high, low, close) <= 0) / count(*)) as p from b group by 1), ck_ohlc as (select symbol, 'ohlc' as \"check\", case when p >= 95 then p when p >= 95 * 0.95 then p * 0.9 else p * 0.5 end as score, case when p >= 95 then 'PASSED' when p >= 95 * 0.95 then 'WARNING' else 'FAILED' end as status from oc)",
    "price": f"{JUMP}, pc as (select symbol, 100.0 * (count(*) filter (j) + count(*) filter (high / nullif(low, 0) - 1 > 0.15)) / count(*) as p from jp group by 1), ck_price as (select symbol, 'price' as \"check\", case when p <= 5 then greatest(80.0, 100 - 5 * p) when p <= 10 then greatest(60.0, 80 - 3 * p) else greatest(0.0, 40 - 2 * p) end as score, case when p <= 5 then 'PASSED' when p <= 10 then 'WARNING' else 'FAILED' end as status from pc)",
    "volume": f"{MEDIAN}, vc as (select symbol, 100.0 * count(*) filter (volume <= 0 or (m > 0 and volume > 20 * m)) / count(*) as p from md group by 1), ck_volume as (select symbol, 'volume' as \"check\", case when p <= 10 then greatest(80.0, 100 - 2 * p) when p <= 20 then greatest(60.0, 80 - p) else greatest(0.0, 50 - p) end as score, case when p <= 10 then 'PASSED' when p <= 20 then 'WARNING' else 'FAILED' end as status from vc)",
    "continuity": f"dc as (select *, date_diff('second', lag(ts) over ({W}), ts) / 3600.0 as dd from b), cc as (select symbol, coalesce(100.0 * count(*) filter (dd between 0.8 and 1.2) / nullif(count(dd), 0), 0) as p, count(*) filter (dd = 0) = 0 as ok from dc group by 1), ck_continuity as (select symbol, 'continuity' as \"check\", case when p >= 90 and ok then least(100.0, p + 5) when p >= 80 then p else greatest(0.0, p - 20) end as score, case when p >= 90 and ok then 'PASSED' when p >= 80 then 'WARNING' else 'FAILED' end as status from cc)",
    "sessions": f"sc as (select symbol, 100.0 * count(*) filter (hour({NY}) between 9 and 15) / count(*) as regular_pct, 100.0 * count(*) filter (hour({NY}) between 4 and 8) / count(*) as pre_market_pct, 100.0 * count(*) filter (hour({NY}) between 16 and 19) / count(*) as post_market_pct, 100.0 * count(*) filter (hour({NY}) not between 4 and 19) / count(*) as overnight_pct from b group by 1), xh as (select *, pre_market_pct + post_market_pct + overnight_pct as x from sc), ck_sessions as (select *, x as extended_pct, 'sessions' as \"check\", case when x >= 80 then least(100.0, x) when x >= 64 then x * 0.9 else x * 0.5 end as score, case when x >= 80 then 'PASSED' when x >= 64 then 'WARNING' else 'FAILED' end as status, concat_ws(',', case when x < 80 and x >= 64 then 'EXTENDED_LIMITED' end, case when x < 64 then 'EXTENDED_INSUFFICIENT' end, case when pre_market_pct < 5 then 'PRE_MARKET_THIN' end, case when post_market_pct < 5 then 'POST_MARKET_THIN' end, case when overnight_pct < 2 then 'OVERNIGHT_THIN' end) as issues, concat_ws(',', case when x < 70 then 'COLLECT_EXTENDED_HOURS' end, case when overnight_pct = 0 then 'COLLECT_OVERNIGHT' end) as advice from xh)",
    "weekdays": "wk as (select symbol, " + ", ".join(f"count(*) filter (isodow({NY}) = {i + 1}) as {n}" for i, n in enumerate(("mon", "tue", "wed", "thu", "fri", "sat", "sun"))) + ", count(*) as n from b group by 1), wd as (select *, 100.0 * (sat + sun) / n as weekend_pct, array_to_string(list_filter([case when mon = 0 then 'mon' end, case when tue = 0 then 'tue' end, case when wed = 0 then 'wed' end, case when thu = 0 then 'thu' end, case when fri = 0 then 'fri' end], lambda x: x is not null), ',') as missing_days from wk), we as (select *, mon + tue + wed + thu + fri as weekdays, case when weekend_pct < 10 then 90.0 when weekend_pct < 30 then 75.0 else 60.0 end as base from wd), ck_weekdays as (select *, 'weekdays' as \"check\", case when weekdays = 0 then 0.0 when missing_days <> '' then greatest(base * 0.8, 40.0) else base end as score, case when weekdays = 0 then 'FAILED' when weekend_pct < 10 then 'PASSED' else 'WARNING' end as status, concat_ws(',', case when weekdays = 0 then 'NO_WEEKDAYS' end, case when weekdays > 0 and weekend_pct >= 10 and weekend_pct < 30 then 'WEEKEND_HIGH' end, case when weekdays > 0 and weekend_pct >= 30 then 'WEEKEND_VERY_HIGH' end, case when missing_days <> '' then 'WEEKDAYS_MISSING' end) as issues, concat_ws(',', case when missing_days <> '' then 'COVER_ALL_WEEKDAYS' end, case when weekend_pct > 20 then 'CHECK_DAY_FILTERS' end) as advice from we)",
}
for _name, _f in Q.CHECKS.items():
    _ids = {"completeness": "q01b", "gaps": "q14", "ohlc": "q08", "price": "q09", "volume": "q10", "continuity": "q11", "sessions": "q12b", "weekdays": "q13b"}
    _query(f"{_ids[_name]}_check_{_name}", lambda s, d, f=_f: f(clean(s, d)), f"{B}, {CHECK_SQL[_name]} select symbol, \"check\", {r6('score::double as score')}, status from ck_{_name}")
_query("q12_session_coverage", lambda s, d: Q.session_coverage(gappy(s, d)), f"{G}, {CHECK_SQL['sessions']} select symbol, {r6('regular_pct', 'pre_market_pct', 'post_market_pct', 'overnight_pct')} from sc")
_query("q13_weekday_coverage", lambda s, d: Q.weekday_coverage(gappy(s, d)), f"{G}, {CHECK_SQL['weekdays']} select symbol, mon, tue, wed, thu, fri, sat, sun, n, {r6('weekend_pct')}, missing_days from wd")

_query("q12c_extended_hours", lambda s, d: Q.extended_hours(gappy(s, d)).select("symbol", "extended_pct", "score", "status", "issues", "advice"), f"{G}, {CHECK_SQL['sessions']} select symbol, {r6('extended_pct', 'score')}, status, issues, advice from ck_sessions")
_query("q13c_weekday_balance", lambda s, d: Q.weekday_balance(gappy(s, d).filter("hour(ts) % 7 < 4")).select("symbol", "weekend_pct", "score", "status", "issues", "advice"), f"{G.replace('with b as', 'with b0 as')}, b as (select * from b0 where hour(ts) % 7 < 4), {CHECK_SQL['weekdays']} select symbol, {r6('weekend_pct', 'score::double as score')}, status, issues, advice from ck_weekdays")


def validate_sql(level: str) -> str:
    parts = [CHECK_SQL[c] for c in Q.LEVELS[level]]
    union = " union all ".join(f"select symbol, \"check\", score::double as score, status, {Q.WEIGHTS[c]}::double as w from ck_{c}" for c in Q.LEVELS[level])
    return f"""{B}, {', '.join(parts)}, al as ({union}), ov as (select symbol, sum(score * w) / greatest(sum(w), 1.0) as overall, count(*) filter (status = 'FAILED') as failed, coalesce(string_agg("check", ',' order by "check") filter (status = 'FAILED'), '') as failed_checks from al group by 1),
vd as (select *, case when failed > 0 then 'FAILED' when overall >= 75 then 'PASSED' else 'WARNING' end as status from ov), ve as (select *, status = 'PASSED' or (status = 'WARNING' and overall >= 60) as backtest_ready from vd)"""


for _level in ("STANDARD", "EXTENDED"):
    _query(f"q15_validate_{_level.lower()}", lambda s, d, lv=_level: Q.validate(clean(s, d), lv), f"{validate_sql(_level)} select symbol, {r6('overall')}, failed, failed_checks, status, backtest_ready from ve")
_query("q16_universe_summary", lambda s, d: Q.universe_summary(Q.validate(clean(s, d))), f"{validate_sql('STANDARD')} select count(*) as symbols, coalesce(string_agg(symbol, ',' order by symbol) filter (status = 'PASSED'), '') as ready, coalesce(string_agg(symbol, ',' order by symbol) filter (status = 'WARNING'), '') as warning, coalesce(string_agg(symbol, ',' order by symbol) filter (status = 'FAILED'), '') as failed_symbols, {r6('100.0 * count(*) filter (backtest_ready) / count(*) as success_rate')} from ve")
_query("q16b_universe_members", lambda s, d: Q.universe_members(Q.validate(clean(s, d))), f"{validate_sql('STANDARD')} select symbol, case status when 'PASSED' then 'ready' when 'WARNING' then 'warning' else 'failed' end as universe_group, backtest_ready, {r6('overall')} from ve")
_query("q17_indicator_null_rate", lambda s, d: Q.indicator_null_rate(I.sma(I.sma(gappy(s, d), 20), 200), ["sma_20", "sma_200"]), f"{G}, n as (select {_full_sql('avg(close)', 'close', 20)} as a, {_full_sql('avg(close)', 'close', 200)} as c from b), r as (select 'sma_20' as indicator, 100.0 * count(*) filter (a is null) / count(*) as p from n union all select 'sma_200', 100.0 * count(*) filter (c is null) / count(*) from n) select indicator, {r6('p as null_pct')}, p > 10 as missing from r")
_query("q18_volume_outliers", lambda s, d: Q.volume_outliers(gappy(s, d), 3.0), f"{G}, m as (select symbol, timeframe, avg(volume) as m, stddev_samp(volume) as s from b group by all), g as (select symbol, timeframe, count(*) filter (volume > m + 3 * s) as outliers, count(*) filter (volume = 0) as z, count(*) as n from b join m using (symbol, timeframe) group by all) select symbol, timeframe, outliers, (case when z > 0.05 * n then z else 0 end)::bigint as zero_volume from g")
_query("q20_integrity_report", lambda s, d: Q.integrity_report(C.flat_fill(gappy(s, d)).unionByName(gappy(s, d).select(*KEY, "open", "high", "low", "close", "volume", "is_filled"))),
       f"{G}, {GAPS}, u as (select symbol, timeframe, unnest(generate_series(gap_start + interval 1 hour, gap_end - interval 1 hour, interval 1 hour)) as ts, true as f from g0 where minutes > 60 and minutes < 4320 union all select symbol, timeframe, ts, false from b), v as (select *, date_diff('second', lag(ts) over ({W}), ts) / 3600.0 as dd from u), w as (select symbol, timeframe, count(*) as total, min(ts) as first_ts, max(ts) as last_ts, 100.0 * count(*) filter (f) / count(*) as filled_pct, count(*) filter (dd > 2) as gaps from v group by all) select symbol, timeframe, total, first_ts, last_ts, gaps, {r6('filled_pct', '100 - filled_pct as real_pct')}, filled_pct > 5 as warning from w")
_query("q21_table_audit", lambda s, d: Q.table_audit(gappy(s, d), I.sma(gappy(s, d), 20).filter("sma_20 > 240")), f"{G}, n as (select *, {_full_sql('avg(close)', 'close', 20)} as a from b), i as (select symbol, timeframe, count(*) as k from n where a > 240 group by all) select symbol, timeframe, count(*) as bars, min(ts) as first_ts, max(ts) as last_ts, coalesce(any_value(k), 0) as indicator_rows, case when coalesce(any_value(k), 0) = 0 then 'EMPTY' else 'OK' end as status from b left join i using (symbol, timeframe) group by all")
_query("q22_quality_tier", lambda s, d: Q.quality_tier(clean(s, d)), f"{B}, {COMPLETE}, {GAPS}, {PRICE}, lg as (select symbol, timeframe, count(*) as k from g0 where minutes > 240 group by all), t as (select symbol, timeframe, completeness_pct as p, coalesce(k, 0) as g, order_violations as v from cp left join lg using (symbol, timeframe) join pr using (symbol, timeframe)) select symbol, timeframe, {r6('p as completeness_pct')}, g as long_gaps, v as order_violations, case when p >= 95 and g <= 5 and v = 0 then 'EXCELLENT' when p >= 85 and g <= 20 and v <= 5 then 'GOOD' when p >= 60 then 'FAIR' when p >= 30 then 'POOR' else 'UNUSABLE' end as tier from t")
_query("q23_indicator_drift", lambda s, d: Q.indicator_drift(*two(s, d), KEY, ["close", "volume"], 5.0), f"with {TWO_SQL}, j as (select p.close as c1, s.close as c2, p.volume as v1, s.volume as v2 from p join s using (symbol, timeframe, ts)), u as (select 'close' as metric, c1 as a, c2 as b from j union all select 'volume', v1, v2 from j) select metric, count(*) as n, count(*) filter (abs(a - b) <= 5 or (a is null and b is null)) as matches, count(*) filter ((a is null) <> (b is null)) as null_mismatches, {r6('max(abs(a - b)) as max_diff')} from u group by 1")
_query("q24_source_overview", lambda s, d: Q.source_overview(two(s, d)[0].withColumn("source", F.lit("even")).unionByName(two(s, d)[1].withColumn("source", F.lit("odd")))), f"with {TWO_SQL}, u as (select *, 'even' as source from p union all select *, 'odd' from s) select symbol, source, count(*) as n, count(*) filter (volume = 0) as zero_volume, {r6('avg(volume) as avg_volume')} from u group by all")
