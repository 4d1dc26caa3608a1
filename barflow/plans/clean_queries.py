"""Queries D1 to D13 and G1 to G11, each with its SQL."""

from __future__ import annotations

import datetime as dt


from ..functions.columns import KEY, SERIES, rounded
from ..operators import clean as C
from ..sources.fixtures import BAD_SQL, bad_bars, bars, bars_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
EVEN, ODD = "event_id % 2 = 0", "event_id % 2 = 1"
TWO_SQL = bars_sql("p", 1, True, EVEN) + ", " + bars_sql("s", 1, True, ODD)
OHLCV = ["open", "high", "low", "close", "volume"]
COLS = "symbol, timeframe, ts, open, high, low, close, volume"
START, END = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9, 12)
NOW = dt.datetime(2024, 1, 10, 3, 30)
SESSIONS = [("OPENING", "09:30", "10:30"), ("POWER", "15:00", "16:00"), ("NIGHT", "20:00", "03:59")]


def _query(name: str, make, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
    SQL[name] = sql


def gappy(spark, sf_dir):
    return bars(spark, sf_dir, 1, True)


def two(spark, sf_dir):
    return [bars(spark, sf_dir, 1, True, EVEN), bars(spark, sf_dir, 1, True, ODD)]


B = "with " + bars_sql("b", 1, True)
NY = "(ts at time zone 'UTC' at time zone 'America/New_York')"
_query("d01_market_hours", lambda s, d: C.market_hours(gappy(s, d)).select(*KEY, "close"), f"{B} select symbol, timeframe, ts, close from b where isodow({NY}) < 6 and hour({NY}) * 60 + minute({NY}) between 570 and 959")
_query("d02_date_range", lambda s, d: C.date_range(gappy(s, d), START, END).select(*KEY, "close"), f"{B} select symbol, timeframe, ts, close from b where ts between '{START}' and '{END}'")
_query("d03_closed_bars", lambda s, d: C.closed_bars(gappy(s, d), NOW, 1).select(*KEY, "close"), f"{B} select symbol, timeframe, ts, close from b where ts + interval 1 hour <= '{NOW}'")
_query("d04_repair_ohlc", lambda s, d: C.repair_ohlc(C.dedupe(bad_bars(s, d), KEY, ["seq"])).select(*KEY, *OHLCV, "big_move"),
       f"""with {BAD_SQL}, one as (select * from bad qualify row_number() over (partition by symbol, timeframe, ts order by seq desc) = 1),
good as (select * replace (greatest(high, low) as high, least(high, low) as low) from one where open > 0 and high > 0 and low > 0 and close > 0)
select {COLS}, coalesce(abs((close - lag(close) over w) / lag(close) over w) > 0.5, false) as big_move from good window w as (partition by symbol, timeframe order by ts)""")
_query("d05_dedupe", lambda s, d: C.dedupe(bad_bars(s, d), KEY, ["seq"]).select(*KEY, "close", "seq"), f"with {BAD_SQL} select symbol, timeframe, ts, close, seq from bad qualify row_number() over (partition by symbol, timeframe, ts order by seq desc) = 1")
_query("d06_duplicate_rows", lambda s, d: C.duplicate_rows(bad_bars(s, d), KEY).select(*KEY, "close", "seq"), f"with {BAD_SQL} select symbol, timeframe, ts, close, seq from bad qualify count(*) over (partition by symbol, timeframe, ts) > 1")
_query("d07_session_label", lambda s, d: C.session_label(gappy(s, d)).select(*KEY, "session"),
       f"{B} select symbol, timeframe, ts, case when hour({NY}) between 4 and 8 then 'PRE_MARKET' when hour({NY}) between 9 and 15 then 'REGULAR' when hour({NY}) between 16 and 19 then 'POST_MARKET' else 'OVERNIGHT' end as session from b")
_query("d08_named_session", lambda s, d: C.named_session(gappy(s, d), SESSIONS).select(*KEY, "session_name"),
       f"""{B} select symbol, timeframe, ts, case when strftime({NY}, '%H:%M') between '09:30' and '10:30' then 'OPENING' when strftime({NY}, '%H:%M') between '15:00' and '16:00' then 'POWER'
when strftime({NY}, '%H:%M') >= '20:00' or strftime({NY}, '%H:%M') <= '03:59' then 'NIGHT' end as session_name from b""")
_query("d09_patch_merge", lambda s, d: C.patch_merge(two(s, d)).select(*KEY, *OHLCV, "source_rank"),
       f"with {TWO_SQL}, u as (select *, 0 as source_rank from p union all select *, 1 from s) select {COLS}, source_rank from u qualify row_number() over (partition by symbol, timeframe, ts order by (coalesce(volume, 0) > 0) desc, source_rank) = 1")
_query("d10_append_missing", lambda s, d: C.append_missing(*two(s, d), KEY).select(*KEY, *OHLCV), f"with {TWO_SQL} select {COLS} from p union all select {COLS} from s where not exists (select 1 from p where p.symbol = s.symbol and p.ts = s.ts)")
_query("d11_first_available", lambda s, d: C.first_available([two(s, d)[0].filter("symbol not like 'c%'"), two(s, d)[1]]).select(*KEY, "close", "source_rank"),
       f"with {TWO_SQL} select symbol, timeframe, ts, close, 0 as source_rank from p where symbol not like 'c%' union all select symbol, timeframe, ts, close, 1 from s where symbol not in (select symbol from p where symbol not like 'c%')")
_query("d12_latest", lambda s, d: C.latest(gappy(s, d), SERIES).select(*KEY, *OHLCV), f"{B} select {COLS} from b qualify row_number() over (partition by symbol, timeframe order by ts desc) = 1")
_query("d13_last_n", lambda s, d: C.last_n(gappy(s, d), SERIES, "ts", 48).select(*KEY, "close"), f"{B} select symbol, timeframe, ts, close from b qualify row_number() over (partition by symbol, timeframe order by ts desc) <= 48")

GAPS = """g0 as (select symbol, timeframe, lag(ts) over w as gap_start, ts as gap_end, lag(close) over w as before_price, open as after_price, date_diff('second', lag(ts) over w, ts) / 60.0 as minutes
  from b window w as (partition by symbol, timeframe order by ts))"""
G = f"{B}, {GAPS}"
GC = "symbol, timeframe, gap_start, gap_end, minutes"
_g = [*SERIES, "gap_start", "gap_end", "minutes"]
_query("g01_detect_gaps", lambda s, d: C.detect_gaps(gappy(s, d), 90.0), f"{G} select {GC}, before_price, after_price from g0 where minutes > 90")
_query("g02_modal_gap_count", lambda s, d: C.modal_gap_count(gappy(s, d)),
       f"""{G}, c as (select symbol, timeframe, minutes as d, count(*) as n from g0 where minutes is not null group by all), m as (select symbol, timeframe, arg_max(d, (n, -d)) as mode from c group by all)
select symbol, timeframe, mode, sum(case when d > 1.5 * mode then n else 0 end)::bigint as gaps from c join m using (symbol, timeframe) group by all""")
_query("g03_classify_gaps", lambda s, d: C.classify_gaps(C.detect_gaps(gappy(s, d), 60.0), 60.0).select(*_g, "gap_type", "severity", "price_change_pct"),
       f"""{G} select {GC}, case when minutes > 2880 then 'WEEKEND' when minutes < 240 then 'SMALL_GAP' when hour(gap_start) >= 20 or hour(gap_start) < 4 then 'OVERNIGHT' else 'UNKNOWN' end as gap_type,
case when minutes / 60 < 4 then 'LOW' when minutes / 60 > 24 then 'HIGH' else 'MEDIUM' end as severity, round((after_price - before_price) / nullif(before_price, 0) * 100, 6) + 0.0 as price_change_pct from g0 where minutes > 60""")
_query("g04_classify_gaps_extended", lambda s, d: C.classify_gaps_extended(C.detect_gaps(gappy(s, d), 60.0), 60.0).select(*_g, "gap_type", "severity", "fillable", "confidence"),
       f"""{G}, t as (select *, minutes / 60 as h, case when minutes / 60 between 48 and 80 and isodow(gap_start) >= 5 and isodow(gap_end) in (1, 7) then 'WEEKEND'
when (hour(gap_start) >= 20 or hour(gap_start) < 4) and minutes / 60 <= 12 then 'OVERNIGHT' when minutes / 60 < 4 then 'SMALL_GAP' when minutes / 60 between 12 and 36 then 'HOLIDAY' when minutes / 60 > 168 then 'API_FAILURE' else 'UNKNOWN' end as gap_type from g0 where minutes > 60)
select {GC}, gap_type, case when gap_type in ('WEEKEND', 'OVERNIGHT') then 'LOW' when h > 72 then 'CRITICAL' when h > 24 then 'HIGH' when h > 4 then 'MEDIUM' else 'LOW' end as severity, h <= 168 and gap_type <> 'API_FAILURE' as fillable,
case when gap_type = 'SMALL_GAP' then 1.0 when gap_type in ('WEEKEND', 'OVERNIGHT') then 0.9 when gap_type = 'HOLIDAY' then 0.7 else 0.5 end::double as confidence from t""")
_query("g05_irregular_gaps", lambda s, d: C.irregular_gaps(gappy(s, d)).select(*_g), f"{G} select {GC} from g0 where minutes > 66 and not minutes / 60 between 17 and 18 and not minutes / 60 between 65 and 66")
_query("g06_file_gap_types", lambda s, d: C.file_gap_types(gappy(s, d), 60.0).select(*_g, "gap_type", "missing_points"),
       f"{G} select {GC}, case when isodow(gap_start) = 5 and isodow(gap_end) = 1 then 'weekend' when minutes > 960 then 'market_closed' else 'data_missing' end as gap_type, (floor(minutes / 60) - 1)::bigint as missing_points from g0 where minutes > 90")
GRID = f"""{B}, sp as (select symbol, timeframe, min(ts) as a, max(ts) as z from b group by all),
grid as (select symbol, timeframe, unnest(generate_series(a, z, interval 1 hour)) as ts from sp), j as (select g.symbol, g.timeframe, g.ts, open, high, low, close, volume from grid g left join b using (symbol, timeframe, ts)),
sides as (select *, last_value(case when close is not null then {{'ts': ts, 'open': open, 'high': high, 'low': low, 'close': close}} end ignore nulls) over (w rows between unbounded preceding and current row) as p,
  first_value(case when close is not null then {{'ts': ts, 'open': open, 'high': high, 'low': low, 'close': close}} end ignore nulls) over (w rows between current row and unbounded following) as n
  from j window w as (partition by symbol, timeframe order by ts)),
parts as (select *, date_diff('second', p.ts, n.ts) / 3600.0 as gap, date_diff('second', p.ts, ts) / 3600.0 as gone from sides)"""
_query("g07_complete_grid", lambda s, d: C.complete_grid(gappy(s, d)).select(*KEY, "close"), f"{GRID} select symbol, timeframe, ts, close from j")
_v = lambda c: f"round(case when close is not null then {c} when gap < 4 then p.{c} + gone / gap * (n.{c} - p.{c}) else p.close end, 6) + 0.0 as {c}"
_query("g08_g09_fill_gaps", lambda s, d: C.fill_gaps(gappy(s, d)), f"{GRID} select symbol, timeframe, ts, {', '.join(map(_v, OHLCV[:4]))}, coalesce(volume, 0.0) as volume, case when close is not null then 'REAL' when gap < 4 then 'INTERPOLATED' else 'FORWARD' end as fill from parts")
_query("g10_flat_fill", lambda s, d: C.flat_fill(gappy(s, d)),
       f"{G}, f as (select symbol, timeframe, unnest(generate_series(gap_start + interval 1 hour, gap_end - interval 1 hour, interval 1 hour)) as ts, before_price as c from g0 where minutes > 60 and minutes < 72 * 60) select symbol, timeframe, ts, c as open, c as high, c as low, c as close, 0.0::double as volume, true as is_filled from f")
_query("g11_fill_with_provenance", lambda s, d: C.fill_with_provenance(gappy(s, d)),
       f"{GRID} select symbol, timeframe, ts, coalesce(close, p.close) as close, coalesce(volume, 0.0) as volume, close is null as is_gap_filled, case when close is null then 'FILL_FORWARD' else 'REAL' end as data_source from parts where close is not null or gap <= 24")

