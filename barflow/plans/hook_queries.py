"""Queries U1 to U5: time, text and number helpers, JSON snapshots and path-dependent rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as H
from ..functions import snapshots as N
from ..functions.columns import KEY, SERIES, rounded, series
from ..operators import clean as C
from ..operators import rules as R
from ..sources.fixtures import bars, bars_sql
from .clean_queries import GAPS, gappy
from .trade_queries import r6

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, make, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
    SQL[name] = sql


NY = "(ts at time zone 'UTC' at time zone 'America/New_York')"


def times(s, d) -> DataFrame:
    b = bars(s, d)
    ny = H.new_york(F.col("ts"))
    return b.select(
        *KEY, ny.alias("ny"), F.to_date(ny).alias("ny_date"), F.hour(ny).alias("ny_hour"), F.weekday(ny).alias("ny_weekday"), F.date_trunc("hour", ny).cast("timestamp_ntz").alias("ny_hour_start"),
        H.minutes_between(F.lag("ts").over(series()), F.col("ts")).alias("minutes"), H.closing_soon(F.col("ts")).alias("closing"), H.closing_soon(F.col("ts"), 120).alias("closing_2h"))


_query("u01_time_parts", times, f"""with {bars_sql('b')}, n as (select *, {NY} as ny from b)
select symbol, timeframe, ts, ny, ny::date as ny_date, hour(ny)::integer as ny_hour, (isodow(ny) - 1)::integer as ny_weekday, date_trunc('hour', ny) as ny_hour_start,
  {r6("date_diff('second', lag(ts) over (partition by symbol, timeframe order by ts), ts) / 60.0 as minutes")},
  isodow(ny) <= 5 and hour(ny) * 60 + minute(ny) >= 950 as closing, isodow(ny) <= 5 and hour(ny) * 60 + minute(ny) >= 840 as closing_2h from n""")


def texts(s, d) -> DataFrame:
    """Keys of bars, names of files made of them and split again, and tags."""
    b = bars(s, d).withColumn("name", F.concat(F.lit("/data/"), F.col("symbol"), F.lit("_"), F.upper("timeframe"), F.lit("_"), F.date_format("ts", "yyyyMMdd"), F.lit(".csv ")))
    tag = F.when(F.hour("ts") % 5 == 0, "ENTRY_LONG").when(F.hour("ts") % 5 == 1, "SL_HIT").when(F.hour("ts") % 5 == 2, "TP1").when(F.hour("ts") % 5 == 3, "FORCED_EXIT")
    symbol, timeframe = H.file_parts(F.col("name"))
    return b.select(*KEY, H.feature_key(F.col("symbol"), F.col("timeframe"), F.col("ts")).alias("key"), symbol.alias("file_symbol"), timeframe.alias("file_timeframe"), H.is_exit_tag(tag).alias("is_exit"))


_query("u02_keys_and_tags", texts, f"""with {bars_sql('b')}
select symbol, timeframe, ts, symbol || '_' || timeframe || '_' || strftime(ts, '%Y-%m-%dT%H:%M:%S') as key, upper(symbol) as file_symbol, timeframe as file_timeframe, hour(ts) % 5 <> 0 as is_exit from b""")


def numbers(s, d) -> DataFrame:
    before = F.lag("close").over(series())
    return bars(s, d).select(
        *KEY, H.clamp(F.col("close"), 100.0, 300.0).alias("clamped"), H.pct_change(F.col("close"), before).alias("change_pct"), F.signum(F.col("close") - F.col("open")).alias("way"),
        H.ratio(F.col("high") - F.col("low"), F.col("volume") - F.floor(F.col("volume"))).alias("safe"), F.greatest("open", "close").alias("top"), F.least("open", "close").alias("bottom"), F.round(F.abs(F.col("open") - F.col("close")), 2).alias("body"))


_query("u03_numbers", numbers, f"""with {bars_sql('b')}, l as (select *, lag(close) over (partition by symbol, timeframe order by ts) as c0 from b)
select symbol, timeframe, ts, {r6('greatest(100.0, least(300.0, close)) as clamped', '100 * (close - c0) / nullif(abs(c0), 0) as change_pct')}, sign(close - open)::double as way,
  {r6('(high - low) / nullif(volume - floor(volume), 0) as safe', 'greatest(open, close) as top', 'least(open, close) as bottom', 'round(abs(open - close), 2) as body')} from l""")


def snapshots(s, d) -> DataFrame:
    """Snapshots written as JSON text and read back: the last bars, and gaps by type and severity, in one table."""
    b = gappy(s, d)
    made = N.to_snapshot(b, C.classify_gaps(C.detect_gaps(b, 90.0), 60.0))
    rows = N.snapshot_rows(made).select(*SERIES, F.lit("bar").alias("kind"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("name"), F.col("close").alias("x"), F.col("volume").alias("y"))
    return rows.unionByName(N.snapshot_counts(made).select(*SERIES, "kind", "name", F.col("n").cast("double").alias("x"), F.lit(0.0).alias("y")))


_query("u04_snapshot", snapshots, f"""with {bars_sql('b', 1, True)}, {GAPS},
gt as (select *, case when minutes > 2880 then 'WEEKEND' when minutes < 240 then 'SMALL_GAP' when hour(gap_start) >= 20 or hour(gap_start) < 4 then 'OVERNIGHT' else 'UNKNOWN' end as gap_type,
         case when minutes / 60 < 4 then 'LOW' when minutes / 60 > 24 then 'HIGH' else 'MEDIUM' end as severity from g0 where minutes > 90),
last as (select * from b qualify row_number() over (partition by symbol, timeframe order by ts desc) <= 5)
select symbol, timeframe, 'bar' as kind, strftime(ts, '%Y-%m-%d %H:%M:%S') as name, {r6('close as x', 'volume as y')} from last
union all select symbol, timeframe, 'type', gap_type, count(*)::double, 0.0 from gt group by all
union all select symbol, timeframe, 'severity', severity, count(*)::double, 0.0 from gt group by all""")


def trailing(s, d) -> DataFrame:
    """A trailing stop over hourly bars at two distances; every sixth hour that rises is an entry."""
    b = bars(s, d).withColumn("enter", (F.hour("ts") % 6 == 0) & (F.col("close") > F.col("open")))
    return R.apply_rule(b, R.TrailingStop, s.createDataFrame([(1, 0.2), (2, 0.6)], "param_id bigint, trail double")).drop("tag")


_query("u05_trailing_stop", trailing, f"""with recursive {bars_sql('b')}, p(param_id, trail) as (values (1::bigint, 0.2::double), (2, 0.6)),
o as (select symbol, timeframe, ts, open, high, low, close, hour(ts) % 6 = 0 and close > open as enter, param_id, trail, row_number() over (partition by symbol, timeframe, param_id order by ts) as n from b, p),
st as (
  select o.*, case when enter then close end as peak, case when enter then 'BUY' end as action, case when enter then close end as price from o where n = 1
  union all
  select o.*, case when peak is null then case when o.enter then o.close end when o.low <= peak * (1 - o.trail) then null else greatest(peak, o.high) end,
    case when peak is null then case when o.enter then 'BUY' end when o.low <= peak * (1 - o.trail) then 'SELL' end,
    case when peak is null then case when o.enter then o.close end when o.low <= peak * (1 - o.trail) then least(o.open, peak * (1 - o.trail)) end
  from st join o on o.symbol = st.symbol and o.timeframe = st.timeframe and o.param_id = st.param_id and o.n = st.n + 1)
select symbol, timeframe, param_id, ts, action, {r6('price')} from st where action is not null""")
