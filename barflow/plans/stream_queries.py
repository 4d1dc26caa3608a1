"""Queries R1 to R8 (run over the events table as a file stream) and S3 to S9."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEY, rounded
from ..operators import signals as P
from ..sources import files as S
from ..sources import store as V
from ..sources import fixtures as X
from ..sources.files import shared_folder
from ..sources.fixtures import bars, bars_sql
from ..streaming import jobs as R
from .clean_queries import TWO_SQL, two
from .trade_queries import PARAMS, PLAN_SQL, hourly, ind_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


FILES = 4  # of a trigger


def streamed(df: DataFrame, files: int = 3, order: str = "ts") -> DataFrame:
    """The rows as a stream of ``files`` Parquet folders, one a trigger, in rising ``order``.

    A trigger takes a number of files, so each folder gets just that many: with fewer, the next
    folder's first files would join it, and the rest of that folder would come too late.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "stream")
    cuts = df.agg(F.percentile_approx(F.unix_micros(F.col(order).cast("timestamp")), [i / files for i in range(1, files)], 10000).alias("q")).first().q or []
    part = F.lit(0)
    for q in cuts:
        part = part + F.when(F.unix_micros(F.col(order).cast("timestamp")) > q, 1).otherwise(0)
    made = df.withColumn("_part", part)
    none = spark.createDataFrame([], df.schema)
    for i in range(files):  # one after the other, so that file times rise
        to = f"{path}/n={i}"
        made.filter(F.col("_part") == i).drop("_part").coalesce(FILES).write.option("maxRecordsPerFile", 0).mode("append").parquet(to)
        if i < files - 1:
            for _ in range(FILES - len(spark.read.schema(df.schema).parquet(to).inputFiles())):  # tasks without rows have written no file
                none.write.mode("append").parquet(to)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/n=*")


def drained(stream: DataFrame) -> DataFrame:
    """All that an append-mode query gives once its source is empty."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession, "sink")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def events(spark, sf_dir) -> DataFrame:
    return X.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def plain(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Zone-less times again."""
    return rounded(df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.select(*cols).dtypes]), digits)



def ingest(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    twice = e.unionByName(e.filter("event_id % 40 = 0"))
    return plain(drained(R.ingest_stream(streamed(twice), ["event_id"])), "event_id", "ts", "value")


def closed_bars(spark, sf_dir) -> DataFrame:
    return plain(drained(R.bars_stream(streamed(events(spark, sf_dir)))), "symbol", "ts", "open", "high", "low", "close", "volume")


def activity(spark, sf_dir) -> DataFrame:
    return plain(drained(R.activity_stream(streamed(events(spark, sf_dir)))), "symbol", "until", "n", "avg_value", digits=9)


def sessions(spark, sf_dir) -> DataFrame:
    return plain(drained(R.session_stream(streamed(events(spark, sf_dir)))), "user_id", "start", "end", "n")


def bar_rows(spark, sf_dir, gappy=True) -> DataFrame:
    return bars(spark, sf_dir, 1, gappy).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume")


def gaps(spark, sf_dir) -> DataFrame:
    return plain(drained(R.gap_stream(streamed(bar_rows(spark, sf_dir)))), "symbol", "gap_start", "gap_end", "minutes")


def live_signals(spark, sf_dir) -> DataFrame:
    return plain(drained(R.signal_stream(streamed(bar_rows(spark, sf_dir, False)))), "symbol", "ts", "side", "close")


def alerts(spark, sf_dir) -> DataFrame:
    plan = P.trade_plan(P.vwap_bounce(hourly(spark, sf_dir), PARAMS)).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "side", "entry", "sl", "tp")
    rows = bar_rows(spark, sf_dir, False).unionByName(plan, allowMissingColumns=True)
    return plain(drained(R.alert_stream(streamed(rows))), "symbol", "alert_ts", "ts", "reason")


def throttled(spark, sf_dir) -> DataFrame:
    s = X.signals_sent(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "strength", F.col("signal_type").alias("direction"))
    return plain(drained(R.throttle_stream(streamed(s))), "symbol", "ts", "strength", "direction")


def confirmed(spark, sf_dir) -> DataFrame:
    full = P.vwap_bounce(hourly(spark, sf_dir), PARAMS).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "side")
    loose = P.vwap_bounce(hourly(spark, sf_dir), {"wick_ratio": 0.5}).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "side")
    return plain(drained(R.confirm_stream(streamed(loose), streamed(full))), "symbol", "ts", "forming_side", "closed_side", "confirmed")


def _add(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        SQL[name] = sql


_add("r01_ingest_stream", ingest, "select event_id, ts, round(value, 6) + 0.0 as value from events")


def corrected(spark, sf_dir) -> DataFrame:
    """Bars streamed into a store, then corrections of every fifth bar; both streams run a second time without their checkpoints, as after a crash."""
    path, b = shared_folder(spark, "corrected"), bars(spark, sf_dir).select(*KEY, "close", "volume")
    late = b.filter(F.hour("ts") % 5 == 0).withColumn("close", F.col("close") + 1)
    for rows, name in ((b, "bars"), (late, "corrections")):
        source = streamed(rows)
        for run in range(2):
            R.upsert_batches(source, path, KEY, f"{path}-{name}-{run}", name).awaitTermination()
    V.compact(spark, path)
    return rounded(V.read_store(spark, path))


_add("r01b_corrected_store", corrected, f"with {bars_sql('b')} select symbol, timeframe, ts, round(close + case when hour(ts) % 5 = 0 then 1 else 0 end, 6) + 0.0 as close, round(volume, 6) + 0.0 as volume from b")
# Append mode gives the windows that ended a day (the watermark) before the last event.
DONE = "(select max(ts) - interval 24 hour from events)"
_add("r02_bars_stream", closed_bars, f"with {bars_sql('b')} select symbol, ts, round(open, 6) + 0.0 as open, round(high, 6) + 0.0 as high, round(low, 6) + 0.0 as low, round(close, 6) + 0.0 as close, round(volume, 6) + 0.0 as volume from b where ts + interval 1 hour <= {DONE}")
_add("r03_activity_stream", activity, f"""with s as (select event_type as symbol, value, unnest(generate_series(date_trunc('hour', ts) + interval 1 hour, date_trunc('hour', ts) + interval 24 hour, interval 1 hour)) as until from events)
select symbol, until, count(*) as n, round(avg(value), 9) + 0.0 as avg_value from s where until <= {DONE} group by all""")
_add("r03b_session_stream", sessions, f"""with o as (select user_id, ts, coalesce(ts >= lag(ts) over w + interval 30 minute, true) as st from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(st::int) over (partition by user_id order by ts rows between unbounded preceding and current row) as run from o)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from r group by user_id, run having max(ts) + interval 30 minute <= {DONE}""")
_add("r04_gap_stream", gaps, f"with {bars_sql('b', 1, True)}, g as (select symbol, lag(ts) over (partition by symbol order by ts) as gap_start, ts as gap_end from b) select symbol, gap_start, gap_end, date_diff('second', gap_start, gap_end) / 60.0 as minutes from g where date_diff('second', gap_start, gap_end) / 60.0 > 90 and gap_end < gap_start + interval 90 day")
_add("r05_signal_stream", live_signals, f"with {ind_sql()} select symbol, ts, side, round(close, 6) + 0.0 as close from sig where side is not null")
_add("r06_alert_stream", alerts, f"""with {ind_sql()}, {PLAN_SQL},
en as (select p.symbol, p.ts, b.ts as last_ts from plan p asof join b on b.symbol = p.symbol and b.ts >= p.ts + interval 8 hour),
h as (select p.symbol, p.ts as alert_ts, b.ts,
        case when (side = 'LONG' and low <= sl) or (side = 'SHORT' and high >= sl) then 'SL' when (side = 'LONG' and high >= tp) or (side = 'SHORT' and low <= tp) then 'TP'
             when b.ts >= p.ts + interval 8 hour then 'TIME_STOP' end as reason
      from plan p left join en using (symbol, ts) join b on b.symbol = p.symbol and b.ts > p.ts and (last_ts is null or b.ts <= last_ts) and b.ts <= p.ts + interval 728 hour),
exits as (select * from h where reason is not null qualify row_number() over (partition by symbol, alert_ts order by ts) = 1)
select * from exits
union all
select p.symbol, p.ts, p.ts + interval 8 hour, 'TIME_STOP' from plan p left join en using (symbol, ts)
where not exists (select 1 from exits e where e.symbol = p.symbol and e.alert_ts = p.ts)
  and (last_ts > p.ts + interval 728 hour or (select max(ts) from b) - interval 24 hour >= p.ts + interval 728 hour)""")
_add("r07_throttle_stream", throttled, f"""with recursive {X.SIGNALS_SQL}, o as (select symbol, ts, strength, signal_type as direction, row_number() over (partition by symbol order by ts, strength) as n from signals),
st as (select symbol, n, ts, strength, direction, true as sent, ts as at_, strength as s_, direction as d_ from o where n = 1
  union all select symbol, n, ts, strength, direction, go, case when go then ts else at_ end, case when go then strength else s_ end, case when go then direction else d_ end
  from (select o.*, at_, s_, d_, o.direction <> d_ or (o.ts >= at_ + interval 30 minute and o.strength >= s_ + 10) or o.ts >= at_ + interval 90 day as go from st join o on o.symbol = st.symbol and o.n = st.n + 1))
select symbol, ts, round(strength, 6) + 0.0 as strength, direction from st where sent""")
_add("r08_confirm_stream", confirmed, f"""with {ind_sql()}, lo as (select symbol, ts, case when low <= vwap and close > vwap and least(open, close) - low > 0.5 * abs(close - open) then 'LONG' when high >= vwap and close < vwap and high - greatest(open, close) > 0.5 * abs(close - open) then 'SHORT' end as side from ind where coalesce(vwap, 0) <> 0 and coalesce(volume_sma_20, 0) <> 0 and volume > volume_sma_20)
select symbol, ts, lo.side as forming_side, sig.side as closed_side, lo.side = sig.side as confirmed from lo join sig using (symbol, ts) where lo.side is not null and sig.side is not null""")


# Stores.
def _query(name: str, make, sql: str) -> None:
    _add(name, lambda s, d: rounded(make(s, d)), sql)


CUT = dt.datetime(2024, 1, 15)
C = "symbol, timeframe, ts, close, volume"
_query("s03_load_bars", lambda s, d: S.load_bars(bars(s, d), ["click", "view"], "1h", dt.datetime(2024, 1, 5), CUT).select(*KEY, "close", "volume"), f"with {bars_sql('b')} select {C} from b where symbol in ('click', 'view') and ts between '2024-01-05' and '{CUT}'")
def repeated(x: DataFrame) -> DataFrame:
    """Each row twice, the second time with one more volume: ``n`` is the order of arrival."""
    return x.select(*KEY, "close", "volume", F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).withColumn("volume", F.col("volume") + F.col("n"))


_query("s04_upsert_bars", lambda s, d: S.upsert_bars(repeated(two(s, d)[0]), repeated(two(s, d)[1]), order=["n"]).select(*KEY, "close", "volume"),
       f"with {TWO_SQL} select symbol, timeframe, ts, close, volume + 1 as volume from s union all select symbol, timeframe, ts, close, volume + 1 as volume from p where not exists (select 1 from s where p.symbol = s.symbol and p.ts = s.ts)")
_query("s05_append_new", lambda s, d: S.append_new(two(s, d)[0].select(*KEY, "close", "volume").withColumn("n", F.lit(0)), repeated(two(s, d)[1]), order=["n"]).select(*KEY, "close", "volume"), f"with {TWO_SQL} select {C} from p union all select {C} from s where not exists (select 1 from p where p.symbol = s.symbol and p.ts = s.ts)")


def candle_files(s, d) -> DataFrame:
    """Bars written as CSV in two formats of header into one folder, and read back."""
    path, b = shared_folder(s, "candles"), bars(s, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    one = b.filter("symbol < 'm'").select(F.col("ts").alias("Datetime"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"), F.col("symbol").alias("Symbol"), F.col("timeframe").alias("Timeframe"))
    other = b.filter("symbol >= 'm'").select("timeframe", "close", "high", "low", "open", F.col("ts").alias("time"), F.col("symbol").alias("ticker"))
    for x in (one, other):
        x.write.mode("append").csv(path, header=True)
    return S.read_candle_csv(s, path)


_query("s01_candle_csv", candle_files, f"with {bars_sql('b')} select symbol, timeframe, ts, open, high, low, close, case when symbol < 'm' then volume end as volume from b where close > 0 and high >= low")


def audits(s, d) -> DataFrame:
    """Bars and a trade a day as nested audit documents of a day each, written and read back; bars and trades in one table."""
    path, b = shared_folder(s, "audits"), bars(s, d)
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    day = b.groupBy("symbol", "timeframe", F.to_date("ts").alias("day")).agg(
        F.collect_list(F.struct(text.alias("timestamp"), "open", "high", "low", "close", F.create_map(F.lit("vol"), F.col("volume")).alias("indicators"), F.lit("NONE").alias("signal"))).alias("bars"),
        F.array(F.min(F.struct(text.alias("timestamp"), F.lit("BUY").alias("side"), F.col("open").alias("price"), F.lit(2.0).alias("quantity"), F.lit(0.5).alias("commission"), F.lit("ENTRY").alias("tag")))).alias("trades"))
    day.select(F.struct(F.lit("s").alias("strategy"), "symbol", "timeframe").alias("metadata"), "bars", "trades").write.json(path)
    found, trades = S.read_audit(s, path, multi_line=False)
    return found.select(*KEY, F.lit("BAR").alias("kind"), F.col("close").alias("price"), F.col("indicators")["vol"].alias("qty")).unionByName(trades.select(*KEY, F.col("side").alias("kind"), "price", "qty"))


_query("s02_audit_json", audits, f"with {bars_sql('b')} select symbol, timeframe, ts, 'BAR' as kind, close as price, volume as qty from b union all select symbol, timeframe, min(ts), 'BUY', arg_min(open, ts), 2.0 from b group by symbol, timeframe, date_trunc('day', ts)")


def stored_indicators(s, d) -> DataFrame:
    """The last 48 rows of each series, then the last 24 of one with other values."""
    path, b = shared_folder(s, "indicators"), hourly(s, d)
    S.write_indicators(b, path, ["vwap", "atr"], 48)
    S.write_indicators(b.filter("symbol = 'click'").withColumn("atr", F.col("atr") * 2), path, ["vwap", "atr"], 24)
    return s.read.parquet(path).select("symbol", F.col("timeframe").cast("string").alias("timeframe"), "ts", "vwap", "atr")


_query("s06_write_indicators", stored_indicators, f"with {ind_sql()}, n as (select *, row_number() over (partition by symbol, timeframe order by ts desc) as n from ind) select symbol, timeframe, ts, round(vwap, 6) + 0.0 as vwap, round(atr * case when symbol = 'click' and n <= 24 then 2 else 1 end, 6) + 0.0 as atr from n where n <= 48")


def indicator_versions(s, d) -> DataFrame:
    """Indicators of the last 48 rows, then of the last 24 of one series with other values, as versions; the first and the last are read."""
    path, b = shared_folder(s, "indicator-store"), hourly(s, d)
    first = V.save_indicators(b, path, ["vwap", "atr"], 48)
    V.save_indicators(b.filter("symbol = 'click'").withColumn("atr", F.col("atr") * 2), path, ["vwap", "atr"], 24)
    V.compact(s, path)
    return V.read_store(s, path, first).withColumn("version", F.lit("first")).unionByName(V.read_store(s, path).withColumn("version", F.lit("last")))


_query("s06c_indicator_versions", indicator_versions, f"""with {ind_sql()}, n as (select *, row_number() over (partition by symbol, timeframe order by ts desc) as n from ind), v(version) as (values ('first'), ('last'))
select symbol, timeframe, ts, round(vwap, 6) + 0.0 as vwap, round(atr * case when version = 'last' and symbol = 'click' and n <= 24 then 2 else 1 end, 6) + 0.0 as atr, version from n, v where n <= 48""")


def store_versions(s, d) -> DataFrame:
    """A store read at its first and at its last version, of one symbol and half the range."""
    path, b = shared_folder(s, "versions"), bars(s, d).select(*KEY, "close", "volume")
    first = V.commit(b, path)
    V.commit(b.filter("symbol = 'click'").withColumn("close", F.col("close") * 2), path)
    V.compact(s, path)
    read = lambda v: V.read_store(s, path, v, symbols=["click", "view"], timeframe="1h", start=dt.datetime(2024, 1, 5), end=CUT)
    return read(first).withColumn("version", F.lit("first")).unionByName(read(None).withColumn("version", F.lit("last")))


_query("s06b_store_versions", store_versions, f"""with {bars_sql('b')}, x as (select {C} from b where symbol in ('click', 'view') and ts between '2024-01-05' and '{CUT}')
select *, 'first' as version from x union all select symbol, timeframe, ts, close * case when symbol = 'click' then 2 else 1 end, volume, 'last' from x""")


def exported(s, d) -> DataFrame:
    path = shared_folder(s, "export")
    b = bars(s, d).select(*KEY, "close", "volume")
    S.export_since(b, "ts", CUT, path)
    return s.read.schema(b.schema).json(path)


_query("s07_export_since", exported, f"with {bars_sql('b')} select {C} from b where ts > '{CUT}'")
_query("s08_purge_older_than", lambda s, d: S.purge_older_than(bars(s, d), "ts", CUT)[0].select(*KEY, "close", "volume"), f"with {bars_sql('b')} select {C} from b where ts >= '{CUT}'")


def ledger(s, d) -> DataFrame:
    from ..operators.clean import detect_gaps

    g = [detect_gaps(x, 120.0).select("symbol", "gap_start", "gap_end", F.lit("flat").alias("method"), (F.col("minutes") / 60 - 1).cast("int").alias("bars_added")) for x in two(s, d)]
    twice = g[1].withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("method", F.when(F.col("n") == 2, "linear").otherwise("spline"))
    return S.merge_gap_ledger(g[0].withColumn("fill_count", F.lit(1)), twice, ["n"])


_g = lambda x, m: f"(select symbol, lag(ts) over (partition by symbol order by ts) as gap_start, ts as gap_end, '{m}' as method from {x} qualify date_diff('second', lag(ts) over (partition by symbol order by ts), ts) > 7200)"
_query("s09_merge_gap_ledger", ledger, f"with {TWO_SQL}, a as {_g('p', 'flat')}, b as {_g('s', 'linear')} select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.gap_start, b.gap_start) as gap_start, coalesce(a.gap_end, b.gap_end) as gap_end, coalesce(b.method, a.method) as method, (date_diff('second', coalesce(a.gap_start, b.gap_start), coalesce(a.gap_end, b.gap_end)) / 3600 - 1)::integer as bars_added, (a.symbol is not null)::integer + 2 * (b.symbol is not null)::integer as fill_count from a full join b on a.symbol = b.symbol and a.gap_start = b.gap_start and a.gap_end = b.gap_end")
