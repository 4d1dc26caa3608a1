"""The given tables as bars, fills, trades, signals and the like, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bucket(ts: Column, hours: int) -> Column:
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.day(ts), F.hour(ts) - F.hour(ts) % hours, F.lit(0), F.lit(0))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def bars(spark: SparkSession, sf_dir: str, hours: int = 1, gappy: bool = False, where: str | None = None) -> DataFrame:
    """OHLCV bars of ``hours`` from events: symbol is the event type (``gappy``: with a user group)."""
    e = table(spark, sf_dir, "events")
    if where:
        e = e.filter(where)
    symbol = F.concat_ws("_", "event_type", (F.col("user_id") % 4).cast("string")) if gappy else F.col("event_type")
    order = F.struct("ts0", "event_id")
    e = e.select(symbol.alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts0"), "event_id", "value", _k().alias("k"))
    name = {1: "1h", 4: "4h", 24: "1d"}[hours]
    return (
        e.groupBy("symbol", F.lit(name).alias("timeframe"), _bucket(F.col("ts0"), hours).alias("ts"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.sum("k").alias("volume"))
        .withColumn("is_filled", F.lit(False))
    )


def bars_sql(name: str, hours: int = 1, gappy: bool = False, where: str = "true") -> str:
    """The same as a common table expression."""
    tf = {1: "1h", 4: "4h", 24: "1d"}[hours]
    symbol = "event_type || '_' || (user_id % 4)::varchar" if gappy else "event_type"
    return f"""{name} as (
  select symbol, '{tf}' as timeframe, ts, arg_min(value, (ts0, event_id)) as open, max(value) as high, min(value) as low,
         arg_max(value, (ts0, event_id)) as close, sum(k) as volume, false as is_filled
  from (select {symbol} as symbol, ts as ts0, event_id, value, json_extract_string(props, '$.k')::double as k,
               date_trunc('day', ts) + to_hours((hour(ts) // {hours}) * {hours}) as ts
        from events where {where})
  group by symbol, ts)"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of 50 symbols, with a total order in ``seq``-like columns."""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return li.select(
        F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("l_linestatus") == "F", "BUY").otherwise("SELL").alias("side"), F.col("l_quantity").cast("double").alias("qty"), price.alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax") / 100).alias("commission"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linestatus").alias("seq"),
    )


FILLS_SQL = """fills as (
  select 'P' || (l_partkey % 50)::varchar as symbol, l_shipdate::timestamp as ts, case when l_linestatus = 'F' then 'BUY' else 'SELL' end as side,
         l_quantity::double as qty, l_extendedprice / l_quantity as price, l_extendedprice * l_tax / 100 as commission,
         row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linestatus) as seq
  from lineitem)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades with reason, strength, ADX and profit."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("symbol"), F.when(F.col("l_linestatus") == "F", "LONG").otherwise("SHORT").alias("side"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.lit(0.05))).alias("pnl"), (F.col("l_extendedprice") * F.col("l_tax") / 100).alias("commission"),
        F.when(F.col("l_returnflag") == "R", "SL").when(F.col("l_returnflag") == "A", "TP").otherwise("TIME_STOP").alias("exit_reason"),
        (55 + F.col("l_quantity") % 46).cast("double").alias("strength"), (F.col("l_quantity") * 2).cast("double").alias("adx"), F.col("l_shipdate").cast("timestamp_ntz").alias("exit_ts"),
        F.col("l_orderkey").alias("trade_id"),
    )


TRADES_SQL = """trades as (
  select 'P' || (l_partkey % 50)::varchar as symbol, case when l_linestatus = 'F' then 'LONG' else 'SHORT' end as side,
         l_extendedprice * (l_discount - 0.05) as pnl, l_extendedprice * l_tax / 100 as commission,
         case l_returnflag when 'R' then 'SL' when 'A' then 'TP' else 'TIME_STOP' end as exit_reason,
         (55 + l_quantity % 46)::double as strength, (l_quantity * 2)::double as adx, l_shipdate::timestamp as exit_ts, l_orderkey as trade_id
  from lineitem)"""


def signals_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    scores = [((_k() + i) % 21).alias(f"{n}_score") for i, n in enumerate(("macd", "rsi", "vwap", "roc", "bollinger", "volume"))]
    return e.select(
        F.col("event_id").alias("signal_id"), F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("event_type").isin("click", "view", "signup"), "LONG").otherwise("SHORT").alias("signal_type"), F.least("value", F.lit(100.0)).alias("strength"),
        F.col("event_type").alias("context"), *scores)


SIGNALS_SQL = """signals as (
  select event_id as signal_id, 'U' || (user_id % 20)::varchar as symbol, ts,
         case when event_type in ('click', 'view', 'signup') then 'LONG' else 'SHORT' end as signal_type, least(value, 100.0) as strength, event_type as context,
         (k + 0) % 21 as macd_score, (k + 1) % 21 as rsi_score, (k + 2) % 21 as vwap_score, (k + 3) % 21 as roc_score, (k + 4) % 21 as bollinger_score, (k + 5) % 21 as volume_score
  from (select *, json_extract_string(props, '$.k')::double as k from events))"""


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("C"), (F.col("o_custkey") % 100).cast("string")).alias("symbol"), (F.col("o_orderkey") % 7).alias("position_id"),
        F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "O", "PENDING").otherwise("CANCELLED").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "STOP_LOSS").when(F.col("o_orderpriority") == "2-HIGH", "EXIT").otherwise("ENTRY").alias("execution_type"),
        (F.col("o_orderkey") % 10 + 1).cast("double").alias("quantity"), (F.col("o_totalprice") / 1000).cast("double").alias("executed_price"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))


EXECUTIONS_SQL = """executions as (
  select 'C' || (o_custkey % 100)::varchar as symbol, o_orderkey % 7 as position_id,
         case o_orderstatus when 'F' then 'FILLED' when 'O' then 'PENDING' else 'CANCELLED' end as status,
         case o_orderpriority when '1-URGENT' then 'STOP_LOSS' when '2-HIGH' then 'EXIT' else 'ENTRY' end as execution_type,
         (o_orderkey % 10 + 1)::double as quantity, (o_totalprice / 1000)::double as executed_price, o_orderdate::timestamp as created_at
  from orders)"""


def collector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hour = F.hour("ts")
    return e.select(
        F.when((hour >= 4) & (hour < 9), "PRE_MARKET").when((hour >= 9) & (hour < 16), "REGULAR").when((hour >= 16) & (hour < 20), "POST_MARKET").otherwise("OVERNIGHT").alias("session"),
        F.col("event_type").alias("symbol"), (F.col("event_type") != "error").alias("success"), _k().alias("points"), F.col("value").alias("ms"))


COLLECTOR_SQL = """collector as (
  select case when hour(ts) between 4 and 8 then 'PRE_MARKET' when hour(ts) between 9 and 15 then 'REGULAR' when hour(ts) between 16 and 19 then 'POST_MARKET' else 'OVERNIGHT' end as session,
         event_type as symbol, event_type <> 'error' as success, json_extract_string(props, '$.k')::double as points, value as ms from events)"""


def bad_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gappy bars with planted faults: swapped high and low, negative close or volume, repeated rows."""
    from pyspark.sql import Window

    b = bars(spark, sf_dir, 1, True)
    r = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    b = b.withColumn("r", r)
    swap = F.col("r") % 97 == 0
    b = b.withColumns({
        "high": F.when(swap, F.col("low")).otherwise(F.col("high")), "low": F.when(swap, F.col("high")).otherwise(F.col("low")),
        "close": F.when(F.col("r") % 101 == 0, -F.col("close")).otherwise(F.col("close")), "volume": F.when(F.col("r") % 103 == 0, F.lit(-1.0)).otherwise(F.col("volume")), "seq": F.lit(1),
    })
    again = b.filter("r % 107 = 0").withColumns({"seq": F.lit(2), "close": F.col("close") + 1})
    return b.unionByName(again).drop("r")


BAD_SQL = bars_sql("gappy", 1, True) + """,
numbered as (select *, row_number() over (partition by symbol order by ts) as r from gappy),
planted as (
  select symbol, timeframe, ts, open, case when r % 97 = 0 then low else high end as high, case when r % 97 = 0 then high else low end as low,
         case when r % 101 = 0 then -close else close end as close, case when r % 103 = 0 then -1.0 else volume end as volume, is_filled, 1 as seq, r from numbered),
bad as (select * exclude r from planted union all select symbol, timeframe, ts, open, high, low, close + 1, volume, is_filled, 2, from planted where r % 107 = 0)"""
