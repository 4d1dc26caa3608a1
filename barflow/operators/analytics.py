"""Aggregations over sent signals, indicators and collection runs.  The time is an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio

SCORES = ["macd_score", "rsi_score", "vwap_score", "roc_score", "bollinger_score", "volume_score"]


def _since(df: DataFrame, since, col: str = "ts") -> DataFrame:
    return df if since is None else df.filter(F.col(col) >= F.lit(since))


def signal_summary(signals: DataFrame, since=None) -> DataFrame:
    """Counts and strengths by type and by symbol, in one pass."""
    g = _since(signals, since).groupingSets([[F.col("signal_type")], [F.col("symbol")]], "signal_type", "symbol")
    return g.agg(F.count("*").alias("n"), F.avg("strength").alias("avg_strength"), F.min("strength").alias("min_strength"), F.max("strength").alias("max_strength"))


def best_conditions(signals: DataFrame, since=None, least: float = 80.0, k: int = 10) -> DataFrame:
    s = _since(signals, since).filter(F.col("strength") >= least)
    g = s.groupBy("context", "signal_type").agg(F.count("*").alias("n"), F.avg("strength").alias("avg_strength")).filter("n >= 2")
    return g.orderBy(F.desc("n"), "context", "signal_type").limit(k)


def indicator_breakdown(signals: DataFrame, since=None, high: float = 15.0) -> DataFrame:
    """Mean, count and rate of high scores of each indicator."""
    long = _since(signals, since).select(F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).alias("v")) for c in SCORES])).alias("x")).select("x.*")
    return long.groupBy("indicator").agg(F.avg("v").alias("avg_score"), F.count_if(F.col("v") >= high).alias("high"), (100 * ratio(F.count_if(F.col("v") >= high), F.count("v"))).alias("high_rate"))


def regime_summary(indicators: DataFrame) -> DataFrame:
    return indicators.groupBy("regime").agg(F.count("*").alias("n"), F.avg("roc").alias("avg_roc"), F.avg("atr_pct").alias("avg_atr_pct"))


def volatility_readings(indicators: DataFrame) -> DataFrame:
    return indicators.groupBy("symbol", "volatility").agg(F.count("*").alias("n"), F.avg("atr_pct").alias("avg_atr_pct"))


def symbol_profile(bars: DataFrame) -> DataFrame:
    """Averages and price range of each symbol with its last ten daily means."""
    daily = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.avg("close").alias("c"))
    last = daily.withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day")))).filter("n <= 10")
    last = last.groupBy("symbol").agg(F.avg("c").alias("last_days_close"), F.count("*").alias("days"))
    g = bars.groupBy("symbol").agg(F.avg("close").alias("avg_close"), F.avg("volume").alias("avg_volume"), (100 * ratio(F.max("high") - F.min("low"), F.min("low"))).alias("range_pct"))
    return g.join(last, "symbol")


def timing(signals: DataFrame, since=None) -> DataFrame:
    """By hour and by weekday (Sunday 0), groups of two or more."""
    s = _since(signals, since).select("strength", F.hour("ts").alias("hour"), (F.dayofweek("ts") - 1).alias("weekday"))
    return s.groupingSets([[F.col("hour")], [F.col("weekday")]], "hour", "weekday").agg(F.count("*").alias("n"), F.avg("strength").alias("avg_strength")).filter("n >= 2")


def recent_activity(signals: DataFrame, now, hours: int = 24) -> DataFrame:
    """Signals of each symbol in the last hours before ``now``."""
    start = F.lit(now) - F.make_dt_interval(hours=F.lit(hours))
    return signals.filter((F.col("ts") > start) & (F.col("ts") <= F.lit(now))).groupBy("symbol").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def last_signals(signals: DataFrame, now, k: int = 5) -> DataFrame:
    return signals.filter(F.col("ts") <= F.lit(now)).orderBy(F.desc("ts"), F.desc("signal_id")).limit(k)


def store_health(df: DataFrame, now) -> DataFrame:
    day = F.col("ts") > F.lit(now) - F.make_dt_interval(hours=F.lit(24))
    return df.agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(day & (F.col("ts") <= F.lit(now))).alias("last_day"))


def collector_performance(stats: DataFrame) -> DataFrame:
    """Success rate, points and mean milliseconds by session and symbol, with subtotals."""
    g = stats.rollup("session", "symbol").agg(F.count("*").alias("runs"), (100 * F.count_if("success") / F.count("*")).alias("success_rate"), F.sum("points").alias("points"), F.avg("ms").alias("avg_ms"))
    return g
