"""Technical indicators as window expressions: bars in, bars with more columns out.

All share the partitioning (symbol, timeframe), so a chain of them costs one exchange.
Values need a full window (warm-up gives null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import SERIES, full, mean, new_york, ratio, running, series
from .ema import ema


def sma(df: DataFrame, n: int, col: str = "close", name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"sma_{n}", mean(F.col(col), n))


def _rsi(x: Column, n: int, zero_loss: str) -> tuple[Column, Column]:
    """Gains and losses of x; the first difference counts as zero."""
    change = F.coalesce(x - F.lag(x).over(series()), F.lit(0.0))
    return F.greatest(change, F.lit(0.0)), F.greatest(-change, F.lit(0.0))


def rsi(df: DataFrame, n: int = 14, zero_loss: str = "null", col: str = "close", name: str = "rsi") -> DataFrame:
    """Relative strength with simple means; without losses null, 50 or 100 (``zero_loss``)."""
    gain, loss = _rsi(F.col(col), n, zero_loss)
    made = df.withColumns({"_gain": gain, "_loss": loss}).withColumns({"_up": mean(F.col("_gain"), n), "_down": mean(F.col("_loss"), n)})
    other = {"null": F.lit(None).cast("double"), "50": F.lit(50.0), "100": F.lit(100.0)}[zero_loss]
    value = F.when(F.col("_down") > 0, 100 - 100 / (1 + F.col("_up") / F.col("_down"))).when(F.col("_down") == 0, other)
    return made.withColumn(name, value).drop("_gain", "_loss", "_up", "_down")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Bands around the mean (sample deviation), their width, %b and a label of the position."""
    c = F.col("close")
    made = df.withColumns({"bb_mid": mean(c, n), "_dev": full(F.stddev_samp(c).over(series(n)), c, n)})
    made = made.withColumns({"bb_upper": F.col("bb_mid") + k * F.col("_dev"), "bb_lower": F.col("bb_mid") - k * F.col("_dev")})
    made = made.withColumns({"bb_width": ratio(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_mid")), "bb_pct": ratio(c - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower"))})
    label = F.when(F.col("bb_pct").isNull(), None).when(F.col("bb_pct") > 1, "ABOVE_UPPER").when(F.col("bb_pct") < 0, "BELOW_LOWER").when(F.col("bb_pct") >= 0.8, "NEAR_UPPER").when(F.col("bb_pct") <= 0.2, "NEAR_LOWER").otherwise("MIDDLE")
    return made.withColumn("bb_position", label).drop("_dev")


def true_range() -> Column:
    """greatest() skips the missing previous close of the first row."""
    before = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range, as a share of the close, and its level."""
    made = df.withColumn("tr", true_range()).withColumn("atr", mean(F.col("tr"), n))
    made = made.withColumn("atr_pct", ratio(F.col("atr"), F.col("close")) * 100)
    p = F.col("atr_pct")
    return made.withColumn("volatility", F.when(p.isNull(), None).when(p < 1, "LOW").when(p < 2, "NORMAL").when(p < 4, "HIGH").otherwise("VERY_HIGH"))


def adx(df: DataFrame, n: int = 14) -> DataFrame:
    """+DI, -DI and ADX by simple means: DI needs n rows, ADX 2n - 1."""
    up, down = F.col("high") - F.lag("high").over(series()), F.lag("low").over(series()) - F.col("low")
    made = df.withColumns({"_up": F.coalesce(up, F.lit(0.0)), "_down": F.coalesce(down, F.lit(0.0)), "_tr": true_range()})
    made = made.withColumns({
        "_plus": F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(F.lit(0.0)),
        "_minus": F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(F.lit(0.0))})
    made = made.withColumns({"_range": mean(F.col("_tr"), n), "_p": mean(F.col("_plus"), n), "_m": mean(F.col("_minus"), n)})
    made = made.withColumns({"plus_di": 100 * ratio(F.col("_p"), F.col("_range")), "minus_di": 100 * ratio(F.col("_m"), F.col("_range"))})
    made = made.withColumn("_dx", 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return made.withColumn("adx", mean(F.col("_dx"), n)).drop("_up", "_down", "_tr", "_plus", "_minus", "_range", "_p", "_m", "_dx")


def _typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def session_vwap(df: DataFrame) -> DataFrame:
    """Volume-weighted typical price since the start of the New York day; null while volume is zero."""
    made = df.withColumn("ny_date", F.to_date(new_york(F.col("ts"))))
    day = running(*SERIES, "ny_date")
    return made.withColumn("vwap", ratio(F.sum(_typical() * F.col("volume")).over(day), F.sum("volume").over(day)))


def cumulative_vwap(df: DataFrame) -> DataFrame:
    """The same since the series began, the close's deviation in %, and a label."""
    every = running(*SERIES)
    made = df.withColumn("cum_vwap", ratio(F.sum(_typical() * F.col("volume")).over(every), F.sum("volume").over(every)))
    made = made.withColumn("vwap_dev", ratio(F.col("close") - F.col("cum_vwap"), F.col("cum_vwap")) * 100)
    d = F.col("vwap_dev")
    return made.withColumn("vwap_label", F.when(d.isNull(), None).when(d > 0.5, "ABOVE").when(d < -0.5, "BELOW").otherwise("NEAR"))


def streak(df: DataFrame, name: str = "streak") -> DataFrame:
    """Signed length of the run of rising or falling closes; a flat close is 0 and ends the run."""
    sign = F.coalesce(F.signum(F.col("close") - F.lag("close").over(series())), F.lit(0.0))
    made = df.withColumn("_sign", sign)
    starts = F.when(F.col("_sign") != F.coalesce(F.lag("_sign").over(series()), F.lit(9.0)), 1).otherwise(0)
    made = made.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(running(*SERIES)))
    run = F.row_number().over(Window.partitionBy(*SERIES, "_run").orderBy("ts"))
    return made.withColumn(name, F.col("_sign") * run).drop("_sign", "_start", "_run")


def percent_rank(df: DataFrame, n: int = 100, name: str = "pct_rank") -> DataFrame:
    """Share (0 to 100) of the last n one-bar returns that are strictly less than this one."""
    before = F.lag("close").over(series())
    made = df.withColumn("_ret", ratio(F.col("close") - before, before))
    less = F.size(F.filter(F.collect_list("_ret").over(series(n)), lambda x: x < F.col("_ret")))
    return made.withColumn(name, full(less / F.lit(float(n)) * 100, F.col("_ret"), n)).drop("_ret")


def connors_rsi(df: DataFrame, price: int = 3, run: int = 2, rank: int = 100) -> DataFrame:
    """Mean of RSI of closes, RSI of streaks and percent rank."""
    made = percent_rank(streak(df, "_streak"), rank, "_rank")
    made = rsi(rsi(made, price, name="_a"), run, col="_streak", name="_b")
    return made.withColumn("crsi", (F.col("_a") + F.col("_b") + F.col("_rank")) / 3).withColumnRenamed("_streak", "streak").drop("_a", "_b", "_rank")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD line, signal line, histogram, crosses and label."""
    made = ema(df, {"_fast": ("close", fast), "_slow": ("close", slow)}).withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    made = ema(made, {"macd_signal": ("macd", signal)}).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    before = F.lag("macd_hist").over(series())
    return made.withColumns({
        "macd_cross": F.when((before <= 0) & (F.col("macd_hist") > 0), "BULLISH").when((before >= 0) & (F.col("macd_hist") < 0), "BEARISH").otherwise("NONE"),
        "macd_label": F.when(F.col("macd_hist") > 0, "BULLISH").when(F.col("macd_hist") < 0, "BEARISH").otherwise("NEUTRAL")})


def stochastic(df: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    """%K, %D and Williams %R."""
    low, high = full(F.min("low").over(series(n)), F.col("low"), n), full(F.max("high").over(series(n)), F.col("high"), n)
    made = df.withColumns({"_low": low, "_high": high})
    made = made.withColumns({"stoch_k": 100 * ratio(F.col("close") - F.col("_low"), F.col("_high") - F.col("_low")), "williams_r": -100 * ratio(F.col("_high") - F.col("close"), F.col("_high") - F.col("_low"))})
    return made.withColumn("stoch_d", mean(F.col("stoch_k"), d)).drop("_low", "_high")


def roc(df: DataFrame, n: int = 10) -> DataFrame:
    """Change over n bars in %, with a momentum label."""
    before = F.lag("close", n).over(series())
    made = df.withColumn("roc", 100 * ratio(F.col("close") - before, before))
    r = F.col("roc")
    return made.withColumn("momentum", F.when(r.isNull(), None).when(r > 2, "STRONG_UP").when(r > 0, "UP").when(r >= -2, "DOWN").otherwise("STRONG_DOWN"))


def obv(df: DataFrame, span: int = 20) -> DataFrame:
    """On-balance volume and its exponential mean."""
    signed = F.coalesce(F.signum(F.col("close") - F.lag("close").over(series())), F.lit(0.0)) * F.col("volume")
    made = df.withColumn("_signed", signed).withColumn("obv", F.sum("_signed").over(running(*SERIES))).drop("_signed")
    return ema(made, {"obv_ema": ("obv", span)})


def volume_oscillator(df: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """Volume over its mean; difference of two exponential means of volume in %, with a label."""
    made = ema(df.withColumn("vol_ratio", ratio(F.col("volume"), mean(F.col("volume"), slow))), {"_f": ("volume", fast), "_s": ("volume", slow)})
    made = made.withColumn("vol_osc", 100 * ratio(F.col("_f") - F.col("_s"), F.col("_s"))).drop("_f", "_s")
    v = F.col("vol_osc")
    return made.withColumn("vol_label", F.when(v.isNull(), None).when(v > 20, "HIGH").when(v < -20, "LOW").otherwise("NORMAL"))


def distances(df: DataFrame, spans=(20, 50, 100, 200)) -> DataFrame:
    """Distance of the close to exponential means and to the session VWAP (column vwap), in %."""
    made = ema(df, {f"ema_{n}": ("close", n) for n in spans})
    made = made.withColumns({f"dist_ema_{n}": 100 * ratio(F.col("close") - F.col(f"ema_{n}"), F.col(f"ema_{n}")) for n in spans})
    return made.withColumn("dist_vwap", 100 * ratio(F.col("close") - F.col("vwap"), F.col("vwap")))


def time_features(df: DataFrame) -> DataFrame:
    """Hour of day and day of week (Monday 0)."""
    return df.withColumns({"hour_of_day": F.hour("ts"), "day_of_week": F.weekday("ts")})


def market_regime(df: DataFrame) -> DataFrame:
    """Regime and level from the absolute ROC."""
    r = F.abs(F.col("roc"))
    return df.withColumns({
        "regime": F.when(r.isNull(), None).when(r > 3, "TRENDING").when(r < 1, "RANGING").otherwise("TRANSITIONING"),
        "regime_level": F.when(r.isNull(), None).when(r > 5, "HIGH").when(r > 2, "NORMAL").otherwise("LOW")})


def all_indicators(bars: DataFrame) -> DataFrame:
    """The standard set: every windowed indicator in one exchange, then the exponential means in one pass."""
    made = sma(sma(sma(bars, 20), 50), 20, "volume", "volume_sma_20")
    made = session_vwap(roc(connors_rsi(adx(atr(bollinger(rsi(made)))))))
    return distances(made, (20, 50, 200))


# Hand-made SQL of the same, on a relation ``b``; ``w`` windows are per series.

def _full_sql(value: str, x: str, n: int) -> str:
    frame = f"partition by symbol, timeframe order by ts rows between {n - 1} preceding and current row"
    return f"case when count({x}) over ({frame}) = {n} then {value} over ({frame}) end"


P_SQL = "partition by symbol, timeframe order by ts"
TR_SQL = f"greatest(high - low, abs(high - lag(close) over ({P_SQL})), abs(low - lag(close) over ({P_SQL})))"


def ema_sql(source: str, out: str, columns: dict[str, tuple[str, int]], keep: str) -> str:
    """Recursive expressions: ``out`` has the columns of ``source`` and the exponential means."""
    first = ", ".join(f"{c}::double as {n}" for n, (c, _) in columns.items())
    step = ", ".join(f"e.{n} + {2 / (s + 1)!r} * (o.{c} - e.{n})" for n, (c, s) in columns.items())
    names = ", ".join(columns)
    return f"""{out}_o as (select *, row_number() over ({P_SQL}) as rn from {source}),
{out}_e as (
  select symbol, timeframe, rn, {first} from {out}_o where rn = 1
  union all
  select o.symbol, o.timeframe, o.rn, {step} from {out}_e e join {out}_o o on o.symbol = e.symbol and o.timeframe = e.timeframe and o.rn = e.rn + 1),
{out} as (select o.* exclude rn, {names} from {out}_o o join {out}_e e using (symbol, timeframe, rn))"""
