"""Data quality: completeness, anomalies, checks with score and status, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SERIES, hours_between, new_york, ratio, series
from .clean import classify_gaps, detect_gaps, session_of

#: Least or most allowed values of the checks, in %.
THRESHOLDS = {"ohlc": 95.0, "price": 5.0, "volume": 10.0, "overall": 75.0, "extended": 80.0}
#: Weights of the checks in the overall score, by level; their sum counts as 1 at least.
WEIGHTS = {"completeness": 0.25, "gaps": 0.20, "ohlc": 0.20, "price": 0.15, "volume": 0.10, "continuity": 0.10, "sessions": 0.05, "weekdays": 0.05}
LEVELS = {"BASIC": ["completeness", "ohlc"], "STANDARD": ["completeness", "gaps", "ohlc", "price", "volume", "continuity"], "EXTENDED": list(WEIGHTS)}


def _before(c: str) -> Column:
    return F.lag(c).over(series())


def completeness(bars: DataFrame, hours: float = 1.0) -> DataFrame:
    """Rows over the steps of the span in %, at most 100."""
    g = bars.groupBy(*SERIES).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    steps = F.greatest(F.floor(hours_between(F.col("first_ts"), F.col("last_ts")) / hours), F.lit(1))
    return g.withColumn("completeness_pct", F.least(F.lit(100.0), 100 * F.col("n") / steps))


def calendar_completeness(bars: DataFrame, minutes: int = 60) -> DataFrame:
    """Against whole days x 5/7 x 6.5 hours of trading; 100 if none are expected."""
    g = bars.groupBy(*SERIES).agg(F.count("*").alias("n"), F.floor(hours_between(F.min("ts"), F.max("ts")) / 24).alias("days"))
    expected = F.floor(F.floor(F.col("days") * F.lit(5.0) / 7) * 6.5 * (60.0 / minutes))
    return g.withColumn("expected", expected).withColumn("completeness_pct", F.when(F.col("expected") == 0, 100.0).otherwise(F.least(F.lit(100.0), 100 * F.col("n") / F.col("expected"))))


def quality_report(bars: DataFrame, minutes: float = 60.0) -> DataFrame:
    """Gap counts, longest and mean gap, maps by type and severity, score and suitability of each series."""
    gaps = classify_gaps(detect_gaps(bars, 1.5 * minutes), minutes)
    total = gaps.groupBy(*SERIES).agg(F.count("*").alias("gaps"), (F.max("minutes") / 60).alias("max_gap_hours"), F.avg("minutes").alias("avg_gap_minutes"))
    by = lambda c, name: gaps.groupBy(*SERIES, c).agg(F.count("*").alias("n")).groupBy(*SERIES).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(name))
    made = bars.groupBy(*SERIES).agg(F.count("*").alias("bars")).join(total, SERIES, "left").join(by("gap_type", "by_type"), SERIES, "left").join(by("severity", "by_severity"), SERIES, "left")
    made = made.fillna({"gaps": 0, "max_gap_hours": 0.0, "avg_gap_minutes": 0.0})
    score = F.greatest(F.lit(0.0), 100 - 2 * F.col("gaps") - 5 * F.col("max_gap_hours") / 24)
    return made.withColumn("score", score).withColumn("suitable", F.col("score") > 85)


def recommended_actions(report: DataFrame) -> DataFrame:
    """Up to five rule texts for each series."""
    rules = F.array(
        F.when(F.col("gaps") > 0, "FILL_GAPS"), F.when(F.col("max_gap_hours") > 24, "CHECK_LONG_GAPS"), F.when(F.col("avg_gap_minutes") > 240, "CHECK_SOURCE"),
        F.when(F.col("score") < 50, "EXCLUDE"), F.when(F.col("score").between(50, 85), "REVIEW"), F.when(F.col("bars") < 100, "COLLECT_MORE"))
    return report.withColumn("actions", F.slice(F.array_compact(rules), 1, 5))


def price_anomalies(bars: DataFrame, jump: float = 0.20) -> DataFrame:
    """Order violations of OHLC and moves beyond ``jump``."""
    bad = (F.col("high") < F.col("low")) | (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    made = bars.withColumn("_j", F.abs(ratio(F.col("close") - _before("close"), _before("close"))) > jump)
    return made.groupBy(*SERIES).agg(F.count_if(bad).alias("order_violations"), F.count_if("_j").alias("jumps"))


def _with_median(bars: DataFrame) -> DataFrame:
    return bars.join(bars.groupBy(*SERIES).agg(F.median("volume").alias("volume_median")), SERIES)


def volume_anomalies(bars: DataFrame, factor: float = 10.0) -> DataFrame:
    """Negative volumes and those beyond ``factor`` medians; zeros too if the median is zero."""
    m = F.col("volume_median")
    return _with_median(bars).groupBy(*SERIES).agg(F.count_if(F.col("volume") < 0).alias("negative"), F.count_if((m > 0) & (F.col("volume") > factor * m)).alias("spikes"), F.count_if((m == 0) & (F.col("volume") == 0)).alias("zeros"))


def _checked(df: DataFrame, check: str, score: Column, status: Column) -> DataFrame:
    return df.select("symbol", F.lit(check).alias("check"), score.alias("score"), status.alias("status"))


def check_completeness(bars: DataFrame) -> DataFrame:
    p = F.col("completeness_pct")
    return _checked(completeness(bars), "completeness", p, F.when(p >= 95, "PASSED").when(p >= 80, "WARNING").otherwise("FAILED"))


def check_ohlc(bars: DataFrame, least: float = THRESHOLDS["ohlc"]) -> DataFrame:
    """Share of bars whose prices are in order and positive."""
    bad = (F.col("high") < F.col("low")) | (F.col("high") < F.col("open")) | (F.col("high") < F.col("close")) | (F.col("low") > F.col("open")) | (F.col("low") > F.col("close")) | (F.least("open", "high", "low", "close") <= 0)
    p = F.col("p")
    g = bars.groupBy("symbol").agg((100 * (1 - F.count_if(bad) / F.count("*"))).alias("p"))
    return _checked(g, "ohlc", F.when(p >= least, p).when(p >= least * 0.95, p * 0.9).otherwise(p * 0.5), F.when(p >= least, "PASSED").when(p >= least * 0.95, "WARNING").otherwise("FAILED"))


def check_prices(bars: DataFrame, most: float = THRESHOLDS["price"]) -> DataFrame:
    """Jumps beyond 20 % and bars with a range beyond 15 %."""
    made = bars.withColumn("_j", F.abs(ratio(F.col("close") - _before("close"), _before("close"))) > 0.20)
    g = made.groupBy("symbol").agg((100 * (F.count_if("_j") + F.count_if(ratio(F.col("high"), F.col("low")) - 1 > 0.15)) / F.count("*")).alias("p"))
    p = F.col("p")
    score = F.when(p <= most, F.greatest(F.lit(80.0), 100 - 5 * p)).when(p <= 2 * most, F.greatest(F.lit(60.0), 80 - 3 * p)).otherwise(F.greatest(F.lit(0.0), 40 - 2 * p))
    return _checked(g, "price", score, F.when(p <= most, "PASSED").when(p <= 2 * most, "WARNING").otherwise("FAILED"))


def check_volume(bars: DataFrame, most: float = THRESHOLDS["volume"]) -> DataFrame:
    """Zero, negative and extreme volumes (beyond 20 medians)."""
    m = F.col("volume_median")
    g = _with_median(bars).groupBy("symbol").agg((100 * F.count_if((F.col("volume") <= 0) | ((m > 0) & (F.col("volume") > 20 * m))) / F.count("*")).alias("p"))
    p = F.col("p")
    score = F.when(p <= most, F.greatest(F.lit(80.0), 100 - 2 * p)).when(p <= 2 * most, F.greatest(F.lit(60.0), 80 - p)).otherwise(F.greatest(F.lit(0.0), 50 - p))
    return _checked(g, "volume", score, F.when(p <= most, "PASSED").when(p <= 2 * most, "WARNING").otherwise("FAILED"))


def check_continuity(bars: DataFrame, hours: float = 1.0) -> DataFrame:
    """Share of distances within 20 % of the step, and repeated times."""
    d = bars.withColumn("_d", hours_between(_before("ts"), F.col("ts")))
    g = d.groupBy("symbol").agg((100 * ratio(F.count_if(F.col("_d").between(0.8 * hours, 1.2 * hours)), F.count("_d"))).alias("p"), F.count_if(F.col("_d") == 0).alias("twice"))
    p, ok = F.coalesce(F.col("p"), F.lit(0.0)), F.col("twice") == 0
    return _checked(g, "continuity", F.when((p >= 90) & ok, F.least(F.lit(100.0), p + 5)).when(p >= 80, p).otherwise(F.greatest(F.lit(0.0), p - 20)), F.when((p >= 90) & ok, "PASSED").when(p >= 80, "WARNING").otherwise("FAILED"))


def session_coverage(bars: DataFrame) -> DataFrame:
    """Bars of each session in % of all."""
    s = bars.withColumn("session", session_of(F.hour(new_york(F.col("ts")))))
    return s.groupBy("symbol").agg(*[(100 * F.count_if(F.col("session") == x) / F.count("*")).alias(x.lower() + "_pct") for x in ("REGULAR", "PRE_MARKET", "POST_MARKET", "OVERNIGHT")])


def _listed(*parts: Column) -> Column:
    """The parts that hold, joined by commas."""
    return F.array_join(F.array_compact(F.array(*parts)), ",")


def extended_hours(bars: DataFrame) -> DataFrame:
    """Session shares with that of all extended hours, its score and status against THRESHOLDS, and what is too thin."""
    g = session_coverage(bars)
    p, least = F.col("extended_pct"), THRESHOLDS["extended"]
    ok, near = p >= least, p >= 0.8 * least
    return g.withColumn("extended_pct", F.col("pre_market_pct") + F.col("post_market_pct") + F.col("overnight_pct")).withColumns({
        "score": F.when(ok, F.least(F.lit(100.0), p)).when(near, p * 0.9).otherwise(p * 0.5), "status": F.when(ok, "PASSED").when(near, "WARNING").otherwise("FAILED"),
        "issues": _listed(F.when(~ok & near, "EXTENDED_LIMITED"), F.when(~near, "EXTENDED_INSUFFICIENT"), F.when(F.col("pre_market_pct") < 5, "PRE_MARKET_THIN"), F.when(F.col("post_market_pct") < 5, "POST_MARKET_THIN"), F.when(F.col("overnight_pct") < 2, "OVERNIGHT_THIN")),
        "advice": _listed(F.when(p < 70, "COLLECT_EXTENDED_HOURS"), F.when(F.col("overnight_pct") == 0, "COLLECT_OVERNIGHT"))})


def check_session_coverage(bars: DataFrame) -> DataFrame:
    return _checked(extended_hours(bars), "sessions", F.col("score"), F.col("status"))


def weekday_coverage(bars: DataFrame) -> DataFrame:
    """Counts by New York weekday (Monday 0), weekend share, and weekdays without bars."""
    names = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    day = F.weekday(new_york(F.col("ts")))
    g = bars.groupBy("symbol").agg(*[F.count_if(day == i).alias(n) for i, n in enumerate(names)], F.count("*").alias("n"))
    missing = F.array_compact(F.array(*[F.when(F.col(n) == 0, n) for n in names[:5]]))
    return g.withColumn("weekend_pct", 100 * (F.col("sat") + F.col("sun")) / F.col("n")).withColumn("missing_days", F.array_join(missing, ","))


def weekday_balance(bars: DataFrame) -> DataFrame:
    """Weekday counts with score, status and issues: by the share of weekend bars, less where weekdays miss, 0 without any weekday."""
    g = weekday_coverage(bars).withColumn("weekdays", F.col("mon") + F.col("tue") + F.col("wed") + F.col("thu") + F.col("fri"))
    p, none, missing = F.col("weekend_pct"), F.col("weekdays") == 0, F.col("missing_days") != ""
    base = F.when(p < 10, 90.0).when(p < 30, 75.0).otherwise(60.0)
    return g.withColumns({
        "score": F.when(none, 0.0).when(missing, F.greatest(base * 0.8, F.lit(40.0))).otherwise(base), "status": F.when(none, "FAILED").when(p < 10, "PASSED").otherwise("WARNING"),
        "issues": _listed(F.when(none, "NO_WEEKDAYS"), F.when(~none & (p >= 10) & (p < 30), "WEEKEND_HIGH"), F.when(~none & (p >= 30), "WEEKEND_VERY_HIGH"), F.when(missing, "WEEKDAYS_MISSING")),
        "advice": _listed(F.when(missing, "COVER_ALL_WEEKDAYS"), F.when(p > 20, "CHECK_DAY_FILTERS"))})


def check_weekdays(bars: DataFrame) -> DataFrame:
    return _checked(weekday_balance(bars), "weekdays", F.col("score"), F.col("status"))


def check_gaps(bars: DataFrame, minutes: float = 60.0) -> DataFrame:
    """Gaps of high severity."""
    high = classify_gaps(detect_gaps(bars, 1.5 * minutes), minutes).groupBy("symbol").agg(F.count_if(F.col("severity") == "HIGH").alias("n"))
    g = bars.select("symbol").distinct().join(high, "symbol", "left").fillna({"n": 0})
    n = F.col("n")
    return _checked(g, "gaps", F.greatest(F.lit(0.0), 100.0 - 20 * n), F.when(n == 0, "PASSED").when(n <= 2, "WARNING").otherwise("FAILED"))


CHECKS = {"completeness": check_completeness, "gaps": check_gaps, "ohlc": check_ohlc, "price": check_prices, "volume": check_volume, "continuity": check_continuity, "sessions": check_session_coverage, "weekdays": check_weekdays}


def all_checks(bars: DataFrame, level: str = "STANDARD") -> DataFrame:
    return reduce(DataFrame.unionByName, [CHECKS[c](bars) for c in LEVELS[level]])


def validate(bars: DataFrame, level: str = "STANDARD") -> DataFrame:
    """Weighted score, status, readiness and failed checks of each symbol."""
    weight = F.element_at(F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("check"))
    g = all_checks(bars, level).withColumn("w", weight).groupBy("symbol").agg(
        (F.sum(F.col("score") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1.0))).alias("overall"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "FAILED", F.col("check")))), ",").alias("failed_checks"))
    status = F.when(F.col("failed") > 0, "FAILED").when(F.col("overall") >= THRESHOLDS["overall"], "PASSED").otherwise("WARNING")
    return g.withColumn("status", status).withColumn("backtest_ready", (F.col("status") == "PASSED") | ((F.col("status") == "WARNING") & (F.col("overall") >= 60)))


def universe_summary(validation: DataFrame) -> DataFrame:
    pick = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("symbol")))), ",")
    return validation.agg(F.count("*").alias("symbols"), pick("PASSED").alias("ready"), pick("WARNING").alias("warning"), pick("FAILED").alias("failed_symbols"), (100 * ratio(F.count_if("backtest_ready"), F.count("*"))).alias("success_rate"))


def universe_members(validation: DataFrame) -> DataFrame:
    """A row a symbol with the group it counts to in ``universe_summary``: for universes too large for one row of names."""
    group = F.when(F.col("status") == "PASSED", "ready").when(F.col("status") == "WARNING", "warning").otherwise("failed")
    return validation.select("symbol", group.alias("universe_group"), "backtest_ready", "overall")


def indicator_null_rate(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(F.array(*[F.struct(F.lit(c).alias("indicator"), (100 * F.count_if(F.col(c).isNull()) / F.count("*")).alias("null_pct")) for c in cols]).alias("a"))
    return one.select(F.explode("a").alias("a")).select("a.*").withColumn("missing", F.col("null_pct") > 10)


def volume_outliers(bars: DataFrame, sigmas: float = 10.0) -> DataFrame:
    """Volumes beyond mean + ``sigmas`` deviations; zero volumes only if above 5 % of the bars."""
    stats = bars.groupBy(*SERIES).agg(F.avg("volume").alias("m"), F.stddev_samp("volume").alias("s"))
    g = bars.join(stats, SERIES).groupBy(*SERIES).agg(F.count_if(F.col("volume") > F.col("m") + sigmas * F.col("s")).alias("outliers"), F.count_if(F.col("volume") == 0).alias("z"), F.count("*").alias("n"))
    return g.select(*SERIES, "outliers", F.when(F.col("z") > 0.05 * F.col("n"), F.col("z")).otherwise(0).alias("zero_volume"))


def integrity_report(bars: DataFrame, hours: float = 1.0) -> DataFrame:
    """Rows, span, real and filled share, gaps beyond two steps, and a warning above 5 % filled."""
    d = bars.withColumn("_d", hours_between(_before("ts"), F.col("ts")))
    g = d.groupBy(*SERIES).agg(F.count("*").alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (100 * F.count_if("is_filled") / F.count("*")).alias("filled_pct"), F.count_if(F.col("_d") > 2 * hours).alias("gaps"))
    return g.withColumns({"real_pct": 100 - F.col("filled_pct"), "warning": F.col("filled_pct") > 5})


def table_audit(bars: DataFrame, indicators: DataFrame) -> DataFrame:
    i = indicators.groupBy(*SERIES).agg(F.count("*").alias("indicator_rows"))
    g = bars.groupBy(*SERIES).agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).join(i, SERIES, "left").fillna({"indicator_rows": 0})
    return g.withColumn("status", F.when(F.col("indicator_rows") == 0, "EMPTY").otherwise("OK"))


def quality_tier(bars: DataFrame, minutes: float = 60.0) -> DataFrame:
    """Tier from completeness, gaps above four hours and price order."""
    c = completeness(bars, minutes / 60).select(*SERIES, "completeness_pct")
    gaps = detect_gaps(bars, 240.0).groupBy(*SERIES).agg(F.count("*").alias("long_gaps"))
    made = c.join(gaps, SERIES, "left").join(price_anomalies(bars), SERIES).fillna({"long_gaps": 0})
    p, g, v = F.col("completeness_pct"), F.col("long_gaps"), F.col("order_violations")
    tier = F.when((p >= 95) & (g <= 5) & (v == 0), "EXCELLENT").when((p >= 85) & (g <= 20) & (v <= 5), "GOOD").when(p >= 60, "FAIR").when(p >= 30, "POOR").otherwise("UNUSABLE")
    return made.select(*SERIES, "completeness_pct", "long_gaps", "order_violations", tier.alias("tier"))


def indicator_drift(left: DataFrame, right: DataFrame, keys: list[str], metrics: list[str], tol: float) -> DataFrame:
    """Rows, matches, null mismatches and largest difference of each metric on common keys."""
    r = right.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    row = lambda m: F.struct(F.lit(m).alias("metric"), F.col(m).alias("a"), F.col(f"_{m}").alias("b"))
    long = left.select(*keys, *metrics).join(r, keys).select(F.explode(F.array(*map(row, metrics))).alias("x")).select("x.*")
    diff = F.abs(F.col("a") - F.col("b"))
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.count_if((diff <= tol) | (F.col("a").isNull() & F.col("b").isNull())).alias("matches"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("null_mismatches"), F.max(diff).alias("max_diff"))


def source_overview(bars: DataFrame, source: str = "source") -> DataFrame:
    return bars.groupBy("symbol", source).agg(F.count("*").alias("n"), F.count_if(F.col("volume") == 0).alias("zero_volume"), F.avg("volume").alias("avg_volume"))




def quality_score(bars: DataFrame, minutes: float = 60.0) -> DataFrame:
    """0.4 of completeness, and ladders of gaps (less for long ones), price and volume anomalies; and whether it suits backtests."""
    gaps = detect_gaps(bars, 1.5 * minutes).groupBy(*SERIES).agg(F.count("*").alias("gaps"), (F.max("minutes") / 60).alias("longest"))
    made = completeness(bars, minutes / 60).join(gaps, SERIES, "left").join(price_anomalies(bars), SERIES).join(volume_anomalies(bars), SERIES).fillna({"gaps": 0, "longest": 0.0})
    g, n = F.col("gaps"), F.col("n")
    price, volume = F.col("order_violations") + F.col("jumps"), F.col("negative") + F.col("spikes") + F.col("zeros")
    ladder = F.when(g == 0, 25.0).when(g <= 5, 20.0).when(g <= 15, 15.0).when(g <= 30, 10.0).otherwise(5.0) * F.when(F.col("longest") > 72, 0.5).when(F.col("longest") > 24, 0.8).otherwise(1.0)
    part = lambda x, top: F.when(x == 0, top).when(x < 0.01 * n, top * 0.8).when(x < 0.05 * n, top * 0.5).otherwise(0.0)
    made = made.withColumn("score", 0.4 * F.col("completeness_pct") + ladder + part(price, 20.0) + part(volume, 15.0))
    return made.select(*SERIES, "score", ((F.col("completeness_pct") >= 90) & (F.col("longest") <= 72) & (price < 0.05 * n)).alias("suitable"))


#: Weights of the parts of readiness.
READINESS = {"gaps_score": 0.25, "ohlc_score": 0.30, "indicators_score": 0.25, "volume_score": 0.10, "consistency_score": 0.10}


def backtest_readiness(bars: DataFrame, indicators: DataFrame, cols: list[str], minutes: float = 60.0) -> DataFrame:
    """Five scores of each series, their weighted sum, whether it is ready for backtests, and why not.

    Columns of ``cols`` that ``indicators`` lacks count as missing, and no series is ready then.
    """
    n, prices = F.col("n"), ["open", "high", "low", "close"]
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    wrong = [F.col("high") < F.col("low"), F.col("high") < F.col("open"), F.col("high") < F.col("close"), F.col("low") > F.col("open"), F.col("low") > F.col("close")]
    below = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) <= 0, F.lit(False)) for c in prices])
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in prices])
    g = bars.withColumn("_gap", hours_between(_before("ts"), F.col("ts"))).groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.min("ts").alias("_a"), F.max("ts").alias("_z"), F.count_if(F.col("_gap") * 60 > 1.5 * minutes).alias("gaps"), F.max(F.when(F.col("_gap") * 60 > 1.5 * minutes, F.col("_gap"))).alias("longest"),
        sum((count(w) for w in wrong), F.lit(0)).alias("_order"), count(below).alias("not_positive"), count(absent).alias("_absent"),
        count(F.col("volume") == 0).alias("_zero"), count(F.col("volume") < 0).alias("_negative"), count(F.col("_gap") == 0).alias("_twice"))
    held = [c for c in cols if c in indicators.columns]
    nulls = indicators.groupBy(*SERIES).agg(sum(((F.count_if(F.col(c).isNull() | F.isnan(c)) > 0.1 * F.count("*")).cast("int") for c in held), F.lit(len(cols) - len(held))).alias("missing"))
    made = g.join(nulls, SERIES, "left").fillna({"missing": len(cols), "longest": 0.0})
    gaps, rate = F.col("gaps"), (F.col("_order") + F.col("not_positive") + F.col("_absent")) / n
    gap_score = F.when(gaps == 0, 100.0).when(gaps <= 0.05 * n, 100 - gaps / (0.05 * n) * 20).otherwise(F.greatest(F.lit(0.0), 80 - 100 * gaps / n))
    odd = F.when(F.col("_zero") > 0.05 * n, F.col("_zero")).otherwise(0) + F.col("_negative")
    days = F.floor(hours_between(F.col("_a"), F.col("_z")) / 24)
    made = made.withColumns({
        "gaps_score": gap_score * F.when(F.col("longest") > 24, 0.7).when(F.col("longest") > 8, 0.9).otherwise(1.0),
        "ohlc_score": F.when(rate > 0.1, 0.0).when(rate > 0.05, 50.0).otherwise(F.greatest(F.lit(0.0), 100 - 1000 * rate)),
        "indicators_score": F.greatest(F.lit(0.0), 100 - 100 * F.col("missing") / max(len(cols), 1)), "volume_score": F.greatest(F.lit(0.0), 100 - 200 * odd / n),
        "consistency_score": F.when(F.col("_twice") > 0, 70.0).otherwise(100.0),
        "completeness_pct": 100 * n / F.greatest(F.lit(1.0), F.floor(days * (5 / 7) * (5.5 * 60 / minutes)))})
    made = made.withColumn("score", F.round(sum((F.col(c) * w for c, w in READINESS.items()), F.lit(0.0)), 2))
    critical = (F.col("longest") > 72) | (F.col("not_positive") > 0) | F.lit(len(held) < len(cols))
    reasons = _listed(
        F.when(F.col("score") < 70, "SCORE"), F.when(critical, "CRITICAL"), F.when(F.col("completeness_pct") < 85, "COMPLETENESS"), F.when(F.col("longest") > 72, "LONG_GAP"),
        F.when(F.col("missing") > 2, "INDICATORS"), F.when(F.col("ohlc_score") < 90, "OHLC"), F.when(n < 100, "FEW_ROWS"))
    return made.withColumn("reasons", reasons).select(*SERIES, *READINESS, "completeness_pct", "score", (F.col("reasons") == "").alias("ready"), "reasons")
