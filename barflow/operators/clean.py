"""Cleaning and merging bars: filters, repair, duplicates, sessions, ranked sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY, SERIES, hours_between, new_york, ratio, series


def market_hours(bars: DataFrame, open: str = "09:30", close: str = "16:00") -> DataFrame:
    """Bars of New York weekdays from ``open`` to before ``close``."""
    ny = new_york(F.col("ts"))
    minute = F.hour(ny) * 60 + F.minute(ny)
    at = lambda s: int(s[:2]) * 60 + int(s[3:])
    return bars.filter((F.weekday(ny) < 5) & (minute >= at(open)) & (minute < at(close)))


def date_range(df: DataFrame, start, end, col: str = "ts") -> DataFrame:
    """Both ends included."""
    return df.filter(F.col(col).between(F.lit(start), F.lit(end)))


def closed_bars(bars: DataFrame, now, hours: int) -> DataFrame:
    return bars.filter(F.col("ts") + F.make_dt_interval(hours=F.lit(hours)) <= F.lit(now))


def repair_ohlc(bars: DataFrame, max_jump: float = 0.5) -> DataFrame:
    """High and low in order, rows with a price that is not positive dropped, big moves flagged."""
    swapped = bars.withColumns({"high": F.greatest("high", "low"), "low": F.least("high", "low")})
    good = swapped.filter((F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0))
    before = F.lag("close").over(series())
    return good.withColumn("big_move", F.coalesce(F.abs(ratio(F.col("close") - before, before)) > max_jump, F.lit(False)))


def dedupe(df: DataFrame, keys: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """One row for each key: the last (or first) by ``order``."""
    by = [F.col(c).desc() if keep == "last" else F.col(c).asc() for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_n = 1").drop("_n")


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n > 1").drop("_n")


def session_of(hour: Column) -> Column:
    return F.when((hour >= 4) & (hour < 9), "PRE_MARKET").when((hour >= 9) & (hour < 16), "REGULAR").when((hour >= 16) & (hour < 20), "POST_MARKET").otherwise("OVERNIGHT")


def session_label(bars: DataFrame) -> DataFrame:
    return bars.withColumn("session", session_of(F.hour(new_york(F.col("ts")))))


def named_session(df: DataFrame, sessions: list[tuple[str, str, str]]) -> DataFrame:
    """First session (name, HH:MM, HH:MM; both ends included) that holds the New York time; ranges may pass midnight."""
    clock = F.date_format(new_york(F.col("ts")), "HH:mm")
    label = F.lit(None).cast("string")
    for name, a, b in reversed(sessions):
        label = F.when((clock >= a) & (clock <= b) if a <= b else (clock >= a) | (clock <= b), name).otherwise(label)
    return df.withColumn("session_name", label)


def patch_merge(sources: list[DataFrame]) -> DataFrame:
    """Ranked sources, best first: a row gives way only if its volume is missing or not positive and a later one's is positive."""
    ranked = reduce(DataFrame.unionByName, [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)])
    order = Window.partitionBy(*KEY).orderBy((F.coalesce(F.col("volume"), F.lit(0.0)) > 0).desc(), "_rank")
    return ranked.withColumn("_n", F.row_number().over(order)).filter("_n = 1").withColumnRenamed("_rank", "source_rank").drop("_n")


def append_missing(primary: DataFrame, secondary: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``primary`` and the rows of ``secondary`` with other keys: for each of them the first by ``order``, ties by a hash of the row."""
    once = dedupe(secondary.withColumn("_tie", F.xxhash64(*secondary.columns)), keys, [*(order or []), "_tie"], keep="first").drop("_tie")
    return primary.unionByName(once.join(primary.select(*keys).distinct(), keys, "left_anti"))


def first_available(sources: list[DataFrame]) -> DataFrame:
    """For each symbol, all rows of the first source that has any."""
    ranked = reduce(DataFrame.unionByName, [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)])
    best = ranked.groupBy("symbol").agg(F.min("source_rank").alias("source_rank"))
    return ranked.join(best, ["symbol", "source_rank"], "left_semi")


def latest(df: DataFrame, keys: list[str], order: str = "ts") -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def last_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).filter(F.col("_n") <= n).drop("_n")


# Gaps.

def detect_gaps(bars: DataFrame, min_minutes: float) -> DataFrame:
    """Distances between consecutive bars above ``min_minutes``, with the prices on both sides."""
    w = series()
    made = bars.select(*SERIES, F.lag("ts").over(w).alias("gap_start"), F.col("ts").alias("gap_end"), F.lag("close").over(w).alias("before_price"), F.col("open").alias("after_price"))
    made = made.withColumn("minutes", hours_between(F.col("gap_start"), F.col("gap_end")) * 60)
    return made.filter(F.col("minutes") > min_minutes)


def modal_gap_count(bars: DataFrame, factor: float = 1.5) -> DataFrame:
    """Gaps above ``factor`` times the commonest distance of each series (the shorter of ties)."""
    d = bars.select(*SERIES, (hours_between(F.lag("ts").over(series()), F.col("ts")) * 60).alias("d")).filter("d is not null").groupBy(*SERIES, "d").agg(F.count("*").alias("n"))
    mode = d.groupBy(*SERIES).agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("mode"))
    return d.join(mode, SERIES).groupBy(*SERIES, "mode").agg(F.sum(F.when(F.col("d") > factor * F.col("mode"), F.col("n")).otherwise(0)).alias("gaps"))


def classify_gaps(gaps: DataFrame, interval_minutes: float) -> DataFrame:
    """Type, severity and price change of gaps."""
    h, lost, at = F.col("minutes") / 60, F.col("minutes") / interval_minutes, F.hour("gap_start")
    return gaps.withColumns({
        "gap_type": F.when(h > 48, "WEEKEND").when(h < 4, "SMALL_GAP").when((at >= 20) | (at < 4), "OVERNIGHT").otherwise("UNKNOWN"),
        "severity": F.when(lost < 4, "LOW").when(lost > 24, "HIGH").otherwise("MEDIUM"),
        "price_change_pct": ratio(F.col("after_price") - F.col("before_price"), F.col("before_price")) * 100})


def classify_gaps_extended(gaps: DataFrame, interval_minutes: float) -> DataFrame:
    """Six types in order, severity to CRITICAL, whether it can be filled, and confidence."""
    h, start = F.col("minutes") / 60, F.col("gap_start")
    friday, monday = F.weekday(start) >= 4, F.weekday(F.col("gap_end")).isin(0, 6)
    overnight = ((F.hour(start) >= 20) | (F.hour(start) < 4)) & (h <= 12)
    kind = F.when((h >= 48) & (h <= 80) & friday & monday, "WEEKEND").when(overnight, "OVERNIGHT").when(h < 4, "SMALL_GAP").when((h >= 12) & (h <= 36), "HOLIDAY").when(h > 168, "API_FAILURE").otherwise("UNKNOWN")
    made = gaps.withColumn("gap_type", kind)
    return made.withColumns({
        "severity": F.when(F.col("gap_type").isin("WEEKEND", "OVERNIGHT"), "LOW").when(h > 72, "CRITICAL").when(h > 24, "HIGH").when(h > 4, "MEDIUM").otherwise("LOW"),
        "fillable": (h <= 168) & (F.col("gap_type") != "API_FAILURE"),
        "confidence": F.when(F.col("gap_type") == "SMALL_GAP", 1.0).when(F.col("gap_type").isin("WEEKEND", "OVERNIGHT"), 0.9).when(F.col("gap_type") == "HOLIDAY", 0.7).otherwise(0.5)})


def irregular_gaps(bars: DataFrame) -> DataFrame:
    """Distances above 1.1 h that look like neither a night (17-18 h) nor a weekend (65-66 h)."""
    h = F.col("minutes") / 60
    return detect_gaps(bars, 66.0).filter(~h.between(17, 18) & ~h.between(65, 66))


def file_gap_types(bars: DataFrame, interval_minutes: float) -> DataFrame:
    """Weekend, market_closed (above 960 min) or data_missing, and the points expected between."""
    gaps = detect_gaps(bars, 1.5 * interval_minutes)
    weekend = (F.weekday("gap_start") == 4) & (F.weekday("gap_end") == 0)
    return gaps.withColumns({"gap_type": F.when(weekend, "weekend").when(F.col("minutes") > 960, "market_closed").otherwise("data_missing"), "missing_points": (F.floor(F.col("minutes") / interval_minutes) - 1).cast("bigint")})


def complete_grid(bars: DataFrame, hours: int = 1) -> DataFrame:
    """A row for each step between a series' first and last bar, and the bars off the grid; repeated bars stay."""
    span = bars.groupBy(*SERIES).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select(*SERIES, F.explode(F.sequence("a", "b", F.make_dt_interval(hours=F.lit(hours)))).alias("ts"))
    return grid.join(bars, KEY, "full")


def _both_sides(grid: DataFrame) -> DataFrame:
    """Nearest known bar before and after each grid row, as structs."""
    bar = F.when(F.col("close").isNotNull(), F.struct("ts", "open", "high", "low", "close"))
    back, ahead = series().rowsBetween(Window.unboundedPreceding, 0), series().rowsBetween(0, Window.unboundedFollowing)
    return grid.withColumns({"_prev": F.last(bar, ignorenulls=True).over(back), "_next": F.first(bar, ignorenulls=True).over(ahead)})


def fill_gaps(bars: DataFrame, hours: int = 1, small_hours: float = 4.0) -> DataFrame:
    """The whole grid: short gaps interpolated in time, long ones carried forward; volume 0 there; ``fill`` says how."""
    made = _both_sides(complete_grid(bars, hours))
    missing = F.col("close").isNull()
    gap = hours_between(F.col("_prev.ts"), F.col("_next.ts"))
    part = hours_between(F.col("_prev.ts"), F.col("ts")) / gap
    value = lambda c: F.when(~missing, F.col(c)).when(gap < small_hours, F.col(f"_prev.{c}") + part * (F.col(f"_next.{c}") - F.col(f"_prev.{c}"))).otherwise(F.col("_prev.close"))
    how = F.when(~missing, "REAL").when(gap < small_hours, "INTERPOLATED").otherwise("FORWARD")
    return made.select(*KEY, *[value(c).alias(c) for c in ("open", "high", "low", "close")], F.coalesce("volume", F.lit(0.0)).alias("volume"), how.alias("fill"))


def flat_fill(bars: DataFrame, hours: int = 1, max_hours: float = 72.0) -> DataFrame:
    """Only the new rows of gaps shorter than ``max_hours``: flat at the close before."""
    gaps = detect_gaps(bars, hours * 60.0).filter(F.col("minutes") < max_hours * 60)
    step = F.make_dt_interval(hours=F.lit(hours))
    rows = gaps.select(*SERIES, F.explode(F.sequence(F.col("gap_start") + step, F.col("gap_end") - step, step)).alias("ts"), F.col("before_price").alias("close"))
    return rows.select(*KEY, *[F.col("close").alias(c) for c in ("open", "high", "low")], "close", F.lit(0.0).alias("volume"), F.lit(True).alias("is_filled"))


def fill_with_provenance(bars: DataFrame, hours: int = 1, max_hours: float = 24.0) -> DataFrame:
    """Grid rows in gaps up to ``max_hours`` carried forward and marked; longer gaps stay open."""
    made = _both_sides(complete_grid(bars, hours))
    missing = F.col("close").isNull()
    keep = ~missing | (hours_between(F.col("_prev.ts"), F.col("_next.ts")) <= max_hours)
    return made.filter(keep).select(*KEY, F.coalesce("close", "_prev.close").alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"), missing.alias("is_gap_filled"), F.when(missing, "FILL_FORWARD").otherwise("REAL").alias("data_source"))
