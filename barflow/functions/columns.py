"""Column helpers: ordered windows per series, warm-up rule, safe division, New York time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ["symbol", "timeframe"]
KEY = [*SERIES, "ts"]
ZONE = "America/New_York"


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def series(rows: int | None = None) -> WindowSpec:
    """Bars of a series in time order; the last ``rows`` of them, if given."""
    w = Window.partitionBy(*SERIES).orderBy("ts")
    return w if rows is None else w.rowsBetween(-(rows - 1), 0)


def running(*keys: str, order=("ts",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, x: Column, n: int) -> Column:
    """``value`` only where the last ``n`` rows all have ``x``: warm-up gives null."""
    return F.when(F.count(x).over(series(n)) == n, value)


def mean(x: Column, n: int) -> Column:
    return full(F.avg(x).over(series(n)), x, n)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null for zero or null b."""
    return F.try_divide(a, b)


def new_york(ts: Column) -> Column:
    """Wall clock in New York of a zone-less UTC time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts)


def hours_between(a: Column, b: Column) -> Column:
    """Hours from a to b, both zone-less."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(3_600_000_000.0)


def minutes_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(60_000_000.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, so that results compare across engines; negative zero becomes zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def closing_soon(ts: Column, minutes: int = 10) -> Column:
    """Whether the market closes within ``minutes`` or has closed: on a New York weekday, that long before 16:00 or later; false for null."""
    ny = new_york(ts)
    return F.coalesce((F.weekday(ny) < 5) & (F.hour(ny) * 60 + F.minute(ny) >= 16 * 60 - minutes), F.lit(False))


def feature_key(symbol: Column, timeframe: Column, ts: Column) -> Column:
    """``symbol_timeframe_time`` with the time as ISO 8601; null if a part is."""
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(symbol, F.lit("_"), timeframe, F.lit("_"), iso)


def file_parts(name: Column) -> tuple[Column, Column]:
    """Symbol (upper case) and timeframe (lower case) of ``SYMBOL_TF_...`` with or without folders; null where the name has no such part."""
    base = F.element_at(F.split(F.trim(name), "/"), -1)
    part = lambda pattern: F.nullif(F.regexp_extract(base, pattern, 1), F.lit(""))
    return F.upper(part(r"^([^_.]+)_")), F.lower(part(r"^[^_.]+_([^_.]+)"))


def is_exit_tag(tag: Column) -> Column:
    """Whether a trade's tag is that of an exit (holds EXIT, SL or TP) or is missing."""
    return F.coalesce(tag, F.lit("")).rlike("EXIT|SL|TP") | (F.coalesce(tag, F.lit("")) == "")


def clamp(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; NaN counts as missing, null stays null."""
    clean = F.nanvl(x, F.lit(None).cast("double"))
    return F.when(clean.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), clean)))


def pct_change(now: Column, before: Column) -> Column:
    """Change from ``before`` to ``now`` in %; null where that is null or zero."""
    return 100 * ratio(now - before, F.abs(before))
