"""Exponential means: the one recursion without a window form.

y[0] = x[0], y[t] = y[t-1] + a (x[t] - y[t-1]).  Over any run of rows the result is an affine
map of the value carried in.  A series is cut by time into chunks of a known number of steps;
each chunk is summed up as such a map, only these maps meet by series, and each chunk is
then solved from the value carried into it.  No pass sees a whole series.  A chunk's rows stay
in the JVM as one array; Python sees the source columns alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import SERIES
from .shipping import ship

CHUNK = 50_000
STEPS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 7 * 86_400}


def step_seconds(timeframe: Column) -> Column:
    """Seconds of a bar of ``timeframe`` (1h, 15m, ...); a minute where that cannot be told."""
    n = F.nullif(F.regexp_extract(timeframe, r"^(\d+)\s*[A-Za-z]", 1), F.lit("")).cast("bigint")
    unit = F.lower(F.regexp_extract(timeframe, r"^\d+\s*([A-Za-z])", 1))
    size = F.element_at(F.create_map(*[x for k, v in STEPS.items() for x in (F.lit(k), F.lit(v))]), unit)
    return F.greatest(F.coalesce(n * size, F.lit(60)), F.lit(1))


def chunk_of(ts: Column, timeframe: Column, chunk: int = CHUNK) -> Column:
    """The number of the range of ``chunk`` steps that a time lies in."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
    return F.floor(micros / (step_seconds(timeframe) * F.lit(chunk * 1_000_000)))


def _solve(x: np.ndarray, alpha: float, carry: float) -> np.ndarray:
    """The recursion over x from ``carry`` in compiled code; nulls repeat the value before them."""
    return pd.Series(np.r_[carry, x]).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[1:]


def ema(df: DataFrame, columns: dict[str, tuple[str, int]], chunk: int = CHUNK) -> DataFrame:
    """``df`` with one column for each ``name: (source column, span)``; several means in one pass.

    A null source repeats the last value; before the first value the result is null.  Rows of one
    time are taken in the order of their other columns, which must be orderable.
    """
    names = list(columns)
    sources = sorted({c for c, _ in columns.values()})
    means = [(sources.index(c), 2 / (span + 1)) for c, span in columns.values()]
    keys = [*SERIES, "_chunk"]
    row = F.struct("ts", *[c for c in df.columns if c != "ts"])
    packed = df.withColumn("_chunk", chunk_of(F.col("ts"), F.col("timeframe"), chunk)).groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    lists = T.ArrayType(T.DoubleType())
    values = [F.col("_rows").getField(c).cast(lists) for c in sources]

    def summary(*xs: pd.Series) -> pd.DataFrame:
        """What chunks do to values carried in: out = last + decay (in - first), or last if nothing is carried in; nan for a chunk without values."""
        made = {"first": [], "last": [], "decay": []}
        for chunk_xs in zip(*xs, strict=True):
            clean = [x[~np.isnan(x)] for x in map(np.asarray, chunk_xs)]
            made["first"].append([float(clean[i][0]) if len(clean[i]) else np.nan for i, _ in means])
            made["last"].append([float(_solve(clean[i], a, np.nan)[-1]) if len(clean[i]) else np.nan for i, a in means])
            made["decay"].append([(1 - a) ** len(clean[i]) for i, a in means])
        return pd.DataFrame(made)

    ends = packed.select(*keys, F.pandas_udf(summary, T.StructType([T.StructField(f, lists) for f in ("first", "last", "decay")]))(*values).alias("_m")).select(*keys, "_m.*")

    def carried(maps: pd.DataFrame) -> pd.DataFrame:
        """The values carried into each chunk, from the maps of one series in order: one row a chunk."""
        maps = maps.sort_values("_chunk", na_position="first").reset_index(drop=True)
        first, last, decay = (np.array(maps[c].tolist(), float).reshape(len(maps), len(means)) for c in ("first", "last", "decay"))
        y, got = np.full(len(means), np.nan), []
        for f, x, d in zip(first, last, decay, strict=True):
            got.append(y)
            y = np.where(np.isnan(f), y, np.where(np.isnan(y), x, x + d * (y - f)))
        return maps[keys].assign(_carry=[g.tolist() for g in got])

    kinds = [f for f in packed.schema if f.name in keys]
    carry = ends.groupBy(*SERIES).applyInPandas(carried, T.StructType([*kinds, T.StructField("_carry", lists)]))

    def finish(carry: pd.Series, *xs: pd.Series) -> pd.DataFrame:
        out = [[_solve(np.asarray(x[i], float), a, c) for (i, a), c in zip(means, cs, strict=True)] for cs, x in zip(carry, zip(*xs, strict=True), strict=True)]
        return pd.DataFrame({f"y{k}": [o[k] for o in out] for k in range(len(means))})

    same = F.lit(True)
    for k in keys:
        same = same & packed[k].eqNullSafe(F.col(f"c.{k}"))
    solved = packed.join(carry.alias("c"), same).select("_rows", F.pandas_udf(finish, T.StructType([T.StructField(f"y{k}", lists) for k in range(len(means))]))("_carry", *values).alias("_y"))
    zipped = F.arrays_zip("_rows", *[F.col(f"_y.y{k}").alias(f"y{k}") for k in range(len(means))])
    held = [c for c in df.columns if c not in names]
    # One struct a row, so that the columns come out of the generator as they are and no plan above has to look into the arrays.
    flat = F.transform(zipped, lambda z: F.struct(*[z["_rows"][c].alias(c) for c in held], *[F.nanvl(z[f"y{k}"], F.lit(None).cast("double")).alias(n) for k, n in enumerate(names)]))
    return solved.select(F.inline(flat))



ship(__name__)
