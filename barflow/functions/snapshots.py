"""Snapshots as JSON text: the last bars of a series and its gaps by type, written and read back without loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import last_rows
from .columns import SERIES, require_columns

PRICES = ["open", "high", "low", "close", "volume"]
#: What a snapshot's text holds; times to the microsecond.
SCHEMA = f"""symbol string, timeframe string, rows array<struct<ts: timestamp_ntz, {", ".join(f"{c}: double" for c in PRICES)}>>,
gaps_by_type map<string, bigint>, gaps_by_severity map<string, bigint>, reasons array<string>"""
OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def to_snapshot(bars: DataFrame, gaps: DataFrame, n: int = 5) -> DataFrame:
    """symbol, timeframe, snapshot: JSON of the last ``n`` bars and the number of gaps (gap_type, severity) of each series.

    A series without gaps has empty maps; a null price stays null.
    """
    require_columns(bars, *SERIES, "ts", *PRICES)
    last = last_rows(bars, n).groupBy(*SERIES).agg(F.array_sort(F.collect_list(F.struct("ts", *[F.col(c).cast("double").alias(c) for c in PRICES]))).alias("rows"))

    def counted(column: str, name: str) -> DataFrame:
        by = gaps.filter(F.col(column).isNotNull()).groupBy(*SERIES, column).agg(F.count("*").alias("k"))
        return by.groupBy(*SERIES).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "k")))).alias(name))

    made = last.join(counted("gap_type", "gaps_by_type"), SERIES, "left").join(counted("severity", "gaps_by_severity"), SERIES, "left")
    none = F.create_map().cast("map<string,bigint>")
    made = made.withColumns({c: F.coalesce(c, none) for c in ("gaps_by_type", "gaps_by_severity")})
    reasons = F.array_compact(F.array(F.when(F.size("gaps_by_type") > 0, "HAS_GAPS"), F.when(F.size("rows") < n, "FEW_ROWS"), F.when(F.exists("rows", lambda r: r["close"].isNull()), "NULL_PRICES")))
    return made.select(*SERIES, F.to_json(F.struct(*SERIES, "rows", "gaps_by_type", "gaps_by_severity", reasons.alias("reasons")), OPTIONS).alias("snapshot"))


def from_snapshot(snapshots: DataFrame, column: str = "snapshot") -> DataFrame:
    """The fields of snapshots; text that is no snapshot gives nulls."""
    return snapshots.select(F.from_json(column, SCHEMA, OPTIONS).alias("_s")).select("_s.*")


def snapshot_rows(snapshots: DataFrame) -> DataFrame:
    """The bars in snapshots, as bars."""
    return from_snapshot(snapshots).select(*SERIES, F.explode("rows").alias("r")).select(*SERIES, "r.*")


def snapshot_counts(snapshots: DataFrame) -> DataFrame:
    """symbol, timeframe, kind (type or severity), name, n: the counts in snapshots."""
    s = from_snapshot(snapshots)
    part = lambda c, kind: s.select(*SERIES, F.lit(kind).alias("kind"), F.explode(c).alias("name", "n"))
    return part("gaps_by_type", "type").unionByName(part("gaps_by_severity", "severity"))
