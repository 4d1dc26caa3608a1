"""A store of bars in versions: corrections are added, readers stay with a version, nothing is changed in place.

Rows are Parquet files that never change.  A version is a small table of the files that make
it up, with what they hold (timeframe, month, ranges of symbol and time), and the last batch
taken from each stream.  It is written beside the store and then renamed to its number, which
only one writer can do; another one that has prepared the same number starts again from the newer version.

A commit adds rows without reading old ones: of rows with the same key the one of the newest
version counts.  ``compact`` merges months that hold more than one version's rows.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import KEY

FILES = "kind string, file string, timeframe string, month string, n bigint, first_symbol string, last_symbol string, first_ts timestamp_ntz, last_ts timestamp_ntz, version bigint, stream string, batch bigint"
VERSION = "_version"
#: Manifests of more rows are an error: compact to larger files first.
MOST_FILES, TRIES = 1_000_000, 20


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the store's versions, rising; none if there is no store."""
    fs, folder = _hadoop(spark, f"{path}/versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Files and stream batches of a version (the newest if None)."""
    known = versions(spark, path)
    version = version if version is not None else known[-1] if known else None
    if version is None:
        return spark.createDataFrame([], FILES)
    if version not in known:
        raise ValueError(f"no version {version} in {path}")
    return spark.read.schema(FILES).parquet(f"{path}/versions/{version:012d}")


def _schema(spark: SparkSession, path: str) -> T.StructType | None:
    """Columns of the rows, as the newest version's note of them says."""
    row = manifest(spark, path).filter("kind = 'schema'").select("file").first()
    return T.StructType.fromJson(json.loads(row.file)) if row else None


def _publish(spark: SparkSession, path: str, number: int, rows: DataFrame) -> bool:
    """Make ``rows`` the manifest of version ``number``; False if another writer has done so first."""
    beside = f"{path}/prepared/{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(beside)
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{number:012d}")
    fs, _ = _hadoop(spark, path)
    fs.mkdirs(to.getParent())
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(jvm.org.apache.hadoop.fs.Path(beside), to, none)  # not over a folder that exists
    except Exception:
        if number not in versions(spark, path):
            raise
        _drop(spark, beside)
        return False
    return True


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def _written(rows: DataFrame, path: str, number: int, keep_version: bool = False) -> tuple[DataFrame, str]:
    """Rows as new files, and what these hold.  Each (timeframe, month) is sorted by symbol and time, so that files hold ranges."""
    spark, folder = rows.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    made = rows if keep_version else rows.withColumn(VERSION, F.lit(number).cast("bigint"))
    parts = made.withColumns({"_tf": F.coalesce("timeframe", F.lit("")), "_month": F.coalesce(F.date_format("ts", "yyyy-MM"), F.lit(""))})
    parts.repartitionByRange("_tf", "_month", "symbol", "ts").sortWithinPartitions("_tf", "_month", "symbol", "ts").write.partitionBy("_tf", "_month").parquet(folder)
    fs, p = _hadoop(spark, folder)
    if not [s for s in fs.listStatus(p) if s.isDirectory()]:  # no rows
        return spark.createDataFrame([], FILES), folder
    back = spark.read.schema(made.schema).option("basePath", folder).parquet(folder)
    held = back.groupBy(F.col("_metadata.file_path").alias("file"), F.col("timeframe"), F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.min("symbol").alias("first_symbol"), F.max("symbol").alias("last_symbol"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(VERSION).alias("version"))
    none = lambda kind: F.lit(None).cast(kind)
    return held.select(F.lit("file").alias("kind"), "file", "timeframe", "month", "n", "first_symbol", "last_symbol", "first_ts", "last_ts", "version", none("string").alias("stream"), none("bigint").alias("batch")), folder


def _note(spark: SparkSession, kind: str, **values) -> DataFrame:
    fields = T.StructType.fromDDL(FILES).names
    return spark.createDataFrame([tuple({"kind": kind, **values}.get(f) for f in fields)], FILES)


def commit(rows: DataFrame, path: str, keys: list[str] = KEY, order: list[str] | None = None, stream: str | None = None, batch: int | None = None) -> int | None:
    """Add ``rows`` as a new version; its number, or None if this batch of this stream is in the store already.

    Of several rows with one key the last by ``order`` counts, ties by a hash of the row.
    """
    spark = rows.sparkSession
    columns = rows.schema
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order or []], F.desc(F.xxhash64(*rows.columns)))
    once = rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    for _ in range(TRIES):
        known = versions(spark, path)
        number = (known[-1] if known else 0) + 1
        now = manifest(spark, path)
        if stream is not None and now.filter((F.col("kind") == "batch") & (F.col("stream") == stream) & (F.col("batch") >= batch)).limit(1).count():
            return None
        files, folder = _written(once, path, number)
        rest = now.filter("kind <> 'schema'") if stream is None else now.filter(~((F.col("kind") == "batch") & (F.col("stream") == stream)) & (F.col("kind") != "schema"))
        new = rest.unionByName(files).unionByName(_note(spark, "schema", file=columns.json()))
        if stream is not None:
            new = new.unionByName(_note(spark, "batch", stream=stream, batch=batch))
        if _publish(spark, path, number, new):
            return number
        _drop(spark, folder)
        time.sleep(0.05)
    raise RuntimeError(f"{TRIES} other writers were faster")


def save_indicators(df: DataFrame, path: str, columns: list[str], n: int | None = None) -> int | None:
    """Key and ``columns`` (NaN as null) of the last ``n`` rows of each series as a new version; rows of other keys stay."""
    made = df if n is None else df.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "timeframe").orderBy(F.desc("ts")))).filter(F.col("_n") <= n)
    return commit(made.select(*KEY, *[F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in df.select(*columns).dtypes]), path)


def chosen_files(spark: SparkSession, path: str, version: int | None = None, symbols: list[str] | None = None, timeframe: str | None = None, start=None, end=None) -> DataFrame:
    """The files of a version that can hold such rows, by their ranges."""
    files = manifest(spark, path, version).filter("kind = 'file'")
    if timeframe is not None:
        files = files.filter(F.col("timeframe") == timeframe)
    if start is not None:
        files = files.filter(F.col("last_ts") >= F.lit(start))
    if end is not None:
        files = files.filter(F.col("first_ts") <= F.lit(end))
    if symbols is not None:
        inside: Column = F.lit(False)
        for s in symbols:
            inside = inside | F.lit(s).between(F.col("first_symbol"), F.col("last_symbol"))
        files = files.filter(inside)
    return files


def read_store(spark: SparkSession, path: str, version: int | None = None, symbols: list[str] | None = None, timeframe: str | None = None, start=None, end=None, keys: list[str] = KEY) -> DataFrame:
    """Rows of a version (the newest if None), of some symbols, a timeframe and a range (both ends included).

    Only files that can hold such rows are read, and only months with rows of several versions are
    merged.  What is returned stays the same whatever is committed later, until ``clean`` drops the version.
    """
    schema = _schema(spark, path)
    if schema is None:
        raise ValueError(f"no store in {path}")
    files = chosen_files(spark, path, version, symbols, timeframe, start, end).select("file", "timeframe", "month", "version").limit(MOST_FILES + 1).collect()
    if len(files) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files: compact the store")
    held: dict[tuple, set] = {}
    for f in files:
        held.setdefault((f.timeframe, f.month), set()).add(f.version)
    wide = T.StructType([*schema.fields, T.StructField(VERSION, T.LongType())])

    def rows(some: list[str]) -> DataFrame:
        df = spark.read.schema(wide).parquet(*some) if some else spark.createDataFrame([], wide)
        if symbols is not None:
            df = df.filter(F.col("symbol").isin(symbols))
        if timeframe is not None:
            df = df.filter(F.col("timeframe") == timeframe)
        if start is not None:
            df = df.filter(F.col("ts") >= F.lit(start))
        return df if end is None else df.filter(F.col("ts") <= F.lit(end))

    several = [f.file for f in files if len(held[f.timeframe, f.month]) > 1]
    newest = Window.partitionBy(*keys).orderBy(F.desc(VERSION))
    single = rows([f.file for f in files if len(held[f.timeframe, f.month]) == 1])
    if not several:
        return single.drop(VERSION)
    merged = rows(several).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    return single.unionByName(merged).drop(VERSION)


def compact(spark: SparkSession, path: str, keys: list[str] = KEY) -> int | None:
    """A version whose months each hold rows of one version; None if that is so already.

    If another writer commits meanwhile, the months that it did not touch are still replaced.
    """
    for _ in range(TRIES):
        known = versions(spark, path)
        now = manifest(spark, path)
        part = ["timeframe", "month"]
        files = now.filter("kind = 'file'")
        several = files.groupBy(*part).agg(F.count_distinct("version").alias("v")).filter("v > 1").select(*part)
        old = [r.file for r in files.join(several, part, "left_semi").select("file").collect()]
        if not old:
            return None
        number = known[-1] + 1
        wide = T.StructType([*_schema(spark, path).fields, T.StructField(VERSION, T.LongType())])
        newest = Window.partitionBy(*keys).orderBy(F.desc(VERSION))
        rows = spark.read.schema(wide).parquet(*old).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", VERSION)
        made, folder = _written(rows, path, number)
        replaced = spark.createDataFrame([(f,) for f in old], "file string")
        if _publish(spark, path, number, now.join(replaced, "file", "left_anti").select(*now.columns).unionByName(made)):
            return number
        _drop(spark, folder)
    raise RuntimeError(f"{TRIES} other writers were faster")


def clean(spark: SparkSession, path: str, keep: int = 2, older_seconds: float = 24 * 3600) -> int:
    """Drop all versions but the last ``keep``, and data folders that none of these names and that are older; how many folders went.

    ``older_seconds`` leaves writers time to finish: their data is written before their version.
    """
    known = versions(spark, path)
    for v in known[:-keep]:
        _drop(spark, f"{path}/versions/{v:012d}")
    used = None
    for v in known[-keep:]:
        folders = manifest(spark, path, v).filter("kind = 'file'").select(F.regexp_extract("file", "/data/([0-9a-f]+)/", 1).alias("folder")).distinct()
        used = folders if used is None else used.unionByName(folders)
    named = {r.folder for r in used.distinct().collect()} if used is not None else set()
    gone = 0
    for part in ("data", "prepared"):
        fs, folder = _hadoop(spark, f"{path}/{part}")
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            if s.getPath().getName() not in named and time.time() - s.getModificationTime() / 1000 >= older_seconds:
                fs.delete(s.getPath(), True)
                gone += 1
    return gone
