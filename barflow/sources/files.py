"""Reading and writing bars, audits and ledgers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY
from ..operators.clean import append_missing, date_range, dedupe

#: Header names that mean a column.
ALIASES = {"symbol": ["symbol", "ticker"], "timeframe": ["timeframe", "interval"], "ts": ["timestamp", "datetime", "date", "time", "ts"], "open": ["open", "o"], "high": ["high", "h"], "low": ["low", "l"], "close": ["close", "c", "price"], "volume": ["volume", "v", "vol"]}
AUDIT = """metadata struct<strategy: string, symbol: string, timeframe: string>,
bars array<struct<timestamp: string, open: double, high: double, low: double, close: double, indicators: map<string, double>, signal: string>>,
trades array<struct<timestamp: string, side: string, price: double, quantity: double, commission: double, tag: string>>"""


def read_candle_csv(spark: SparkSession, path: str) -> DataFrame:
    """Candles from CSV files, each read by its own header; columns may come in any order and under any of ALIASES.

    Symbol and timeframe come from such columns, else from ``SYMBOL_TF_DATE_TIME.csv``.  Values
    that are not numbers become null; rows need a time, four prices, close > 0 and high >= low.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_file"), F.split("value", ",").alias("_f"))
    lines = lines.withColumn("_f", F.transform("_f", lambda x: F.trim(F.regexp_replace(x, "^\\x{FEFF}|\"", ""))))
    names = F.transform("_f", F.lower)
    holds = lambda n: F.arrays_overlap(names, F.array(*[F.lit(a) for a in ALIASES[n]]))
    is_header = holds("ts") & holds("close")
    headers = lines.filter(is_header).groupBy("_path").agg(F.min(names).alias("_names"))  # one row a file
    rows = lines.filter(~is_header).join(headers, "_path")

    def value(n: str) -> Column:
        places = [F.nullif(F.array_position("_names", F.lit(a)), F.lit(0)) for a in ALIASES[n]]
        return F.get("_f", F.coalesce(*places).cast("int") - 1)

    of_file = lambda pattern: F.nullif(F.regexp_extract("_file", pattern, 1), F.lit(""))
    made = rows.select(
        F.coalesce(value("symbol"), of_file(r"^([^_]+)_")).alias("symbol"), F.coalesce(value("timeframe"), of_file(r"^[^_]+_([^_.]+)")).alias("timeframe"),
        value("ts").try_cast("timestamp_ntz").alias("ts"), *[value(c).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])
    return made.dropna(subset=["ts", "open", "high", "low", "close"]).filter("close > 0 and high >= low")


def read_audit(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Bars and trades of nested audit documents, one a file, or one a line without ``multi_line``."""
    doc = spark.read.schema(AUDIT).json(path, multiLine=multi_line).select("metadata.symbol", "metadata.timeframe", "bars", "trades")
    bars = doc.select("symbol", "timeframe", F.explode("bars").alias("b")).select("symbol", "timeframe", F.col("b.timestamp").try_cast("timestamp_ntz").alias("ts"), "b.open", "b.high", "b.low", "b.close", "b.indicators", "b.signal")
    trades = doc.select("symbol", "timeframe", F.posexplode("trades").alias("seq", "t")).select("symbol", "timeframe", "seq", F.col("t.timestamp").try_cast("timestamp_ntz").alias("ts"), "t.side", "t.price", F.col("t.quantity").alias("qty"), "t.commission", "t.tag")
    return bars, trades


def load_bars(df: DataFrame, symbols: list[str] | None = None, timeframe: str | None = None, start=None, end=None, order: str | None = None) -> DataFrame:
    """Bars of some symbols, a timeframe and a range; of repeated keys the last by ``order`` stays.

    Where bars lie in folders by ``month`` (yyyy-MM, see ``write_indicators``), the range picks the folders, too.
    """
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(symbols))
    if timeframe is not None:
        df = df.filter(F.col("timeframe") == timeframe)
    if start is not None and end is not None:
        df = date_range(df, start, end)
        if "month" in df.columns:
            of = lambda t: F.date_format(F.lit(t).cast("timestamp_ntz"), "yyyy-MM")
            df = df.filter(F.col("month").between(of(start), of(end)))
    return dedupe(df, KEY, [order]) if order else df


def upsert_bars(existing: DataFrame, incoming: DataFrame, keys: list[str] = KEY, order: list[str] | None = None) -> DataFrame:
    """Incoming rows win; of several for a key the last by ``order`` (columns of both), ties by a hash of the row."""
    both = existing.withColumn("_v", F.lit(0)).unionByName(incoming.withColumn("_v", F.lit(1)))
    return dedupe(both.withColumn("_tie", F.xxhash64(*existing.columns)), list(keys), ["_v", *(order or []), "_tie"]).drop("_v", "_tie")


def append_new(existing: DataFrame, incoming: DataFrame, keys: list[str] = KEY, order: list[str] | None = None) -> DataFrame:
    """Existing rows win; of several incoming rows for a key the first by ``order`` is added, ties by a hash of the row."""
    return append_missing(existing, incoming, list(keys), order)


def last_rows(df: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("symbol", "timeframe").orderBy(F.desc("ts"))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def write_indicators(df: DataFrame, path: str, columns: list[str], n: int | None = None) -> None:
    """Upsert key and ``columns`` (NaN as null) of the last ``n`` rows of each series into the store, by timeframe and month.

    A folder that any reader of Parquet can read, for one writer at a time; ``store.save_indicators`` is for
    several writers and for readers meanwhile.  Stored rows of other keys stay.  Only touched partitions are read and replaced; their new
    content is written beside the store first, so that a failed run leaves it as it was.
    """
    spark = df.sparkSession
    made = (df if n is None else last_rows(df, n)).select(*KEY, *[F.nanvl(c, F.lit(None)).alias(c) if t == "double" else F.col(c) for c, t in df.select(*columns).dtypes])
    made = made.withColumn("month", F.date_format("ts", "yyyy-MM"))
    try:
        stored = spark.read.schema(made.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        merged = upsert_bars(made.limit(0), made)
    else:
        touched = made.select("timeframe", "month").distinct()  # a row for each month of a timeframe
        merged = upsert_bars(stored.join(touched, ["timeframe", "month"], "left_semi").select(*made.columns), made)
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    merged.write.parquet(beside)
    replaced = spark.read.schema(made.schema).parquet(beside)
    replaced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("timeframe", "month").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(beside)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def export_since(df: DataFrame, ts: str, cutoff, path: str, fmt: str = "json") -> None:
    newer = df.filter(F.col(ts) > F.lit(cutoff))
    newer.write.mode("overwrite").json(path) if fmt == "json" else newer.write.mode("overwrite").csv(path, header=True)


def purge_older_than(df: DataFrame, ts: str, cutoff) -> tuple[DataFrame, int]:
    """Rows to keep and the number removed."""
    old = F.col(ts) < F.lit(cutoff)
    return df.filter(~old), df.filter(old).count()


def merge_gap_ledger(ledger: DataFrame, fills: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The ledger of fills (symbol, gap_start, gap_end, method, bars_added, fill_count): known keys count up and refresh, others start.

    Each fill of a batch counts; the last by ``order`` (ties: the greatest method and number of bars) gives method and bars_added.
    """
    keys = ["symbol", "gap_start", "gap_end"]
    last = F.max(F.struct(*(order or []), F.col("method").alias("_m"), F.col("bars_added").alias("_b")))
    new = fills.groupBy(*keys).agg(last.alias("_l"), F.count("*").cast("int").alias("_new")).select(*keys, "_l._m", "_l._b", "_new")
    both = ledger.join(new, keys, "full_outer")
    return both.select(*keys, F.coalesce("_m", "method").alias("method"), F.coalesce("_b", "bars_added").alias("bars_added"), (F.coalesce("fill_count", F.lit(0)) + F.coalesce("_new", F.lit(0))).alias("fill_count"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the cluster's checkpoints; in local mode a temporary one where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base or base.startswith("<"):  # an optional setting without a value reads as <undefined>
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="barflow-")
    return f"{base.rstrip('/')}/barflow/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """``df`` as a new Parquet table in the shared folder, so that several jobs over it do not make it again; ``parts``: its folders."""
    path = shared_folder(df.sparkSession, name)
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
