"""Shared helpers: reading tables, cutting lineage, shipping helpers to workers."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so that workers need not import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one of this process, in local mode only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder or folder.startswith("<"):  # an optional setting without a value reads as <undefined>
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="barflow-")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table of a DataFrame that ``saved`` gave, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared(spark: SparkSession, data) -> Broadcast:
    """A broadcast of plain ``data`` (bytes, text, arrays), which workers read without this package; see ``built``."""
    return spark.sparkContext.broadcast({"data": data})


def built(broadcast: Broadcast, build):
    """In a worker: ``build(data)`` of a ``shared`` broadcast, made once for as long as the worker's tasks use it."""
    held = broadcast.value
    if "built" not in held:
        held["built"] = build(held["data"])
    return held["built"]


def slices(column: pa.Array, most: int = 200, size: int = 500_000) -> Iterator[list[str | None]]:
    """The texts of an Arrow column as runs of bounded count and (but for a single long text) bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(column):
        done = ends[i - 1] if i else 0
        j = min(max(i + 1, int(np.searchsorted(ends, done + size, side="right"))), i + most, len(column))
        yield column[i:j].to_pylist()
        i = j


def hash_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """About ``n`` rows (all if there are fewer, never more than twice as many), chosen by a hash of ``key``.

    One count and one filter: nothing is sorted, and no task sends more than its share.
    """
    step = -(-df.count() // n)
    return df.filter(F.pmod(F.xxhash64(key), F.lit(step)) == 0).limit(2 * n) if step > 1 else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


SPACE = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Array of the maximal runs of characters outside SPACE; null text: empty array."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE))
    return F.filter(F.split(flat, " "), lambda w: w != "")


ship(__name__)
