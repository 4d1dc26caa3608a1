"""Order within keys of any size: places of rows, and digests of rows joined in order.

A key may hold a large share of all rows, so nothing gathers a key: rows are dealt by
ranges of (key, order), each range is worked on by itself, and only one number or one
joined piece of a range takes part in the pass over a key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship

#: Bytes of a joined piece.
PIECE = 1 << 20


def numbered(df: DataFrame, keys: list[str], order: list[Column], ranges: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row within its key, from 0, as column ``name``; written as a table.

    ``ranges``: the columns after ``keys`` by which rows are dealt; rows equal in them stay together, and they agree with ``order``.
    """
    dealt = saved(df.repartitionByRange(*keys, *ranges).withColumn("_part", F.spark_partition_id()), f"{name}-ranges")
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))  # a key has a row for each range it reaches into
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_of"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    return placed.join(before, same).withColumn(name, (F.col("_place") + F.col("_before")).cast("bigint")).select(*df.columns, name)


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where rows of sorted ``table`` begin a new group."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        code = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 20_000) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups of ``keys``, of about ``most`` rows or one group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.flatnonzero(starts(table, keys))[-1])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` dealt by ``keys`` and sorted by them, then by ``order``, for a pass that streams."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def joined_sha256(rows: DataFrame, keys: list[str], order: list[str], value: str, separator: str, name: str) -> DataFrame:
    """For each key, SHA-256 (lowercase hex) of the UTF-8 of its values joined in order, as column ``name``.

    SHA-256 runs over its input from front to end, so a key's bytes pass through one task; they
    come as pieces that ranges have joined before, and memory is a piece.
    """
    mark, between = len(keys), separator.encode()
    kept = rows.select(*keys, *order, F.coalesce(F.col(value), F.lit("")).alias("_value"))
    schema = [f for f in kept.schema.fields if f.name in keys]
    schema = sorted(schema, key=lambda f: keys.index(f.name))
    from pyspark.sql import types as T

    piece_schema = T.StructType([*schema, T.StructField("_part", T.LongType()), T.StructField("_seq", T.LongType()), T.StructField("_bytes", T.BinaryType())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, key, held, size, out = TaskContext.get().partitionId(), 0, None, [], 0, []
        types = None

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*types, pa.int64(), pa.int64(), pa.binary()], strict=True)], names=piece_schema.names)

        for b in batches:
            types = types or [b.schema.field(k).type for k in keys]
            columns = [b.column(k).to_pylist() for k in keys]
            for row in zip(*columns, b.column("_value").to_pylist(), strict=True):
                if held and (row[:mark] != key or size > PIECE):
                    out.append((*key, part, seq, between.join(held)))
                    seq, held, size = seq + 1, [], 0
                    if len(out) >= 1000 or len(out[-1][-1]) > PIECE:
                        yield batch()
                        out = []
                key = row[:mark]
                held.append(row[mark].encode("utf-8", "surrogatepass"))
                size += len(held[-1])
        if held:
            out.append((*key, part, seq, between.join(held)))
        if out:
            yield batch()

    digest_schema = T.StructType([*schema, T.StructField(name, T.StringType())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out, types = None, None, [], None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*types, pa.string()], strict=True)], names=digest_schema.names)

        for b in batches:
            types = types or [b.schema.field(k).type for k in keys]
            for row in zip(*[b.column(k).to_pylist() for k in keys], b.column("_bytes").to_pylist(), strict=True):
                if sha is None or row[:mark] != key:
                    if sha is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = row[:mark], hashlib.sha256()
                else:
                    sha.update(between)
                sha.update(row[mark])
            if len(out) >= 5000:
                yield batch()
                out = []
        if sha is not None:
            out.append((*key, sha.hexdigest()))
        if out:
            yield batch()

    ranged = kept.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    joined = ranged.mapInArrow(pieces, piece_schema)
    return by_group(joined, keys, [F.col("_part"), F.col("_seq")]).mapInArrow(digests, digest_schema)


ship(__name__)
