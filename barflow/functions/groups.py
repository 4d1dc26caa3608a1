"""Passes over sorted rows in workers, a whole group at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shipping import ship


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Places where a new group of ``keys`` begins in sorted ``table``; nulls are a group."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        code = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of sorted batches as tables; held are a batch and the group that is not yet whole."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        if held is not None:  # does the group go on?
            seam = pa.concat_tables([held.slice(held.num_rows - 1), table.slice(0, 1)])
            if len(group_starts(seam, keys)) == 2:
                yield held
                held = None
        cuts = group_starts(table, keys).tolist()
        for k, at in enumerate(cuts):
            part = table.slice(at, (cuts[k + 1] if k + 1 < len(cuts) else table.num_rows) - at)
            if k and held is not None:
                yield held
                held = None
            held = part if held is None else pa.concat_tables([held, part])
    if held is not None:
        yield held


ship(__name__)
