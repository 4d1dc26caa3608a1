"""Path-dependent rules: a hook that sees a series' bars in order and keeps a small state.

A rule is an object with ``start()``, the state before the first bar, and
``on_bars(state, bars)``, which gets a run of consecutive bars as arrays and gives the new
state and its actions.  Where runs end is up to the data's batches, so all that a rule must
remember goes through its state; results do not depend on the runs.  Series and parameter
sets are spread over tasks; a task holds one batch and one state.  What comes before a bar
decides what a rule does next, so one series under one parameter set is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import SERIES
from ..functions.groups import group_starts
from ..functions.shipping import ship

MOST_SETS = 10_000
ACTION = "symbol string, timeframe string, param_id bigint, ts timestamp_ntz, action string, price double, tag string"


class Rule(Protocol):
    """What a strategy must offer; made anew for each series from its parameters."""

    #: Columns of bars that the rule reads, besides the time.
    columns: list[str]

    def start(self) -> Any:
        """The state before the first bar."""

    def on_bars(self, state: Any, bars: dict[str, np.ndarray]) -> tuple[Any, list[tuple[int, str, float, str]]]:
        """The state after these bars, and actions: (place of the bar, action, price, tag), in order."""


class TrailingStop:
    """Buys at the close of a bar that ``enter`` marks, and sells when a later low reaches the highest high since, less ``trail``.

    The stop of a bar comes from the bars before it; a bar that opens below it sells at its open.
    A bar that sells does not buy.  State: the highest price since the entry, None without a position.
    """

    columns = ["open", "high", "low", "close", "enter"]

    def __init__(self, trail: float):
        self.trail = trail

    def start(self) -> float | None:
        return None

    def on_bars(self, state, bars):
        opens, highs, lows, closes = (bars[c].astype(float) for c in ("open", "high", "low", "close"))
        enter = np.flatnonzero(bars["enter"].astype(bool))
        actions, at, n = [], 0, len(opens)
        while at < n:
            if state is None:  # straight to the next entry
                k = int(enter.searchsorted(at))
                if k == len(enter):
                    break
                at = int(enter[k])
                actions.append((at, "BUY", float(closes[at]), "ENTRY"))
                state, at = float(closes[at]), at + 1
                continue
            peaks = np.maximum.accumulate(np.r_[state, highs[at:]])  # before each bar from here on, and after the last
            stops = peaks[:-1] * (1 - self.trail)
            hit = np.flatnonzero(lows[at:] <= stops)
            if not len(hit):
                state = float(peaks[-1])
                break
            i = int(hit[0])
            actions.append((at + i, "SELL", float(min(opens[at + i], stops[i])), "TRAILING_STOP"))
            state, at = None, at + i + 1
        return state, actions


def apply_rule(bars: DataFrame, make, params: DataFrame) -> DataFrame:
    """Actions of ``make(**parameters)``, a Rule, for every series under every row of ``params`` (param_id and the parameters).

    More than MOST_SETS parameter sets are an error.  Rows of one time are taken in the order of their values.
    """
    sets = {r.param_id: {k: v for k, v in r.asDict().items() if k != "param_id"} for r in params.limit(MOST_SETS + 1).collect()}
    if len(sets) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} parameter sets")
    columns = make(**next(iter(sets.values()))).columns if sets else []
    keys = [*SERIES, "param_id"]
    schema = T.StructType.fromDDL(ACTION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rule, state = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            cuts = [*group_starts(table, keys).tolist(), b.num_rows]
            out = []
            for a, z in zip(cuts, cuts[1:], strict=False):
                now = tuple(b.column(k)[a].as_py() for k in keys)
                if now != key:
                    key, rule = now, make(**sets[now[2]])
                    state = rule.start()
                part = b.slice(a, z - a)
                state, actions = rule.on_bars(state, {c: part.column(c).to_numpy(zero_copy_only=False) for c in columns})
                ts = part.column("ts")
                out += [(*key, ts[i].as_py(), action, price, tag) for i, action, price, tag in actions]
            if out:
                kinds = [b.schema.field(c).type for c in (*keys, "ts")] + [pa.string(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    spread = bars.select(*SERIES, "ts", *columns).withColumn("param_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in sets]) if sets else F.array().cast("array<bigint>")))
    return spread.repartition(*keys).sortWithinPartitions(*keys, "ts", *columns).mapInArrow(run, schema)


ship(__name__)
