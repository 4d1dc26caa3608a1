"""Token counts by rank-synchronous merging of ragged numpy arrays.

The distinct words of a batch are held as one flat array of symbols.  In each step
every word that can still merge merges its lowest-ranked pair at all its places at once
(of overlapping places the leftmost first); words that cannot are counted and leave.
Where such a merge would make a pair of lower rank, which has to go before the other
places, the word merges its leftmost place only.  A text's count is the sum over its words.

Defined cases: null text counts as empty: 0 bytes, 0 tokens.  Rows keep their other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import built, shared, ship, slices
from .spm import Vocabulary, Words, code_points

OVER = 4096
#: Words kept with their counts in a worker, and texts merged at once.
CACHE_WORDS, BLOCK = 1_000_000, 1000
NEVER = np.iinfo(np.int32).max


def apart(hits: np.ndarray) -> np.ndarray:
    """Of rising places, those that merge when overlapping pairs go leftmost first: every other one of a run of neighbours."""
    first = np.r_[True, hits[1:] != hits[:-1] + 1]
    place = np.arange(len(hits))
    return hits[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]


class Counter:
    """Counts tokens; keeps the counts of words seen."""

    def __init__(self, vocabulary: Vocabulary):
        v, self.words = vocabulary, Words(vocabulary)
        self.n = len(v.text) + 4  # the last four stand for characters outside the vocabulary, by their UTF-8 length
        width = lambda c: 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        every = np.arange(0x110000)
        self.symbol = (len(v.text) - 1 + width(every)).astype(np.int32)
        singles = np.array([ord(p) for p in v.text[: v.singles]], np.int64)
        self.symbol[singles] = np.arange(v.singles)
        self.cost = np.array([len(x) for x in v.out] + [1, 2, 3, 4], np.int64)
        pairs = np.array([a * self.n + b for a, b in v.merge], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.merged = pairs[order], np.fromiter(v.merge.values(), np.int32, len(pairs))[order]
        self.seen: dict[str, int] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What each pair merges to, which is also its rank; NEVER if nothing."""
        if not len(self.pairs):
            return np.full(len(a), NEVER, np.int32)
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NEVER)

    def early(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Whether a merge would make a pair, with a neighbour as it is or merged alike, that goes before the places still to come."""
        again = len(at) > 1 and (owner[at[1:]] == owner[at[:-1]]).any()
        if not again:
            return np.zeros(len(at), bool)
        before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(symbols) - 1)
        left = np.where((at > 0) & (owner[before] == owner[at]), self.rank(symbols[before], made), NEVER)
        right = np.where((after == at + 2) & (owner[after] == owner[at]), self.rank(made, symbols[after]), NEVER)
        return np.minimum(np.minimum(left, right), self.rank(made, made)) < made

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each (non-empty) word."""
        total = np.zeros(len(words), np.int64)
        points, lengths = code_points(words)
        symbols, owner = self.symbol[points], np.repeat(np.arange(len(words)), lengths)
        ranks = np.full(len(symbols), NEVER, np.int32)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            if (done := least == NEVER).any():
                gone = np.repeat(done, sizes)
                np.add.at(total, owner[gone], self.cost[symbols[gone]])
                symbols, ranks, owner = symbols[~gone], ranks[~gone], owner[~gone]
                least, sizes = least[~done], sizes[~done]
                if not len(symbols):
                    break
            hits = np.flatnonzero(ranks == np.repeat(least, sizes))
            at = apart(hits)
            risky = self.early(symbols, owner, at, ranks[at])
            if risky.any():  # these words go one place at a time
                at = at[np.r_[True, owner[at[1:]] != owner[at[:-1]]] | ~np.isin(owner[at], owner[at[risky]])]
            symbols[at] = ranks[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, ranks, owner = symbols[keep], ranks[keep], owner[keep]
            at = at - np.arange(len(at))  # each merge took away one symbol behind it
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(symbols) - 1)
                joined = (right > left) & (owner[left] == owner[right])
                ranks[left] = np.where(joined, self.rank(symbols[left], symbols[right]), NEVER)
        return total

    def texts(self, texts: list[str | None]) -> list[int]:
        split = [self.words.split(t) for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.seen))
        if len(self.seen) + len(new) > CACHE_WORDS:
            self.seen.clear()
            new = list(set(chain.from_iterable(split)))
        if new:
            self.seen.update(zip(new, self.count(new).tolist(), strict=True))
        return [sum(map(self.seen.__getitem__, ws)) for ws in split]


def token_counts(docs: DataFrame, model: bytes, text: str = "text", over: int = OVER) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (replacing columns of these names)."""
    source = shared(docs.sparkSession, model)

    @F.arrow_udf("bigint")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = built(source, lambda data: Counter(Vocabulary(data)))
        for column in batches:
            yield pa.array([n for texts in slices(column, BLOCK, 2_000_000) for n in counter.texts(texts)], pa.int64())

    n = n_tokens(F.coalesce(F.col(text), F.lit("")))
    return docs.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint"), "n_tokens": n}).withColumn("over_limit", F.col("n_tokens") > over)


ship(__name__)
