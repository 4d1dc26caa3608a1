"""SentencePiece encoding by backtracking, and decoding.

A word is encoded left to right: take the longest match of an Aho-Corasick automaton,
accept it if it may follow the piece before it, else try the next shorter one; if none fits, mark the place as failed in a bit field, drop the
last piece and go on from there.  Two pieces may be neighbours if merging their joined
text again would give just these two; that is found by undoing their merges from the
latest back, and kept for each pair.

Defined cases: null text is the empty text, with no ids; characters outside the
vocabulary become bytes; a vocabulary mark in a text decodes as a space, as the
library has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import built, shared, ship, slices
from .spm import MARK, Vocabulary, Words

#: Bounds of what a worker keeps, and rows of one output batch.
CACHE_WORDS, CACHE_PAIRS, BATCH = 300_000, 200_000, 100


class Codec:
    """Encodes words and keeps what they gave."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.words = vocabulary, Words(vocabulary)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, str] = {}  # ids, joined by commas
        self.odd: dict[str, str] = {}  # decoded texts of words that are not just themselves with spaces for marks
        # The two parts that each symbol is made of, when its text is merged alone.
        self.parts: list[tuple[int, int] | None] = [None] * len(vocabulary.text)
        self.matches = ahocorasick.Automaton()
        for s, p in enumerate(vocabulary.text):
            if s >= vocabulary.singles and not self.derive(s, p):
                continue  # merging never gives this piece
            self.matches.add_word(p, (s, len(p)))
        self.matches.make_automaton()
        self.reachable = {p: s for p, (s, _) in self.matches.items()}
        self.size = [len(p) for p in vocabulary.text]
        self.most = max(self.size)
        # The longest shorter piece that each one starts with, -1 if there is none.
        self.shorter = [next((self.reachable[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reachable), -1) for p in vocabulary.text]
        # Decimal id and decoded text by symbol and by id; characters that are pieces themselves.
        self.of_symbol = [(str(x[0]), p.replace(MARK, " ")) for x, p in zip(vocabulary.out, vocabulary.text, strict=True)]
        self.of_id = {x[0]: y for x, y in zip(vocabulary.out, self.of_symbol, strict=True) if len(x) == 1}
        self.byte_of = {x: b for b, x in enumerate(vocabulary.byte)}
        self.plain = {p for p, x in zip(vocabulary.text, vocabulary.out, strict=True) if len(p) == 1 and x[0] not in self.byte_of}

    def derive(self, s: int, p: str) -> bool:
        """Find the last merge that makes symbol s from its own text; False if merging ends elsewhere."""
        now, merge = [self.v.symbol[c] for c in p], self.v.merge
        while len(now) > 1:
            best, at = min(((merge.get((a, b), 1 << 40), i) for i, (a, b) in enumerate(zip(now, now[1:], strict=False))), default=(1 << 40, 0))
            if best == 1 << 40:
                return False
            if len(now) == 2:
                self.parts[s] = (now[0], now[1])
            now[at : at + 2] = [best]
        return now[0] == s

    def fits(self, a: int, b: int) -> bool:
        """Whether the joined text of two symbols merges to just these two."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        limit, merge, parts = 1 << 40, self.v.merge, self.parts
        while True:
            if merge.get((a, b), 1 << 40) < limit:
                return False  # before one of the two was whole, this merge would have come first
            later = a > b
            if (parts[a] if later else parts[b]) is None:
                later = not later
                if (parts[a] if later else parts[b]) is None:
                    return True
            if later:
                limit, a = a, parts[a][1]
            else:
                limit, b = b + 1, parts[b][0]

    def symbols(self, word: str) -> list[int]:
        """Symbols of a text whose characters are all in the vocabulary."""
        longest = [s for _, (s, _) in self.matches.iter_long(word)]
        known, last = self.pairs, None
        for good, s in enumerate(longest):  # the longest matches one after another, as far as they fit
            if last is not None and not (known.get((last, s)) or self.fits(last, s)):
                break
            last = s
        else:
            return longest
        n, size, shorter, fits = len(word), self.size, self.shorter, self.fits
        starts, at = {}, 0  # the longest match at each place looked at
        for s in longest:
            starts[at] = s
            at += size[s]
        out = longest[:good]
        at = sum([size[s] for s in out])
        failed, s = bytearray(n // 8 + 1), longest[good]  # a bit for each place from which nothing fits
        last = out[-1] if out else None
        while True:
            end = at + size[s]
            if not failed[end >> 3] >> (end & 7) & 1 and (last is None or (fits(last, s) if (fit := known.get((last, s))) is None else fit)):
                out.append(s)
                if end == n:
                    return out
                at, last, s = end, s, starts.get(end)
                if s is None:
                    s = starts[end] = next(self.matches.iter_long(word[end : end + self.most]))[1][0]
                continue
            s = shorter[s]  # the next shorter piece
            if s < 0:  # none fits here after the last piece
                failed[at >> 3] |= 1 << (at & 7)
                s = out.pop()
                at -= size[s]
                last = out[-1] if out else None

    def ids(self, word: str) -> list[int]:
        """Ids of a word: those of its symbols, and bytes for characters outside the vocabulary."""
        v, ids, start = self.v, [], 0
        for i in range(len(word) + 1):
            if i == len(word) or word[i] not in v.symbol:
                if i > start:
                    ids += [x for s in self.symbols(word[start:i]) for x in v.out[s]]
                if i < len(word):
                    ids += [v.byte[b] for b in word[i].encode("utf-8", "surrogatepass")]
                start = i + 1
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of a word's ids, marks as spaces: pieces as they are, runs of bytes as UTF-8."""
        out, run = [], bytearray()
        for x in ids:
            if x in self.byte_of:
                run.append(self.byte_of[x])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.of_id[x][1])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def word(self, word: str) -> tuple[str, str]:
        """The ids joined by commas and the text they decode to."""
        if self.plain.issuperset(word):
            got = [self.of_symbol[s] for s in self.symbols(word)]
            return ",".join([x[0] for x in got]), "".join([x[1] for x in got])
        ids = self.ids(word)
        return ",".join(map(str, ids)), self.decode(ids)

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, ids joined by commas and decoded text, of each text."""
        seen, odd = self.seen, self.odd
        for t in texts:
            words = self.words.split(t)
            if len(seen) > CACHE_WORDS:
                seen.clear()
                odd.clear()
            for w in words:
                if w not in seen:
                    seen[w], back = self.word(w)
                    if back != w.replace(MARK, " "):
                        odd[w] = back
            ids = ",".join([seen[w] for w in words])
            if odd and not odd.keys().isdisjoint(words):
                text = "".join([odd[w] if w in odd else w.replace(MARK, " ") for w in words])
            else:
                text = "".join(words).replace(MARK, " ")
            yield (ids.count(",") + 1 if ids else 0), ids, text[1:] if text.startswith(" ") else text


def _rows(batches: Iterator[pa.RecordBatch], source, text: str, digest: bool) -> Iterator[pa.RecordBatch]:
    """Batches with the made columns added, a bounded number of rows at a time."""
    codec = built(source, lambda data: Codec(Vocabulary(data)))
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        at = 0
        for block in slices(batch.column(text), BATCH):
            counts, ids, ends, decoded = [], [], [0], []
            for n, joined, back in codec.texts(block):
                counts.append(n)
                if digest:
                    ids.append(sha(joined))
                    decoded.append(sha(back))
                else:
                    ids.append(np.array(joined.split(",") if joined else [], np.int32))
                    ends.append(ends[-1] + n)
                    decoded.append(back)
            made = [pa.array(counts, pa.int64()), pa.array(ids, pa.string()) if digest else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids))), pa.array(decoded, pa.string())]
            part = batch.slice(at, len(block))
            at += len(block)
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])


def encode_decode(docs: DataFrame, model: bytes, text: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` with n_tokens and, of each text, its ids (array of int) and decoded text (replacing columns of these names).

    ``digest``: instead of ids and text their SHA-256, ids_sha256 (of the decimal ids
    joined by commas) and decoded_sha256 (of UTF-8), so that only digests leave the workers.
    """
    source = shared(docs.sparkSession, model)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
    kinds = ["bigint", "string", "string"] if digest else ["bigint", "array<int>", "string"]
    docs = docs.drop(*[n for n in names if n != text])
    schema = T.StructType([*docs.schema.fields, *[f for n, k in zip(names, kinds, strict=True) for f in T.StructType.fromDDL(f"{n} {k}").fields]])
    return docs.mapInArrow(lambda b: _rows(b, source, text, digest), schema)


ship(__name__)
