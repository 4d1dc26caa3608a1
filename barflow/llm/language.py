"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives, from any place of a text,
the longest match that the labelled text holds.  A text is parsed into such matches
one after another; each phrase costs about log2(training length) bits, and the language
that needs the fewest bits a character wins.

Text is lower-cased, letters stay, and each run of other characters is one separator.
Whole texts are parsed, in blocks of BLOCK characters that all advance together (a
phrase ends at a block's end).  Each language has an alphabet of its own, all letters of
its labelled text; a letter that it does not hold ends a phrase there.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is
every text if there is no labelled text.  Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import built, saved, shared, ship, slices

#: Bounds of the labelled sample: documents and characters for each language, and languages; longer texts than TRAIN_DOC_CHARS come last.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_DOC_CHARS, LANGUAGES, BLOCK = 64, 40_000, 4_000, 1000, 1024
#: Transitions of an alphabet of up to so many symbols are a full table, those of a larger one a sorted list.
DENSE = 64
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def automaton(codes: list[int], width: int) -> dict:
    """Suffix automaton of ``codes`` (below ``width``) as plain arrays: transitions by state * width + code, and those of the root."""
    to, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        now, p = len(to), last
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in to[p]:
            to[p][c] = now
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    root = np.zeros(width, np.int32)
    root[list(to[0])] = list(to[0].values())
    keys = np.fromiter((s * width + c for s, t in enumerate(to) for c in sorted(t)), np.int64)
    return {"states": len(to), "width": width, "root": root, "keys": keys, "ends": np.fromiter((t[c] for t in to for c in sorted(t)), np.int32)}


class Automaton:
    """Transitions of a suffix automaton: a full table of a small alphabet, else the sorted list."""

    def __init__(self, states: int, width: int, root: np.ndarray, keys: np.ndarray, ends: np.ndarray):
        self.width, self.root, self.dense = width, root, width <= DENSE
        if self.dense:
            self.flat = np.full(states * width, -1, np.int32)
            self.flat[keys] = ends
        else:  # a last key that nothing asks for
            self.keys, self.ends = np.r_[keys, np.iinfo(np.int64).max], np.r_[ends, np.int32(-1)]

    def after(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The state after each symbol, -1 where there is none."""
        if self.dense:
            return self.flat[state * self.width + c]
        key = state.astype(np.int64) * self.width + c
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ends[at], np.int32(-1))


class Parser:
    """Parses texts into phrases of each language; made of labelled texts, or of the ``data`` of such a parser."""

    def __init__(self, texts: dict[str, str] | None = None, data: dict | None = None):
        self.texts = {k: texts[k] for k in sorted(texts or {})}
        self.data = data or self.learn()

    def learn(self) -> dict:
        """Letters and, by language, the automaton of its labelled text: plain arrays of bounded size."""
        self.letters("".join(sorted(c for c in set("".join(self.texts.values()).lower()) if c.isalpha())))
        tables = {}
        for k, t in self.texts.items():
            codes = self.codes(t)[:TRAIN_CHARS]
            if len(codes):
                held = np.unique(codes)
                own = np.zeros(self.known + 2, np.int32)
                own[held] = np.arange(1, len(held) + 1)
                tables[k] = {"size": len(codes), "held": held, "table": automaton(own[codes].tolist(), len(held) + 1)}
        return {"letters": self.alphabet, "tables": tables}

    def letters(self, alphabet: str) -> None:
        """Symbols of characters: 0 separator, 1 a letter that is in no labelled text, then the letters."""
        self.alphabet, self.known = alphabet, len(alphabet)
        self.symbol = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8 if self.known < 254 else np.uint32, 0x110000)
        self.symbol[[ord(c) for c in alphabet]] = np.arange(2, self.known + 2)

    def prepare(self) -> "Parser":
        self.letters(self.data["letters"])
        tables = self.data["tables"]
        self.langs = list(tables)
        self.bits = np.array([np.log2(x["size"] + 1) for x in tables.values()])
        self.owns, self.tables = [], []
        for x in tables.values():
            own = np.zeros(self.known + 2, np.int32)  # 0: not held by this language
            own[x["held"]] = np.arange(1, len(x["held"]) + 1)
            self.owns.append(own)
            self.tables.append(Automaton(**x["table"]))
        return self

    def codes(self, text: str) -> np.ndarray:
        """Symbols of a text, runs of separators as one."""
        got = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        return got[np.r_[True, (got[1:] != 0) | (got[:-1] != 0)]] if len(got) else got

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text needs in each language."""
        total = np.zeros((len(codes), len(self.langs)))
        pieces = [(i, c[k : k + BLOCK]) for i, c in enumerate(codes) for k in range(0, len(c), BLOCK)]
        if not pieces:
            return total
        pieces.sort(key=lambda x: -len(x[1]))
        lengths = np.array([len(p) for _, p in pieces])
        grid = np.zeros((lengths[0], len(pieces)), self.symbol.dtype)
        for k, (_, p) in enumerate(pieces):
            grid[: len(p), k] = p
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        owner = np.array([i for i, _ in pieces])
        for lang, (own, table) in enumerate(zip(self.owns, self.tables, strict=True)):
            state, count = np.zeros(len(pieces), np.int32), np.ones(len(pieces), np.int64)
            for step in range(lengths[0]):
                n = active[step]
                c = own[grid[step, :n]]
                after = table.after(state[:n], c)
                ends = after < 0
                count[:n] += ends
                state[:n] = np.where(ends, table.root[c], after)
            np.add.at(total[:, lang], owner, count)
        return total

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        codes = [self.codes(t) for t in texts]
        known = [bool(len(c)) and bool(c.any()) for c in codes]
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        bits = self.phrases([c if k else c[:0] for c, k in zip(codes, known, strict=True)]) * self.bits
        out = []
        for k, row in zip(known, bits, strict=True):
            if not k:
                out.append((UNKNOWN, 0.0))
                continue
            best, *rest = np.argsort(row, kind="stable")
            out.append((self.langs[best], float(1 - row[best] / row[rest[0]]) if rest else 1.0))
        return out


def labelled_sample(docs: DataFrame) -> dict[str, str]:
    """For each language, whole labelled texts in bounded amount, from documents that are not held out.

    Texts come in the order of a hash of their id, those longer than TRAIN_DOC_CHARS after
    all others, until TRAIN_DOCS or TRAIN_CHARS are reached.  More than LANGUAGES languages are an error.
    """
    size = F.length("text")
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", F.xxhash64("text").alias("of_text"), size.alias("size"))
    order = [(F.col("size") > TRAIN_DOC_CHARS), F.xxhash64("doc_id"), F.col("doc_id"), F.col("of_text")]
    chosen = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("n") <= TRAIN_DOCS)
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    chosen = saved(chosen.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < TRAIN_CHARS).select("doc_id", "lang", "of_text", "n"), "labelled")
    if chosen.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    named = docs.select("doc_id", "lang", "text").withColumn("of_text", F.xxhash64("text"))
    texts = named.join(F.broadcast(chosen), ["doc_id", "lang", "of_text"]).select("lang", "n", "text").dropDuplicates(["lang", "n"]).collect()  # TRAIN_DOCS for each language at most
    by: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r.lang, r.n)):
        by.setdefault(r.lang, []).append(r.text)
    return {k: "\n".join(v) for k, v in by.items()}


def identify(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """``docs`` with held_out, lang_pred and score (replacing columns of these names).

    ``docs`` has doc_id and text, ``train`` (``docs`` if None) doc_id, text and lang.
    """
    learned = shared(docs.sparkSession, Parser(labelled_sample(docs if train is None else train)).data)

    @F.arrow_udf("lang_pred string, score double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = built(learned, lambda data: Parser(data=data).prepare())
        for column in batches:
            rows = [x for texts in slices(column, 2000, 4_000_000) for x in parser.judge(texts)]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.float64())], names=["lang_pred", "score"])

    # As of unknown outcome: else a filter on lang_pred goes below this column, and each text is parsed twice, by two workers a task.
    got = docs.withColumn("_judged", judge.asNondeterministic()(F.coalesce(F.col("text"), F.lit(""))))
    return got.withColumns({"held_out": held_out(F.col("doc_id")), "lang_pred": F.col("_judged.lang_pred"), "score": F.col("_judged.score")}).drop("_judged")


ship(__name__)
