"""Benchmark decontamination by a generalised suffix automaton of test items.

Texts are lower-cased (A-Z) and split into words of digits, letters and characters
beyond ASCII.  The automaton of all items' words tells, word by word of a training text,
the longest run of words ending there that some item holds.  Where that run reaches the
window (LENGTH words, or all of a shorter item), its words are hit.  ``remove`` takes the
hit spans out of a text and drops texts of which more than a share is hit.

Items of any total size are taken in blocks of BLOCK_WORDS words, each with an automaton
of its own, AT_ONCE of them in a pass over the texts; long items are cut into pieces that
overlap by a window less one word, so that no window is lost.

Defined cases: a null or empty text has no words and is clean; an item without words, or
a null one, has no window; a null item_id's windows make words hit but name no item;
repeated items and ids count once; the documents' other columns stay, but for those made here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import built, saved, shared, ship, slices

LENGTH, MAX_SHARE, BLOCK_WORDS, AT_ONCE, PIECE_WORDS = 10, 0.5, 200_000, 4, 5000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 as they count in words: lower case, and a space for what is no word character.
BYTES = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
CHUNK = 1 << 20


def normal_words(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), SEPARATORS), lambda w: w != "")


def learn(pieces: list[tuple[int | None, list[str]]], length: int = LENGTH) -> dict:
    """Generalised suffix automaton of (item_id, words) as plain data, with the items of each window."""
    vocabulary: dict[str, int] = {}
    codes = [[vocabulary.setdefault(w, len(vocabulary)) for w in words] for _, words in pieces]
    to: list[dict[int, int]] = [{}]
    link, size = [-1], [0]

    def split(p: int, q: int, c: int) -> int:
        """The state of the longest match of p with c, cut out of q where q holds longer ones."""
        if size[q] == size[p] + 1:
            return q
        copy = len(to)
        to.append(dict(to[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        while p >= 0 and to[p].get(c) == q:
            to[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    for words in codes:
        last = 0
        for c in words:
            if c in to[last]:
                last = split(last, to[last][c], c)
                continue
            now, p = len(to), last
            to.append({})
            size.append(size[last] + 1)
            link.append(0)
            while p >= 0 and c not in to[p]:
                to[p][c] = now
                p = link[p]
            if p >= 0:
                link[now] = split(p, to[p][c], c)
            last = now
    owners: set[tuple[int, int, int | None]] = set()  # state, words of the window, item
    for (item, _), words in zip(pieces, codes, strict=True):
        k = min(length, len(words))
        state = 0
        for i, c in enumerate(words):
            state = to[state][c]
            if i + 1 >= k:
                while size[link[state]] >= k:
                    state = link[state]
                owners.add((state, k, item))
    width = max(len(vocabulary), 1)
    return {
        "words": [w.encode() for w in vocabulary], "length": length,
        "keys": np.fromiter((s * width + c for s, t in enumerate(to) for c in t), np.int64), "ends": np.fromiter((e for t in to for e in t.values()), np.int32),
        "link": np.array(link, np.int32), "size": np.array(size, np.int32), "owners": sorted(owners, key=lambda o: (o[0], o[1], o[2] is not None, o[2] or 0)),
    }


class Matcher:
    """Streams texts through an automaton that ``learn`` gave."""

    def __init__(self, data: dict):
        self.code = {w: i for i, w in enumerate(data["words"])}
        self.width = max(len(self.code), 1)
        self.go = dict(zip(data["keys"].tolist(), data["ends"].tolist(), strict=True))
        self.link, self.size = data["link"].tolist(), data["size"].tolist()
        self.items: dict[int, dict[int, set]] = {}
        for state, k, item in data["owners"]:
            self.items.setdefault(state, {}).setdefault(k, set()).add(item)
        self.least = min((k for _, k, _ in data["owners"]), default=1 << 60)
        self.near: dict[int, int] = {}

    def owner(self, state: int) -> int:
        """The nearest of ``state`` and the states of its suffixes that holds a window, 0 if none does."""
        got = self.near.get(state)
        if got is None:
            got = state
            while got and got not in self.items:
                got = self.link[got]
            self.near[state] = got
        return got

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, merged runs of hit words (end exclusive), items with a window in the text."""
        get, link, size, width, code, least = self.go.get, self.link, self.size, self.width, self.code, self.least
        state = match = n = 0
        spans: list[tuple[int, int]] = []
        found: set[tuple[int, int]] = set()
        for words in chunks(text.encode("utf-8", "surrogatepass").translate(BYTES)):
            for c in map(code.get, words):
                n += 1
                if c is None:
                    state = match = 0
                    continue
                after = get(state * width + c)
                while after is None:  # the root knows every word of the vocabulary
                    state = link[state]
                    match = size[state]
                    after = get(state * width + c)
                state = after
                match += 1
                if match >= least:
                    at = self.owner(state)
                    while at:
                        for k in self.items[at]:
                            if k <= match:
                                found.add((at, k))
                                a = n - k
                                while spans and spans[-1][1] >= a:
                                    a = min(a, spans.pop()[0])
                                spans.append((a, n))
                        at = self.owner(link[at])
        return n, spans, set().union(*[self.items[s][k] for s, k in found]) - {None}


def chunks(data: bytes) -> Iterator[list[bytes]]:
    """The words of normalised bytes, a bounded run of bytes (or one word) at a time."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """``text`` without runs of hit words, and these runs in code points (end exclusive)."""
    if not spans:
        return text, []
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(BYTES), np.uint8) != 32
    edges = np.diff(np.r_[False, inside, False].astype(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    ends = [(int(first[a]), int(last[b - 1])) for a, b in spans]
    left = b"".join(raw[a:b] for a, b in zip([0, *[b for _, b in ends]], [*[a for a, _ in ends], len(raw)], strict=True))
    return left.decode("utf-8", "surrogatepass"), [(int(points[a]), int(points[b])) for a, b in ends]


def pieces_of(items: DataFrame, length: int = LENGTH, size: int = PIECE_WORDS) -> DataFrame:
    """item_id, words of the items, long ones in pieces of ``size`` windows."""
    ws = items.select("item_id", normal_words(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    last = F.greatest(F.size("_w") - F.lit(length), F.lit(0))
    cut = ws.select("item_id", "_w", F.explode(F.sequence(F.lit(0), last, F.lit(size))).alias("_from"))
    return cut.select("item_id", F.slice("_w", F.col("_from") + 1, F.lit(size + length - 1)).alias("words"))


def windows(docs: DataFrame, items: DataFrame, text: str = "text", length: int = LENGTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, hits (array of runs of hit words) and items (ids with a window in the text), replacing columns of these names."""
    spark = docs.sparkSession
    pieces = pieces_of(items, length)
    blocks = -(-(pieces.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words)
    if blocks > 1:
        pieces = saved(pieces.withColumn("_block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks))), "items")
    made = ["n_words", "hits", "items"]
    out = docs.drop(*[c for c in made if c != text])

    def matcher(block: int):
        rows = pieces if blocks <= 1 else pieces.filter(F.col("_block") == block)
        source = shared(spark, learn([(r.item_id, r.words) for r in rows.select("item_id", "words").collect()], length))  # about BLOCK_WORDS words

        @F.arrow_udf("n_words bigint, hits array<struct<start: bigint, end: bigint>>, items array<bigint>")
        def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            found = built(source, Matcher)
            hit = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            for column in batches:
                rows = [found.scan(t) for texts in slices(column) for t in texts]
                yield pa.StructArray.from_arrays(
                    [pa.array([n for n, _, _ in rows], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in rows], hit), pa.array([sorted(i) for _, _, i in rows], pa.list_(pa.int64()))],
                    names=made)

        return scan(F.coalesce(F.col(text), F.lit("")))

    for k in range(max(blocks, 1)):
        out = out.withColumn(f"_found{k}", matcher(k))
        if k:  # what the blocks have found so far, in one column
            both = F.struct(F.col("_found0.n_words").alias("n_words"), F.concat("_found0.hits", f"_found{k}.hits").alias("hits"), F.array_union("_found0.items", f"_found{k}.items").alias("items"))
            out = out.withColumn("_found0", both).drop(f"_found{k}")
            out = saved(out, "scanned") if k % AT_ONCE == 0 else out
    merged = F.col("_found0.hits") if blocks <= 1 else F.aggregate(F.array_sort("_found0.hits"), F.array().cast("array<struct<start: bigint, end: bigint>>"), _merge)
    return out.withColumns({"n_words": F.col("_found0.n_words"), "hits": merged, "items": F.col("_found0.items")}).drop("_found0")


def _merge(runs: Column, x: Column) -> Column:
    """Sorted runs with one more, joined to the last if they touch."""
    last = F.get(runs, F.size(runs) - 1)
    rest = F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0)))
    longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
    return F.when((F.size(runs) > 0) & (last["end"] >= x["start"]), F.array_append(rest, longer)).otherwise(F.array_append(runs, x))


def measured(found: DataFrame) -> DataFrame:
    """``windows`` with n_hit, n_items and contaminated."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("bigint"), "contaminated": F.size("hits") > 0})


def remove(docs: DataFrame, items: DataFrame, text: str = "text", length: int = LENGTH, max_share: float = MAX_SHARE) -> DataFrame:
    """``docs`` with the measures, spans (code points taken out), clean_text, and kept: no more than ``max_share`` of the words were hit."""

    @F.arrow_udf("clean_text string, spans array<struct<start: bigint, end: bigint>>")
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for texts, hits in batches:
            rows = [cut(t, [(h["start"], h["end"]) for h in hs]) for t, hs in zip(texts.to_pylist(), hits.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([[{"start": a, "end": b} for a, b in s] for _, s in rows], kind)], names=["clean_text", "spans"])

    made = ["n_hit", "n_items", "contaminated", "spans", "clean_text", "kept"]
    got = measured(windows(docs.drop(*[c for c in made if c != text]), items, text, length))
    done = got.withColumn("_cut", apply(F.coalesce(F.col(text), F.lit("")), F.col("hits")))
    return done.withColumns({"clean_text": F.col("_cut.clean_text"), "spans": F.col("_cut.spans"), "kept": F.col("n_hit") <= F.lit(max_share) * F.col("n_words")}).drop("_cut")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query; items by the order of their decimal ids as text."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return measured(found).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


#: Words in DuckDB, the windows of items, and every place of a document where one begins.
SQL = r"""
with dw as (
  select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from documents),
iw as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w
  from benchmark),
wins as (
  select distinct item_id, k, w[i:i + k - 1] as win
  from (select item_id, w, least(len(w), 10) as k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from iw where len(w) > 0)),
sizes as (select distinct k from wins),
starts as (
  select r, i, k, w[i:i + k - 1] as win
  from (select r, w, unnest(range(1, len(w) + 1)) as i from dw), sizes where i + k - 1 <= len(w)),
found as (select r, i, k, item_id from starts join wins using (k, win)),
hit as (select r, count(distinct p)::bigint as n_hit from (select r, unnest(range(i, i + k)) as p from found) group by r),
named as (select r, count(distinct item_id)::bigint as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from found group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit using (r) left join named using (r)
"""

ship(__name__)
