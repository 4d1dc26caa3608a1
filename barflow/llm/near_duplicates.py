"""Near-duplicate classes: DartMinHash signatures, banding, exact checks and components.

A text is the weighted set of its shingles of SHINGLE words (a shorter text: one shingle
of all its words); the weight of a shingle is its count, so its region is that many
unit slabs.  Darts are thrown by hash into slab x rank cells (ranks in doubling
intervals, a Poisson number of darts each), and each dart has a coordinate; the earliest
dart of a coordinate is the signature there.  A text needs about k ln k + 2k darts in
all, however many shingles it has; more ranks are looked at until every coordinate has one.
Equality at a coordinate has the probability of the weighted Jaccard likeness.

Texts with the same shingles are one node.  Nodes that agree in a band of ROWS
coordinates share a bucket; two nodes of a bucket are a link if their exact likeness is
SIMILARITY or more; classes are the connected components of links.  Buckets never form
all their pairs: the most central member of each is compared with the others first, and
components of these links become roots.  Members of buckets that still hold several
roots meet once more by a prefix filter: two sets that are alike enough share one of
their first shingles in any common order, and shingles that a single root holds stand
first in this order and cannot be shared between roots.  Only members of different
roots form pairs, in blocks of bounded size.  Where these could be many more than the
members' shingles, only pairs with a lead (a share of the members, by hash) are formed
at first, and linked roots become one before the next pass, with LEADS times as many
leads: a member with many links to a large root is in it after a few pairs.  All members
are leads in the last pass, so both steps are exact: no link between two classes that a
bucket holds is lost.  Members and the order of their shingles are those of the first
pass; roots that are linked later only take pairs away.

Defined cases: texts without a word are alike only if equal; a null text is alone; rows
count by their text, so rows that share a doc_id but not the text may be in different
classes and repeated rows are in one; a class is named by its least doc_id (null if no
row of it has one); ``kept`` keeps the row of the least doc_id, nulls last, of each class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, saved, ship

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
BASE = 2.0**-6  # width of the first interval of ranks
CHUNK_BYTES, CHUNK_TEXTS = 1_000_000, 1000  # texts handled at once
PAIR_BLOCK, SIZE_STEP = 1000, 1.05  # members of a block of pairs; ratio of two classes of sizes
POSSIBLE, LEADS = 0.25, 8  # possible pairs of a pass for each first shingle of a member; a pass's leads for each of the pass before
ALL = 0.5  # a share of leads that would hold three quarters of the pairs
U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Hashes of counted shingles, for a chunk of texts at a time, without a Python object a word."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.byte = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
        self.power = self.inverse = np.ones(1, U)
        self.place = mix(np.arange(1, size + 1, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)

    def powers(self, n: int) -> None:
        if len(self.power) < n:
            base = 0x2545F4914F6CDD1D
            self.power = np.cumprod(np.r_[U(1), np.full(n, base, U)])
            self.inverse = np.cumprod(np.r_[U(1), np.full(n, pow(base, -1, 2**64), U)])

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document number, unit) of each counted shingle of UTF-8 texts; a unit is a hash of shingle and count so far."""
        none = np.zeros(0, np.int64), np.zeros(0, U)
        if not len(data):
            return none
        self.powers(len(data) + 1)
        inside = ~SPACES[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets[:-1]] = True
        first = inside & (np.r_[True, ~inside[:-1]] | begins[:-1])
        starts = np.flatnonzero(first)
        if not len(starts):
            return none
        last = inside & np.r_[~inside[1:] | begins[1:-1], True]
        ends = np.flatnonzero(last) + 1
        total = np.r_[U(0), np.cumsum(self.byte[data] * self.power[: len(data)])]
        word = mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(U))
        doc = np.searchsorted(offsets, starts, side="right") - 1
        n, k = len(word), self.size
        padded_word, padded_doc = np.r_[word, np.zeros(k, U)], np.r_[doc, np.full(k, -1)]
        shingle = np.zeros(n, U)
        for j in range(k):
            shingle += np.where(padded_doc[j : j + n] == doc, mix(padded_word[j : j + n] + self.place[j]) * self.place[j], U(0))
        whole = padded_doc[k - 1 : k - 1 + n] == doc
        head = np.r_[True, doc[1:] != doc[:-1]]
        keep = whole | (head & ~whole)
        shingle, doc = mix(shingle[keep]), doc[keep]
        order = np.lexsort((shingle, doc))
        shingle, doc = shingle[order], doc[order]
        new = np.r_[True, (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])]
        at = np.arange(len(new))
        count = at - np.maximum.accumulate(np.where(new, at, 0))
        return doc, mix(shingle + count.astype(U) * U(0x9E3779B97F4A7C15))


def poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, ... to where the rest is nothing."""
    k = np.arange(int(mean + 12 * math.sqrt(mean) + 30))
    logs = -mean + k * math.log(mean) - np.array([math.lgamma(i + 1) for i in k])
    return np.cumsum(np.exp(logs))


class Darts:
    """DartMinHash signatures of k coordinates."""

    def __init__(self, k: int = BANDS * ROWS):
        self.k, self.tables = k, {}

    def throw(self, doc: np.ndarray, unit: np.ndarray, docs: int) -> np.ndarray:
        """Signature (docs x k) of the units of each document; all ones where it has none."""
        k = self.k
        best = np.full(docs * k, np.iinfo(U).max, U)
        sizes = np.bincount(doc, minlength=docs)
        with np.errstate(divide="ignore"):
            reach = (k * math.log(k) + 2 * k) / np.maximum(sizes, 1)
        level, low, width = 0, 0.0, BASE
        open_docs = sizes > 0
        while open_docs.any():
            on = open_docs[doc]
            if not on.all():
                doc, unit = doc[on], unit[on]
            if level not in self.tables:
                self.tables[level] = poisson_table(width)
            seed = mix(unit + U((level + 1) * 0xA0761D6478BD642F % 2**64))
            count = np.searchsorted(self.tables[level], (seed >> U(11)).astype(np.float64) * 2.0**-53, side="right")
            some = count > 0
            many = count[some]
            owner = np.repeat(doc[some], many)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            dart = mix(np.repeat(seed[some], many) + (number.astype(U) + U(1)) * U(0xE7037ED1A0B428DB))
            rank = (low + (dart >> U(40)).astype(np.float64) * 2.0**-24 * width).astype(np.float32)
            coordinate = (mix(dart) % U(k)).astype(np.int64)
            packed = (rank.view(np.uint32).astype(U) << U(32)) | (dart & U(0xFFFFFFFF))
            np.minimum.at(best, owner * k + coordinate, packed)
            low += width
            width = low  # intervals double
            level += 1
            # A document is done when it has looked far enough and every coordinate has its earliest dart.
            filled = (best.reshape(docs, k) != np.iinfo(U).max).all(1)
            open_docs &= ~((low >= reach) & filled)
        return best.reshape(docs, k)

    def bands(self, signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
        """One hash for each band of a signature."""
        n = len(signature)
        turns = mix(np.arange(1, rows + 1, dtype=U)) | U(1)
        return mix((mix(signature.reshape(n, -1, rows)) * turns).sum(2, dtype=U)).view(np.int64)


def chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of runs of texts, of bounded size but for a single long text."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        j = min(j, len(column), i + CHUNK_TEXTS)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _signed(texts: Iterator[pa.Array], bands: int, rows: int, size: int) -> Iterator[pa.Array]:
    """s1, s2 (two hashes of all shingles) and bands of each text; null for texts without a word."""
    shingler, darts = Shingler(size), Darts(bands * rows)
    for column in texts:
        out = []
        for data, offsets in chunks(column):
            n = len(offsets) - 1
            doc, unit = shingler.units(data, offsets)
            got = darts.bands(darts.throw(doc, unit, n), rows)
            has = np.bincount(doc, minlength=n) > 0
            sums = []
            for turn in (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)):
                total = np.zeros(n, U)
                np.add.at(total, doc, mix(unit ^ turn))
                sums.append(pa.array(total.view(np.int64)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * int(has.sum()) + 1, bands, dtype=np.int32)), pa.array(got[has].ravel(), pa.int64()))
            where = pa.array(np.where(has, np.cumsum(has) - 1, 0), pa.int64(), mask=~has)
            out.append(pa.StructArray.from_arrays([*sums, lists.take(where)], names=["s1", "s2", "bands"], mask=pa.array(~has)))
        yield pa.concat_arrays(out) if out else pa.array([], pa.struct([("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))]))


def _shingled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(rep, units): the units of each text."""
    shingler = Shingler(size)
    for batch in batches:
        out = []
        for data, offsets in chunks(batch.column("text")):
            n = len(offsets) - 1
            doc, unit = shingler.units(data, offsets)
            ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=n))].astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.view(np.int64))))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))], names=["rep", "units"])


def _stars(edges: DataFrame) -> bool:
    """Whether every node of edges (a, b) is either a root or has one edge, to a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    return not ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).filter("ups > low").agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b), a != b, that are not the least of their connected component: root is the least.

    Large-star and small-star steps in turn, until the edges are stars.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        old, edges = edges, saved(small, "edges")
        forget(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _links(pairs: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, ...) whose exact likeness is high enough."""
    left, right = units.select(F.col("rep").alias("a"), F.col("units").alias("x")), units.select(F.col("rep").alias("b"), F.col("units").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(right, "b").join(left, "a").filter(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both)).drop("x", "y")


def _central(buckets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of each bucket's most central member and the others, where sizes and own shingles leave room for a link."""
    members = buckets.select("key", F.struct("own", "rep", "n").alias("m"))  # the least: fewest shingles that no other text has
    first = members.groupBy("key").agg(F.min("m").alias("f"))
    room = F.least(F.col("m.n") - F.col("m.own"), F.col("f.n") - F.col("f.own"))
    near = (F.col("m.rep") != F.col("f.rep")) & (room >= _need(F.col("m.n"), F.col("f.n"), similarity))
    return members.join(first, "key").filter(near).select(F.col("f.rep").alias("a"), F.col("m.rep").alias("b")).distinct()


def _need(n: Column, m: Column, similarity: float) -> Column:
    """Shingles that sets of n and m must share to be alike enough."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (n + m) - F.lit(1e-6))


def _prefixes(torn: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """(rep, n, root, unit, p): the first shingles of each member that members of other roots hold too, with their places.

    The order is: shingles that a single root holds, then by rising number of members.
    """
    spread = torn.join(units, "rep").select("rep", "n", "root", F.explode("units").alias("unit"))
    held = spread.groupBy("unit").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
    met = spread.join(held.filter("low <> high").select("unit", "c"), "unit")
    lists = met.groupBy("rep", "n", "root").agg(F.sort_array(F.collect_list(F.struct("c", "unit"))).alias("us"))  # no longer than the text
    reach = F.col("n") - _need(F.col("n"), F.lit(similarity) * F.col("n"), similarity)  # the last place that any partner may ask for
    first = lists.withColumns({"before": F.col("n") - F.size("us"), "reach": reach}).filter("before <= reach")
    return first.select("rep", "n", "root", "before", F.posexplode(F.slice("us", F.lit(1), (F.col("reach") - F.col("before") + 1).cast("int"))).alias("i", "u")).select(
        "rep", "n", "root", "u.unit", (F.col("before") + F.col("i")).alias("p"))


def _sides(first: DataFrame, similarity: float, share: float) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Shorter sets, longer sets, the counts of both by key, and the keys, for the pairs that hold a lead.

    The shorter (or equal) set of a pair meets the longer one under a shingle and the
    class of the shorter one's size, which keeps first parts as short as they can be.  Shorter
    sets that are leads meet all longer ones (way 0), the others only leads (way 1).
    """
    step = math.log(SIZE_STEP)
    size_class = lambda n: F.floor(F.log(n) / F.lit(step)).cast("int")
    short = first.filter(F.col("p") <= F.col("n") - _need(F.col("n"), F.col("n"), similarity)).withColumn("size", size_class(F.col("n")))
    least = F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-6))
    long = first.withColumn("size", F.explode(F.sequence(size_class(F.greatest(least, F.lit(1))), size_class(F.col("n")))))
    shortest = F.greatest(least, F.floor(F.exp(F.col("size") * F.lit(step)) - F.lit(1e-6)))
    long = long.filter(F.col("p") <= F.col("n") - _need(F.col("n"), shortest, similarity))
    lead = F.pmod(F.xxhash64(F.lit("lead"), "rep"), F.lit(2**40)) < F.lit(share * 2.0**40)
    short = short.withColumn("way", F.when(lead, 0).otherwise(1))
    long = long.withColumn("way", F.explode(F.when(lead, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))) if share < 1 else F.lit(0))
    keys = ["unit", "size", "way"]
    both = short.select(*keys, "root", F.lit(1).alias("s"), F.lit(0).alias("l")).unionByName(long.select(*keys, "root", F.lit(0).alias("s"), F.lit(1).alias("l")))
    by_root = both.groupBy(*keys, "root").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    counts = by_root.groupBy(*keys).agg(F.max_by(F.struct("root", "s", "l"), F.struct("l", "root")).alias("top"), F.sum("s").alias("s"), F.sum("l").alias("l"))
    counts = counts.select(*keys, F.col("top.root").alias("top"), (F.col("s") - F.col("top.s")).alias("s0"), F.col("l").alias("l0"), F.col("top.s").alias("s1"), (F.col("l") - F.col("top.l")).alias("l1")).filter("s0 * l0 + s1 * l1 > 0")
    return short, long, counts, keys


def _share(first: DataFrame, similarity: float, before: float) -> float:
    """The share of leads for which possible pairs are about POSSIBLE times the rows of ``first``; at least LEADS times the share of the pass before.

    From ALL on it is 1: such a share leaves few pairs to a later pass.
    """
    possible = _sides(first, similarity, 1.0)[2].agg(F.sum(F.expr("double(s0) * l0 + double(s1) * l1"))).first()[0]
    share = max(LEADS * before, POSSIBLE * first.count() / possible) if possible else 1.0
    return share if share < ALL else 1.0


def _crossing(first: DataFrame, similarity: float, block: int = PAIR_BLOCK, share: float = 1.0) -> DataFrame:
    """Pairs (a, b, root_a, root_b) of members of different roots that share one of their first shingles; one of them is a lead.

    Under each key the commonest root's shorter sets only meet longer sets of other
    roots, and both sides are cut into blocks of about ``block`` members.
    """
    short, long, counts, keys = _sides(first, similarity, share)
    cuts = lambda c: F.ceil(c / F.lit(block)).cast("int")
    blocks = lambda c: F.sequence(F.lit(0), F.greatest(cuts(c), F.lit(1)) - F.lit(1))
    place = lambda c: F.pmod(F.xxhash64("rep"), F.greatest(cuts(c), F.lit(1))).cast("int")
    rest = F.col("root") != F.col("top")
    own = lambda rest_of, top_of: F.when(rest, F.col(rest_of)).otherwise(F.col(top_of))
    shorter = short.join(counts, keys).filter(own("l0", "l1") > 0).select(
        *keys, rest.alias("others"), place(own("s0", "s1")).alias("i"), F.explode(blocks(own("l0", "l1"))).alias("j"), F.struct("rep", "n", "root", "p").alias("x"))
    part = lambda others, s, l: F.struct(F.lit(others).alias("others"), place(F.col(l)).alias("j"), blocks(F.col(s)).alias("i"))
    parts = F.filter(F.array(F.when(F.col("s0") > 0, part(True, "s0", "l0")), F.when((F.col("s1") > 0) & rest, part(False, "s1", "l1"))), lambda x: x.isNotNull())
    longer = long.join(counts, keys).select(*keys, F.struct("rep", "n", "root", "p").alias("y"), F.explode(parts).alias("at")).select(*keys, "at.others", "at.j", F.explode("at.i").alias("i"), "y")
    need = _need(F.col("x.n"), F.col("y.n"), similarity)
    meet = (
        (F.col("x.root") != F.col("y.root")) & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rep") < F.col("y.rep"))))
        & (F.col("x.p") <= F.col("x.n") - need) & (F.col("y.p") <= F.col("y.n") - need)
    )
    found = shorter.join(longer, [*keys, "others", "i", "j"]).filter(meet)
    return found.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.root").alias("root_a"), F.col("y.root").alias("root_b")).distinct()


def _roots(signed: DataFrame, nodes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(rep, root) of the nodes that are linked to others, without the roots themselves."""
    entries = nodes.filter("kind = 0").select(F.col("first.rid").alias("rep"), F.posexplode("bands").alias("band", "value")).select("rep", F.xxhash64("band", "value").alias("key"))
    several = entries.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").select("key")
    found = saved(entries.join(several, "key").distinct(), "found")
    involved = found.select("rep").distinct()
    texts = signed.select(F.col("rid").alias("rep"), "text").join(involved, "rep", "left_semi")
    units = saved(texts.mapInArrow(lambda b: _shingled(b, shingle), "rep bigint, units array<bigint>"), "units")
    # Shingles that a text has to itself cannot be in any overlap: an exact bound on its likeness to every other text.
    alone = units.select("rep", F.explode("units").alias("unit")).groupBy("unit").agg(F.count("*").alias("c"), F.min("rep").alias("rep")).filter("c = 1").groupBy("rep").agg(F.count("*").alias("own"))
    sizes = units.select("rep", F.size("units").cast("bigint").alias("n")).join(alone, "rep", "left").select("rep", "n", F.coalesce("own", F.lit(0)).alias("own"))
    buckets = saved(found.join(sizes.filter(F.col("n") - F.col("own") >= F.lit(similarity) * F.col("n") - F.lit(1e-6)), "rep"), "buckets")

    # The most central member of each bucket against the others.
    roots = components(_links(_central(buckets, similarity), units, similarity)).withColumnRenamed("node", "rep")

    # Buckets that still hold several roots.
    now = buckets.join(roots, "rep", "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    open_keys = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    torn = saved(now.join(open_keys, "key", "left_semi").select("rep", "n", "root").distinct(), "torn")
    first = saved(_prefixes(torn, units, similarity), "prefixes")

    # More leads in each pass; the order of shingles stays, and those that a single root holds by now form no pairs.
    share, tops = 0.0, None
    while share < 1:
        now = _moved(first, tops)
        share = _share(now, similarity, share)
        links = _links(_crossing(now, similarity, share=share), units, similarity)
        joined = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))  # of roots, not of texts
        if joined.take(1):
            joined = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
            if tops is not None:
                joined = saved(tops.withColumnsRenamed({"root": "was", "top": "root"}).join(joined, "root", "left").select(F.col("was").alias("root"), F.coalesce("top", "root").alias("top")).unionByName(joined), "tops")
            tops = joined
    if tops is None:
        return roots
    return _moved(roots, tops).unionByName(tops.select(F.col("root").alias("rep"), F.col("top").alias("root")))


def _moved(members: DataFrame, tops: DataFrame | None) -> DataFrame:
    """``members`` with the tops of their roots."""
    if tops is None:
        return members
    return members.join(tops, "root", "left").withColumn("root", F.coalesce("top", "root")).select(members.columns)


def _classed(docs: DataFrame, similarity: float, shingle: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs`` saved with a number (rid) of each row, (kind, h1, h2, root, first) of each node, and (root, best) of each class."""

    @F.arrow_udf("s1 bigint, s2 bigint, bands array<bigint>")
    def sign(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _signed(texts, bands, rows, shingle)

    text = F.col("text")
    numbered = docs.withColumn("rid", F.monotonically_increasing_id()).withColumn("signed", sign(F.coalesce(text, F.lit(""))))
    # Kinds: texts with words by their shingles, texts without by themselves, null texts alone.
    keys = F.when(text.isNull(), F.struct(F.lit(2).alias("kind"), F.col("rid").alias("h1"), F.lit(0).cast("bigint").alias("h2"))) \
        .when(F.col("signed").isNull(), F.struct(F.lit(1).alias("kind"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))) \
        .otherwise(F.struct(F.lit(0).alias("kind"), F.col("signed.s1").alias("h1"), F.col("signed.s2").alias("h2")))
    signed = saved(numbered.withColumn("k", keys).select(*docs.columns, "rid", "k.kind", "k.h1", "k.h2", "signed.bands"), "signed")
    nodes = saved(signed.groupBy("kind", "h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"), F.first("bands").alias("bands")), "nodes")  # rows of a node have the same bands
    roots = _roots(signed, nodes, similarity, shingle)
    placed = nodes.withColumn("rep", F.col("first.rid")).join(roots, "rep", "left").select("kind", "h1", "h2", "first", F.coalesce("root", "rep").alias("root"))
    return signed, placed, placed.groupBy("root").agg(F.min("first").alias("best"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id (the least doc_id of the class) of each row of ``docs`` (doc_id, text)."""
    signed, placed, best = _classed(docs.select("doc_id", "text"), similarity, shingle, bands, rows)
    named = placed.join(best, "root").select("kind", "h1", "h2", F.col("best.doc_id").alias("class_id"))
    return signed.select("doc_id", "kind", "h1", "h2").join(named, ["kind", "h1", "h2"]).select("doc_id", "class_id")


def kept(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each class, with all its columns: that of the least doc_id."""
    names = {c: f"kept_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # other columns may have the names that are made here
    signed, _, best = _classed(docs.withColumnsRenamed(names), similarity, shingle, bands, rows)
    return signed.join(best.select(F.col("best.rid").alias("rid")), "rid", "left_semi").select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


ship(__name__)
