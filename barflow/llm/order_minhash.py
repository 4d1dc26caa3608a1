"""Order MinHash fingerprints with DataFrame functions only.

A text is the sequence of its words (a word longer than ``piece`` code points
counts as several pieces).  Its k-mers of ``k`` consecutive words are numbered by
occurrence, so the elements of one text are distinct.  Each of ``sketches`` hash
functions orders the elements; its two least are put back into text order and
hashed as a pair.  Two texts agree in a signature only if they share the chosen
elements *and* their order, so the share of equal signatures falls with the edit
distance, not just with the overlap of sets.

Defined cases: null text is the empty text; the empty text has the fingerprint of
no element (all texts without a word are alike); texts of fewer than ``k`` words have
one k-mer of all their words, and pairs of it alone; equal texts have equal
fingerprints; repeated rows each get a row; other columns do not matter.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, saved

K, SKETCHES, PIECE = 5, 32, 24
#: Bits of a hash that a place takes in sorted arrays, and bits of any place of a text.
POS_BITS, PLACE_BITS = 30, 30
POS = (1 << POS_BITS) - 1
#: Elements that a hash function is expected to leave below its bound; fewer than two do three times in 10^12, and such texts are done again without a bound.
LEFT = 30
#: Rows of one ordered bucket, and most buckets (their bounds are 8 bytes each in the plan; beyond 65 million rows buckets grow, and their sort spills).
BUCKET_ROWS, MAX_BUCKETS = 1000, 65536


def pieces(text: Column, piece: int = PIECE) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([^\\x20\\x09-\\x0D]{{1,{piece}}})"), F.lit(1))


def _kmers(ws: Column, k: int) -> Column:
    """Hash of the k words from each place (of those there are, at the end of a text shorter than k)."""
    last = F.greatest(F.size(ws) - F.lit(k), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(ws, i + F.lit(j) if j else i) for j in range(k)]))


def _numbered(hashes: Column) -> Column:
    """Hash of (k-mer, occurrence number) at each place; only texts with repeated k-mers come here.

    In the sorted array of hash bits and places, equal k-mers form runs in text order,
    so the occurrence numbers of a run are 0, 1, ... to its length.
    """
    bits = lambda s, i: F.shiftright(F.get(s, i), POS_BITS)
    packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~POS)).bitwiseOR(i.cast("bigint"))))

    def occurrences(s: Column) -> Column:
        """By place: place and occurrence number in one long, sorted."""
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - F.lit(1)), lambda i: (i == 0) | (bits(s, i) != bits(s, i - F.lit(1))))
        runs = let(starts, lambda f: F.flatten(F.transform(f, lambda x, j: F.sequence(F.lit(0), F.coalesce(F.get(f, j + F.lit(1)), F.size(s)) - x - F.lit(1)))))
        return F.sort_array(F.zip_with(s, runs, lambda x, o: F.shiftleft(x.bitwiseAND(F.lit(POS)), POS_BITS).bitwiseOR(o.cast("bigint"))))

    return F.zip_with(hashes, let(packed, occurrences), lambda h, o: F.when(o.bitwiseAND(F.lit(POS)) == 0, h).otherwise(F.xxhash64(h, o.bitwiseAND(F.lit(POS)))))


def elements(text: Column, k: int = K, piece: int = PIECE) -> Column:
    """Array of the hashes of the occurrence-numbered k-mers of a text, in text order; null if it has no word."""
    number = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), h).otherwise(_numbered(h))
    return let(pieces(text, piece), lambda ws: F.when(F.size(ws) > 0, let(_kmers(ws, k), number)))


def signatures(
    rows: DataFrame, keys: list[str], text: str, k: int = K, sketches: int = SKETCHES, place_bits: int = PLACE_BITS, carry: list[str] = (), left: int | None = LEFT,
) -> DataFrame:
    """``keys``, ``carry`` (columns of fixed width that follow from the keys) and ``signature``, an array of ``sketches`` longs, for each distinct ``keys``.

    The elements of a row are exploded, hashed by each function and reduced in the same
    task, before any exchange: a text leaves its task as ``sketches`` longs.  A hash above a
    bound that about ``left`` elements of the text stay below cannot be one of the two least
    (all of a text with fewer elements stay), which leaves few rows to aggregate.  Where
    fewer than two stay below, the entry is null: ask again with ``left`` None, no bound.

    Both least hashes and their order come from plain minima: for each bit of the place, the
    least hash of the elements with and without it.  Two elements differ in a bit of their
    places, so the second least hash is the least that stands in the other half of some bit,
    and the highest such bit tells which of the two comes first.  ``place_bits``: as many as
    any text's places need; more change nothing but the work.
    """
    made = rows.withColumn("kmers", F.coalesce(elements(F.col(text), k), F.array(F.lit(None).cast("bigint"))))
    share = F.lit(float("inf") if left is None else float(left)) / F.size("kmers")
    bound = F.when(share < 1, (F.lit(-(2.0**63)) + share * F.lit(2.0**64)).cast("bigint"))
    exploded = made.withColumn("bound", bound).select(*keys, *carry, "bound", F.posexplode("kmers").alias("p", "h"))
    # A constant list of functions keeps the compiled loop short.
    hashed = exploded.withColumn("j", F.explode(F.array(*[F.lit(j) for j in range(sketches)])))
    below = hashed.withColumn("x", F.when(F.col("h").isNotNull(), F.xxhash64("h", "j"))).drop("h")
    below = below.filter("bound is null or x <= bound or (p = 0 and j = 0)")  # one element in any case, so that no text is lost
    bit = lambda t: F.col("p").bitwiseAND(F.lit(1 << t)) == 0
    least = below.groupBy(*keys, "j").agg(
        F.first("bound").alias("bound"), *[F.first(c).alias(c) for c in carry], *[F.min(F.when(bit(t), F.col("x"))).alias(f"a{t}") for t in range(place_bits)], *[F.min(F.when(~bit(t), F.col("x"))).alias(f"b{t}") for t in range(place_bits)])
    other = lambda t: F.when(F.col(f"a{t}").isNotNull() & F.col(f"b{t}").isNotNull(), F.greatest(f"a{t}", f"b{t}"))
    two = least.withColumns({"one": F.least("a0", "b0"), "two": F.least(*[other(t) for t in range(place_bits)], F.lit(None).cast("bigint"))})
    ahead = F.coalesce(*[F.when(F.greatest(f"a{t}", f"b{t}") == F.col("two"), F.col(f"a{t}") == F.col("one")) for t in reversed(range(place_bits))])
    sure = F.col("bound").isNull() | (F.col("two") <= F.col("bound"))
    tuples = F.when(F.coalesce(ahead, F.lit(True)), F.xxhash64("j", "one", "two")).otherwise(F.xxhash64("j", "two", "one"))
    pair = two.select(*keys, *carry, "j", F.when(sure, tuples).alias("s"))
    each = pair.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carry], *[F.max(F.when(F.col("j") == j, F.col("s"))).alias(f"s{j}") for j in range(sketches)])
    return each.select(*keys, *carry, F.array(*[f"s{j}" for j in range(sketches)]).alias("signature"))


def fingerprint(signature: Column) -> Column:
    """The signature as text, eight hexadecimal digits for each tuple."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples of two fingerprints, 0 to 1."""
    cut = lambda s: F.regexp_extract_all(s, F.lit("(.{8})"), F.lit(1))
    return F.aggregate(F.zip_with(cut(a), cut(b), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.greatest(F.length(a) / 8, F.lit(1.0))


def _heads(docs: DataFrame, bucket_rows: int) -> tuple[list[int], dict[int | None, list[int]]]:
    """Upper doc_ids of buckets of about ``bucket_rows`` rows, ascending, and the upper ties of each doc_id (None: null) that fills several.

    Every bound is that of a row, so no bucket is empty.  At most MAX_BUCKETS come from doc_ids and as many from nulls.
    A doc_id that holds the rows of several buckets stands at several quantiles; its rows, like those
    without a doc_id, are cut into ranges of the tie, a hash of the text.
    """
    size = docs.agg(F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    parts_of = lambda n: max(1, min(MAX_BUCKETS, n // bucket_rows))
    buckets = parts_of(size.n)
    cuts = [i / buckets for i in range(1, buckets)] + [1.0]
    got = docs.agg(F.percentile_approx("doc_id", cuts, max(10000, 4 * buckets)).alias("q"), F.max("doc_id").alias("m")).first()
    ids = Counter(x for x in [*(got.q or []), got.m] if x is not None)
    hot: dict[int | None, int] = {d: c for d, c in ids.items() if c > (2 if d == got.m else 1)}
    if size.nulls:
        hot[None] = parts_of(size.nulls)
    if not hot:
        return sorted(ids), {}
    parts = F.when(F.col("doc_id").isNull(), F.lit(hot.get(None, 1)))
    chosen, known = F.col("doc_id").isNull(), [d for d in hot if d is not None]
    if known:
        chosen = chosen | F.col("doc_id").isin(known)
        parts = F.coalesce(parts, F.element_at(F.create_map(*[F.lit(x).cast("bigint") for d in known for x in (d, hot[d])]), F.col("doc_id")))
    part = F.least(F.floor((_tie().cast("double") / F.lit(2.0**64) + F.lit(0.5)) * parts), parts - 1)
    ends = docs.filter(chosen).groupBy("doc_id", part.alias("part")).agg(F.max(_tie()).alias("tie")).collect()  # no more rows than buckets
    ties: dict[int | None, list[int]] = {}
    for r in sorted(ends, key=lambda r: r.tie):
        ties.setdefault(r.doc_id, []).append(r.tie)
    return sorted(ids), ties


def _tie() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _bucket(bounds: list[int], ties: dict[int | None, list[int]]) -> Column:
    """(bucket, head) of a row: number of its bucket in ascending (doc_id, tie), nulls first, and whether it has the bucket's upper bound."""
    doc_id, tie = F.col("doc_id"), _tie()
    longs = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs]) if xs else F.array().cast("array<bigint>")
    below = lambda xs, x: F.size(F.filter(xs, lambda b: b < x))
    at = lambda bucket, head: F.struct(bucket.cast("bigint").alias("bucket"), head.alias("head"))
    within = lambda xs, first: let(below(xs, tie), lambda i: at(F.lit(first) + i, F.get(xs, i) == tie))
    nulls = ties.get(None, [])
    wide = max(1, int(len(bounds) ** 0.5))  # two short searches
    blocks = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    block = F.least(below(longs([b[-1] for b in blocks]), doc_id), F.lit(max(0, len(blocks) - 1)))

    def placed(i: Column, xs: Column) -> Column:
        return at(F.lit(len(nulls)) + i * F.lit(wide) + below(xs, doc_id), F.array_contains(xs, doc_id))

    plain = let(block, lambda i: let(F.get(F.array(*[longs(b) for b in blocks]), i), lambda xs: placed(i, xs))) if blocks else at(F.lit(0), F.lit(False))
    hot = {d: t for d, t in ties.items() if d is not None}
    if hot:  # buckets of such a doc_id follow each other; all after it move up
        ids = sorted(hot)
        more, starts = 0, []
        for d in ids:
            starts.append(len(nulls) + bounds.index(d) + more)
            more += len(hot[d]) - 1
        ups = [s - len(nulls) - bounds.index(d) for d, s in zip(ids, starts, strict=True)] + [more]
        rank = below(longs(ids), doc_id)
        of = lambda j: let(F.get(F.array(*[longs(hot[d]) for d in ids]), j), lambda xs: let(
            below(xs, tie), lambda i: at(F.get(longs(starts), j) + i, F.get(xs, i) == tie)))
        moved = lambda b: at(b["bucket"] + F.get(longs(ups), rank), b["head"])
        plain = F.when(F.array_contains(longs(ids), doc_id), let(rank, of)).otherwise(let(plain, moved))
    return F.when(doc_id.isNull(), within(longs(nulls), 0)).otherwise(plain)


def edited_fingerprints(docs: DataFrame, k: int = K, sketches: int = SKETCHES, bucket_rows: int = BUCKET_ROWS, left: int = LEFT) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    ``docs`` has doc_id and text.  The next document is the one after it in descending
    (doc_id, tie, text), the tie being a hash of the text; after the last, the first.  The
    edited text has the last third of the code points replaced by as many of the next
    document (or all it has).  Null doc_ids come last.  Rows that share a doc_id are ordered
    by tie and text; equal rows each get a row.  ``left``: see ``signatures``; it changes the work, not the result.

    The only exchange of texts is by ranges of (doc_id, tie).  Each range also holds a copy of
    the rows that follow it, the head of the next range, so that no task needs the whole order.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    longest = base.agg(F.max(F.length("text"))).first()[0] or 0  # an edited text is no longer than its text, and has fewer elements than characters
    bounds, ties = _heads(base, bucket_rows)
    top = len(bounds) - 1 + sum(len(t) - (d is not None) for d, t in ties.items())
    placed = base.withColumn("at", _bucket(bounds, ties))
    # Buckets follow each other downwards, and the top one follows the last.
    previous = F.when(F.col("at.bucket") == top, F.lit(0)).otherwise(F.col("at.bucket") + 1).cast("bigint")
    own = F.struct(F.col("at.bucket").alias("b"), F.lit(False).alias("guest"))
    copies = F.when(F.col("at.head"), F.array(own, F.struct(previous.alias("b"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    spread = placed.select("doc_id", "text", F.explode(copies).alias("to")).select(F.col("to.b").alias("bucket"), F.col("to.guest").alias("guest"), "doc_id", "text")
    bits = max(1, longest.bit_length())
    made = saved(_fingerprints(spread, k, sketches, bits, left), "fingerprints")
    unsure = made.filter("unsure").select("bucket").distinct()
    if unsure.take(1):  # these buckets again, without a bound
        again = _fingerprints(spread.join(unsure, "bucket", "left_semi"), k, sketches, bits, None)
        made = made.join(unsure, "bucket", "left_anti").unionByName(again)
    return made.drop("bucket", "unsure")


def _fingerprints(spread: DataFrame, k: int, sketches: int, place_bits: int, left: int | None) -> DataFrame:
    """The result of ``edited_fingerprints`` by bucket of (bucket, guest, doc_id, text); ``unsure``: an entry of a row or the next one is missing."""
    follow = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), _tie().desc(), F.col("text").desc())
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = spread.select("bucket", "guest", "doc_id", "text", F.row_number().over(follow).alias("rid"), F.lead("text").over(follow).alias("next"))
    rows = rows.select(
        "bucket", "guest", "rid", "doc_id", n.cast("bigint").alias("n_chars"), "text",
        F.when(~F.col("guest"), F.concat(F.substring("text", F.lit(1), n - third), F.substring("next", F.lit(1), third))).alias("edited"),
    )
    texts = rows.select("bucket", "guest", "rid", "doc_id", "n_chars", F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.lit(None).cast("string").alias("sha"), F.col("text").alias("t")),
        F.struct(F.lit(1).alias("which"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.col("edited").alias("t")))).alias("x"))
    texts = texts.select("bucket", "guest", "rid", "doc_id", "n_chars", "x.which", "x.sha", "x.t").filter("which = 0 or not guest")
    # The digest goes along as four longs.
    quarter = lambda i: F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("bigint")
    texts = texts.withColumns({f"sha{i}": quarter(i) for i in range(4)}).drop("sha")
    signed = signatures(texts, ["bucket", "rid", "which"], "t", k, sketches, place_bits, ["guest", "doc_id", "n_chars", *(f"sha{i}" for i in range(4))], left)
    signed = signed.withColumn("sha", F.concat(*[F.lpad(F.lower(F.hex(f"sha{i}")), 16, "0") for i in range(4)]))
    pick = lambda c, w: F.max(F.when(F.col("which") == w, F.col(c)))
    signed = signed.withColumns({"fp": fingerprint(F.col("signature")), "missing": F.exists("signature", lambda s: s.isNull())})
    each = signed.groupBy("bucket", "rid").agg(
        F.first("guest").alias("guest"), F.first("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"),
        F.max("missing").alias("missing"), pick("sha", 1).alias("edited_sha256"), pick("fp", 0).alias("fingerprint"), pick("fp", 1).alias("edited_fingerprint"))
    by_place = Window.partitionBy("bucket").orderBy("rid")
    each = each.withColumns({"next": F.lead("fingerprint").over(by_place), "unsure": F.col("missing") | F.coalesce(F.lead("missing").over(by_place), F.lit(False))}).filter(~F.col("guest"))
    return each.select(
        "bucket", "unsure", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
