"""Prefix trie of conversations, with totals of every subtree.

A node is a sequence of first turns (role, text) that some conversation starts with.  It
is known by its depth and a key of 128 bits: the exclusive or of hashes of (depth, role,
text) of its turns, so a key is a running fold that blocks of turns can be folded apart.

Totals roll up by bands of HEIGHT depths.  Inside a band each node adds its figures to all
its ancestors of the band.  Band roots (depths that HEIGHT divides) then form a tree of their
own, with depths divided by HEIGHT, and get their whole totals the same way; the completed
total of a band root is at last added to its ancestors in the band above.  A node explodes
into HEIGHT ancestors at most, twice, and there are log(depth) / log(HEIGHT) rounds.

Defined cases: a null role or text is empty; rows without a conv_id belong to no
conversation; rows of one turn are ordered by role, then text; repeated rows are turns of their own; an
empty table gives no node; other columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship
from .ordering import joined_sha256, numbered

HEIGHT, BLOCK, SALTS, FAMILY, MOST_SHARED = 16, 1024, 8, 5, 9
NODE = ["depth", "x", "y"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text of all rows with a conv_id."""
    empty = F.lit("")
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    placed = numbered(rows, ["conv_id"], [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], [F.asc_nulls_first("turn"), F.col("role"), F.substring("text", 1, 64)], "place")
    return placed.select("conv_id", (F.col("place") + 1).alias("place"), "role", "text")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share first turns: turns (conv_id, place, role, text) and conversations (conv_id, length).

    Conversation c takes the first h turns of c - c % FAMILY (all if it has fewer, none if there is none) for
    its own first h; h is crc32 of c in decimal, modulo MOST_SHARED.
    """
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    convs = counts.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    had = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    convs = convs.join(had, "base", "left").withColumn("shared", F.least("h", F.coalesce("of_base", F.lit(0).cast("bigint"))))
    convs = saved(convs.select("conv_id", "base", "h", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("bigint"))).alias("length")), "rebuilt")
    own = turns.join(convs, "conv_id").filter(F.col("place") > F.col("h")).select("conv_id", (F.col("place") - F.col("h") + F.col("shared")).alias("depth"), "role", "text", "length")
    first = turns.filter(F.col("place") < MOST_SHARED).withColumnRenamed("conv_id", "base")  # at most 8 rows a conversation, for 5 others
    taken = convs.join(first, "base").filter(F.col("place") <= F.col("shared")).select("conv_id", F.col("place").alias("depth"), "role", "text", "length")
    return own.unionByName(taken), convs.select("conv_id", "length")


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The node of each conversation at each depth, the root included: conv_id, depth, x, y, that of its parent (px, py), bytes of its last text, is_end.

    ``turns``: conv_id, depth (from 1, without gaps), role, text, length; ``convs``: conv_id, length.
    """
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256)
    rows = turns.select("conv_id", "depth", F.octet_length("text").cast("bigint").alias("bytes"), (F.col("depth") == F.col("length")).alias("is_end"), said.alias("said"))
    rows = rows.select("conv_id", "depth", "bytes", "is_end", F.xxhash64("depth", "said").alias("hx"), F.xxhash64("said", F.lit("y"), "depth").alias("hy"), F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    rows = saved(rows, "turn-keys")
    folds = rows.groupBy("conv_id", "block").agg(F.bit_xor("hx").alias("bx"), F.bit_xor("hy").alias("by"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each BLOCK turns
    zero = F.lit(0).cast("bigint")
    carried = folds.select("conv_id", "block", F.coalesce(F.bit_xor("bx").over(before), zero).alias("cx"), F.coalesce(F.bit_xor("by").over(before), zero).alias("cy"))
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = rows.withColumns({"wx": F.bit_xor("hx").over(within), "wy": F.bit_xor("hy").over(within)}).join(carried, ["conv_id", "block"])
    keyed = keyed.withColumns({"x": F.col("wx").bitwiseXOR(F.col("cx")), "y": F.col("wy").bitwiseXOR(F.col("cy"))})
    below = keyed.select("conv_id", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("hx")).alias("px"), F.col("y").bitwiseXOR(F.col("hy")).alias("py"), "bytes", "is_end")
    none = F.lit(None).cast("bigint")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("x"), zero.alias("y"), none.alias("px"), none.alias("py"), zero.alias("bytes"), (F.col("length") == 0).alias("is_end"))
    return saved(below.unionByName(root), "paths")


def subtree_sums(paths: DataFrame, values: DataFrame, names: list[str], height: int = HEIGHT) -> DataFrame:
    """Sums of ``names`` over the subtree of every node of ``values`` (depth, x, y, names), by bands.

    ``paths``: conv_id, depth, x, y of every conversation, from the root down without gaps.
    """
    deepest = values.agg(F.max("depth")).first()[0] or 0
    band = F.floor(F.col("depth") / height)
    is_root = F.col("depth") % height == 0
    # A band root ends the band above, too: there its row gives its ancestors.
    ranks = paths.select("conv_id", *NODE, F.explode(F.when(is_root & (F.col("depth") > 0), F.array(band, band - 1)).otherwise(F.array(band))).alias("band"))
    upward = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)  # height + 1 rows at most
    ranks = ranks.withColumn("up", F.collect_list(F.struct(*NODE)).over(upward))
    own = ranks.filter(F.col("band") == band).groupBy(*NODE).agg(F.any_value("up").alias("up"))
    sums = [F.sum(c).alias(c) for c in names]
    inside = values.join(own, NODE).select(F.explode("up").alias("to"), *names).select("to.*", *names)
    if deepest < height:
        return inside.groupBy(*NODE).agg(*sums)
    inside = saved(inside.groupBy(*NODE).agg(*sums), "bands")
    scaled = lambda df, c: df.withColumn("depth", c.cast("bigint"))
    done = subtree_sums(scaled(paths.filter(is_root), band), scaled(inside.filter(is_root), band), names, height)
    over = ranks.filter(F.col("band") < band).groupBy(*NODE).agg(F.any_value("up").alias("up"))
    above = over.select(*NODE, F.slice("up", F.lit(1), F.size("up") - 1).alias("up"))
    passed = scaled(done, F.col("depth") * height).join(above, NODE).select(F.explode("up").alias("to"), *names).select("to.*", *names)
    return inside.unionByName(passed).groupBy(*NODE).agg(*sums)


def trie(turns: DataFrame, convs: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Nodes (depth, x, y, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) and the paths they come from.

    ``saved_tokens``: for each node of a subtree, bytes of its last text for every member but one.
    """
    every = paths(turns, convs)
    long = lambda c: c.cast("bigint")
    nodes = every.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.any_value("px").alias("px"), F.any_value("py").alias("py"))
    nodes = saved(nodes, "nodes")
    counts = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    full = saved(nodes.join(counts, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "trie")
    values = full.select(*NODE, long(F.col("n_children") == 0).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    sums = subtree_sums(every.select("conv_id", *NODE), values, ["n_leaves", "saved_tokens"], height)
    # Parents with very many children: their children are dealt over SALTS keys.  The root, parent of all of depth 1, is one value.
    root = full.filter("depth = 0").agg(F.min("conv_id")).first()[0]
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    parents = full.filter("depth > 0 and n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"), F.explode(salts).alias("salt"))
    deep = full.filter("depth > 1").withColumn("salt", F.pmod("x", F.lit(SALTS)).cast("int")).join(parents, ["depth", "px", "py", "salt"])
    made = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children"]
    flat = full.filter("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root).cast("bigint")))
    return deep.select(*made).unionByName(flat.select(*made)).join(sums, NODE), every


def digest(nodes: DataFrame, every: DataFrame) -> DataFrame:
    """The columns of the query: nodes with the digest of the conversations that end there."""
    ends = joined_sha256(every.filter("is_end").withColumn("id", F.col("conv_id").cast("string")), NODE, ["conv_id"], "id", ",", "ends_sha256")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(ends, NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


#: Sequences of turns as lists; totals by joining each node with the first turns of the nodes below it.
SQL = r"""
with placed as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
own as (select conv_id, list({'r': role, 't': text} order by p) as turns from placed group by conv_id),
hashed as (
  select conv_id, turns, xor(list_reduce(list_concat([4294967295::ubigint::hugeint], flatten(list_transform(range(1, strlen(conv_id::varchar) + 1),
      lambda i: [ascii(substr(conv_id::varchar, i, 1))::hugeint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, o: case when o >= 0 then xor(c, o) when c % 2 = 1 then xor(c // 2, 3988292384::hugeint) else c // 2 end), 4294967295::hugeint) % 9 as h
  from own),
rebuilt as (
  select c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) as turns
  from hashed c left join own b on b.conv_id = c.conv_id - c.conv_id % 5),
steps as (select conv_id, unnest(range(0, len(turns) + 1)) as d, turns, len(turns) as n from rebuilt),
members as (select conv_id, d, turns[1:d] as path, d = n as is_end from steps),
nodes as (
  select path, d, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * (case when d = 0 then 0 else strlen(path[d].t) end) as saving,
         string_agg(conv_id::varchar, ',' order by conv_id) filter (where is_end) as ends
  from members group by path, d),
children as (select path[1:d - 1] as path, d - 1 as d, count(*) as n_children from nodes where d > 0 group by 1, 2),
known as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (path, d)),
spread as (select path[1:k] as path, k as d, case when n_children = 0 then 1 else 0 end as leaf, saving from (select path, n_children, saving, unnest(range(0, d + 1)) as k from known)),
totals as (select path, d, sum(leaf)::bigint as n_leaves, sum(saving)::bigint as saved_tokens from spread group by path, d)
select k.conv_id, k.d::bigint as depth, p.conv_id as parent_conv_id, k.n_convs::bigint as n_convs, k.n_children::bigint as n_children, n_leaves, saved_tokens, sha256(coalesce(k.ends, '')) as ends_sha256
from known k join totals using (path, d) left join nodes p on k.d > 0 and p.d = k.d - 1 and p.path = k.path[1:k.d - 1]
"""

ship(__name__)
