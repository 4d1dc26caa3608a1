"""Repair of a conversation's turns at least cost, with the least audit of all cheapest repairs.

Rows have faults (blank, duplicate, truncated).  Edits keep a row, give it another role,
delete it or insert an empty turn, so that the roles read ``(s?(ua)+)?``.  Costs are found by
dynamic programming over nodes (row, state of that pattern).  The edits that lie on a
cheapest way are arcs; each arc is ranked by the audit letters it starts with, 1, 2, 4, ...
of them: the rank of twice as many letters is that of the pair (own rank, rank of the arc
that many steps on), and the pointers to that arc double as well.  The ranks pick the arc to
start with, the doubled pointers give the whole path.

A conversation of any length is cut into blocks of BLOCK rows.  A block's costs are a matrix
from entry to exit states, so a block takes part in the pass over a conversation as 16
numbers; then each block finds its own paths, and a second pass picks the entry state.

Defined cases: a null role or text is one space, as is a null conv_id or turn where its decimal form is
read; rows of a null conv_id are a conversation; rows of one turn are ordered by role, then
text; an empty table gives no row; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, saved, ship
from .ordering import by_group, joined_sha256, numbered, starts, whole_groups

BLOCK, CELLS = 512, 100_000
#: Costs of the edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.  Codes of role initials: s 0, u 1, a 2, any other.
STATES, OTHER, NEVER = 4, 3, 1 << 40
#: The state after a kept row of each code (-1: not allowed), and after a turn of the role that a state asks for.
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
NEXT = np.array([2, 2, 3, 2])
#: Edits as they sort, and what is left to pay at the end of a conversation.
LETTERS, ROLES = np.array(["D", "I", "K", "R"]), np.array(["-", "s", "u", "a"])
AT_END = np.array([0, 2 * INSERT, INSERT, 0])
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True


def damaged(conversations: DataFrame) -> DataFrame:
    """key, conv_id, turn, pos, role, text of the rows, with faults sown by crc32 of ``conv_id:turn``."""
    space = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), space))
    placed = numbered(rows, ["key"], [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], [F.asc_nulls_first("turn"), F.col("role"), F.substring("text", 1, 64)], "place")
    lot = F.crc32(F.concat("key", F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    copies = F.when(F.col("lot") == 0, F.array().cast("array<int>")).when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("lot") == 1, F.lit("")).when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, F.lit("user")).otherwise(F.col("role"))
    sown = placed.withColumn("lot", lot).select("key", "conv_id", "turn", F.explode(copies).alias("copy"), "place", role.alias("role"), text.alias("text"))
    return saved(sown.select("key", "conv_id", "turn", (2 * F.col("place") + F.col("copy")).alias("pos"), "role", "text"), "damaged")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (key, pos, role, text, ...) with code (of the role's initial), fault, block and nth, the row's place in its block."""
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    seen = rows.filter(~blank).groupBy("key", "role", F.sha2("text", 256)).agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("first"))
    cut = ~F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1)).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    fault = F.when(blank, BLANK).when(F.col("first").isNull(), DUPLICATE).when(cut, CUT).otherwise(NONE)
    block = F.floor(F.col("pos") / (2 * BLOCK)).cast("bigint")
    found = rows.join(seen, ["key", "pos"], "left").withColumns({"code": code, "fault": fault, "block": block}).drop("first")
    return saved(found.withColumn("nth", F.row_number().over(Window.partitionBy("key", "block").orderBy("pos")) - 1), "faults")


def costs(code: np.ndarray, fault: np.ndarray, size: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs from each node (block, row, state) to each of the ends: (blocks, rows + 1, STATES, ends).

    ``code`` and ``fault``: (blocks, rows), aligned at the end, of ``size`` rows each; ``end``: (blocks, STATES, ends).
    """
    n, width = code.shape
    out = np.full((n, width + 1, STATES, end.shape[2]), NEVER, np.int64)
    out[:, width] = end
    state = np.arange(STATES)
    for i in range(width - 1, -1, -1):
        live = np.flatnonzero(size >= width - i)
        after = out[live, i + 1]
        held = np.where(fault[live, i] == CUT, TRUNCATED, 0)[:, None, None]
        stays = (fault[live, i] == NONE) | (fault[live, i] == CUT)
        to = KEPT[state[None, :], code[live, i][:, None]]
        keep = np.where((stays[:, None] & (to >= 0))[..., None], held + np.take_along_axis(after, np.maximum(to, 0)[..., None], 1), NEVER)
        rerole = np.where(stays[:, None, None], REROLE + held + after[:, NEXT], NEVER)
        here = np.minimum(np.minimum(keep, rerole), DELETE + after)
        out[live, i] = np.minimum(np.minimum(here, INSERT + here[:, NEXT]), 2 * INSERT + here[:, NEXT[NEXT]])
    return np.minimum(out, NEVER)


def ranked_paths(code: np.ndarray, fault: np.ndarray, size: np.ndarray, end: np.ndarray, last: np.ndarray, first: np.ndarray) -> tuple[list, list, list]:
    """For each block, by entry state, the least audit of the cheapest ways, the role after each letter and the exit state (-1: not entered so).

    ``end``: (blocks, STATES) costs still to come; ``last``: the block ends its conversation; ``first``: it begins one, so that only state 0 enters.
    """
    n, width = code.shape
    cost = costs(code, fault, size, end[..., None])[..., 0]
    node = lambda b, i, s: (b * (width + 1) + i) * STATES + s
    # Arcs on a cheapest way, in the order of node, then letter.
    shape = (n, width + 1, STATES, len(LETTERS))
    best, to = np.zeros(shape, bool), np.zeros(shape, np.int64)
    b, i, s = np.ogrid[:n, :width, :STATES]
    here, after = cost[:, :width], cost[:, 1:]
    there = (i >= width - size[:, None, None]) & (here < NEVER)
    stays = ((fault == NONE) | (fault == CUT))[..., None]
    held = np.where(fault == CUT, TRUNCATED, 0)[..., None]
    kept = KEPT[np.arange(STATES)[None, None, :], code[..., None]]
    best[:, :width, :, 0] = there & (DELETE + after == here)
    to[:, :width, :, 0] = node(b, i + 1, s)
    best[:, :width, :, 1] = there & (INSERT + here[..., NEXT] == here)
    to[:, :width, :, 1] = node(b, i, NEXT[s])
    best[:, :width, :, 2] = there & stays & (kept >= 0) & (held + np.take_along_axis(after, np.maximum(kept, 0), 2) == here)
    to[:, :width, :, 2] = node(b, i + 1, kept)
    best[:, :width, :, 3] = there & stays & (REROLE + held + after[..., NEXT] == here)
    to[:, :width, :, 3] = node(b, i + 1, NEXT[s])
    best[:, width, :, 1] = last[:, None] & (INSERT + end[:, NEXT] == end)
    to[:, width, :, 1] = node(np.arange(n)[:, None], width, NEXT[None, :])
    arcs = np.flatnonzero(best)
    target, letter = to.ravel()[arcs], arcs % len(LETTERS)
    # The arc after each: of those that leave its target, the least letter; letters differ, so there is one.  The last arc is followed by the end.
    finish = len(arcs)
    leaving = np.searchsorted(arcs, np.arange(n * (width + 1) * STATES + 1) * len(LETTERS))
    has = leaving[1:] > leaving[:-1]
    pointer = np.r_[np.where(has[target], leaving[target], finish), finish]
    rank = np.r_[letter + 1, 0]
    length = np.r_[np.ones(finish, np.int64), 0]
    pointers = [pointer]
    while (pointers[-1] != finish).any():
        jump = pointers[-1]
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
        length = length + length[jump]
        pointers.append(jump[jump])
    chosen, owner = [], []
    for k in range(n):
        for state in (0,) if first[k] else range(STATES):
            at = node(k, width - size[k], state)
            out = np.arange(leaving[at], leaving[at + 1])
            if len(out):
                chosen.append(int(out[np.argmin(rank[out])]))
                owner.append((k, state))
    audits, roles = [[""] * STATES for _ in range(n)], [[""] * STATES for _ in range(n)]
    exits = [[-1] * STATES for _ in range(n)]
    if chosen:
        sizes = length[chosen]
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(chosen, sizes)
        for bit, jump in enumerate(pointers):
            at = np.where(step >> bit & 1, jump[at], at)
        text, after = "".join(LETTERS[letter[at]]), "".join(ROLES[target[at] % STATES])
        ends = np.cumsum(sizes)
        for (k, state), a, z in zip(owner, ends - sizes, ends, strict=True):
            audits[k][state], roles[k][state] = text[a:z], after[a:z]
            exits[k][state] = int(target[at[z - 1]] % STATES)
    return audits, roles, exits


def _aligned(code: np.ndarray, fault: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of like size as matrices aligned at their ends: (which blocks, code, fault)."""
    by_size = np.argsort(size, kind="stable")
    at = 0
    while at < len(by_size):
        to = at + 1
        while to < len(by_size) and (to - at + 1) * (size[by_size[to]] + 1) <= CELLS:
            to += 1
        some = by_size[at:to]
        width = int(size[some].max())
        place = begin[some][:, None] + size[some][:, None] - width + np.arange(width)[None, :]
        inside = place >= begin[some][:, None]
        yield some, np.where(inside, code[np.maximum(place, 0)], OTHER), np.where(inside, fault[np.maximum(place, 0)], BLANK)
        at = to


def _groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(starts(table, ["key", "block"]))
    return new, np.diff(np.r_[new, table.num_rows])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block to (key, block, costs from entry to exit state, first and last code, illegal neighbours)."""
    for table in whole_groups(batches, ["key", "block"]):
        begin, size = _groups(table)
        code, fault = table["code"].to_numpy(), table["fault"].to_numpy()
        matrix = np.zeros((len(begin), STATES * STATES), np.int64)
        unit = np.where(np.eye(STATES, dtype=bool), 0, NEVER)
        for some, c, f in _aligned(code, fault, begin, size):
            cost = costs(c, f, size[some], np.broadcast_to(unit, (len(some), STATES, STATES)))
            matrix[some] = cost[np.arange(len(some)), c.shape[1] - size[some]].reshape(len(some), -1)
        bad = np.r_[~LEGAL[code[:-1], code[1:]], False].astype(np.int64)
        bad[np.r_[begin[1:], len(code)] - 1] = 0
        yield pa.RecordBatch.from_arrays([
            table["key"].combine_chunks().take(pa.array(begin)), table["block"].combine_chunks().take(pa.array(begin)),
            pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), STATES * STATES).cast(pa.list_(pa.int64())),
            pa.array(code[begin].astype(np.int32)), pa.array(code[begin + size - 1].astype(np.int32)), pa.array(np.add.reduceat(bad, begin)),
        ], names=["key", "block", "matrix", "first", "last", "illegal"])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from its end: the costs still to come at each block's end, and the cost from its start."""
    key, come, follow = None, None, None
    for b in batches:
        out = []
        for k, block, matrix, first, last, illegal in zip(*[b.column(c).to_pylist() for c in ("key", "block", "matrix", "first", "last", "illegal")], strict=True):
            ends = key is None or k != key[0]
            key = (k,)
            end = AT_END if ends else come
            illegal += 0 if ends else int(not LEGAL[last, follow])
            come = np.minimum((np.array(matrix).reshape(STATES, STATES) + end).min(1), NEVER)
            come = np.minimum(np.minimum(come, INSERT + come[NEXT]), 2 * INSERT + come[NEXT[NEXT]])
            follow = first
            out.append((k, block, end.tolist(), ends, int(come[0]), illegal))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["key", "block", "come", "ends", "cost", "illegal"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, each led by a row with the costs to come, to their audits and exits by entry state."""
    for table in whole_groups(batches, ["key", "block"]):
        begin, size = _groups(table)
        code, fault = table["code"].to_numpy(), table["fault"].to_numpy()
        head = table.take(pa.array(begin))
        end, last, first = np.array(head["come"].to_pylist()), head["ends"].to_numpy(), head["block"].to_numpy() == 0
        audits, roles, exits = [None] * len(begin), [None] * len(begin), [None] * len(begin)
        for some, c, f in _aligned(code, fault, begin + 1, size - 1):
            for k, a, r, e in zip(some, *ranked_paths(c, f, size[some] - 1, end[some], last[some], first[some]), strict=True):
                audits[k], roles[k], exits[k] = a, r, e
        yield pa.RecordBatch.from_arrays([head["key"].combine_chunks(), head["block"].combine_chunks(), pa.array(audits, pa.list_(pa.string())), pa.array(roles, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))], names=["key", "block", "audits", "roles", "exits"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation in order: the audit of the state that each is entered in."""
    key, state = None, 0
    for b in batches:
        out = []
        for k, block, audits, roles, exits in zip(*[b.column(c).to_pylist() for c in ("key", "block", "audits", "roles", "exits")], strict=True):
            state = 0 if key is None or k != key[0] else state
            key = (k,)
            out.append((k, block, audits[state], roles[state]))
            state = exits[state]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["key", "block", "audit", "roles"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired turns and a report of conversations.

    ``rows``: key (text, not null), turn, pos (order within the key, up to two rows a place), role, text.
    Turns: key, block, seq (order), edit, role, text.  Report: key, blank, duplicate, truncated, illegal, cost, audit.
    """
    found = faults(rows)
    flags = found.select("key", "block", "nth", "code", "fault")
    blocks = saved(by_group(flags, ["key", "block"], [F.col("nth")]).mapInArrow(_matrices, "key string, block bigint, matrix array<bigint>, first int, last int, illegal bigint"), "blocks")
    ends = blocks.repartition("key").sortWithinPartitions("key", F.desc("block")).mapInArrow(_backward, "key string, block bigint, come array<bigint>, ends boolean, cost bigint, illegal bigint")
    ends = saved(ends, "block-ends")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    heads = ends.select("key", "block", F.lit(-1).alias("nth"), F.lit(OTHER).alias("code"), F.lit(NONE).alias("fault"), "come", "ends")
    led = heads.unionByName(flags.select("*", none("come", "array<bigint>"), none("ends", "boolean")))
    ways = by_group(led, ["key", "block"], [F.col("nth")]).mapInArrow(_paths, "key string, block bigint, audits array<string>, roles array<string>, exits array<int>")
    chosen = saved(by_group(ways, ["key"], [F.col("block")]).mapInArrow(_forward, "key string, block bigint, audit string, roles string"), "block-audits")
    edits = chosen.select("key", "block", "roles", F.posexplode(F.split("audit", "")).alias("seq", "edit")).filter("edit <> ''")
    nth = F.sum((F.col("edit") != "I").cast("int")).over(Window.partitionBy("key", "block").orderBy("seq")) - 1  # at most three letters a row of a block
    edits = edits.select("key", "block", "seq", "edit", F.when(F.col("edit") != "I", nth).alias("nth"), F.expr("if(substring(roles, seq + 1, 1) = 'u', 'user', 'assistant')").alias("new"))
    held = edits.filter("edit in ('K', 'R')").join(found.select("key", "block", "nth", "role", "text"), ["key", "block", "nth"])
    held = held.select("key", "block", "seq", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("new")).alias("role"), "text")
    put_in = edits.filter("edit = 'I'").select("key", "block", "seq", "edit", F.col("new").alias("role"), F.lit("").alias("text"))
    count = lambda kind, name: F.sum((F.col("fault") == kind).cast("bigint")).alias(name)
    report = found.groupBy("key").agg(count(BLANK, "blank"), count(DUPLICATE, "duplicate"), count(CUT, "truncated"))
    report = report.join(ends.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.min_by("cost", "block").alias("cost")), "key")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")  # the audit itself is one value
    return held.unionByName(put_in), report.join(chosen.groupBy("key").agg(audit.alias("audit")), "key")


def gaps(rows: DataFrame) -> DataFrame:
    """key, gaps: numbers between the least and the greatest turn that no row has; nulls do not count."""
    turns = rows.filter("turn is not null").select("key", "turn").distinct().groupBy("key")
    return turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))


def digest(conversations: DataFrame) -> DataFrame:
    """The columns of the query: every conversation, damaged and repaired."""
    rows = damaged(conversations)
    turns, report = repair(rows)
    line = F.concat("role", F.lit(":"), "text")
    sha = joined_sha256(turns.withColumn("line", line), ["key"], ["block", "seq"], "line", "\n", "repaired_sha256")
    every = conversations.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key")).distinct()
    got = every.join(gaps(rows), "key", "left").join(report, "key", "left").join(sha, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return got.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


ship(__name__)
