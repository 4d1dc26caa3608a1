"""Brute force for the operators on conversations and on benchmark items."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, pos int, depth int, block string, n_words string"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3]))


def cheapest(roles, faults):
    """Cost and least audit of all repairs, by growing all audits in order of cost; and what it leaves."""
    import heapq

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, left = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))  # the first to come is the cheapest, and of equals the least audit
        if i == len(roles) and state in ("", "a"):
            return cost, audit, left
        asked = "assistant" if state == "u" else "user"
        steps = [(5, "I", i, asked, (None, asked))]
        if i < len(roles):
            steps.append((2, "D", i + 1, None, None))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                initial = roles[i][:1]
                if (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    steps.append((more, "K", i + 1, initial, (i, roles[i])))
                steps.append((1 + more, "R", i + 1, asked, (i, asked)))
        for c, letter, j, to, kept in steps:
            heapq.heappush(heap, (cost + c, audit + letter, j, state if to is None else to[:1], left if kept is None else (*left, kept)))
    raise AssertionError


def repaired(rows):
    """What the query should give for the rows of one conversation."""
    out = []
    for r in sorted_rows(rows):
        conv, turn, role, text = r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        role = "user" if lot == 4 else role
        out += [(turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    seen, faults = set(), []
    for _, role, text in out:
        kept = text.strip(ASCII_SPACE)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    roles = [r for _, r, _ in out]
    cost, audit, left = cheapest(roles, faults)
    turns = {t for t, _, _ in out if t is not None}
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
    lines = "\n".join(f"{role}:{'' if i is None else out[i][2]}" for i, role in left)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (rows[0][0], gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha(lines))


REPAIRED = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_conversation(rows):
    found = collections.defaultdict(list)
    for r in rows:
        found[r[0]].append(r[:4])
    return found


@pytest.fixture(scope="module")
def talks(spark):
    """Random conversations, with nulls in any column, ties, repeated rows, long texts and clashing names."""
    rnd = random.Random(8)
    texts = ["Yes.", "No!", "why", "", " \n", "And so?", "end. ", "é 😀", None, "Yes.", "x" * 3000 + "."]
    rows = []
    for c in range(220):
        for t in range(rnd.choice([1, 2, 3, 5, 8, 13])):
            turn = rnd.choice([t, t, t, t, t + 2, None, 3])
            rows.append((c, turn, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Update"]), rnd.choice(texts)))
    rows += [(None, 0, "user", "Hello."), (None, None, "assistant", "Well."), (-7, 0, "user", "Minus."), (3, None, None, None), (3, None, None, None), rows[0], rows[0]]
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." if t % 7 else "cut off") for t in range(2600)]
    rows += [(905, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["A.", "B", f"{t}."])) for t in range(1500)]
    return spark.createDataFrame([(*r, "k", 1, 2, "b", "w") for r in rows], SCHEMA).repartition(3)


def test_repair(spark, talks, monkeypatch):
    from barflow.llm import turn_repair as m

    rows = [tuple(r) for r in talks.collect()]
    want = sorted((repaired(v) for v in by_conversation(rows).values()), key=str)
    got = m.digest(talks)
    assert got.columns == REPAIRED
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert m.digest(talks.limit(0)).count() == 0


def test_repair_of_given_conversations(spark):
    from barflow.llm import turn_repair as m

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    want = sorted((repaired(v) for v in by_conversation(rows).values()), key=str)
    got = m.digest(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def trie_of(rows):
    """Every node of the rebuilt conversations, its totals by walking from each node to all its prefixes."""
    own = {c: [("" if r[2] is None else r[2], "" if r[3] is None else r[3]) for r in sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))] for c, v in by_conversation(rows).items() if c is not None}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), children[p], leaves[p], saved[p], sha(",".join(map(str, ends[p])))) for p, cs in members.items()), built


@pytest.mark.parametrize("height", [16, 3])
def test_trie(spark, talks, height):
    from barflow.llm import prefix_trie as m

    short = talks.filter("conv_id is null or conv_id < 900") if height == 3 else talks.filter("conv_id is null or conv_id <> 905")
    short = short.filter("turn is null or turn < 700")
    want, _ = trie_of([tuple(r) for r in short.collect()])
    turns, convs = m.rebuilt(m.ordered_turns(short))
    got = m.digest(*m.trie(turns, convs, height))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want, key=lambda r: tuple(-1 if x is None else x for x in r)) if False else sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_trie_of_nothing(spark, talks):
    from barflow.llm import prefix_trie as m

    assert m.digest(*m.trie(*m.rebuilt(m.ordered_turns(talks.limit(0))))).count() == 0


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def normal(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(text, items):
    """Words hit by any window of any item, and the items, by comparing every place."""
    ws, hit, found = normal(text), set(), set()
    for item, t in items:
        iw = normal(t)
        k = min(10, len(iw))
        windows = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if iw else set()
        for i in range(len(ws) - k + 1):
            if k and tuple(ws[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(item)
    ids = sorted(str(x) for x in found if x is not None)
    return len(ws), len(hit), len(ids), sha(",".join(ids)), bool(hit)


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_decontamination(spark, block_words):
    from barflow.llm import decontamination as m

    rnd = random.Random(2)
    word = lambda: rnd.choice(["alpha", "Beta", "gamma", "ümlaut", "中文", "x1", "7"])
    text = lambda n: "".join(word() + rnd.choice([" ", "-", "\n", "... ", "\x7f"]) for _ in range(n))
    items = [(i, text(rnd.choice([1, 4, 9, 10, 11, 30, 80]))) for i in range(14)]
    items = [(i, t if len(normal(t)) > 3 else t + "rare word") for i, t in items] + [(3, "one more of three"), (50, None), (51, "--"), (None, "the item without an id"), (52, items[0][1]), (53, items[0][1])]
    docs = [(i, text(rnd.randint(0, 200))) for i in range(40)]
    for i in range(40, 70):
        _, t = rnd.choice(items)
        docs.append((i, text(20) + (t or "").upper().replace("ÜMLAUT", "ümlaut") + text(20)))
    docs += [(100, None), (101, ""), (102, "the ITEM without-an id"), (103, (text(50) + items[5][1]) * 400), (None, items[4][1]), (40, docs[40][1]), (104, " ".join(f"{c}" for c in "abc" * 2_000_000))]
    frame = spark.createDataFrame([(*d, "n", "h", 1, "s") for d in docs], "doc_id bigint, text string, n_words string, hits string, items int, spans string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = m.digest(m.windows(frame, bench, block_words=block_words))
    want = sorted(str((d, *hits(t, items))) for d, t in docs)
    assert sorted(str(tuple(r)) for r in found.collect()) == want
    if block_words == 200_000:
        assert m.windows(frame.limit(0), bench).count() == 0
        assert m.digest(m.windows(frame.limit(5), bench.limit(0))).filter("contaminated").count() == 0


def test_removal_of_spans(spark):
    from barflow.llm import decontamination as m

    item = "One two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "short item")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"Ünder before, {item.upper()}! After it {'more words ' * 20}"), (2, f"x {item}"), (3, "clean é text"), (4, None), (5, "a Short-ITEM here and short item")], "doc_id bigint, text string")
    by = {r.doc_id: r for r in m.remove(docs, bench).collect()}
    assert by[1].clean_text == f"Ünder before, ! After it {'more words ' * 20}" and by[1].kept and [(s.start, s.end) for s in by[1].spans] == [(14, 14 + len(item))]
    assert by[2].clean_text == "x " and not by[2].kept and by[2].n_hit == 11
    assert by[3].clean_text == "clean é text" and by[3].kept and by[3].spans == []
    assert by[4].clean_text == "" and by[4].kept and by[4].n_words == 0
    assert by[5].clean_text == "a  here and " and by[5].n_hit == 4 and not by[5].kept
    assert m.remove(docs.withColumn("kept", F.lit(1)), bench).count() == 5
