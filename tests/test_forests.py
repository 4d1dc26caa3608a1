"""Forests of all symbols grown together: independent of each other, as good as a forest of one symbol, in a fixed number of jobs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.operators import ml as M

SCHEMA = "symbol string, n bigint, a double, b double, c double, label double"
COLS = ["a", "b", "c"]


def samples(spark, symbols, per=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for s in symbols:
        for i in range(per):
            a, b, c = rnd.uniform(0, 1), rnd.uniform(-5, 5), rnd.choice([0.0, 1.0, None])
            odds = 4 * (a - 0.5) + (b > 1) * 2 - 1 + 2 * (c or 0) * (a > 0.3)
            rows.append((s, i, a, b, c, float(rnd.random() < 1 / (1 + np.exp(-2 * odds)))))
    return spark.createDataFrame(rows, SCHEMA)


def auc(rows):
    rows = sorted(rows, key=lambda r: r.prob)
    i = 0
    probs = [r.prob for r in rows]
    good = bad = won = 0
    while i < len(rows):
        j = i
        while j < len(rows) and probs[j] == probs[i]:
            j += 1
        p, q = sum(r.label == 1 for r in rows[i:j]), sum(r.label == 0 for r in rows[i:j])
        won += p * (bad + q / 2)
        good, bad, i = good + p, bad + q, j
    return won / (good * bad)


def test_as_good_as_single_fits_and_independent_of_others(spark):
    df = samples(spark, ["A", "B"]).unionByName(spark.createDataFrame([("few", 1, 1.0, 1.0, 1.0, 1.0), ("few", 2, 1.0, 1.0, 1.0, 0.0), (None, 3, 1.0, 1.0, 1.0, 1.0)] + [("one", i, 1.0, 1.0, 1.0, 1.0) for i in range(80)], SCHEMA))
    train, test = df.filter("n % 3 > 0"), df.filter("n % 3 = 0")
    forests = M.forests_by_symbol(train, COLS, ["n"])
    assert sorted(r.symbol for r in forests.collect()) == ["A", "B"]
    scored = M.score_forests(forests, test, COLS).collect()
    assert len(scored) == test.count() and all(r.prob == 1.0 for r in scored if r.symbol not in ("A", "B"))
    alone = {r.n: r.prob for r in M.score_forests(M.forests_by_symbol(train.filter("symbol = 'A'"), COLS, ["n"]), test.filter("symbol = 'A'"), COLS).collect()}
    assert alone == {r.n: r.prob for r in scored if r.symbol == "A"}
    for s in ("A", "B"):
        mine = [r for r in scored if r.symbol == s]
        one = M.score(M.train(train.filter(F.col("symbol") == s).fillna(0.0), COLS), test.filter(F.col("symbol") == s).fillna(0.0), COLS).collect()
        assert auc(mine) > 0.75 and auc(mine) > auc(one) - 0.03


@pytest.mark.parametrize("depth", [2])
def test_jobs_do_not_grow_with_symbols(spark, depth):
    tracker = spark.sparkContext.statusTracker()

    def jobs(symbols):
        group = f"forests-{len(symbols)}"
        df = samples(spark, symbols, 60)
        spark.sparkContext.setJobGroup(group, group)
        M.forests_by_symbol(df, COLS, ["n"], trees=4, depth=depth)
        found = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("", "")
        return found

    few, many = jobs(["A"]), jobs([f"S{i}" for i in range(12)])
    assert few > 0 and many <= few + 6  # joins may take another form, but there is no job a symbol


def test_a_single_split_is_the_best_one(spark):
    """One tree of one split on a feature that decides the label."""
    rows = [("A", i, float(i % 10), 0.0, 0.0, float(i % 10 > 6)) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    forests = M.forests_by_symbol(df, ["a"], ["n"], trees=3, depth=1)
    assert all((r.prob > 0.99) if r.label else (r.prob < 0.01) for r in M.score_forests(forests, df, ["a"]).collect())
    assert M.forests_by_symbol(df.limit(0), ["a"], ["n"], trees=2, depth=1).count() == 0
