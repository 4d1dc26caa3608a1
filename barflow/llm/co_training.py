"""Quality classifier by co-training two views of a document.

The content view sees shares and counts in the text and its words, hashed into WORDS
kinds (the share of a text's distinct words that is of each kind); the metadata view sees
source, language and sizes.  Each view is a logistic regression.  In every round each view
labels the pool documents it is surest of, and those join the *other* view's training
set.  At the end both views are calibrated on labelled documents kept aside, and the
score of every document is the mean of the two calibrated log-odds, as a probability.

Fitting uses a bounded sample of labelled rows and a bounded pool of unlabelled ones;
features and scores of all documents are DataFrame expressions.

Defined cases: null text is the empty text; null source or language counts as the rarest;
without labels of both kinds every score is the share of good labels (0.5 without any).
Documents with several labels count by the mean of them, 0.5 as good.  Of rows that share
a doc_id the one with the least hash of its text is learned from; each gets its own score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import hash_sample, ship

#: Bounds of the labelled sample and the pool; rounds, and documents of each kind a view hands over in one.
LABELLED, POOL, ROUNDS, HANDED, SURE, CLASSES = 6000, 6000, 5, 60, 0.9, 50
#: Kinds of words; ridge of plain features and of each of the many word shares.
WORDS, RIDGE, WORD_RIDGE = 256, 1.0, 100.0
CONTENT = ["c_symbols", "c_upper", "c_digits", "c_bangs", "c_pipes", "c_stops", "c_spaces", "c_word", "c_repeats"]
META = ["m_chars", "m_lines", "m_line"]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, the numeric features of both views and ``kinds``, the hashed distinct words."""
    t = F.coalesce(F.col("text"), F.lit(""))
    n = F.greatest(F.length("_t"), F.lit(1))
    count = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    words = F.size("_w")
    parts = docs.select("doc_id", "source", "lang", t.alias("_t"), F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("_w"))
    return parts.withColumn("_d", F.array_distinct("_w")).select(
        "doc_id", "source", "lang",
        (count("#*$%&<>") / n).alias("c_symbols"), (count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n).alias("c_upper"), (count("0123456789") / n).alias("c_digits"),
        (count("!?") / n).alias("c_bangs"), (count("|") / n).alias("c_pipes"), (count(".") / n).alias("c_stops"), (count(" ") / n).alias("c_spaces"),
        (F.length("_t") / F.greatest(words, F.lit(1)) / 10).alias("c_word"), (1 - F.size("_d") / F.greatest(words, F.lit(1))).alias("c_repeats"),
        (F.ln(n.cast("double")) / 10).alias("m_chars"), (F.ln(count("\n") + 1.0) / 5).alias("m_lines"), (F.ln(n / (count("\n") + 1)) / 10).alias("m_line"),
        F.transform("_d", lambda w: F.pmod(F.xxhash64(w), F.lit(WORDS)).cast("int")).alias("kinds"), F.xxhash64("_t").alias("_h"),
    )


def shares(kinds: Column) -> Column:
    """WORDS shares of the kinds of a text, as 32-bit floats."""

    def pack(kinds: pd.Series) -> pd.Series:
        return kinds.map(lambda k: (np.bincount(k, minlength=WORDS) / max(len(k), 1)).astype("<f4").tobytes())

    return F.pandas_udf(pack, BinaryType())(kinds)


def fit(x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    hold = np.diag(np.r_[np.broadcast_to(ridge, len(w) - 1), 1e-6].astype(float))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (p - y) + hold @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class View:
    """One view: its columns scaled, and its weights."""

    def __init__(self, x: np.ndarray, plain: int | None = None):
        """``plain``: how many columns are plain features; the rest are word shares."""
        self.ridge = np.where(np.arange(x.shape[1]) < (x.shape[1] if plain is None else plain), RIDGE, WORD_RIDGE)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        self.w = np.zeros(x.shape[1] + 1)
        self.a, self.b = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.w = fit((x - self.mean) / self.scale, y, self.ridge)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling on rows that were not trained on."""
        self.a, self.b = fit(self.odds(x)[:, None], y, 1e-3)

    def column(self, columns: list[Column], kinds: Column | None = None) -> Column:
        """Calibrated log-odds as an expression; ``kinds``: hashed words, whose shares follow the columns."""
        slopes = self.w[:-1] / self.scale
        odds = F.lit(float(self.w[-1]))
        for c, m, w in zip(columns, self.mean, slopes, strict=False):
            odds = odds + (c - F.lit(float(m))) * F.lit(float(w))
        if kinds is not None:
            rest = slopes[len(columns):]
            weight = F.array(*[F.lit(float(w)) for w in rest])
            total = F.aggregate(kinds, F.lit(0.0), lambda a, k: a + F.get(weight, k))
            odds = odds + total / F.greatest(F.size(kinds), F.lit(1)) - F.lit(float(self.mean[len(columns):] @ rest))
        return odds * F.lit(float(self.a)) + F.lit(float(self.b))


def co_train(xs: list[np.ndarray], y: np.ndarray, plain: tuple = (None, None)) -> tuple[list[View], list[np.ndarray]]:
    """Two calibrated views on the rows of ``xs``, and what each was trained on; ``y``: 1, 0 or nan (the pool), with both labels present; ``plain``: see View.

    Every fourth row is kept aside for calibration, if that leaves both labels on either side.
    """
    known = ~np.isnan(y)
    both = lambda rows: (rows & (y == 1)).any() and (rows & (y == 0)).any()
    aside = known & (np.arange(len(y)) % 4 == 0)
    aside = aside if both(aside) else known
    train = known & ~aside if both(known & ~aside) else known
    target = [np.where(train, y, np.nan) for _ in xs]
    views = [View(x, n) for x, n in zip(xs, plain, strict=True)]
    for turn in range(ROUNDS + 1):
        for v, x, t in zip(views, xs, target, strict=True):
            v.fit(x[~np.isnan(t)], t[~np.isnan(t)])
        if turn == ROUNDS:
            break
        for i, (v, x) in enumerate(zip(views, xs, strict=True)):
            other = target[1 - i]
            p = 1 / (1 + np.exp(-np.clip(v.odds(x), -30, 30)))
            free = np.isnan(other) & ~known
            for kind, sure in ((1.0, p), (0.0, 1 - p)):
                take = np.flatnonzero(free & (sure >= SURE))
                other[take[np.argsort(-sure[take], kind="stable")][:HANDED]] = kind
    for v, x in zip(views, xs, strict=True):
        v.calibrate(x[aside], y[aside])
    return views, target


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, content_score, meta_score, score (0 to 1), quality_pred (0/1) and kept of every document.

    ``docs``: doc_id, text, source, lang; ``labels``: doc_id, quality.
    """
    docs = docs.select("doc_id", "text", "source", "lang")
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    sample = hash_sample(marks, LABELLED, "doc_id").collect()
    quality = {r.doc_id: float(r.q >= 0.5) for r in sample}
    pool = hash_sample(docs.select("doc_id").filter("doc_id is not null"), POOL, "doc_id")
    ids = sorted({r.doc_id for r in pool.collect()} | set(quality))  # at most 2 (LABELLED + POOL)
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(i,) for i in ids], "doc_id bigint") if ids else docs.select("doc_id").limit(0)
    seen = features(docs.join(F.broadcast(chosen), "doc_id", "left_semi")).withColumn("kinds", shares("kinds"))
    seen = seen.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in seen.columns if c != "doc_id"]), F.struct("_h", "source", "lang")).alias("x"))
    rows = seen.select("doc_id", "x.*").toPandas().sort_values("doc_id")
    y = rows.doc_id.map(quality)
    good = float(np.nanmean(y)) if len(rows) and y.notna().any() else 0.5
    # Kinds of the metadata view: the most frequent sources and languages of the sample.
    kinds = [(c, v) for c in ("source", "lang") for v in sorted(rows[c].dropna().value_counts().index[:CLASSES])]
    made = features(docs)
    content = [F.col(c) for c in CONTENT]
    meta = [F.col(c) for c in META] + [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, v in kinds]
    if not (y == 1).any() or not (y == 0).any():
        odds = [F.lit(float(np.log((good + 1e-6) / (1 - good + 1e-6))))] * 2
    else:
        bags = np.frombuffer(b"".join(rows.kinds), "<f4").reshape(len(rows), WORDS)
        xs = [np.c_[rows[CONTENT].to_numpy(float), bags], np.c_[rows[META].to_numpy(float), np.array([(rows[c] == v).to_numpy(float) for c, v in kinds]).reshape(len(kinds), -1).T]]
        views, _ = co_train(xs, y.to_numpy(float), (len(CONTENT), None))
        odds = [views[0].column(content, F.col("kinds")), views[1].column(meta)]
    sure = lambda c: 1 / (1 + F.exp(-F.greatest(F.least(c, F.lit(30.0)), F.lit(-30.0))))
    scored = made.select("doc_id", sure(odds[0]).alias("content_score"), sure(odds[1]).alias("meta_score"), sure((odds[0] + odds[1]) / 2).alias("score"))
    return scored.withColumn("quality_pred", (F.col("score") >= 0.5).cast("int")).withColumn("kept", F.col("score") >= 0.5)


ship(__name__)
