"""Features, labels, splits, training, evaluation and filters for models on bars."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEY, SERIES, new_york, ratio, series
from ..sources.files import saved

FEATURES = ["rsi", "natr", "dist_vwap", "vol_ratio", "dist_ema200", "wick_pct", "hour"]


def features(df: DataFrame) -> DataFrame:
    """Stationary features of bars with rsi, atr, vwap, volume_sma_20 and ema_200."""
    wick = (F.least("open", "close") - F.col("low")) - (F.col("high") - F.greatest("open", "close"))
    return df.withColumns({
        "natr": 100 * ratio(F.col("atr"), F.col("close")), "dist_vwap": F.coalesce(100 * ratio(F.col("close") - F.col("vwap"), F.col("vwap")), F.lit(0.0)),
        "vol_ratio": F.coalesce(ratio(F.col("volume"), F.col("volume_sma_20")), F.lit(0.0)), "dist_ema200": 100 * ratio(F.col("close") - F.col("ema_200"), F.col("ema_200")),
        "wick_pct": 100 * ratio(wick, F.col("close")), "hour": F.hour(new_york(F.col("ts"))).cast("double")})


def lag_features(df: DataFrame, cols: list[str], lags: int = 5) -> DataFrame:
    return df.withColumns({f"{c}_L{k}": F.lag(c, k).over(series()) for c in cols for k in range(1, lags + 1)})


def labelled_samples(fills: DataFrame, bars: DataFrame, cols: list[str], feature_bar: str = "signal") -> DataFrame:
    """Entry fills (tag ENTRY) with the symbol's next exit (tag not ENTRY): result, label, and the features of the entry bar.

    ``feature_bar='signal'`` takes the bar before the fill, so no feature is of the fill's own bar.
    """
    w = Window.partitionBy(*SERIES).orderBy(F.desc("ts"), F.desc("tag")).rowsBetween(Window.unboundedPreceding, 0)
    exit_ = F.last(F.when(F.col("tag") != "ENTRY", F.struct("ts", "price")), ignorenulls=True).over(w)
    e = fills.withColumn("x", exit_).filter("tag = 'ENTRY' and x is not null")
    way = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    e = e.select(*KEY, "side", F.col("price").alias("entry_price"), F.col("x.ts").alias("exit_ts"), F.col("x.price").alias("exit_price"), (way * (F.col("x.price") - F.col("price"))).alias("pnl"))
    b = bars.select(*KEY, *cols)
    if feature_bar == "signal":
        b = b.select(*KEY, *[F.lag(c).over(series()).alias(c) for c in cols])
    return e.join(b, KEY).withColumn("label", (F.col("pnl") > 0).cast("double")).dropna(subset=cols)


def label_balance(samples: DataFrame) -> DataFrame:
    """Samples and share of label 1 by year and symbol, by year, and in all: that row is there without samples too (a rollup gives none)."""
    rows = samples.select(F.year("ts").alias("year"), "symbol", "label", F.lit(1).alias("_one"))
    none = samples.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    made = rows.unionByName(none).rollup("year", "symbol").agg(F.count("_one").alias("n"), F.avg("label").alias("positive"), F.grouping_id().alias("_level"))
    return made.filter("n > 0 or _level = 3").drop("_level")


def split(samples: DataFrame, keys: list[str], test: float = 0.2, seed: int = 42, stratify: bool = True) -> DataFrame:
    """``is_test`` for the fraction of rows (of each label) that come first by a seeded hash: exact and repeatable.

    The rank is found without putting a label in one task: rows are counted in 4096 ranges of
    the hash, whole ranges below the cut are taken, and only the range at the cut is ranked.
    """
    part = ["label"] if stratify else []
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    made = samples.withColumn("_h", h).withColumn("_r", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    sizes = made.groupBy(*part, "_r").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*part).orderBy("_r")  # at most 4096 rows a label
    sizes = sizes.withColumn("_before", F.sum("_c").over(w) - F.col("_c")).withColumn("_cut", F.floor(F.sum("_c").over(Window.partitionBy(*part)) * F.lit(test)))
    near = made.join(F.broadcast(sizes), [*part, "_r"])
    place = F.row_number().over(Window.partitionBy(*part, "_r").orderBy("_h", *keys))
    return near.withColumn("is_test", F.col("_before") + place <= F.col("_cut")).drop("_h", "_r", "_c", "_before", "_cut")


def train(samples: DataFrame, cols: list[str], kind: str = "rf", min_samples: int = 50, seed: int = 42):
    """A fitted random forest (``rf``) or boosted trees (``gbt``) with classes weighed evenly; None below ``min_samples`` or with one class."""
    samples = samples.persist()  # every tree reads them again
    try:
        n = samples.agg(F.count("*").alias("n"), F.avg("label").alias("p")).first()
        if n.n < min_samples or not 0 < n.p < 1:
            return None
        weighed = samples.withColumn("w", F.when(F.col("label") == 1, F.lit(0.5 / n.p)).otherwise(F.lit(0.5 / (1 - n.p))))
        x = VectorAssembler(inputCols=cols, outputCol="features").transform(weighed)
        maker = RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, weightCol="w") if kind == "rf" else GBTClassifier(maxIter=10, maxDepth=3, seed=seed, weightCol="w")
        return maker.fit(x)
    finally:
        samples.unpersist()


#: Trees a symbol, splits from the root to a leaf, ranges of a feature, and features looked at in a node (of all; None: their root).
TREES, DEPTH, BINS = 20, 5, 32
#: Chances of a Poisson count with mean 1 being at most 0, 1, 2, ...: how often a tree draws a sample.
DRAWS = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]


def forests_by_symbol(samples: DataFrame, cols: list[str], keys: list[str], min_samples: int = 50, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, seed: int = 42) -> DataFrame:
    """A random forest for each symbol with ``min_samples`` samples of both labels, all grown together: a row a symbol.

    Trees grow level by level: counts of both labels by (symbol, tree, node, feature, range) choose
    each node's split, then every sample goes on to its next nodes.  The number of jobs depends
    on ``depth`` alone, samples of one symbol may be in any number of tasks, and a symbol's
    forest does not depend on other symbols.  ``keys`` (with the symbol) name a sample: their hash says
    how often each tree draws it.  A null feature counts as 0; labels weigh evenly within a symbol.
    """
    known = samples.filter("symbol is not null and label is not null")
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    cuts = [i / bins for i in range(1, bins)]
    of_symbol = known.groupBy("symbol").agg(
        F.count("*").alias("_n"), F.sum((F.col("label") == 1).cast("bigint")).alias("_ones"),
        F.array(*[F.array_distinct(F.percentile_approx(v, cuts, 10_000)) for v in value.values()]).alias("_cuts"))
    of_symbol = saved(of_symbol.filter((F.col("_n") >= min_samples) & (F.col("_ones") > 0) & (F.col("_ones") < F.col("_n"))), "forest-symbols")
    start = F.array_repeat(F.lit(1), trees)
    binned = known.join(of_symbol, "symbol").select("symbol", (F.col("label") == 1).cast("int").alias("y"), F.xxhash64(*keys, F.lit(seed)).alias("h"), _ranges(value, "_cuts").alias("bins"), start.alias("nodes"))
    rows = saved(binned, "forest-samples")
    looked = max(1, round(len(cols) ** 0.5))
    levels = []
    for level in range(depth + 1):
        draws = F.pmod(F.xxhash64("h", "tree"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        times = sum([F.when(draws >= p, 1).otherwise(0) for p in DRAWS], F.lit(0))
        drawn = rows.select("symbol", "y", "h", "bins", F.posexplode("nodes").alias("tree", "node")).filter("node > 0").withColumn("k", times).filter("k > 0")
        counts = drawn.select("symbol", "tree", "node", "y", "k", F.posexplode("bins").alias("feature", "bin")).groupBy("symbol", "tree", "node", "feature", "bin").agg(
            F.sum("k").alias("k"), F.sum(F.col("k") * F.col("y")).alias("k1"))
        levels.append(saved(_splits(counts, of_symbol, looked, level < depth, seed), "forest-level"))
        if level < depth:
            chosen = levels[-1].filter("feature is not null").groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct(F.col("tree") * F.lit(1 << depth + 1) + F.col("node"), F.struct("feature", "bin")))).alias("map"))
            chosen = chosen.select("symbol", F.transform(F.sequence(F.lit(0), F.lit((trees << depth + 1) - 1)), lambda i: F.element_at("map", i)).alias("splits"))
            split = lambda node, tree: F.get("splits", tree * F.lit(1 << depth + 1) + node)
            right = lambda s: (F.get("bins", s["feature"]) > s["bin"]).cast("int")
            onward = F.transform("nodes", lambda node, tree: F.when((node > 0) & split(node, tree).isNotNull(), 2 * node + right(split(node, tree))).otherwise(F.lit(-1)))
            rows = saved(rows.join(chosen, "symbol").select("symbol", "y", "h", "bins", onward.alias("nodes")), "forest-samples")
    every = reduce(DataFrame.unionByName, levels)
    place = F.col("tree") * F.lit(1 << depth + 1) + F.col("node")
    packed = every.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct(place, F.struct("feature", "bin", "prob")))).alias("map"))  # trees * 2 ** (depth + 1) entries at most
    forest = F.transform(F.sequence(F.lit(0), F.lit((trees << depth + 1) - 1)), lambda i: F.element_at("map", i))
    return saved(packed.select("symbol", forest.alias("forest")).join(of_symbol.select("symbol", F.col("_cuts").alias("cuts"), F.col("_n").alias("n")), "symbol").withColumns({"trees": F.lit(trees), "depth": F.lit(depth)}), "forests")


def _ranges(value: dict[str, Column], cuts: str) -> Column:
    """The range of each feature: how many of its cuts lie below the value."""
    return F.array(*[_below(F.get(cuts, F.lit(i)), v) for i, v in enumerate(value.values())])


def _below(cuts: Column, v: Column) -> Column:
    return F.size(F.filter(cuts, lambda x: x < v))


def _splits(counts: DataFrame, of_symbol: DataFrame, looked: int, grow: bool, seed: int) -> DataFrame:
    """symbol, tree, node, prob of label 1, and the split that lowers the Gini impurity most (null: a leaf).

    ``looked`` features of a node are looked at, by a hash.
    """
    node = ["symbol", "tree", "node"]
    # Labels weigh evenly: a 1 counts as many as there are 0s for it.
    weighed = counts.join(of_symbol.select("symbol", ((F.col("_n") - F.col("_ones")) / F.col("_ones")).alias("up")), "symbol")
    one, zero = F.col("k1") * F.col("up"), (F.col("k") - F.col("k1")).cast("double")
    w = Window.partitionBy(*node, "feature")  # a row a range
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = weighed.withColumns({"one": one, "zero": zero}).withColumns({"l1": F.sum("one").over(upto), "l0": F.sum("zero").over(upto), "t1": F.sum("one").over(w), "t0": F.sum("zero").over(w)})
    impure = lambda a, b: F.when(a + b > 0, a * b / (a + b)).otherwise(0.0)
    r1, r0 = F.col("t1") - F.col("l1"), F.col("t0") - F.col("l0")
    gain = impure(F.col("t1"), F.col("t0")) - impure(F.col("l1"), F.col("l0")) - impure(r1, r0)
    prob = (F.col("t1") / (F.col("t1") + F.col("t0"))).alias("prob")
    if not grow:
        return sums.filter("feature = 0").groupBy(*node).agg(F.first(prob).alias("prob")).select(*node, "prob", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("int").alias("bin"))
    ranked = F.row_number().over(Window.partitionBy(*node).orderBy("lot", "feature"))
    features = sums.select(*node, "feature").distinct().withColumn("lot", F.xxhash64("tree", "node", "feature", F.lit(seed))).withColumn("place", ranked).filter(F.col("place") <= looked).select(*node, "feature", F.lit(True).alias("seen"))
    rated = sums.withColumn("gain", F.round(gain, 9)).join(features, [*node, "feature"], "left")
    ok = F.col("seen") & (F.col("gain") > 1e-7) & ((r1 + r0) > 0)
    best = F.max(F.when(ok, F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))).alias("best")
    return rated.groupBy(*node).agg(F.max(F.when(F.col("feature") == 0, prob)).alias("prob"), best).select(*node, "prob", (-F.col("best.f")).cast("int").alias("feature"), (-F.col("best.b")).cast("int").alias("bin"))


def train_by_symbol(samples: DataFrame, cols: list[str], kind: str = "rf", min_samples: int = 50, most: int = 1000) -> dict:
    """For a few symbols (``forests_by_symbol`` is for many): a model for each symbol with ``min_samples`` samples of both labels; more than ``most`` such symbols are an error.

    Each fit is a job over the samples of one symbol; only symbol names reach the driver.
    """
    fit = samples.groupBy("symbol").agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).filter(f"symbol is not null and n >= {int(min_samples)} and k > 1")
    names = sorted(r.symbol for r in fit.select("symbol").limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} symbols to train; raise most, or train one model over all")
    return {s: train(samples.filter(F.col("symbol") == s), cols, kind, min_samples) for s in names}


def score(model, samples: DataFrame, cols: list[str]) -> DataFrame:
    x = VectorAssembler(inputCols=cols, outputCol="features").transform(samples)
    return model.transform(x).withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def score_by_symbol(models: dict, samples: DataFrame, cols: list[str]) -> DataFrame:
    """Probabilities by each symbol's own model; symbols without one pass with 1.0."""
    rest = samples.filter(~F.coalesce(F.col("symbol").isin(*models), F.lit(False))).withColumn("prob", F.lit(1.0))
    for symbol, model in models.items():
        rest = rest.unionByName(score(model, samples.filter(F.col("symbol") == symbol), cols))
    return rest


def score_forests(models: DataFrame, samples: DataFrame, cols: list[str]) -> DataFrame:
    """Probabilities by each symbol's own forest (``forests_by_symbol``), in one join; symbols without one pass with 1.0."""
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    made = samples.join(models.select(F.col("symbol").alias("_symbol"), *[F.col(c).alias(f"_{c}") for c in ("forest", "cuts", "trees", "depth")]), F.col("symbol") == F.col("_symbol"), "left").withColumn("_bins", _ranges(value, "_cuts"))
    size = F.pow(F.lit(2.0), F.col("_depth") + 1).cast("int")
    at = lambda tree, node: F.get("_forest", tree * size + node)

    def walk(tree: Column) -> Column:
        def onward(node: Column, _: Column) -> Column:
            split = at(tree, node)
            return F.when(split["feature"].isNull(), node).otherwise(2 * node + (F.get("_bins", split["feature"]) > split["bin"]).cast("int"))

        return at(tree, F.aggregate(F.sequence(F.lit(1), F.col("_depth")), F.lit(1), onward))["prob"]

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("_trees") - 1), walk), F.lit(0.0), lambda a, p: a + p)
    prob = F.when(F.col("_symbol").isNull(), F.lit(1.0)).otherwise(total / F.col("_trees"))
    return made.withColumn("prob", prob).drop("_symbol", "_forest", "_cuts", "_trees", "_depth", "_bins")


def _counted_before(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``before``: the sum of ``n`` over rows of smaller prob, by ``keys``, for one row a prob.

    Sums of 4096 ranges of prob come first, so that no task orders more than a range.
    """
    ranged = counts.withColumn("_r", F.floor(F.col("prob") * 4096))
    w = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # at most 4097 rows of keys
    sums = ranged.groupBy(*keys, "_r").agg(F.sum(n).alias("_n")).select(*keys, "_r", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_r").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(sums, [*keys, "_r"]).withColumn("before", F.col("_before") + F.coalesce(F.sum(n).over(inner), F.lit(0))).drop("_r", "_before")


def evaluate(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 and ROC-AUC (by average ranks) of prob against label, by ``keys``; rows without a prob are left out.

    Ranks come from counts of each distinct probability, so ties and sizes do not matter.
    """
    y, hit = F.col("label") == 1, F.col("prob") >= 0.5
    c = lambda x: F.sum(F.when(x, F.col("n")).otherwise(0))
    by = scored.filter("prob is not null").groupBy(*keys, "label", "prob").agg(F.count("*").alias("n"))
    base = by.groupBy(*keys).agg(c(y & hit).alias("tp"), c(~y & hit).alias("fp"), c(y & ~hit).alias("fn"), c(~y & ~hit).alias("tn"))
    pos = by.groupBy(*keys, "prob").agg(F.sum(F.when(y, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(~y, F.col("n")).otherwise(0)).alias("q"))
    pos = _counted_before(pos, list(keys), "q")
    auc = pos.groupBy(*keys).agg(ratio(F.sum(F.col("p") * (F.col("before") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))
    made = base.join(auc, list(keys)) if keys else base.crossJoin(auc)  # without keys both are one row
    made = made.withColumns({
        "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
        "precision": F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)),
        "recall": F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))})
    f1 = F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return made.withColumn("f1", f1).select(*keys, "accuracy", "precision", "recall", "f1", "auc")


def rank_models(scored: DataFrame, model: str = "model") -> DataFrame:
    """The measures of each model and its place by F1; equal ones by the model's name."""
    made = evaluate(scored, [model])  # one row a model
    return made.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("f1"), model)))


PERCENTILES = {"median_prob": 0.5, "p75_prob": 0.75, "p90_prob": 0.9, "p95_prob": 0.95}


def probability_profile(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Least, largest and mean probability, its percentiles (between neighbours in proportion), and the share that passes each threshold.

    Percentiles are found by the counts of distinct probabilities, without ordering all in one task.
    """
    p = F.col("prob")
    one = scored.filter("prob is not null").agg(
        F.count("*").alias("_n"), F.min(p).alias("min_prob"), F.max(p).alias("max_prob"), F.avg(p).alias("mean_prob"),
        F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (100 * ratio(F.count_if(p >= t), F.count("*"))).alias("pass_rate")) for t in thresholds]).alias("a"))
    counts = _counted_before(scored.filter("prob is not null").groupBy("prob").agg(F.count("*").alias("c")), [], "c")
    placed = counts.crossJoin(F.broadcast(one.select("_n")))  # one row
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("c")), p))

    def percentile(q: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(q)
        low, share = at(F.floor(place)), F.max(place - F.floor(place))
        return low + (at(F.ceil(place)) - low) * share

    found = placed.agg(*[percentile(q).alias(n) for n, q in PERCENTILES.items()])
    held = ["min_prob", "max_prob", "mean_prob", *PERCENTILES]
    return one.crossJoin(found).select(*held, F.explode("a").alias("x")).select(*held, "x.*")  # one row each


def histogram(scored: DataFrame, bins: int = 10) -> DataFrame:
    return scored.groupBy(F.least(F.width_bucket("prob", F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("label").alias("positive"))


def filter_by_probability(signals: DataFrame, scores: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Signals whose probability is high enough; those without a score pass."""
    return signals.join(scores.select(*keys, "prob"), keys, "left").withColumn("prob", F.coalesce("prob", F.lit(1.0))).filter(F.col("prob") >= threshold)
