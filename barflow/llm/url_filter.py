"""URL filters: rules by host suffix and path prefix, else gradient-boosted trees on lexical features.

DataFrame functions and ``pyspark.ml`` only.  URLs that a rule decides are the labelled
ones; a bounded sample of them (chosen by hash) trains the trees, which judge the rest.
Statistics of suffixes cover all pages: the share of pages and the number of hosts under
a suffix, as orders of magnitude (powers of ten).  They hold no label and cannot name a suffix, so the trees do
not just repeat the rules; ``held_out`` measures what they learn.

Defined cases: a null URL and one without ``://`` has an empty host and path, fits no rule
and has zero features; repeated rows each get a row; a URL of any length is read whole;
other columns of the pages do not matter; if the sample is empty or of one kind, the
method's verdict is allow (or that kind's).
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, let, saved

#: (host, path prefix, verdict); a short list, which becomes part of the plan.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Bound of the labelled sample; trees and their depth.
TRAIN_ROWS, TREES, DEPTH, SEED = 20_000, 10, 4, 7
#: Statistics are broadcast up to so many suffixes; beyond that the join is salted.
BROADCAST_SUFFIXES, SALTS = 50_000, 64
FEATURES = ["url_len", "host_len", "path_len", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params", "fragment", "suffix_share", "suffix_hosts"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c != "", let(share(c), lambda p: -p * F.log2(p))).otherwise(F.lit(0.0)))
    return F.when(n > 0, F.aggregate(bits, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))).otherwise(F.lit(0.0))


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url) with host, path, the lexical features and the host's suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_path(F.col("url"))
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("double")
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    parts = pages.withColumns({"host": host, "path": path})
    return parts.withColumns({
        "url_len": F.length(url).cast("double"), "host_len": F.length("host").cast("double"), "path_len": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"), "labels": count(F.col("host"), ".") + 1,
        "digit_ratio": F.when(F.length(url) > 0, (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / F.length(url)).otherwise(F.lit(0.0)),
        "hyphens": count(F.col("host"), "-"), "entropy": entropy(url),
        "params": F.when(query == "", F.lit(0.0)).otherwise(count(query, "&") + 1), "fragment": F.contains(url, F.lit("#")).cast("double"),
        "suffix": F.substring_index("host", ".", -1),
    })


def suffix_stats(made: DataFrame) -> DataFrame:
    """suffix, suffix_share (of all pages) and suffix_hosts (about how many), both as whole decimal logarithms, rounded down."""
    # Hosts are counted by host first, so that no task holds all pages of a suffix.
    hosts = made.groupBy("suffix", "host").agg(F.count("*").alias("n"))
    counts = saved(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("hosts")), "suffixes")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    return counts.select("suffix", F.floor(F.log10(F.col("n") / F.lit(total))).cast("double").alias("suffix_share"), F.floor(F.log10(F.col("hosts"))).cast("double").alias("suffix_hosts"))


def _with_stats(df: DataFrame, by_suffix: DataFrame, small: bool) -> DataFrame:
    if small:
        return df.join(F.broadcast(by_suffix), "suffix")
    salted = by_suffix.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a suffix may hold a third of all pages
    return df.withColumn("_salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int")).join(salted, ["suffix", "_salt"]).drop("_salt")


def _fit(sample: DataFrame):
    """Trees trained on rows of features and label, or the constant score if there is one kind of label only."""
    has = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("bad")).first()
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    if not 0 < has.bad < has.n:
        constant = F.lit(1.0 if has.n and has.bad == has.n else 0.0)
        return lambda df: df.withColumn("block_score", constant)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label").fit(vectors.transform(sample).select("features", "label"))
    return lambda df: model.transform(vectors.transform(df)).withColumn("block_score", vector_to_array("probability")[1])


def _prepared(pages: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    """Pages with features, rule and by_rule; the saved sample of those that a rule decides, with label."""
    made = lexical(pages.select("page_id", "url"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    made = made.withColumns({"rule": rule, "by_rule": verdict})
    by_suffix = suffix_stats(made)
    small = by_suffix.limit(BROADCAST_SUFFIXES + 1).count() <= BROADCAST_SUFFIXES
    chosen = hash_sample(made.filter("by_rule is not null"), TRAIN_ROWS, "page_id")
    labelled = _with_stats(chosen.withColumn("label", (F.col("by_rule") == "block").cast("double")), by_suffix, small)
    return _with_stats(made, by_suffix, small), saved(labelled.repartition(4, "page_id"), "urls")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score (null where a rule decides)."""
    made, sample = _prepared(pages, rules)
    scored = _fit(sample)(made)
    method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), F.when(F.col("by_rule").isNull(), F.col("block_score")).alias("block_score"))


def held_out(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row: labelled rows aside (hosts of a quarter by hash), accuracy of the trees there, and of always saying the commoner kind."""
    sample = _prepared(pages, rules)[1].withColumn("aside", F.pmod(F.xxhash64("host"), F.lit(4)) == 0)
    scored = _fit(sample.filter("not aside"))(sample.filter("aside"))
    right = ((F.col("block_score") >= 0.5) == (F.col("label") == 1)).cast("double")
    return scored.agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.greatest(F.avg("label"), 1 - F.avg("label")).alias("commoner"))
