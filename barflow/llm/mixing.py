"""Mixing sources to target weights by Poisson replication.

A source's rate is the number of times its documents must be seen on average for its
share of all characters to be its target share.  Each document draws a uniform number
from a hash of its id, inverts the Poisson distribution of its source's rate, and is
repeated that often; the copies are then ordered by a hash over the whole table.  A rate
above PART_RATE is cut into equal parts: a Poisson number is the sum of independent ones,
so each part draws for itself, as a row of its own that may go to any task.

Defined cases: a null source is a source of its own; without targets every source weighs
the same; a source without a target gets rate 0 and goes; a source whose texts are all empty
has rate 1; rows that share a doc_id get the same number of copies; a null doc_id counts as
the empty id; columns named copy_no and shuffle_key are replaced, all others stay, whatever
their names.  The same seed gives the same copies on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

SEED = "mix-1"
#: Rates are broadcast up to so many sources; beyond that the join is salted.
BROADCAST_SOURCES, SALTS = 50_000, 64
#: Largest rate of one draw; copies of a draw are fewer than PART_COPIES, which spaces the copy numbers of parts.
PART_RATE, PART_COPIES = 64.0, 1000


def rates(docs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(source, rate): ``targets`` has source and weight; one small row for each source."""
    mass = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("mass"))
    if targets is None:
        weighed = mass.withColumn("weight", F.lit(1.0))
    else:
        want = targets.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        weighed = mass.join(want, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna({"weight": 0.0})
    total = weighed.agg(F.sum("mass").alias("all_mass"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("mass") == 0, F.lit(1.0)).when(F.col("all_weight") == 0, F.lit(0.0)).otherwise(F.col("weight") / F.col("all_weight") * F.col("all_mass") / F.col("mass"))
    return weighed.crossJoin(F.broadcast(total)).select("source", rate.alias("rate"))  # total is one row


def poisson_cdf(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, ... to where nothing is left; empty for rate 0."""
    most = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(40.0)).cast("int")
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        log = s["log"] + F.ln(rate) - F.ln(k.cast("double"))
        return F.struct(log.alias("log"), F.array_append(s["cdf"], F.element_at(s["cdf"], -1) + F.exp(log)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["cdf"])).otherwise(F.array().cast("array<double>"))


def _key(seed: str, docs_id: Column, *more: Column) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(docs_id.cast("string"), F.lit("")), *[c for x in more for c in (F.lit(":"), x.cast("string"))]))


def uniform(doc_id: Column, seed: str = SEED, part: Column | None = None) -> Column:
    """In [0, 1), from the first 52 bits of MD5 of seed and id, and of the part after the first."""
    key = _key(seed, doc_id) if part is None else F.when(part == 0, _key(seed, doc_id)).otherwise(_key(seed, doc_id, part))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix(docs: DataFrame, targets: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) repeated, with copy_no (from 1; by PART_COPIES from part to part) and shuffle_key, in the order of shuffle_key."""
    docs = docs.drop("copy_no", "shuffle_key")
    mark = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))  # no column begins with so many
    n = {x: f"{mark}{x}" for x in ("source", "rate", "parts", "cdf", "part", "salt", "salts", "n")}
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")
    drawn = rates(docs, targets).withColumn("parts", parts).withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))
    drawn = saved(drawn.select(F.col("source").alias(n["source"]), F.col("parts").alias(n["parts"]), F.col("cdf").alias(n["cdf"])), "rates")
    same = F.col("source").eqNullSafe(F.col(n["source"]))
    size = drawn.agg(F.count("*").alias("n"), F.max(n["parts"]).alias("parts")).first()
    if size.n <= BROADCAST_SOURCES:
        rated = docs.join(F.broadcast(drawn), same)
    else:  # a source may hold a third of all rows
        salted = drawn.withColumn(n["salts"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = docs.withColumn(n["salt"], F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col(n["salt"]) == F.col(n["salts"])))
    rated = rated.withColumn(n["part"], F.explode(F.sequence(F.lit(0), F.col(n["parts"]) - 1))) if (size.parts or 1) > 1 else rated.withColumn(n["part"], F.lit(0))
    if (size.parts or 1) > 1:  # parts of a document go to several tasks before they become copies
        rated = rated.repartition(F.col("doc_id"), F.col(n["part"]))
    u = uniform(F.col("doc_id"), seed, F.col(n["part"]))
    counted = rated.withColumn("shuffle_key", u).withColumn(n["n"], F.size(F.filter(n["cdf"], lambda x: x <= F.col("shuffle_key")))).filter(F.col(n["n"]) > 0)
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col(n["n"])))).withColumn("copy_no", F.col("copy_no") + F.col(n["part"]) * PART_COPIES)
    keyed = copies.withColumn("shuffle_key", _key(seed, F.col("doc_id"), F.col("copy_no")))
    return keyed.select(*docs.columns, "copy_no", "shuffle_key").orderBy("shuffle_key", "doc_id", "copy_no")


SQL = """
with mass as (select source, sum(coalesce(length(text), 0)) as mass from documents group by source),
rates as (
  select source, case when mass = 0 then 1.0::double else (1.0::double / count(*) over ()) * (sum(mass) over ())::double / mass::double end as rate from mass),
parted as (select *, greatest(ceil(rate / 64), 1)::integer as parts from rates),
drawn as (
  select *, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '') || case when part = 0 then '' else ':' || part::varchar end), 1, 13))::bigint::double / 4503599627370496.0 as u
  from (select d.doc_id, d.source, d.lang, d.n_chars, d.text, unnest(range(r.parts))::integer as part from documents d join parted r on d.source is not distinct from r.source)),
steps as (
  select source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) as cdf
  from (select source, rate / parts as rate, unnest(range(0, ceil(rate / parts + 12 * sqrt(rate / parts) + 40)::bigint + 1)) as k from parted where rate > 0)),
counted as (
  select d.*, (select count(*) from steps s where s.source is not distinct from d.source and s.cdf <= d.u) as n from drawn d),
copies as (select *, (unnest(range(1, n + 1)) + 1000 * part)::integer as copy_no from counted)
select doc_id, text, lang, source, n_chars, copy_no,
       md5('mix-1:' || coalesce(doc_id::varchar, '') || ':' || copy_no::varchar) as shuffle_key
from copies
"""
