"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the output; its rate is that share times the size of the output over its
own rows. A document's number of copies is the inverse Poisson distribution at a uniform number that its
key and the seed give, so it is the same in every run and needs no state. Copies are then ordered by a hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.store import driver_table

#: Every source gets the same share.
EQUAL: dict[str, float] = {}
#: Sources up to this count are broadcast with their rates; more are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Copies that one task makes of a row at once; rows whose rate is above this are dealt to tasks by parts of so many copies.
PART = 4096
#: Rates up to this start at no copies, where exp(-rate) does not underflow.
FROM_ZERO = 400.0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of the parts, the same on every engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def poisson(rate: Column, u: Column) -> Column:
    """The least k whose cumulative probability reaches u, by summing terms.

    Terms more than nine standard deviations from the rate are together below any u and are left out, so a row
    takes about 18 * sqrt(rate) steps: far fewer than its copies. The first term of a large rate comes from
    Stirling's series in the form that loses no digits.
    """
    wide = 9 * F.sqrt(rate)
    k = F.when(rate <= FROM_ZERO, F.lit(0.0)).otherwise(F.floor(rate - wide).cast("double"))
    ratio = (rate - k) / k
    stirling = -k * (ratio - F.log1p(ratio)) - 1 / (12 * k) + 1 / (360 * k * k * k)
    p = F.when(rate <= FROM_ZERO, F.exp(-rate)).otherwise(F.exp(stirling) / F.sqrt(2 * F.lit(math.pi) * k))
    start = F.struct(k.cast("long").alias("k"), p.alias("p"), p.alias("cdf"))

    def step(s: Column, i: Column) -> Column:
        p = s.p * rate / i
        done = (s.cdf >= u) | ((i > rate) & (s.cdf + p == s.cdf))  # u may be above the rounded sum of all terms
        return F.when(done, s).otherwise(F.struct(i.alias("k"), p.alias("p"), (s.cdf + p).alias("cdf")))

    return F.aggregate(F.sequence(k.cast("long") + 1, F.ceil(rate + wide).cast("long") + 40), start, step, lambda s: s.k)


def rates(docs: DataFrame, weights: dict[str, float], size: float | None = None) -> DataFrame:
    """Per source: rows and rate. Sources without a weight share alike what the given weights leave; with none given all are equal.

    A null source is a source of its own. `size` is the wanted number of output rows (default: as many as come in).
    """
    counts = docs.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("rows"))
    given = F.lit(None).cast("double")
    for name, weight in weights.items():
        given = F.when(F.col("of") == name, F.lit(float(weight))).otherwise(given)
    counts = counts.withColumn("given", given)
    total = counts.agg(F.sum("rows").alias("total"), F.sum("given").alias("weight"), F.sum(F.col("given").isNull().cast("int")).alias("free"))
    share = F.coalesce(F.col("given"), F.greatest(F.lit(0.0), 1 - F.coalesce("weight", F.lit(0.0))) / F.col("free"))
    return counts.crossJoin(F.broadcast(total)).select("of", "rows", (share * (F.lit(size) if size else F.col("total")) / F.col("rows")).alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float], size: float | None = None, seed: int = 0) -> DataFrame:
    """The columns of docs and `copy` (from 0): each row as often as its Poisson number says, maybe never.

    Rows with equal doc_id get the same number. Empty tables give no rows; a `copy` column of docs gives way to
    this one, all others stay. Rows of sources with rates above PART, of which there are few for the copies they
    make, have their copies made by many tasks.
    """
    spark = docs.sparkSession
    docs = docs.drop("copy")
    found = rates(docs, weights, size).select(F.col("of").alias("_of"), F.col("rate").alias("_rate"))
    rows = found.limit(BROADCAST_SOURCES + 1).collect()
    few = len(rows) <= BROADCAST_SOURCES
    if few:
        found = driver_table(spark, [tuple(r) for r in rows], found.schema)
    large = any(r._rate > PART for r in rows) if few else not found.where(F.col("_rate") > PART).isEmpty()
    n = poisson(F.col("_rate"), uniform(F.lit(seed), F.col("doc_id")))

    def parts(which: DataFrame) -> DataFrame:
        joined = docs.join(F.broadcast(which) if few else which, docs["source"].eqNullSafe(which["_of"])).withColumn("_copies", n).where("_copies > 0")
        return joined.select(*[docs[c] for c in docs.columns], "_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(PART).cast("long"))).alias("_from"))

    made = parts(found.where(F.col("_rate") <= PART) if large else found)
    if large:
        dealt = parts(found.where(F.col("_rate") > PART)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "_from")
        made = made.unionByName(dealt)
    last = F.least(F.col("_copies"), F.col("_from") + PART) - 1
    return made.select(*docs.columns, F.explode(F.sequence("_from", last)).alias("copy"))


def mix(docs: DataFrame, weights: dict[str, float], size: float | None = None, seed: int = 0) -> DataFrame:
    """Replicated documents in a global random order; `place` is the number they are ordered by, instead of any column of that name."""
    copies = replicate(docs.drop("place"), weights, size, seed)
    return copies.withColumn("place", uniform(F.lit(seed), F.lit("place"), F.col("doc_id"), F.col("copy"))).orderBy("place", "doc_id", "copy")
