"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

Each source's mean repetition rate is its target share of `budget` characters over the characters it has. Every document
draws its number of copies from the Poisson distribution with that mean, by inverting the distribution at a number in
[0, 1) hashed from the seed and the row; copies are dealt out by a second hash, which is a global shuffle.

The hash is the first 52 bits of md5 over doc_id and the md5 of the text, which any engine can repeat; so rows that share
a doc_id, or have none, draw each for themselves. Means above STEP are drawn as sums of parts, so the inversion never
underflows. A null source is a source of its own, and so is a source without a stated weight, which takes
`default_weight`. Null and empty texts have no characters but are drawn like others; a source of empty texts only has
rate 0. Rows equal in doc_id and text draw the same number, each for itself, and are spread over SPREAD partitions. Null
doc_id is hashed as "", null text as an empty one. An empty table gives none. Texts of any length are only hashed and
carried. Columns of docs are kept, whatever their names, but for copy and mix_key, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A mean is drawn in parts of at most this size.
STEP = 32.0
#: Terms of the inverted distribution: beyond them its tail is under 2^-53 for every mean up to STEP.
TERMS = 110
#: Partitions over which rows that are equal in doc_id and text are spread.
SPREAD = 64
#: Sources up to which the table of rates is broadcast; beyond, it is joined by a shuffle.
MAX_BROADCAST = 20_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts, joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(
        float(2**52)
    )


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float, budget: float) -> DataFrame:
    """source, n_docs, chars, rate: one row per source, pre-aggregated before its shuffle."""
    sizes = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars")
    )
    stated = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")] if weights else F.lit(
        None
    ).cast("double")
    weighed = sizes.withColumn("weight", F.coalesce(stated, F.lit(float(default_weight))))
    total = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars"))
    wanted = F.col("weight") / F.col("all_weight") * F.col("all_chars") * budget / F.col("chars")
    rate = F.when((F.col("chars") > 0) & (F.col("all_weight") > 0), wanted).otherwise(F.lit(0.0))
    # the totals are one row
    return weighed.join(F.broadcast(total)).select("source", "n_docs", "chars", rate.alias("rate"))


def _cdf(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS - 1."""
    logs = [math.lgamma(k + 1) for k in range(TERMS)]
    log_factorial = lambda k: F.element_at(F.array(*map(F.lit, logs)), (k + 1).cast("int"))
    term = lambda k: F.exp(k * F.log(mean) - mean - log_factorial(k))
    terms = F.transform(F.sequence(F.lit(0), F.lit(TERMS - 1)), term)
    last = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0))
    return F.aggregate(terms, F.array().cast("array<double>"), lambda done, p: F.concat(done, F.array(p + last(done))))


def mix(
    docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, budget: float = 1.0, seed: int = 17
) -> DataFrame:
    """The columns of docs, then copy (from 1) and mix_key; rows are dealt to partitions at random and sorted by mix_key
    within each, which is a random order.

    docs needs doc_id, text and source. The rates are stored once, and broadcast if their number is proven small.
    """
    docs = docs.drop("copy", "mix_key")
    rates = source_rates(docs, weights, default_weight, budget).filter("rate > 0")
    rates = written(rates.select(F.col("source").alias("rate_source"), "rate"), "mixing-rates")
    parts = F.ceil(F.col("rate") / STEP).cast("int")
    table = rates.select("rate_source", parts.alias("n_parts"), _cdf(F.col("rate") / parts).alias("cdf"))
    if rates.count() <= MAX_BROADCAST:
        table = F.broadcast(table)
    inner = [f"_{k}" for k in range(len(docs.columns))]
    at = dict(zip(docs.columns, inner, strict=True))
    rows = docs.toDF(*inner)
    row_hash = F.md5(F.coalesce(F.col(at["text"]), F.lit("")).cast("binary"))
    rows = rows.withColumn("key", F.concat_ws("|", F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit("")), row_hash))
    drawn = lambda i: F.size(F.filter("cdf", lambda c: c <= uniform(F.lit(str(seed)), F.col("key"), i.cast("string"))))
    one = F.size(F.filter("cdf", lambda c: c <= F.col("drawn")))
    more = F.aggregate(F.transform(F.sequence(F.lit(2), F.col("n_parts")), drawn), F.lit(0), lambda a, b: a + b)
    joined = rows.join(table, F.col(at["source"]).eqNullSafe(F.col("rate_source")))
    joined = joined.withColumn("drawn", uniform(F.lit(str(seed)), F.col("key"), F.lit("1")))
    times = one + F.when(F.col("n_parts") > 1, more).otherwise(F.lit(0))
    # where a row lies in the input tells equal rows apart, but for nothing else than to spread them
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).alias("spread")
    # the number is computed once, in the array that is exploded; no copies are an empty one
    copies = joined.select(
        *inner, "key", spread, F.posexplode(F.array_repeat(F.lit(True), times)).alias("before", "is_copy")
    )
    copies = copies.select(*inner, "key", "spread", (F.col("before") + 1).alias("copy"))
    keyed = copies.withColumn(
        "mix_key", F.md5(F.concat_ws("|", F.lit(str(seed + 1)), "key", F.col("copy").cast("string")))
    )
    # dealt by one hash and sorted by another: a global shuffle that needs no sample of the keys, so texts are read once
    mixed = keyed.drop("key").repartition("mix_key", "spread").sortWithinPartitions("mix_key")
    return mixed.select(*[F.col(n).alias(c) for c, n in at.items()], "copy", "mix_key")
