"""Data for activity forecasts: bins of calls, the lag graph of families, baselines and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAMILIES = {"reads": "read", "searches": "search", "edits": "edit", "shells": "shell"}
CHUNK = ["session", "agent", "chunk"]


def bins(calls: DataFrame, size: int = 4) -> DataFrame:
    """Counts per family in bins of `size` consecutive eligible calls; an ineligible call (of an agent) ends a chunk, and a
    bin that is not full is left out."""
    w = Window.partitionBy("session", "agent").orderBy("aseq").rowsBetween(Window.unboundedPreceding, 0)
    chunks = calls.withColumn("chunk", F.sum((F.col("category") == "agent").cast("long")).over(w)).filter(
        "category <> 'agent'"
    )
    c = Window.partitionBy(*CHUNK)
    rows = chunks.withColumn(
        "bin", F.floor((F.row_number().over(c.orderBy("aseq")) - 1) / size).cast("long")
    ).withColumn("_full", F.floor(F.count(F.lit(1)).over(c) / size))
    return rows.filter(F.col("bin") < F.col("_full")).groupBy(*CHUNK, "bin").agg(
        *[F.count_if(F.col("category") == v).alias(k) for k, v in FAMILIES.items()]
    )


def _long(b: DataFrame) -> DataFrame:
    return b.unpivot([*CHUNK, "bin"], list(FAMILIES), "family", "n")


def lag_graph(b: DataFrame) -> DataFrame:
    """How families follow one another from bin to bin: products with the next bin, each session with the same weight, rows
    adding up to one. Next bins come by a window, not by a join."""
    w = Window.partitionBy(*CHUNK).orderBy("bin")
    nxt = b.withColumns({f"_{k}": F.lead(k).over(w) for k in FAMILIES})
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), (F.col(s) * F.col(f"_{t}")).alias("dot"))
                for s in FAMILIES
                for t in FAMILIES
            ]
        )
    )
    dots = nxt.filter(F.col("_reads").isNotNull()).select("session", pairs.alias("p")).groupBy(
        "session", "p.source", "p.target"
    ).agg(F.sum("p.dot").cast("double").alias("dot"))
    shares = dots.withColumn("w", F.try_divide("dot", F.sum("dot").over(Window.partitionBy("session"))))
    mean = shares.groupBy("source", "target").agg(F.avg("w").alias("w"))
    return mean.select(
        "source", "target", F.round(F.try_divide("w", F.sum("w").over(Window.partitionBy("source"))), 6).alias("weight")
    )


def baselines(b: DataFrame, history: int = 8) -> DataFrame:
    """Mean absolute error per test session of two forecasts: the training mean, and the mean of the bins before."""
    u = _long(b)
    train = u.filter("session % 2 = 0").groupBy("family").agg(F.avg("n").alias("mean"))
    w = Window.partitionBy(*CHUNK, "family").orderBy("bin").rowsBetween(-history, -1)
    test = u.filter("session % 2 = 1").withColumn("recent", F.avg("n").over(w)).filter("recent IS NOT NULL")
    # one row per family
    rows = test.join(F.broadcast(train), "family")
    return rows.groupBy("session").agg(
        F.round(F.avg(F.abs(F.col("n") - F.col("mean"))), 6).alias("mean_error"),
        F.round(F.avg(F.abs(F.col("n") - F.col("recent"))), 6).alias("recent_error"),
        F.count(F.lit(1)).alias("targets"),
    )


def bootstrap(scores: DataFrame, rounds: int = 500) -> DataFrame:
    """95 % interval of the mean difference of two errors, sessions drawn with repetition: each session's number of draws
    in a round is Poisson, from a hash, so rounds are sums and no round is put together in one place."""
    u = F.pmod(F.xxhash64("session", "round"), F.lit(2**31)) / F.lit(float(2**31))
    times = F.size(
        F.filter(
            F.array(*[F.lit(x) for x in (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)]),
            lambda c: c <= F.col("_u"),
        )
    )
    drawn = scores.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_u", u).withColumn(
        "_t", times
    )
    means = drawn.groupBy("round").agg(
        F.try_divide(F.sum(F.col("_t") * (F.col("recent_error") - F.col("mean_error"))), F.sum("_t")).alias("d")
    )
    return means.agg(
        F.round(F.percentile("d", 0.025), 6).alias("low"),
        F.round(F.percentile("d", 0.975), 6).alias("high"),
        F.count("d").alias("rounds"),
    )
