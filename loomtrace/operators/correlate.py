"""From events to calls: deduplication, pairing of starts and ends, running counts, links by containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup_counts(raw: DataFrame) -> DataFrame:
    """Events per session, and how many remain when each event_key counts once (pre-aggregated by key)."""
    keys = raw.groupBy("session", "event_key").agg(F.count(F.lit(1)).alias("n"))
    return keys.groupBy("session").agg(
        F.sum("n").alias("events"),
        F.count(F.lit(1)).alias("kept"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicates"),
    )


def pair_by_id(raw: DataFrame) -> DataFrame:
    """One row per (session, agent, call_id): the first start and the first end; later ones are counted. A call without end
    is open, one without start an orphan; the duration is known only with both, and not below zero."""
    at = lambda phase, column: F.min(F.when(F.col("phase") == phase, F.col(column)))
    n = lambda phase: F.count_if(F.col("phase") == phase)
    pairs = raw.groupBy("session", "agent", "call_id").agg(
        F.coalesce(at("start", "tool"), F.min("tool")).alias("tool"),
        at("start", "ns").alias("start_ns"),
        at("end", "ns").alias("end_ns"),
        F.coalesce(at("end", "status"), F.lit("open")).alias("status"),
        (F.greatest(n("start") - 1, F.lit(0)) + F.greatest(n("end") - 1, F.lit(0))).cast("long").alias(
            "duplicate_phases"
        ),
        (n("start") == 0).alias("orphan"),
    )
    span = F.floor((F.col("end_ns") - F.col("start_ns")) / 1_000_000).cast("long")
    return pairs.withColumn("duration_ms", F.when(span.isNotNull(), F.greatest(span, F.lit(0).cast("long"))))


def pair_by_occurrence(raw: DataFrame) -> DataFrame:
    """Pairs without ids: the n-th start with the n-th end of the same agent, tool and input."""
    key = ["session", "agent", "tool", "k"]
    w = Window.partitionBy(*key).orderBy("ns", "call_id")
    once = raw.select(*key, "phase", "ns", "call_id").distinct()
    side = lambda phase, name: once.filter(F.col("phase") == phase).withColumn(
        "n", F.row_number().over(w).cast("long")
    ).select(*key, "n", F.col("ns").alias(name))
    return side("start", "start_ns").join(side("end", "end_ns"), [*key, "n"], "left")


def running_distinct(calls: DataFrame, column: str, name: str) -> DataFrame:
    """How many distinct values of a column a session has shown up to each call."""
    first = F.row_number().over(Window.partitionBy("session", column).orderBy("seq")) == 1
    so_far = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("_new", first.cast("long")).select(
        "session", "seq", "call_id", F.sum("_new").over(so_far).alias(name)
    )


def unique_container(children: DataFrame, parents: DataFrame) -> DataFrame:
    """The one call whose time holds a child's start; none where several do.

    children: session, agent, lo. parents: session, call_id, parent, start_ns, end_ns (null: still open).
    """
    # open calls are counted along a session's time, and their hashes summed: where one is open, the sum is its hash. An
    # agent's own calls are counted alike and taken off; so no child is joined with all calls around it.
    parents = parents.filter(F.col("end_ns").isNull() | (F.col("end_ns") > F.col("start_ns")))
    mark = F.xxhash64("call_id").cast("decimal(38,0)")
    edge = lambda at, sign: parents.filter(f"{at} IS NOT NULL").select(
        "session", F.col("parent").alias("agent"), F.col(at).alias("ns"), F.lit(0).alias("asks"),
        F.lit(sign).alias("n"), (mark * sign).alias("mark")
    )
    zero = F.lit(0).cast("decimal(38,0)").alias("mark")
    asks = children.select(
        "session", "agent", F.col("lo").alias("ns"), F.lit(1).alias("asks"), F.lit(0).alias("n"), zero
    )
    every = edge("start_ns", 1).unionByName(edge("end_ns", -1)).unionByName(asks)
    so_far = lambda *by: Window.partitionBy("session", *by).orderBy("ns", "asks").rangeBetween(
        Window.unboundedPreceding, 0
    )
    others = lambda c: F.sum(c).over(so_far()) - F.sum(c).over(so_far("agent"))
    found = every.withColumns({"_n": others("n"), "_m": others("mark")}).filter("asks = 1")
    n = found.groupBy("session", "agent").agg(
        F.sum("_n").cast("long").alias("candidates"), F.sum("_m").cast("long").alias("_m")
    )
    ids = parents.select(
        F.col("session").alias("_s"), F.xxhash64("call_id").alias("_h"), F.col("call_id").alias("spawned_by")
    )
    one = (F.col("session") == F.col("_s")) & (F.col("_m") == F.col("_h")) & (F.col("candidates") == 1)
    return n.join(ids, one, "left").select("session", "agent", "candidates", "spawned_by")
