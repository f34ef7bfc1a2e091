"""Evidence graphs: observed dependencies of calls, removals, preconditions with three values, routing, run facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(calls: DataFrame) -> DataFrame:
    """source, target (call ids), kind: a call depends on the one before it in its agent with the same work and content,
    or of the same job; on the search that listed its target; or on the agent call that opened its epoch."""
    agent = ["session", "agent"]
    before = lambda by: Window.partitionBy(*by).orderBy("aseq")
    same = calls.withColumn(
        "source", F.lag("call_id").over(before([*agent, "category", "target", "content_fp"]))
    ).withColumn("kind", F.lit("content"))
    job = calls.filter("server IS NOT NULL").withColumn(
        "source", F.lag("call_id").over(before([*agent, "server", "params"]))
    ).withColumn("kind", F.lit("job"))
    upto = before([*agent, "epoch"]).rowsBetween(Window.unboundedPreceding, -1)
    opened = calls.withColumn(
        "source", F.last(F.when(F.col("category") == "agent", F.col("call_id")), ignorenulls=True).over(upto)
    ).withColumn("kind", F.lit("delegation"))
    listed = calls.withColumn(
        "source",
        F.last(
            F.when((F.col("category") == "search") & (F.col("status") == "success"), F.col("call_id")), ignorenulls=True
        ).over(before([*agent, "epoch", "target"]).rowsBetween(Window.unboundedPreceding, -1)),
    ).filter("category = 'read'").withColumn("kind", F.lit("explicit"))
    parts = [
        x.filter("source IS NOT NULL").select("session", "source", F.col("call_id").alias("target"), "kind")
        for x in (same, job, opened, listed)
    ]
    return reduce(DataFrame.unionByName, parts)


def broken_by(all_edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges whose source is removed (session, call_id) while their target stays."""
    gone = removed.select("session", "call_id").distinct()
    hit = all_edges.join(gone.withColumnRenamed("call_id", "source"), ["session", "source"], "left_semi")
    return hit.join(gone.withColumnRenamed("call_id", "target"), ["session", "target"], "left_anti")


def validity(facts: list[Column]) -> Column:
    """Of facts that are true, false or null (unknown): any false rejects, any unknown leaves it open."""
    any_false = reduce(lambda a, b: a | b, [F.coalesce(~x, F.lit(False)) for x in facts])
    any_unknown = reduce(lambda a, b: a | b, [x.isNull() for x in facts])
    return F.when(any_false, "rejected").when(any_unknown, "indeterminate").otherwise("admissible")


def scenario_facts(calls: DataFrame) -> DataFrame:
    """Per (session, target): whether a replacement keeps the outcome, touches no edit, and was fast enough (null: not known)."""
    return calls.groupBy("session", "target").agg(
        F.count(F.lit(1)).alias("calls"),
        F.when(F.count("content_fp") > 0, F.count_distinct("content_fp") <= 4).alias("same_outcome"),
        F.every(F.col("category") != "edit").alias("no_edit"),
        F.when(F.count("duration_ms") == F.count(F.lit(1)), F.max("duration_ms") < 40_000).alias("fast"),
    )


def sensitivity(facts: DataFrame, names: list[str]) -> DataFrame:
    """How many scenarios have which verdict as they stand, with each fact taken as established, and with all of them."""
    none = [F.col(n) for n in names]
    runs = {"observed": none, "all": [F.lit(True)] * len(names)} | {
        n: [F.lit(True) if m == n else F.col(m) for m in names] for n in names
    }
    # an unknown may be taken as established; what is refuted stays so
    take = lambda cols: [
        F.coalesce(F.when(F.col(n) == F.lit(False), F.lit(False)), c) for n, c in zip(names, cols, strict=True)
    ]
    each = F.explode(
        F.array(*[F.struct(F.lit(k).alias("run"), validity(take(v)).alias("verdict")) for k, v in runs.items()])
    )
    return facts.select(each.alias("r")).groupBy("r.run", "r.verdict").agg(F.count(F.lit(1)).alias("scenarios"))


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """Each path with the longest root that holds it: the path's own ancestors are made and joined by equality."""
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    met = paths.withColumn("_up", F.explode(ups)).join(roots.select(F.col(root).alias("_up")).distinct(), "_up")
    return met.groupBy(path).agg(F.max_by("_up", F.length("_up")).alias(root))


def field_view(facts: DataFrame) -> DataFrame:
    """facts (run, field, time, value): latest value, extremes, distinct values, conflicts (several values at one time)."""
    at = facts.groupBy("run", "field", "time").agg(
        F.count_distinct("value").alias("_v"),
        F.max("value").alias("hi"),
        F.min("value").alias("lo"),
        F.count(F.lit(1)).alias("_n"),
    )
    return at.groupBy("run", "field").agg(
        F.sum("_n").alias("samples"),
        F.max_by("hi", "time").alias("latest"),
        F.min("lo").alias("least"),
        F.max("hi").alias("greatest"),
        F.count_if(F.col("_v") > 1).alias("conflicts"),
    )


def novelty(facts: DataFrame) -> DataFrame:
    """What each observation adds: a value not seen before, one seen at the last time, or one that comes back."""
    w = Window.partitionBy("run", "field", "value").orderBy("time", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.lag("value").over(Window.partitionBy("run", "field").orderBy("time", "id"))
    kind = F.when(F.col("_seen") == 0, "new").when(F.col("_last") == F.col("value"), "unchanged").otherwise("again")
    rows = facts.withColumn("_seen", F.count(F.lit(1)).over(w)).withColumn("_last", last)
    return rows.groupBy("run", "field", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
