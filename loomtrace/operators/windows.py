"""Ordered analytics: islands, sliding counts, episodes, interval unions, timelines, runs, simulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

NS = 1_000_000_000


def islands(df: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """df with the number of its island: it rises by one at each row where `breaks` holds (nulls do not break)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("long")).withColumn(
        name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_break")


def lagged(df: DataFrame, by: list[str], order: list[str], **columns: str) -> DataFrame:
    """df with the previous row's values: name=column."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({name: F.lag(column).over(w) for name, column in columns.items()})


def ranked(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's place in a total order, counted from 1, without any task that sees all rows: rows are split by
    ranges of the order and sorted within each; a row's place is its place there and the number of rows before its range.
    order: columns that together tell rows apart."""
    split = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(
        split.withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}), "ranked"
    )
    # one row per partition
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.col("_nth").bitwiseAND(F.lit((1 << 33) - 1))
    placed = numbered.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + nth + 1).cast("long"))
    return placed.drop("_part", "_nth", "_before")


#: Length of the stretches of time by which a long order is counted piece by piece.
STRETCH_S = 60


def placed(
    df: DataFrame, by: list[str], time: str, order: list[str], name: str = "seq", sizes_of: DataFrame | None = None
) -> DataFrame:
    """df with each row's place among the rows of `by` (from 0) along time and order, without a task that sees all of them:
    places within a stretch of time, and the number of rows in the stretches before it. sizes_of: the frame in which these
    are counted, where another than df has the same rows."""
    stretch = F.coalesce(F.floor(F.col(time) / (STRETCH_S * NS)).cast("long"), F.lit(-(1 << 62)))
    rows = df.withColumn("_stretch", stretch)
    key = [*by, "_stretch"]
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    counted = rows if sizes_of is None else sizes_of.withColumn("_stretch", stretch)
    sizes = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(*[F.col(k).alias(f"_of{k}") for k in key], F.coalesce(before, F.lit(0)).alias("_before"))
    met = rows.join(offsets, [rows[k].eqNullSafe(offsets[f"_of{k}"]) for k in key])
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(time, *order))
    return met.withColumn(name, (F.col("_before") + nth - 1).cast("long")).drop("_before", "_stretch", *[f"_of{k}" for k in key])


def most_in_window(calls: DataFrame, seconds: int) -> DataFrame:
    """The most calls of a tool in any span of so many seconds, by session."""
    w = Window.partitionBy("session", "tool").orderBy("start_ns").rangeBetween(-seconds * NS, 0)
    return calls.withColumn("_n", F.count(F.lit(1)).over(w)).groupBy("session", "tool").agg(
        F.max("_n").alias(f"most_in_{seconds}s")
    )


def episodes(calls: DataFrame, gap_seconds: int = 1_200) -> DataFrame:
    """Stretches of an agent's calls without a gap longer than gap_seconds."""
    by, order = ["session", "agent"], ["start_ns", "call_id"]
    cut = islands(
        lagged(calls, by, order, _before="start_ns"),
        by,
        order,
        F.col("start_ns") - F.col("_before") > gap_seconds * NS,
        "episode",
    )
    return cut.groupBy("session", "agent", "episode").agg(
        F.count(F.lit(1)).alias("calls"), F.min("start_ns").alias("first_ns"), F.max("start_ns").alias("last_ns")
    )


def same_response(calls: DataFrame, gap_ms: int = 2_000) -> DataFrame:
    """Whether a call came from the same response as the one before it: by emitter if both are known, else by the gap."""
    w = Window.partitionBy("session", "agent").orderBy("aseq")
    before, end = F.lag("emitter").over(w), F.lag("end_ns").over(w)
    gap = F.floor((F.col("start_ns") - end) / 1_000_000)
    both = before.isNotNull() & F.col("emitter").isNotNull()
    return calls.select(
        "session",
        "agent",
        "aseq",
        F.when(both, before == F.col("emitter")).otherwise(F.coalesce(gap < gap_ms, F.lit(False))).alias("same"),
        F.when(both, "exact").otherwise("heuristic").alias("basis"),
    )


def trigger_of(calls: DataFrame) -> DataFrame:
    """How often each category follows each other one within an agent."""
    w = Window.partitionBy("session", "agent").orderBy("aseq")
    return calls.withColumn("trigger", F.coalesce(F.lag("category").over(w), F.lit("none"))).groupBy(
        "category", "trigger"
    ).agg(F.count(F.lit(1)).alias("n"))


def active_union(calls: DataFrame, by: str = "session") -> DataFrame:
    """Time covered by at least one call (union) beside the sum of all calls' times."""
    w = Window.partitionBy(by).orderBy("start_ns", "call_id").rowsBetween(Window.unboundedPreceding, -1)
    timed = calls.filter("end_ns IS NOT NULL").withColumn("_until", F.max("end_ns").over(w))
    new = F.greatest(F.lit(0), F.col("end_ns") - F.greatest("start_ns", F.coalesce("_until", "start_ns")))
    return timed.groupBy(by).agg(
        F.sum(new).alias("active_ns"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("tool_ns")
    )


def timeline(calls: DataFrame, width_ns: int) -> DataFrame:
    """Buckets of width_ns per session: starts and failures in the bucket of the start, time spread over all buckets it
    overlaps, and the union of that time. A call is split only into buckets it touches."""
    bucket = lambda ns: F.floor(F.col(ns) / width_ns)
    starts = calls.groupBy("session", bucket("start_ns").alias("bucket")).agg(
        F.count(F.lit(1)).alias("starts"),
        F.count_if(F.col("status") == "error").alias("failures"),
        F.count_if(F.col("server").isNotNull()).alias("mcp"),
        F.count_if(F.col("status") == "unknown").alias("unknown"),
    )
    spread = calls.filter("end_ns > start_ns").select(
        "session",
        "call_id",
        "start_ns",
        "end_ns",
        F.explode(F.sequence(bucket("start_ns"), F.floor((F.col("end_ns") - 1) / width_ns))).alias("bucket"),
    )
    parts = spread.select(
        "session",
        "bucket",
        "call_id",
        F.greatest("start_ns", F.col("bucket") * width_ns).alias("lo"),
        F.least("end_ns", (F.col("bucket") + 1) * width_ns).alias("hi"),
    )
    w = Window.partitionBy("session", "bucket").orderBy("lo", "call_id").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_until", F.coalesce(F.max("hi").over(w), F.col("lo")))
    times = parts.groupBy("session", "bucket").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("tool_ns"),
        F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "_until"))).alias("active_ns"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return starts.join(times, ["session", "bucket"], "full").select(
        "session", "bucket", *[zero(c) for c in ("starts", "failures", "mcp", "unknown", "tool_ns", "active_ns")]
    )


def writer_runs(calls: DataFrame) -> DataFrame:
    """Runs of consecutive edits of a target by one agent, and how often the writer changes."""
    edits = calls.filter("category = 'edit'")
    by, order = ["session", "target"], ["start_ns", "call_id"]
    cut = islands(lagged(edits, by, order, _before="agent"), by, order, F.col("_before") != F.col("agent"), "run")
    runs = cut.groupBy(*by, "run").agg(F.min("agent").alias("agent"), F.count(F.lit(1)).alias("edits"))
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.count_distinct("agent").alias("agents"), F.max("edits").alias("longest")
    )


def handoffs(calls: DataFrame) -> DataFrame:
    """Reads whose last edit of the same target before them is by another agent."""
    w = Window.partitionBy("session", "target").orderBy("start_ns", "call_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    edit = F.when(F.col("category") == "edit", F.struct(F.col("agent").alias("a"), F.col("call_id").alias("c")))
    both = calls.filter("category IN ('read', 'edit')").withColumn("_w", F.last(edit, ignorenulls=True).over(w))
    return both.filter((F.col("category") == "read") & (F.col("_w.a") != F.col("agent"))).select(
        "session",
        "target",
        F.col("agent").alias("reader"),
        F.col("_w.a").alias("writer"),
        F.col("call_id").alias("read_id"),
        F.col("_w.c").alias("write_id"),
    )


def rereads(calls: DataFrame) -> DataFrame:
    """Reads of a target that the same agent read in an earlier epoch; modified if anyone edited it between."""
    edits = F.sum((F.col("category") == "edit").cast("long")).over(
        Window.partitionBy("session", "target").orderBy("start_ns", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    reads = calls.filter("category IN ('read', 'edit')").withColumn("_e", edits).filter("category = 'read'")
    last = lagged(
        reads, ["session", "agent", "target"], ["start_ns", "call_id"], _epoch="epoch", _before="_e", _fp="content_fp"
    )
    again = last.filter(F.col("_epoch") < F.col("epoch"))
    kind = F.when(F.col("_e") > F.col("_before"), "modified_between").when(
        F.col("_fp") == F.col("content_fp"), "identical"
    ).otherwise("changed")
    return again.withColumn("kind", kind).groupBy("session", "kind").agg(
        F.count(F.lit(1)).alias("rereads"),
        F.count_distinct("target").alias("targets"),
        F.count_distinct("agent").alias("agents"),
    )


def cooldown(times: Column, delay: int) -> Column:
    """When calls at `times` (sorted seconds) are served if one is served at most every `delay`: a call within the delay
    waits and replaces one that waits; what waits is served when the delay is over, and at the end. A call at that very
    moment takes its place. One fold over the array: struct<served array, last, pending>."""
    state = F.struct(
        F.array().cast("array<double>").alias("served"),
        F.lit(None).cast("double").alias("last"),
        F.lit(None).cast("double").alias("pending"),
    )

    def serve(s: Column, t: Column) -> Column:
        due = s["last"] + F.lit(float(delay))
        late = s["pending"].isNotNull() & (due < t)
        done = F.when(late, F.concat(s["served"], F.array(due))).otherwise(s["served"])
        last = F.when(late, due).otherwise(s["last"])
        now = last.isNull() | (t - last >= delay)
        return F.struct(
            F.when(now, F.concat(done, F.array(t))).otherwise(done).alias("served"),
            F.when(now, t).otherwise(last).alias("last"),
            F.when(now, F.lit(None).cast("double")).otherwise(t).alias("pending"),
        )

    end = lambda s: F.when(
        s["pending"].isNotNull(), F.concat(s["served"], F.array(s["last"] + F.lit(float(delay))))
    ).otherwise(s["served"])
    return F.aggregate(times, state, serve, end)


def cooldown_simulation(
    calls: DataFrame, delays: tuple[int, ...] = (10, 30, 60, 120, 300, 600), gap_seconds: int = 1_200
) -> DataFrame:
    """Per agent, tool and delay: calls, calls still made, calls avoided, over episodes that a fold runs through."""
    by, order = ["session", "agent", "tool"], ["start_ns", "call_id"]
    cut = islands(
        lagged(calls, by, order, _b="start_ns"),
        by,
        order,
        F.col("start_ns") - F.col("_b") > gap_seconds * NS,
        "episode",
    )
    lists = cut.groupBy(*by, "episode").agg(F.array_sort(F.collect_list(F.col("start_ns") / NS)).alias("times"))
    each = lists.withColumn("delay", F.explode(F.array(*map(F.lit, delays))))
    served = F.lit(None).cast("array<double>")
    for d in delays:
        served = F.when(F.col("delay") == d, cooldown(F.col("times"), d)).otherwise(served)
    return each.withColumn("_served", F.size(served)).groupBy("session", "agent", "tool", "delay").agg(
        F.sum(F.size("times")).alias("calls"),
        F.sum("_served").alias("made"),
        F.sum(F.size("times") - F.col("_served")).alias("avoided"),
    )
