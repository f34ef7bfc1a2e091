"""Roll-ups of calls: tool metrics at several granularities, statuses, costs, coverage, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that count as failures.
FAILURES = ("error", "timeout", "denied", "interrupted")


def failed(status: Column | str = "status") -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*FAILURES)


def n_if(condition: Column) -> Column:
    return F.count_if(condition)


def strict_sum(value: Column) -> Column:
    """The sum, or null as soon as one value is missing."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def tool_metrics(calls: DataFrame) -> DataFrame:
    """Metrics per (server, tool), per server and in all, by grouping sets: one pass and one shuffle.

    The median is interpolated, the 95th percentile is of the nearest rank; both over known durations only. The failure
    rate is failures over calls whose outcome is known, null without any.
    """
    c = calls.filter("server IS NOT NULL").withColumn("failed", failed()).withColumn(
        "decided", failed() | (F.col("status") == "success")
    )
    sets = c.groupingSets([["server", "tool"], ["server"], []], "server", "tool")
    return sets.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count("duration_ms").alias("measured"),
        (F.count(F.lit(1)) - F.count("duration_ms")).alias("unmeasured"),
        F.percentile("duration_ms", 0.5).alias("median_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").cast("long").alias("p95_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.sum("duration_ms").alias("total_ms"),
        F.sum("bytes").alias("output_bytes"),
        F.round(F.try_divide(100.0 * n_if(F.col("failed")), n_if(F.col("decided"))), 6).alias("failure_pct"),
    )


def status_summary(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session", "status").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("duration_ms").alias("total_ms"),
        F.min("start_ns").alias("first_ns"),
        F.max("start_ns").alias("last_ns"),
    )


def top_servers(calls: DataFrame, n: int = 3) -> DataFrame:
    """The n servers with most calls of each session; ties by name."""
    counts = calls.filter("server IS NOT NULL").groupBy("session", "server").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")
    )
    order = Window.partitionBy("session").orderBy(F.desc("n"), "server")
    return counts.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= n)


def session_rollup(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_distinct("agent").alias("agents"),
        n_if(failed()).alias("failures"),
        n_if(F.col("status") == "open").alias("open_calls"),
        n_if(F.col("status") == "unknown").alias("unknown_calls"),
        F.min("start_ns").alias("first_ns"),
        F.max(F.coalesce("end_ns", "start_ns")).alias("last_ns"),
        F.min_by("tool", F.struct("start_ns", "call_id")).alias("first_tool"),
        F.max("epoch").alias("epochs"),
    )


def agent_rollup(calls: DataFrame) -> DataFrame:
    """Per agent; a category that is the same in all calls, else null."""
    return calls.groupBy("session", "agent").agg(
        F.min("start_ns").alias("first_ns"),
        F.max("end_ns").alias("last_end_ns"),
        F.count(F.lit(1)).alias("calls"),
        F.when(F.count_distinct("category") == 1, F.max("category")).alias("only_category"),
        F.max_by("status", F.struct("start_ns", "call_id")).alias("last_status"),
    )


def unreliable_timing(calls: DataFrame, least_calls: int = 3, span_ns: int = 2_000_000_000) -> DataFrame:
    """Agents whose calls all fall into a span too short to be real."""
    span = F.max(F.coalesce("end_ns", "start_ns")) - F.min("start_ns")
    return calls.groupBy("session", "agent", "epoch").agg(F.count(F.lit(1)).alias("n"), span.alias("span_ns")).filter(
        (F.col("n") >= least_calls) & (F.col("span_ns") < span_ns)
    )


def tool_stats(calls: DataFrame) -> DataFrame:
    """Per tool; output bytes leave out the echo of edits."""
    return calls.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        n_if(failed()).alias("errors"),
        n_if(F.col("status") == "unknown").alias("unknown_calls"),
        n_if(F.col("status") == "open").alias("open_calls"),
        F.sum(F.when(F.col("category") != "edit", F.col("bytes"))).alias("output_bytes"),
        F.percentile("duration_ms", 0.5).alias("median_ms"),
        F.count_distinct("agent").alias("agents"),
    )


def error_breakdown(calls: DataFrame, samples: int = 5) -> DataFrame:
    """Groups of failed calls, with the first sequence numbers of each."""
    bad = calls.filter(failed())
    order = Window.partitionBy("tool", "server", "target").orderBy("session", "seq")
    # ranked before they are collected, so no list outgrows `samples`
    ranked = bad.withColumn("_r", F.row_number().over(order))
    return ranked.groupBy("tool", "server", "target").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("agent").alias("agents"),
        F.concat_ws(
            ",",
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("_r") <= samples, F.struct("_r", "session", "seq")))),
                lambda s: F.concat_ws(":", s["session"], s["seq"]),
            ),
        ).alias("samples"),
    )


def work_units(calls: DataFrame) -> DataFrame:
    return calls.groupBy("category", "target").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_distinct("tool").alias("tools"),
        F.count_distinct("agent").alias("agents"),
        F.count_distinct("content_fp").alias("contents"),
        n_if(F.col("status") == "success").alias("succeeded"),
        n_if(failed()).alias("failed"),
        n_if(F.col("status") == "open").alias("open_calls"),
    )


def coverage(calls: DataFrame) -> DataFrame:
    """Which facts were ever observed, as one row per capability."""
    facts = {
        "durations": "duration_ms", "outputs": "bytes", "servers": "server", "ends": "end_ns", "contents": "content_fp"
    }
    seen = calls.agg(*[F.count(c).alias(k) for k, c in facts.items()], F.count(F.lit(1)).alias("all_calls"))
    return seen.unpivot(["all_calls"], list(facts), "capability", "known").select(
        "capability",
        "known",
        (F.col("known") > 0).alias("observed"),
        (F.col("known") == F.col("all_calls")).alias("complete"),
    )


def observed_cost(calls: DataFrame, *by: str) -> DataFrame:
    """Bytes and time of call sets: strict sums (null where one is missing), partial sums and how many are known."""
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        strict_sum(F.col("bytes")).alias("strict_bytes"),
        F.sum("bytes").alias("known_bytes"),
        F.count("bytes").alias("bytes_known_for"),
        strict_sum(F.col("duration_ms")).alias("strict_ms"),
        F.sum("duration_ms").alias("known_ms"),
    )


def cost_union(findings: DataFrame, calls: DataFrame) -> DataFrame:
    """Cost of overlapping findings (rule, call_id, session): each call counts once per rule, and once in all."""
    members = findings.select("rule", "session", "call_id").distinct()
    joined = members.join(calls.select("session", "call_id", "bytes", "duration_ms"), ["session", "call_id"])
    per_rule = joined.groupBy("rule").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("bytes").alias("bytes"), F.sum("duration_ms").alias("ms")
    )
    once = joined.drop("rule").distinct().agg(
        F.lit("all").alias("rule"),
        F.count(F.lit(1)).alias("calls"),
        F.sum("bytes").alias("bytes"),
        F.sum("duration_ms").alias("ms"),
    )
    return per_rule.unionByName(once)


def largest(calls: DataFrame, column: str, n: int = 5) -> DataFrame:
    return calls.filter(F.col(column).isNotNull()).orderBy(F.desc(column), "session", "seq").limit(n).select(
        "session", "seq", "tool", column
    )


def keyset_page(calls: DataFrame, before_ns: int, before_id: int, n: int) -> DataFrame:
    """The next n calls of a listing from the newest down, behind a cursor."""
    behind = (F.col("start_ns") < before_ns) | ((F.col("start_ns") == before_ns) & (F.col("call_id") < before_id))
    return calls.filter(behind).orderBy(F.desc("start_ns"), F.desc("call_id")).limit(n).select(
        "session", "call_id", "start_ns", "tool", "status"
    )


def filtered(
    calls: DataFrame,
    equal: dict | None = None,
    since: int | None = None,
    until: int | None = None,
    contains: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Calls that match all given conditions; status "failure" stands for all failures; times by overlap, half open."""
    keep = F.lit(True)
    for column, value in (equal or {}).items():
        keep &= F.col(column) == value
    if status == "failure":
        keep &= failed()
    elif status:
        keep &= F.col("status") == status
    if since is not None:
        keep &= F.coalesce("end_ns", "start_ns") >= since
    if until is not None:
        keep &= F.col("start_ns") < until
    if contains:
        keep &= F.lower("target").contains(contains.lower())
    return calls.filter(keep)
