"""Queries over calls: metrics, roll-ups, costs, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import correlate, metrics, windows
from ..sources.bridge import Frames
from .registry import query

FAILED = "status IN ('error', 'timeout', 'denied', 'interrupted')"


@query(
    "mcp_metrics_grouping_sets",
    f"""
WITH c AS (SELECT *, {FAILED} AS failed, status = 'success' OR {FAILED} AS decided FROM calls WHERE server IS NOT NULL),
x AS (SELECT 1 AS g, server, tool, duration_ms, bytes, failed, decided FROM c UNION ALL SELECT 2, server, NULL,
  duration_ms, bytes, failed, decided FROM c
  UNION ALL SELECT 3, NULL, NULL, duration_ms, bytes, failed, decided FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY g, server, tool ORDER BY duration_ms NULLS LAST) AS rn,
  count(duration_ms) OVER (PARTITION BY g, server, tool) AS n FROM x)
SELECT server, tool, count(*) AS calls, count(duration_ms) AS measured, count(*) - count(duration_ms) AS unmeasured,
  quantile_cont(duration_ms, 0.5) AS median_ms,
  max(CASE WHEN rn = ceil(0.95 * n) THEN duration_ms END) AS p95_ms, max(duration_ms) AS max_ms,
    sum(duration_ms)::BIGINT AS total_ms, sum(bytes)::BIGINT AS output_bytes,
  round(100.0 * count(*) FILTER (WHERE failed) / nullif(count(*) FILTER (WHERE decided), 0), 6) AS failure_pct
FROM r GROUP BY g, server, tool""",
)
def mcp_metrics_grouping_sets(f: Frames) -> DataFrame:
    return metrics.tool_metrics(f.calls)


@query(
    "project_status_summary",
    "SELECT session, status, count(*) AS n, sum(duration_ms)::BIGINT AS total_ms, min(start_ns) AS first_ns, "
    "max(start_ns) AS last_ns FROM calls GROUP BY 1, 2",
)
def project_status_summary(f: Frames) -> DataFrame:
    return metrics.status_summary(f.calls)


@query(
    "project_mcp_top",
    """
WITH n AS (SELECT session, server, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM calls WHERE server IS NOT NULL GROUP
  BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, server) AS place FROM n) WHERE place
  <= 3""",
)
def project_mcp_top(f: Frames) -> DataFrame:
    return metrics.top_servers(f.calls)


_ROLLUP = f"""
SELECT session, count(*) AS calls, count(DISTINCT agent) AS agents, count(*) FILTER (WHERE {FAILED}) AS failures,
  count(*) FILTER (WHERE status = 'open') AS open_calls,
  count(*) FILTER (WHERE status = 'unknown') AS unknown_calls, min(start_ns) AS first_ns, max(coalesce(end_ns,
    start_ns)) AS last_ns,
  first(tool ORDER BY start_ns, call_id) AS first_tool, max(epoch) AS epochs FROM calls GROUP BY 1"""


@query("session_rollup", _ROLLUP)
def session_rollup(f: Frames) -> DataFrame:
    return metrics.session_rollup(f.calls)


@query(
    "session_listing",
    f"WITH r AS ({_ROLLUP}) SELECT session, last_ns, calls, failures, row_number() OVER (ORDER BY last_ns DESC, "
    f"session) AS place FROM r",
)
def session_listing(f: Frames) -> DataFrame:
    rows = metrics.session_rollup(f.calls).select("session", "last_ns", "calls", "failures")
    return windows.ranked(rows, [F.desc("last_ns"), F.asc("session")])


@query(
    "agent_rollup",
    """
SELECT session, agent, min(start_ns) AS first_ns, max(end_ns) AS last_end_ns, count(*) AS calls, CASE WHEN
  count(DISTINCT category) = 1 THEN max(category) END AS only_category,
  last(status ORDER BY start_ns, call_id) AS last_status FROM calls GROUP BY 1, 2""",
)
def agent_rollup(f: Frames) -> DataFrame:
    return metrics.agent_rollup(f.calls)


@query(
    "timing_unreliable_agents",
    """
SELECT * FROM (SELECT session, agent, epoch, count(*) AS n, max(coalesce(end_ns, start_ns)) - min(start_ns) AS span_ns
  FROM calls GROUP BY 1, 2, 3)
WHERE n >= 3 AND span_ns < 900000000000""",
)
def timing_unreliable_agents(f: Frames) -> DataFrame:
    return metrics.unreliable_timing(f.calls, span_ns=900_000_000_000)


@query(
    "tool_stats_medians",
    f"""
SELECT tool, count(*) AS calls, count(*) FILTER (WHERE {FAILED}) AS errors, count(*) FILTER (WHERE status = 'unknown')
  AS unknown_calls, count(*) FILTER (WHERE status = 'open') AS open_calls,
  sum(CASE WHEN category <> 'edit' THEN bytes END)::BIGINT AS output_bytes, quantile_cont(duration_ms, 0.5) AS
    median_ms, count(DISTINCT agent) AS agents FROM calls GROUP BY 1""",
)
def tool_stats_medians(f: Frames) -> DataFrame:
    return metrics.tool_stats(f.calls)


@query(
    "error_breakdown",
    f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY tool, server, target ORDER BY session, seq) AS r FROM calls WHERE
  {FAILED})
SELECT tool, server, target, count(*) AS n, count(DISTINCT agent) AS agents, string_agg(session || ':' || seq, ',' ORDER
  BY r) FILTER (WHERE r <= 5) AS samples FROM r GROUP BY 1, 2, 3""",
)
def error_breakdown(f: Frames) -> DataFrame:
    return metrics.error_breakdown(f.calls)


@query(
    "work_units",
    f"""
SELECT category, target, count(*) AS calls, count(DISTINCT tool) AS tools, count(DISTINCT agent) AS agents,
  count(DISTINCT content_fp) AS contents,
  count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE {FAILED}) AS failed, count(*) FILTER
    (WHERE status = 'open') AS open_calls FROM calls GROUP BY 1, 2""",
)
def work_units(f: Frames) -> DataFrame:
    return metrics.work_units(f.calls)


@query(
    "coverage_matrix",
    """
WITH n AS (SELECT count(*) AS n, count(duration_ms) AS durations, count(bytes) AS outputs, count(server) AS servers,
  count(end_ns) AS ends, count(content_fp) AS contents FROM calls)
SELECT capability, known, known > 0 AS observed, known = n AS complete FROM (UNPIVOT n ON durations, outputs, servers,
  ends, contents INTO NAME capability VALUE known)""",
)
def coverage_matrix(f: Frames) -> DataFrame:
    return metrics.coverage(f.calls)


@query(
    "observed_cost_by_group",
    """
SELECT category, status, count(*) AS calls, CASE WHEN count(bytes) = count(*) THEN sum(bytes) END::BIGINT AS
  strict_bytes, sum(bytes)::BIGINT AS known_bytes, count(bytes) AS bytes_known_for,
  CASE WHEN count(duration_ms) = count(*) THEN sum(duration_ms) END::BIGINT AS strict_ms, sum(duration_ms)::BIGINT AS
    known_ms FROM calls GROUP BY 1, 2""",
)
def observed_cost_by_group(f: Frames) -> DataFrame:
    return metrics.observed_cost(f.calls, "category", "status")


@query(
    "cost_union",
    f"""
WITH m AS (SELECT DISTINCT 'failed' AS rule, session, call_id FROM calls WHERE {FAILED} UNION SELECT 'large', session,
  call_id FROM calls WHERE bytes > 700),
j AS (SELECT m.rule, c.session, c.call_id, c.bytes, c.duration_ms FROM m JOIN calls c USING (session, call_id))
SELECT rule, count(*) AS calls, sum(bytes)::BIGINT AS bytes, sum(duration_ms)::BIGINT AS ms FROM j GROUP BY 1
UNION ALL SELECT 'all', count(*), sum(bytes)::BIGINT, sum(duration_ms)::BIGINT FROM (SELECT DISTINCT session, call_id,
  bytes, duration_ms FROM j)""",
)
def cost_union(f: Frames) -> DataFrame:
    c = f.calls
    found = c.filter(metrics.failed()).select(F.lit("failed").alias("rule"), "session", "call_id").unionByName(
        c.filter("bytes > 700").select(F.lit("large").alias("rule"), "session", "call_id")
    )
    return metrics.cost_union(found, c)


@query(
    "largest_outputs",
    "SELECT session, seq, tool, bytes FROM calls WHERE bytes IS NOT NULL ORDER BY bytes DESC, session, seq LIMIT 5",
)
def largest_outputs(f: Frames) -> DataFrame:
    return metrics.largest(f.calls, "bytes")


@query(
    "longest_calls",
    "SELECT session, seq, tool, duration_ms FROM calls WHERE duration_ms IS NOT NULL ORDER BY duration_ms DESC, "
    "session, seq LIMIT 5",
)
def longest_calls(f: Frames) -> DataFrame:
    return metrics.largest(f.calls, "duration_ms")


@query(
    "keyset_page",
    "SELECT session, call_id, start_ns, tool, status FROM calls WHERE (start_ns, call_id) < (30000000000000, 500) "
    "ORDER BY start_ns DESC, call_id DESC LIMIT 50",
)
def keyset_page(f: Frames) -> DataFrame:
    return metrics.keyset_page(f.calls, 30_000_000_000_000, 500, 50)


@query(
    "dynamic_filter",
    f"SELECT session, call_id, tool, target FROM calls WHERE category = 'shell' AND {FAILED} AND coalesce(end_ns, "
    f"start_ns) >= 5000000000000 AND start_ns < 30000000000000 AND contains(lower(target), '1')",
)
def dynamic_filter(f: Frames) -> DataFrame:
    return metrics.filtered(
        f.calls, {"category": "shell"}, 5_000_000_000_000, 30_000_000_000_000, "1", "failure"
    ).select("session", "call_id", "tool", "target")


@query(
    "time_slice",
    "SELECT session, tool, count(*) AS calls, sum(bytes)::BIGINT AS bytes FROM calls WHERE start_ns >= 10000000000000 "
    "AND start_ns < 20000000000000 GROUP BY 1, 2",
)
def time_slice(f: Frames) -> DataFrame:
    part = f.calls.filter((F.col("start_ns") >= 10_000_000_000_000) & (F.col("start_ns") < 20_000_000_000_000))
    return part.groupBy("session", "tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("bytes").alias("bytes"))


@query(
    "events_dedup_counts",
    "SELECT session, count(*) AS events, count(DISTINCT event_key) AS kept, count(*) - count(DISTINCT event_key) AS "
    "duplicates FROM raw GROUP BY 1",
    ("raw",),
)
def events_dedup_counts(f: Frames) -> DataFrame:
    return correlate.dedup_counts(f.raw)


_PAIRED = """
SELECT session, agent, call_id, coalesce(min(tool) FILTER (WHERE phase = 'start'), min(tool)) AS tool, min(ns) FILTER
  (WHERE phase = 'start') AS start_ns, min(ns) FILTER (WHERE phase = 'end') AS end_ns,
  coalesce(min(status) FILTER (WHERE phase = 'end'), 'open') AS status,
  (greatest(count(*) FILTER (WHERE phase = 'start') - 1, 0) + greatest(count(*) FILTER (WHERE phase = 'end') - 1,
    0))::BIGINT AS duplicate_phases,
  count(*) FILTER (WHERE phase = 'start') = 0 AS orphan,
  CASE WHEN count(*) FILTER (WHERE phase = 'end') > 0 AND count(*) FILTER (WHERE phase = 'start') > 0 THEN
    greatest((min(ns) FILTER (WHERE phase = 'end') - min(ns) FILTER (WHERE phase = 'start')) // 1000000, 0) END AS
    duration_ms
FROM raw GROUP BY 1, 2, 3"""


@query("pair_calls_by_id", _PAIRED, ("raw",))
def pair_calls_by_id(f: Frames) -> DataFrame:
    return correlate.pair_by_id(f.raw)


@query(
    "pair_calls_heuristic",
    """
WITH d AS (SELECT DISTINCT session, agent, tool, k, phase, ns, call_id FROM raw),
s AS (SELECT *, row_number() OVER (PARTITION BY session, agent, tool, k ORDER BY ns, call_id) AS n FROM d WHERE phase =
  'start'),
e AS (SELECT *, row_number() OVER (PARTITION BY session, agent, tool, k ORDER BY ns, call_id) AS n FROM d WHERE phase =
  'end')
SELECT s.session, s.agent, s.tool, s.k, s.n, s.ns AS start_ns, e.ns AS end_ns FROM s LEFT JOIN e USING (session, agent,
  tool, k, n)""",
    ("raw",),
)
def pair_calls_heuristic(f: Frames) -> DataFrame:
    return correlate.pair_by_occurrence(f.raw)


@query("call_sequence", "SELECT session, agent, call_id, seq, aseq FROM calls")
def call_sequence(f: Frames) -> DataFrame:
    return f.calls.select("session", "agent", "call_id", "seq", "aseq")


@query(
    "context_epoch",
    "SELECT session, agent, epoch, count(*) AS calls, min(aseq) AS first_call, max(aseq) AS last_call FROM calls "
    "GROUP BY 1, 2, 3",
)
def context_epoch(f: Frames) -> DataFrame:
    return f.calls.groupBy("session", "agent", "epoch").agg(
        F.count(F.lit(1)).alias("calls"), F.min("aseq").alias("first_call"), F.max("aseq").alias("last_call")
    )


@query(
    "turn_index",
    """
WITH s AS (SELECT session, seq, call_id, row_number() OVER (PARTITION BY session, target ORDER BY seq) = 1 AS is_new
  FROM calls)
SELECT session, seq, call_id, sum(is_new::INT) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT
  AS turn FROM s""",
)
def turn_index(f: Frames) -> DataFrame:
    return correlate.running_distinct(f.calls, "target", "turn")


@query(
    "agent_spawn_containment",
    """
WITH a AS (SELECT session, agent, min(start_ns) AS lo, max(coalesce(end_ns, start_ns)) AS hi FROM calls WHERE epoch = 1
  GROUP BY 1, 2),
p AS (SELECT session, call_id, agent AS parent, start_ns, lead(start_ns) OVER (PARTITION BY session ORDER BY start_ns,
  call_id) AS end_ns FROM calls WHERE category = 'agent' AND target IN ('k1', 'k2')),
m AS (SELECT a.session, a.agent, count(p.call_id) AS candidates, min(p.call_id) AS call_id FROM a LEFT JOIN p ON
  p.session = a.session AND p.parent <> a.agent AND p.start_ns <= a.lo AND (p.end_ns IS NULL OR a.lo < p.end_ns) GROUP
  BY 1, 2)
SELECT session, agent, candidates, CASE WHEN candidates = 1 THEN call_id END AS spawned_by FROM m""",
)
def agent_spawn_containment(f: Frames) -> DataFrame:
    from pyspark.sql import Window

    c = f.calls
    children = c.filter("epoch = 1").groupBy("session", "agent").agg(F.min("start_ns").alias("lo"))
    w = Window.partitionBy("session").orderBy("start_ns", "call_id")
    parents = c.filter("category = 'agent' AND target IN ('k1', 'k2')").select(
        "session", "call_id", F.col("agent").alias("parent"), "start_ns", F.lead("start_ns").over(w).alias("end_ns")
    )
    return correlate.unique_container(children, parents)
