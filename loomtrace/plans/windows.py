"""Queries over ordered calls."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import windows
from ..sources.bridge import Frames
from .registry import query


@query(
    "max_in_window",
    """
WITH n AS (SELECT session, tool, count(*) OVER (PARTITION BY session, tool ORDER BY start_ns RANGE BETWEEN 600000000000
  PRECEDING AND CURRENT ROW) AS n FROM calls)
SELECT session, tool, max(n) AS most_in_600s FROM n GROUP BY 1, 2""",
)
def max_in_window(f: Frames) -> DataFrame:
    return windows.most_in_window(f.calls, 600)


_EPISODES = """
WITH l AS (SELECT *, start_ns - lag(start_ns) OVER (PARTITION BY session, agent ORDER BY start_ns, call_id) AS gap FROM
  calls),
e AS (SELECT *, sum(CASE WHEN gap > 1200000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session, agent ORDER BY
  start_ns, call_id ROWS UNBOUNDED PRECEDING) AS episode FROM l)
"""


@query(
    "episodes",
    _EPISODES + "SELECT session, agent, episode::BIGINT AS episode, count(*) AS calls, min(start_ns) AS first_ns, max(start_ns) AS last_ns FROM e GROUP BY 1, 2, 3",
)
def episodes(f: Frames) -> DataFrame:
    return windows.episodes(f.calls)


@query(
    "same_response_pairs",
    "SELECT session, agent, aseq, coalesce(lag(emitter) OVER w = emitter, FALSE) AS same, CASE WHEN lag(emitter) OVER "
    "w IS NULL THEN 'heuristic' ELSE 'exact' END AS basis FROM calls WINDOW w AS (PARTITION BY session, agent ORDER "
    "BY aseq)",
)
def same_response_pairs(f: Frames) -> DataFrame:
    return windows.same_response(f.calls)


@query(
    "trigger_classification",
    "WITH t AS (SELECT category, coalesce(lag(category) OVER (PARTITION BY session, agent ORDER BY aseq), 'none') AS "
    "trigger FROM calls) SELECT category, trigger, count(*) AS n FROM t GROUP BY 1, 2",
)
def trigger_classification(f: Frames) -> DataFrame:
    return windows.trigger_of(f.calls)


@query(
    "timeline_active_union",
    """
WITH u AS (SELECT session, start_ns, end_ns, max(end_ns) OVER (PARTITION BY session ORDER BY start_ns, call_id ROWS
  BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM calls WHERE end_ns IS NOT NULL)
SELECT session, sum(greatest(0, end_ns - greatest(start_ns, coalesce(until, start_ns))))::BIGINT AS active_ns,
  sum(end_ns - start_ns)::BIGINT AS tool_ns FROM u GROUP BY 1""",
)
def timeline_active_union(f: Frames) -> DataFrame:
    return windows.active_union(f.calls)


@query(
    "timeline_buckets",
    """
WITH s AS (SELECT session, start_ns // 3600000000000 AS bucket, count(*) AS starts, count(*) FILTER (WHERE status =
  'error') AS failures, count(server) AS mcp, count(*) FILTER (WHERE status = 'unknown') AS unknown FROM calls GROUP BY
  1, 2),
p AS (SELECT session, call_id, b AS bucket, greatest(start_ns, b * 3600000000000) AS lo, least(end_ns, (b + 1) *
  3600000000000) AS hi
  FROM (SELECT *, unnest(generate_series(start_ns // 3600000000000, (end_ns - 1) // 3600000000000)) AS b FROM calls
    WHERE end_ns > start_ns)),
q AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY session, bucket ORDER BY lo, call_id ROWS BETWEEN UNBOUNDED
  PRECEDING AND 1 PRECEDING), lo) AS until FROM p),
t AS (SELECT session, bucket, sum(hi - lo)::BIGINT AS tool_ns, sum(greatest(0, hi - greatest(lo, until)))::BIGINT AS
  active_ns FROM q GROUP BY 1, 2)
SELECT session, bucket, coalesce(starts, 0) AS starts, coalesce(failures, 0) AS failures, coalesce(mcp, 0) AS mcp,
  coalesce(unknown, 0) AS unknown, coalesce(tool_ns, 0) AS tool_ns, coalesce(active_ns, 0) AS active_ns
FROM s FULL JOIN t USING (session, bucket)""",
)
def timeline_buckets(f: Frames) -> DataFrame:
    return windows.timeline(f.calls, 3_600_000_000_000)


@query(
    "shared_write_runs",
    """
WITH l AS (SELECT *, coalesce(lag(agent) OVER w <> agent, FALSE)::INT AS b FROM calls WHERE category = 'edit' WINDOW w
  AS (PARTITION BY session, target ORDER BY start_ns, call_id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY session, target ORDER BY start_ns, call_id ROWS UNBOUNDED PRECEDING) AS run
  FROM l),
g AS (SELECT session, target, run, min(agent) AS agent, count(*) AS edits FROM r GROUP BY 1, 2, 3)
SELECT session, target, count(*) AS runs, count(DISTINCT agent) AS agents, max(edits) AS longest FROM g GROUP BY 1,
  2""",
)
def shared_write_runs(f: Frames) -> DataFrame:
    return windows.writer_runs(f.calls)


@query(
    "handoffs",
    """
WITH b AS (SELECT *, last_value(CASE WHEN category = 'edit' THEN agent END IGNORE NULLS) OVER w AS writer,
  last_value(CASE WHEN category = 'edit' THEN call_id END IGNORE NULLS) OVER w AS write_id
  FROM calls WHERE category IN ('read', 'edit') WINDOW w AS (PARTITION BY session, target ORDER BY start_ns, call_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session, target, agent AS reader, writer, call_id AS read_id, write_id FROM b WHERE category = 'read' AND writer
  <> agent""",
)
def handoffs(f: Frames) -> DataFrame:
    return windows.handoffs(f.calls)


@query(
    "rereads_after_epoch",
    """
WITH e AS (SELECT *, sum(CASE WHEN category = 'edit' THEN 1 ELSE 0 END) OVER (PARTITION BY session, target ORDER BY
  start_ns, call_id ROWS UNBOUNDED PRECEDING) AS edits FROM calls WHERE category IN ('read', 'edit')),
l AS (SELECT *, lag(epoch) OVER w AS pe, lag(edits) OVER w AS pw, lag(content_fp) OVER w AS pf FROM e WHERE category =
  'read' WINDOW w AS (PARTITION BY session, agent, target ORDER BY start_ns, call_id))
SELECT session, CASE WHEN edits > pw THEN 'modified_between' WHEN pf = content_fp THEN 'identical' ELSE 'changed' END AS
  kind, count(*) AS rereads, count(DISTINCT target) AS targets, count(DISTINCT agent) AS agents
FROM l WHERE pe < epoch GROUP BY 1, 2""",
)
def rereads_after_epoch(f: Frames) -> DataFrame:
    return windows.rereads(f.calls)


@query("cooldown_simulation")
def cooldown_simulation(f: Frames) -> DataFrame:
    return windows.cooldown_simulation(f.calls)
