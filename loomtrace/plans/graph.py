"""Queries of evidence graphs, replacement scenarios, routing and run facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph, usage
from ..sources.bridge import Frames
from .registry import query

_EDGES = """WITH e AS (
SELECT session, lag(call_id) OVER (PARTITION BY session, agent, category, target, content_fp ORDER BY aseq) AS source,
  call_id AS target, 'content' AS kind FROM calls
UNION ALL SELECT session, lag(call_id) OVER (PARTITION BY session, agent, server, params ORDER BY aseq), call_id, 'job'
  FROM calls WHERE server IS NOT NULL
UNION ALL SELECT session, last_value(CASE WHEN category = 'agent' THEN call_id END IGNORE NULLS) OVER (PARTITION BY
  session, agent, epoch ORDER BY aseq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), call_id, 'delegation' FROM
  calls
UNION ALL SELECT session, source, call_id, 'explicit' FROM (SELECT *, last_value(CASE WHEN category = 'search' AND
  status = 'success' THEN call_id END IGNORE NULLS) OVER (PARTITION BY session, agent, epoch, target ORDER BY aseq ROWS
  BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM calls) WHERE category = 'read'),
g AS (SELECT * FROM e WHERE source IS NOT NULL)"""


@query("graph_edges", _EDGES + " SELECT * FROM g")
def graph_edges(f: Frames) -> DataFrame:
    return graph.edges(f.calls)


@query(
    "graph_removal_check",
    _EDGES + ", x AS (SELECT session, call_id FROM calls WHERE category = 'search' AND params = 1) SELECT session, source, target, kind FROM g WHERE (session, source) IN (SELECT session, call_id FROM x) AND (session, target) NOT IN (SELECT session, call_id FROM x)",
)
def graph_removal_check(f: Frames) -> DataFrame:
    return graph.broken_by(graph.edges(f.calls), f.calls.filter("category = 'search' AND params = 1")).select(
        "session", "source", "target", "kind"
    )


_FACTS = """WITH f AS (SELECT session, target, count(*) AS calls, CASE WHEN count(content_fp) > 0 THEN count(DISTINCT content_fp) <= 4 END AS same_outcome, bool_and(category <> 'edit') AS no_edit, CASE WHEN count(duration_ms) = count(*) THEN max(duration_ms) < 40000 END AS fast FROM calls GROUP BY 1, 2)"""


@query(
    "replacement_validity",
    _FACTS + " SELECT session, target, calls, CASE WHEN same_outcome = FALSE OR no_edit = FALSE OR fast = FALSE THEN 'rejected' WHEN same_outcome IS NULL OR no_edit IS NULL OR fast IS NULL THEN 'indeterminate' ELSE 'admissible' END AS verdict FROM f",
)
def replacement_validity(f: Frames) -> DataFrame:
    facts = graph.scenario_facts(f.calls)
    return facts.select(
        "session",
        "target",
        "calls",
        graph.validity([F.col("same_outcome"), F.col("no_edit"), F.col("fast")]).alias("verdict"),
    )


@query(
    "replacement_sensitivity",
    _FACTS
    + """, r AS (SELECT 'observed' AS run, same_outcome AS a, no_edit AS b, fast AS c FROM f UNION ALL SELECT 'all',
  coalesce(same_outcome, TRUE), coalesce(no_edit, TRUE), coalesce(fast, TRUE) FROM f
  UNION ALL SELECT 'same_outcome', coalesce(same_outcome, TRUE), no_edit, fast FROM f UNION ALL SELECT 'no_edit',
    same_outcome, coalesce(no_edit, TRUE), fast FROM f UNION ALL SELECT 'fast', same_outcome, no_edit, coalesce(fast,
    TRUE) FROM f)
SELECT run, CASE WHEN a = FALSE OR b = FALSE OR c = FALSE THEN 'rejected' WHEN a IS NULL OR b IS NULL OR c IS NULL THEN
  'indeterminate' ELSE 'admissible' END AS verdict, count(*) AS scenarios FROM r GROUP BY 1, 2""",
)
def replacement_sensitivity(f: Frames) -> DataFrame:
    return graph.sensitivity(graph.scenario_facts(f.calls), ["same_outcome", "no_edit", "fast"])


@query(
    "route_longest_prefix",
    """WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '') AS path FROM
  pages), r AS (SELECT DISTINCT regexp_extract(path, '^[^/]+') AS root FROM p UNION SELECT DISTINCT regexp_extract(path,
  '^[^/]+/[^/]+') FROM p WHERE path LIKE '%/fr%')
SELECT path, arg_max(root, length(root)) AS root FROM p JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY
  1""",
    (),
)
def route_longest_prefix(f: Frames) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "")
    p = f.table("pages").select(path.alias("path")).distinct()
    roots = p.select(F.regexp_extract("path", "^[^/]+", 0).alias("root")).union(
        p.filter("path LIKE '%/fr%'").select(F.regexp_extract("path", "^[^/]+/[^/]+", 0))
    ).distinct()
    return graph.longest_prefix(p, roots, "path", "root")


@query(
    "route_anchor_asof",
    "WITH a AS (SELECT agent, start_ns, max(target) AS anchor FROM calls WHERE category = 'agent' GROUP BY 1, 2), c "
    "AS (SELECT agent, start_ns, call_id FROM calls WHERE category <> 'agent') SELECT c.agent, c.start_ns, c.call_id, "
    "a.anchor AS asof_anchor FROM c ASOF LEFT JOIN a ON c.agent = a.agent AND c.start_ns >= a.start_ns",
)
def route_anchor_asof(f: Frames) -> DataFrame:
    left = f.calls.filter("category <> 'agent'").select("agent", "start_ns", "call_id")
    return usage.asof_before(
        left,
        f.calls.filter("category = 'agent'").select("agent", "start_ns", F.col("target").alias("anchor")),
        "agent",
        "start_ns",
        "anchor",
    )


def _facts(f: Frames) -> DataFrame:
    return f.calls.select(
        F.col("agent").alias("run"),
        F.col("tool").alias("field"),
        F.floor(F.col("start_ns") / 3_600_000_000_000).alias("time"),
        F.col("content_fp").alias("value"),
        F.col("call_id").alias("id"),
    )


_RUN = (
    "WITH f AS (SELECT agent AS run, tool AS field, start_ns // 3600000000000 AS time, content_fp AS value, call_id AS "
    "id FROM calls)"
)


@query(
    "run_field_view",
    _RUN + ", a AS (SELECT run, field, time, count(DISTINCT value) AS v, max(value) AS hi, min(value) AS lo, count(*) AS n FROM f GROUP BY 1, 2, 3) SELECT run, field, sum(n)::BIGINT AS samples, arg_max(hi, time) AS latest, min(lo) AS least, max(hi) AS greatest, count(*) FILTER (WHERE v > 1) AS conflicts FROM a GROUP BY 1, 2",
)
def run_field_view(f: Frames) -> DataFrame:
    return graph.field_view(_facts(f))


@query(
    "run_novelty",
    _RUN + ", w AS (SELECT *, count(*) OVER (PARTITION BY run, field, value ORDER BY time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, lag(value) OVER (PARTITION BY run, field ORDER BY time, id) AS last FROM f) SELECT run, field, CASE WHEN seen = 0 THEN 'new' WHEN last = value THEN 'unchanged' ELSE 'again' END AS kind, count(*) AS n FROM w GROUP BY 1, 2, 3",
)
def run_novelty(f: Frames) -> DataFrame:
    return graph.novelty(_facts(f))


@query(
    "role_carry_forward",
    "SELECT session, seq, last_value(server IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED "
    "PRECEDING) AS role FROM calls",
)
def role_carry_forward(f: Frames) -> DataFrame:
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return f.calls.select("session", "seq", F.last("server", ignorenulls=True).over(w).alias("role"))
