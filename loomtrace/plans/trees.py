"""Queries over trees of threads (usage logs written from the responses) and over context boundaries of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import boundaries, trees
from ..sources.bridge import Frames
from ..sources.stored import stored
from .registry import query

_START = 5
_AGENTS = "/root/"


def _usage_lines(f: Frames) -> DataFrame:
    """A log per thread: its metadata, and of each response its record, now and then told again (equally, or with another
    number), a running total, or a record copied from the parent. Thread t belongs to the tree of thread t % 10 and hangs
    below thread (t // 10 // 3) * 10 + t % 10."""
    t, rid, i = F.col("thread"), F.col("response_id"), F.col("idx")
    name = lambda c: F.concat(F.lit("t"), c.cast("string"))
    root, parent = t % 10, F.floor(F.floor(t / 10) / 3).cast("long") * 10 + t % 10
    child = t >= 10
    where = F.when(t % 29 == 0, "/other/x").otherwise(F.lit(f"{_AGENTS}a"))
    spawn = F.struct(name(parent).alias("parent_thread_id"), where.alias("agent_path"))
    source = F.when(child, F.struct(F.struct(spawn.alias("thread_spawn")).alias("subagent")))

    def line(kind: str, payload: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias("payload")))

    told = {
        "input_tokens": F.col("input_tokens"),
        "cached_input_tokens": F.floor(F.col("input_tokens") / 10),
        "cache_write_input_tokens": F.lit(0),
        "output_tokens": F.col("output_tokens"),
        "reasoning_output_tokens": F.floor(F.col("output_tokens") / 2),
        "total_tokens": F.col("input_tokens") + F.col("output_tokens") + (rid % 17 == 0).cast("long"),
    }
    w = Window.partitionBy("thread").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    r = f.responses.select("thread", "idx", "response_id", *[v.cast("long").alias(k) for k, v in told.items()])
    r = r.select("*", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(f"_{k}") for k in told])
    usage = lambda more=0: F.struct(*[(F.col(k) + (more if k == "output_tokens" else 0)).alias(k) for k in told])
    grown = F.struct(*[(F.col(f"_{k}") + ((t % 9 == 0).cast("long") if k == "cached_input_tokens" else 0)).alias(k) for k in told])

    def record(owner: Column, ident: Column, numbers: Column) -> Column:
        return line("token_usage_record", F.struct(
            owner.alias("thread_id"), name(root).alias("session_id"), ident.alias("response_id"),
            numbers.alias("usage"), grown.alias("thread_token_usage"),
        ))

    ident = F.concat(F.lit("r"), rid.cast("string"))
    again = F.when(rid % 11 == 0, record(name(t), ident, usage(1))).when(rid % 7 == 0, record(name(t), ident, usage()))
    third = F.when(rid % 5 == 0, line("event_msg", F.struct(F.lit("token_count").alias("type")))).when(
        rid % 13 == 0, record(F.when(child, name(parent)).otherwise("else"), F.concat(F.lit("p"), rid.cast("string")), usage())
    )
    meta = line("session_meta", F.struct(name(t).alias("id"), name(root).alias("session_id"), source.alias("source")))
    # the lines of a response, and before its first the metadata, come from one reading of the responses
    told_lines = [F.when(i == 1, meta), record(name(t), ident, usage()), again, third]
    every = r.select(name(t).alias("file"), "idx", F.posexplode(F.array(*told_lines)).alias("n", "value")).filter("value IS NOT NULL")
    every = every.select("file", (F.col("idx") * 3 - 2 + F.col("n")).cast("long").alias("line"), "value")
    return stored(every, "usage-lines")


def _told(f: Frames) -> tuple[DataFrame, DataFrame]:
    lines = _usage_lines(f)
    metas = trees.threads(lines)
    starts = metas.filter("is_root").select("root_id", F.lit(_START).cast("long").alias("start_line"))
    return metas, stored(trees.records(lines, metas, starts, _AGENTS), "usage-records")


_FIELDS = ", ".join(trees.FIELDS)
# the records of the logs: r is the thread's own, with what the copies agree on; u its usage, g the cumulative one
_TREES = """
WITH b AS (SELECT thread, idx, response_id AS rid, thread >= 10 AS child, input_tokens, input_tokens // 10 AS
  cached_input_tokens, 0 AS cache_write_input_tokens, output_tokens, output_tokens // 2 AS reasoning_output_tokens,
  input_tokens + output_tokens + CASE WHEN response_id % 17 = 0 THEN 1 ELSE 0 END AS total_tokens FROM responses),
g AS (SELECT *, {grown} FROM b WINDOW w AS (PARTITION BY thread ORDER BY idx ROWS UNBOUNDED PRECEDING)),
u AS (SELECT * REPLACE (CASE WHEN rid % 11 <> 0 THEN output_tokens END AS output_tokens) FROM g WHERE (child OR idx > 1)
  AND NOT (child AND thread % 29 = 0)),
threads AS (SELECT DISTINCT thread, thread % 10 AS root, CASE WHEN thread >= 10 THEN thread // 30 * 10 + thread % 10 END
  AS parent FROM b)
""".format(
    grown=", ".join(
        f"coalesce(sum({k}) OVER w, 0)::BIGINT{' + CASE WHEN thread % 9 = 0 THEN 1 ELSE 0 END' if k.startswith('cached') else ''} AS g_{k}"
        for k in trees.FIELDS
    )
)
_SUM = ", ".join(f"CASE WHEN count(rid) > 0 AND count({k}) = count(rid) THEN sum({k})::BIGINT END AS {k}" for k in trees.FIELDS)


@query(
    "usage_tree_totals",
    _TREES.replace("WITH", "WITH RECURSIVE", 1)
    + """, up AS (SELECT thread, thread AS above FROM threads UNION ALL SELECT up.thread, t.parent FROM up JOIN threads t ON
  t.thread = up.above JOIN threads p ON p.thread = t.parent)
SELECT 't' || (above % 10) AS root_id, 't' || above AS thread_id, count(DISTINCT up.thread) AS threads, count(rid) AS responses,
  count(*) FILTER (WHERE output_tokens IS NOT NULL AND rid % 17 <> 0) AS complete, """
    + _SUM
    + " FROM up LEFT JOIN u ON u.thread = up.thread GROUP BY above",
    ("responses",),
)
def usage_tree_totals(f: Frames) -> DataFrame:
    """Totals of each thread with all threads below it."""
    metas, rows = _told(f)
    return trees.subtree_totals(metas, trees.responses(rows))


@query(
    "usage_tree_checks",
    _TREES
    + ", s AS (SELECT thread, count(rid) AS responses, "
    + ", ".join(f"CASE WHEN count({k}) = count(rid) THEN sum({k})::BIGINT END AS s_{k}" for k in trees.FIELDS)
    + " FROM u GROUP BY thread), d AS (SELECT g.thread, "
    + ", ".join(
        f"CASE WHEN child THEN arg_max(g_{k}, idx) WHEN max(idx) > 1 THEN arg_max(g_{k}, idx) - arg_min(g_{k}, idx) END AS d_{k}"
        for k in trees.FIELDS
    )
    + " FROM g WHERE NOT (child AND thread % 29 = 0) GROUP BY g.thread, child) "
    "SELECT 't' || t.thread AS file, 't' || t.root AS root_id, 't' || t.thread AS thread_id, t.thread = t.root AS is_root, "
    "coalesce(responses, 0) AS responses, "
    + ", ".join(f"s_{k} AS sum_{k}, d_{k} AS delta_{k}" for k in trees.FIELDS)
    + ", ("
    + " + ".join(f"CASE WHEN s_{k} = d_{k} IS NOT NULL THEN 1 ELSE 0 END" for k in trees.FIELDS)
    + ")::INT AS checked, CASE WHEN "
    + " AND ".join(f"s_{k} = d_{k} IS NOT NULL" for k in trees.FIELDS)
    + " THEN "
    + " AND ".join(f"s_{k} = d_{k}" for k in trees.FIELDS)
    + " END AS full_match FROM threads t LEFT JOIN s ON s.thread = t.thread LEFT JOIN d ON d.thread = t.thread",
    ("responses",),
)
def usage_tree_checks(f: Frames) -> DataFrame:
    """Of each log, sums of its responses against the growth of its cumulative usage."""
    metas, rows = _told(f)
    return trees.verified(metas, rows, trees.responses(rows))


@query(
    "usage_tree_exclusions",
    """WITH r AS (SELECT *, thread % 10 AS root, response_id AS rid, CASE WHEN thread >= 10 AND thread % 29 = 0 THEN
  'other_agent' END AS other FROM responses),
w AS (SELECT root, unnest([{first}, {second}, {third}]) AS w FROM (SELECT *, CASE WHEN thread = root AND idx = 1 THEN
  'before_start' END AS early FROM r)) SELECT 't' || root AS root_id, nullif(w, 'kept') AS why, count(*) AS n FROM w
  WHERE w IS NOT NULL GROUP BY ALL""".format(
        first="coalesce(other, early, 'kept')",
        second="CASE WHEN rid % 11 = 0 OR rid % 7 = 0 THEN coalesce(other, early, 'kept') END",
        third="CASE WHEN rid % 5 = 0 THEN coalesce(other, 'token_count') WHEN rid % 13 = 0 THEN coalesce(other, CASE WHEN "
        "thread >= 10 AND thread // 30 = 0 THEN 'parent_copy' ELSE 'other_thread' END) END",
    ),
    ("responses",),
)
def usage_tree_exclusions(f: Frames) -> DataFrame:
    """Of each tree, how many records count and why others do not."""
    return _told(f)[1].groupBy("root_id", "why").agg(F.count(F.lit(1)).alias("n"))


def _transcript(f: Frames) -> DataFrame:
    """A transcript per agent, a line a call. Each fifth line tells the node of three lines before anew: of a sixth of them
    the parent is no node, of others the line before (a cycle as of then); agent calls are compactions, some without time."""
    q, k = F.col("aseq"), F.col("params") + F.col("call_id") % 6
    again = q % 5 == 4
    uid = lambda n: F.concat(F.lit("u"), n.cast("string"))
    told = lambda n: n - F.when(n % 5 == 4, 3).otherwise(0)
    parent = F.when(again & (k == 0), F.lit("gone")).when(again & (k == 1), uid(q - 1)).when(again, uid(q - 4)).when(
        q > 0, uid(told(q - 1))
    )
    ns = F.when(F.col("call_id") % 19 != 0, F.col("start_ns") - F.when(F.col("call_id") % 23 == 0, 600_000_000_000).otherwise(0))
    return f.calls.select(
        F.col("call_id").cast("string").alias("id"),
        F.col("agent").cast("string").alias("file"),
        (q + 1).alias("line"),
        uid(told(q)).alias("uid"),
        parent.alias("parent"),
        (F.col("category") == "agent").alias("compaction"),
        ns.alias("ns"),
        "status",
    )


_BOUNDS = """
WITH RECURSIVE c AS (SELECT *, params + call_id % 6 AS x, aseq % 5 = 4 AS again FROM calls),
n AS (SELECT call_id::VARCHAR AS id, agent::VARCHAR AS file, aseq + 1 AS line, 'u' || (aseq - CASE WHEN again THEN 3 ELSE 0
  END) AS uid, CASE WHEN again AND x = 0 THEN 'gone' WHEN again AND x = 1 THEN 'u' || (aseq - 1) WHEN again THEN 'u' ||
  (aseq - 4) WHEN aseq > 0 THEN 'u' || (aseq - 1 - CASE WHEN (aseq - 1) % 5 = 4 THEN 3 ELSE 0 END) END AS parent,
  category = 'agent' AS compaction, CASE WHEN call_id % 19 <> 0 THEN start_ns - CASE WHEN call_id % 23 = 0 THEN
  600000000000 ELSE 0 END END AS ns, status FROM c),
v AS (SELECT *, coalesce(lead(line) OVER (PARTITION BY file, uid ORDER BY line), 9223372036854775807) AS upto FROM n),
q AS (SELECT id, file, line, uid, ns FROM n WHERE status = 'success'),
w AS (SELECT q.id, q.file, q.line, q.uid AS node, v.parent, v.compaction, [q.uid] AS seen, CASE WHEN v.compaction THEN 'found'
  WHEN v.parent IS NULL THEN 'initial' END AS e FROM q JOIN v ON v.file = q.file AND v.uid = q.uid AND v.line <= q.line AND
  q.line < v.upto
  UNION ALL SELECT w.id, w.file, w.line, w.parent, v.parent, v.compaction, list_append(seen, w.parent), CASE WHEN
    list_contains(seen, w.parent) THEN 'cycle' WHEN v.uid IS NULL THEN 'absent' WHEN v.compaction THEN 'found' WHEN v.parent
    IS NULL THEN 'initial' END FROM w LEFT JOIN v ON v.file = w.file AND v.uid = w.parent AND v.line <= w.line AND w.line <
    v.upto WHERE e IS NULL),
g AS (SELECT id, e, CASE e WHEN 'found' THEN node WHEN 'initial' THEN 'initial:' || node END AS graph_boundary FROM w WHERE e IS NOT
  NULL),
k AS (SELECT * FROM n WHERE compaction),
r AS (SELECT q.id, arg_max(k.uid, (k.ns, k.line)) AS uid FROM q JOIN k ON k.file = q.file AND k.line <= q.line AND k.ns <= q.ns
  GROUP BY q.id),
s AS (SELECT file, uid, arg_min({'ns': ns}, line).ns AS began FROM k GROUP BY ALL),
b AS (SELECT q.*, g.e, g.graph_boundary, coalesce(r.uid, g.graph_boundary) AS b, CASE WHEN r.id IS NULL THEN 'pointers' ELSE
  'recorded' END AS basis FROM q LEFT JOIN g ON g.id = q.id LEFT JOIN r ON r.id = q.id),
o AS (SELECT b.id, b.file, b.line, b.uid, b.ns, CASE WHEN b.ns < s.began THEN NULL ELSE b.b END AS boundary, CASE WHEN b.ns <
  s.began THEN 'before_copied_boundary' WHEN e IN ('absent', 'cycle', 'initial') THEN e END AS reason, graph_boundary, basis FROM b
  LEFT JOIN s ON s.file = b.file AND s.uid = b.b)
"""


@query("boundary_walk", _BOUNDS + "SELECT * FROM o", ("calls",))
def boundary_walk(f: Frames) -> DataFrame:
    """The context boundary of each successful call, along parents as they existed at its line."""
    lines = stored(_transcript(f), "transcript")
    return boundaries.boundaries(lines, lines.filter("status = 'success'"))


@query(
    "window_contents",
    _BOUNDS
    + """, x AS (SELECT file, file || '/' || boundary AS boundary, line, id, ns FROM o WHERE boundary IS NOT NULL),
z AS (SELECT boundary, min(ns) AS first, max(ns) AS last FROM x WHERE line % 3 = 0 GROUP BY 1)
SELECT x.boundary, count(*) AS contents FROM x JOIN z ON z.boundary = x.boundary WHERE x.ns IS NOT NULL AND (first IS NULL OR
  first <= x.ns) AND (last IS NULL OR x.ns < last) GROUP BY 1""",
    ("calls",),
)
def window_contents(f: Frames) -> DataFrame:
    """How many contents fall into each window: it has a boundary, and lasts from its first request to its last."""
    lines = stored(_transcript(f), "transcript")
    bounded = stored(boundaries.boundaries(lines, lines.filter("status = 'success'")), "bounded").filter("boundary IS NOT NULL")
    rows = bounded.select("line", F.col("id").alias("content_id"), F.concat_ws("/", "file", "boundary").alias("boundary"), "ns")
    spans = rows.filter("line % 3 = 0").groupBy("boundary").agg(F.min("ns").alias("since_ns"), F.max("ns").alias("until_ns"))
    spans = stored(spans.withColumn("window_id", F.col("boundary")), "spans")
    return boundaries.contents_of_windows(rows, spans).groupBy("boundary").agg(F.count(F.lit(1)).alias("contents"))
