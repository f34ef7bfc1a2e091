"""Queries of smaller joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence, metrics, run_facts
from ..sources.bridge import Frames
from .registry import query

R = ("responses",)


@query(
    "shared_references",
    "SELECT session, target, count(DISTINCT CASE WHEN category = 'read' THEN agent END) AS readers, count(*) FILTER "
    "(WHERE category = 'read') AS reads, count(*) FILTER (WHERE category = 'edit') AS edits FROM calls WHERE category "
    "IN ('read', 'edit') GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN category = 'read' THEN agent END) >= 2",
)
def shared_references(f: Frames) -> DataFrame:
    return evidence.shared_references(f.calls)


@query(
    "new_input_between",
    """WITH n AS (SELECT *, sum((category = 'agent')::INT) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED
  PRECEDING) AS n FROM calls), l AS (SELECT *, lag(n) OVER (PARTITION BY session, agent, tool, target ORDER BY aseq) AS
  p FROM n)
SELECT session, agent, call_id, (n - p)::BIGINT AS inputs FROM l WHERE p IS NOT NULL AND category <> 'agent'""",
)
def new_input_between(f: Frames) -> DataFrame:
    return evidence.inputs_between(f.calls)


@query(
    "usage_of_busiest_thread",
    "WITH t AS (SELECT thread % 10 AS grp, thread, count(*) AS n, arg_max(input_tokens, idx) AS input_tokens FROM "
    "responses GROUP BY 1, 2) SELECT grp, thread, n, input_tokens FROM t QUALIFY row_number() OVER (PARTITION BY grp "
    "ORDER BY n DESC, thread) = 1",
    R,
)
def usage_of_busiest_thread(f: Frames) -> DataFrame:
    return evidence.busiest(f.responses, F.col("thread") % 10)


@query(
    "quota_gauge",
    "SELECT session, agent, first(bytes ORDER BY start_ns, call_id) AS first, last(bytes ORDER BY start_ns, call_id) "
    "AS last, max(bytes) AS greatest FROM calls WHERE bytes IS NOT NULL GROUP BY 1, 2",
)
def quota_gauge(f: Frames) -> DataFrame:
    return evidence.gauge(f.calls, "bytes")


@query(
    "context_reread_once",
    "WITH o AS (SELECT session, agent, emitter, first(content_fp ORDER BY aseq) AS v, count(*) AS n FROM calls GROUP "
    "BY 1, 2, 3) SELECT session, agent, count(*) AS responses, sum(n)::BIGINT AS calls, sum(v)::BIGINT AS content_fp "
    "FROM o GROUP BY 1, 2",
)
def context_reread_once(f: Frames) -> DataFrame:
    return evidence.once_per_response(f.calls, "content_fp")


@query(
    "duration_by_index",
    "WITH r AS (SELECT tool, duration_ms, row_number() OVER (PARTITION BY tool ORDER BY duration_ms, call_id) - 1 AS "
    "i, count(*) OVER (PARTITION BY tool) AS n FROM calls WHERE duration_ms IS NOT NULL) SELECT tool, max(CASE WHEN i "
    "= n // 2 THEN duration_ms END) AS mid, max(CASE WHEN i = n * 9 // 10 THEN duration_ms END) AS p90, "
    "max(duration_ms) AS greatest FROM r GROUP BY 1",
)
def duration_by_index(f: Frames) -> DataFrame:
    return evidence.by_index(f.calls, "tool", "duration_ms")


@query(
    "token_count_delta",
    "WITH t AS (SELECT thread, idx, input_tokens // 100000 AS total, lag(input_tokens // 100000) OVER (PARTITION BY "
    "thread ORDER BY idx) AS p FROM responses) SELECT thread, idx, total, total - coalesce(p, 0) AS delta FROM t "
    "WHERE p IS NULL OR p <> total",
    R,
)
def token_count_delta(f: Frames) -> DataFrame:
    return evidence.changes_only(f.responses, F.floor(F.col("input_tokens") / 100_000))


@query(
    "gathered_until_next",
    "WITH g AS (SELECT *, sum((category = 'shell')::INT) OVER (PARTITION BY session, agent ORDER BY aseq DESC ROWS "
    "UNBOUNDED PRECEDING) AS g FROM calls) SELECT session, agent, min(aseq) AS first_aseq, count(*) AS calls, "
    "sum(bytes)::BIGINT AS bytes, max((category = 'shell')::INT)::BIGINT AS ended FROM g GROUP BY session, agent, g",
)
def gathered_until_next(f: Frames) -> DataFrame:
    return evidence.until_next(f.calls, F.col("category") == "shell")


@query(
    "version_timeline",
    "SELECT target, content_fp, min(start_ns) AS first_ns, max(start_ns) AS last_ns, count(DISTINCT session) AS "
    "sessions FROM calls GROUP BY 1, 2",
)
def version_timeline(f: Frames) -> DataFrame:
    return evidence.versions(f.calls)


@query(
    "pattern_steps",
    """WITH p AS (SELECT category, target, content_fp, status, lead(category) OVER w AS c2, lead(target) OVER w AS t2,
  lead(content_fp) OVER w AS f2, lead(status) OVER w AS s2 FROM calls WINDOW w AS (PARTITION BY session, agent ORDER BY
  aseq)),
e AS (SELECT category || '>' || c2 AS pattern, 0 AS pos, target, content_fp, status FROM p WHERE c2 IS NOT NULL UNION
  ALL SELECT category || '>' || c2, 1, t2, f2, s2 FROM p WHERE c2 IS NOT NULL)
SELECT pattern, pos, count(*) AS n, count(DISTINCT target) AS targets, count(DISTINCT content_fp) AS contents,
  count(DISTINCT status) AS statuses, CASE WHEN count(DISTINCT content_fp) <= 1 AND count(DISTINCT status) <= 1 THEN
  'mechanical' ELSE 'judgment' END AS kind FROM e GROUP BY 1, 2""",
)
def pattern_steps(f: Frames) -> DataFrame:
    return evidence.steps(f.calls)


@query(
    "calls_with_listed_events",
    "WITH i AS (SELECT session, call_id, unnest([call_id, call_id + 7, call_id + 5000]) AS event_id FROM calls) "
    "SELECT session, call_id, count(*) AS events FROM i WHERE event_id IN (SELECT event_id FROM ev WHERE event_type = "
    "'click') GROUP BY 1, 2",
    ("calls", "ev"),
)
def calls_with_listed_events(f: Frames) -> DataFrame:
    listed = F.format_string("[%d,%d,%d]", F.col("call_id"), F.col("call_id") + 7, F.col("call_id") + 5_000)
    return evidence.with_listed_events(f.calls, listed, f.events.filter("event_type = 'click'"))


@query(
    "feedback_of_calls",
    "SELECT tool, count(*) AS calls, count(l.quality) AS marked, count(*) FILTER (WHERE l.quality = 0) AS "
    "false_positives FROM calls LEFT JOIN labels l ON l.doc_id = call_id GROUP BY 1",
)
def feedback_of_calls(f: Frames) -> DataFrame:
    marks = f.table("labels").select(F.col("doc_id").alias("call_id"), "quality")
    return f.calls.join(marks, "call_id", "left").groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count("quality").alias("marked"),
        F.count_if(F.col("quality") == 0).alias("false_positives"),
    )


@query(
    "wait_alternatives",
    "WITH n AS (SELECT session, server, tool, count(*) AS n FROM calls WHERE server IS NOT NULL GROUP BY 1, 2, 3) "
    "SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY session, server ORDER BY n DESC, tool) = 1",
)
def wait_alternatives(f: Frames) -> DataFrame:
    return evidence.wait_alternatives(f.calls)


@query(
    "near_lines",
    "SELECT DISTINCT a.session, a.seq, a.target FROM calls a WHERE a.category = 'read' AND EXISTS (SELECT 1 FROM "
    "calls b WHERE b.category = 'search' AND b.session = a.session AND b.target = a.target AND abs(a.seq - b.seq) <= "
    "10)",
)
def near_lines(f: Frames) -> DataFrame:
    c = f.calls.select("session", "seq", "target", "category")
    return evidence.near_lines(
        c.filter("category = 'read'").drop("category"), c.filter("category = 'search'"), "session", "seq", "target"
    )


@query(
    "unique_prefixes",
    """WITH i AS (SELECT DISTINCT substr(sha256(url), 1, 12) AS id FROM pages), n AS (SELECT a.id, max(CASE WHEN b.id IS
  NULL THEN 0 ELSE (SELECT coalesce(max(k), 0) FROM range(1, 13) t(k) WHERE substr(a.id, 1, k) = substr(b.id, 1, k))
  END) AS c
  FROM i a LEFT JOIN i b ON a.id <> b.id AND substr(a.id, 1, 2) = substr(b.id, 1, 2) GROUP BY 1)
SELECT id, greatest(2, least(12, c + 1))::INT AS chars FROM n""",
    (),
)
def unique_prefixes(f: Frames) -> DataFrame:
    return evidence.unique_prefix(f.table("pages").select(F.substring(F.sha2("url", 256), 1, 12).alias("id")), "id", 2)


@query(
    "pointer_walk",
    "WITH RECURSIVE w AS (SELECT thread, idx, idx AS cur, 0 AS steps FROM responses UNION ALL SELECT thread, idx, cur "
    "// 2, steps + 1 FROM w WHERE cur > 1) SELECT thread * 1000 + idx AS node, thread * 1000 + 1 AS root, "
    "max(steps)::BIGINT AS steps FROM w GROUP BY thread, idx",
    R,
)
def pointer_walk(f: Frames) -> DataFrame:
    node = lambda i: F.struct("thread", i.cast("long").alias("idx"))
    links = f.responses.select(
        node(F.col("idx")).alias("node"), F.when(F.col("idx") > 1, node(F.floor(F.col("idx") / 2))).alias("parent")
    )
    # the numbers are made at the end: those of long threads clash with the next thread's
    number = lambda c: (F.col(f"{c}.thread") * 1_000 + F.col(f"{c}.idx")).alias(c)
    return evidence.walk(links, "node", "parent").select(number("node"), number("root"), "steps")


@query(
    "context_windows",
    "WITH d AS (SELECT *, input_tokens - lag(input_tokens) OVER (PARTITION BY thread, ctx ORDER BY idx) AS d FROM "
    "responses) SELECT thread, ctx, arg_min(input_tokens, idx) AS first, arg_max(input_tokens, idx) AS last, "
    "max(input_tokens) AS peak, sum(greatest(d, 0))::BIGINT AS growth, count(*) FILTER (WHERE d < 0) AS falls FROM d "
    "GROUP BY 1, 2",
    R,
)
def context_windows(f: Frames) -> DataFrame:
    return evidence.context_windows(f.responses)


@query(
    "contract_match",
    "WITH k AS (SELECT DISTINCT sha256(tool || '|' || target) AS h, CASE WHEN params = 1 THEN 'wait' ELSE 'notify' "
    "END AS kind FROM calls WHERE target IN ('k1', 'k2', 'k3') AND params IN (1, 2)) SELECT tool, kind, count(*) AS "
    "calls, count(DISTINCT target) AS targets FROM calls JOIN k ON sha256(tool || '|' || target) = h GROUP BY 1, 2",
)
def contract_match(f: Frames) -> DataFrame:
    some = f.calls.filter("target IN ('k1', 'k2', 'k3') AND params IN (1, 2)")
    contracts = some.select(
        F.sha2(F.concat_ws("|", "tool", "target"), 256).alias("scope_hash"),
        F.when(F.col("params") == 1, "wait").otherwise("notify").alias("kind"),
    ).distinct()
    return evidence.contract_match(f.calls, contracts)


@query(
    "habits",
    "SELECT tool, target, count(*) AS n FROM calls GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY n DESC, tool, target "
    "LIMIT 8",
)
def habits(f: Frames) -> DataFrame:
    return evidence.habits(f.calls)


@query(
    "bulk_threads",
    "WITH g AS (SELECT session, agent, count(*) AS n, max(start_ns) - min(start_ns) AS span, sum(duration_ms)::BIGINT "
    "AS ms FROM calls GROUP BY 1, 2) SELECT session, agent, n, n >= 20 AND span < 43000000000000 AS bulk, CASE WHEN "
    "NOT (n >= 20 AND span < 43000000000000) THEN ms END AS measured_ms FROM g",
)
def bulk_threads(f: Frames) -> DataFrame:
    return evidence.bulk_threads(f.calls, span_ns=43_000_000_000_000)


@query(
    "run_output_facts",
    r"""WITH l AS (SELECT event_id, 'host 12.5 HITCH' || chr(10) || 'STREAM phase key=' || k || ' maxFrame=' || (k % 7)
  || 'ms left=-' || k || 's' AS line FROM ev),
p AS (SELECT unnest(regexp_extract_all(line, '([A-Za-z]\w*=-?\d+(?:ms|s)?)', 1)) AS kv FROM l)
SELECT split_part(kv, '=', 1) AS key, regexp_extract(kv, '(ms|s)$', 1) AS unit, count(*) AS n,
  sum(regexp_extract(split_part(kv, '=', 2), '^-?\d+')::BIGINT)::BIGINT AS total FROM p GROUP BY 1, 2""",
    ("ev",),
)
def run_output_facts(f: Frames) -> DataFrame:
    line = F.format_string(
        "host 12.5 HITCH\nSTREAM phase key=%d maxFrame=%dms left=-%ds", F.col("k"), F.col("k") % 7, F.col("k")
    )
    return evidence.key_values(f.events.select("event_id", line.alias("line")), "line").groupBy("key", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.sum("number").alias("total")
    )


@query(
    "config_segments",
    """WITH l AS (SELECT *, coalesce(lag(tier) OVER (PARTITION BY thread ORDER BY idx) <> tier, FALSE)::INT AS b FROM
  responses), s AS (SELECT *, sum(b) OVER (PARTITION BY thread ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT AS segment
  FROM l),
g AS (SELECT thread, segment, min(idx) AS start, count(*) AS n, max(tier) AS tier FROM s GROUP BY 1, 2)
SELECT *, lead(start) OVER (PARTITION BY thread ORDER BY segment) AS "end" FROM g""",
    R,
)
def config_segments(f: Frames) -> DataFrame:
    return evidence.segments_of(f.responses, ["thread"], ["idx"], "tier")


@query(
    "map_counters",
    "WITH c AS (UNPIVOT (SELECT count(*) FILTER (WHERE status = 'open') AS open_calls, count(*) FILTER (WHERE server "
    "IS NULL) AS serverless, count(*) AS all_calls FROM calls) ON open_calls, serverless, all_calls INTO NAME name "
    "VALUE n) SELECT name, n FROM c",
)
def map_counters(f: Frames) -> DataFrame:
    """Counters that travel as a map per session, summed by key."""
    n = F.create_map(
        F.lit("open_calls"),
        F.count_if(F.col("status") == "open"),
        F.lit("serverless"),
        F.count_if(F.col("server").isNull()),
        F.lit("all_calls"),
        F.count(F.lit(1)),
    )
    maps = f.calls.groupBy("session").agg(n.alias("m"))
    return maps.select(F.explode("m").alias("name", "v")).groupBy("name").agg(F.sum("v").alias("n"))


@query(
    "top_findings",
    "WITH f AS (SELECT session, agent, target, count(*) AS n, CASE WHEN count(*) >= 6 OR count(*) FILTER (WHERE "
    "status IN ('error', 'timeout', 'denied', 'interrupted')) > 0 THEN 2 ELSE 1 END AS rank FROM calls WHERE category "
    "= 'shell' GROUP BY 1, 2, 3 HAVING count(*) >= 3) SELECT session, agent, target, n FROM f WHERE rank >= 2 QUALIFY "
    "row_number() OVER (PARTITION BY session ORDER BY n DESC, agent, target) <= 3",
)
def top_findings(f: Frames) -> DataFrame:
    from pyspark.sql import Window

    from ..operators import detectors

    found = detectors.tool_gap(f.calls).filter("confidence <> 'low'")
    w = Window.partitionBy("session").orderBy(F.desc("n"), "agent", "target")
    return found.withColumn("_r", F.row_number().over(w)).filter("_r <= 3").select("session", "agent", "target", "n")


@query(
    "session_reports",
    "WITH r AS (SELECT session, 'failed' AS rule, count(*) AS findings, sum(aseq)::BIGINT AS calls FROM calls WHERE "
    "status = 'error' GROUP BY 1) SELECT session, '{\"report_version\":\"1.1\",\"session\":' || session || "
    "',\"rules\":[{\"rule\":\"failed\",\"findings\":' || findings || ',\"calls\":' || calls || '}]}' AS report FROM r",
)
def session_reports(f: Frames) -> DataFrame:
    from ..sources import store

    return store.reports(
        f.calls.filter(metrics.failed()).select("session", F.lit("failed").alias("rule"), F.col("aseq").alias("n"))
    )


_OUTPUT = """CASE WHEN k % 5 = 0 THEN '{"status": "s' || (k % 2) || '", "exit_code": ' || (k % 3) || ', "failures": ' ||
  (k % 4) || ', "other": 1}'
  WHEN k % 7 = 0 THEN '<note>exit_code=9</note><status>st' || (k % 2) || '</status><event>c' || (k % 2) ||
    ' 3.5 fail boom</event><summary>over; exit code ' || (k % 3) || '</summary>'
  ELSE '=== role' || (k % 3) || chr(10) || k || '.5 STREAM phase' || (k % 2) || ' a=' || k || ' b=' || (k % 9) || 'ms'
    || chr(10) || 'host ' || k || '.0 hitch ' || k || ' ms' || chr(10)
    || 'host 2.0 END failures=' || (k % 4) || chr(10) || 'mystery ' || k || chr(10) || 'run finished' END"""


@query(
    "run_facts",
    """
WITH t AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'json' WHEN k % 7 = 0 THEN 'xml' ELSE 'lines' END AS form FROM ev),
f AS (SELECT 'process_status' AS field, NULL AS role, NULL AS phase, 's' || (k % 2) AS value FROM t WHERE form = 'json'
  UNION ALL SELECT 'process_exit', NULL, NULL, (k % 3)::VARCHAR FROM t WHERE form = 'json' UNION ALL SELECT
    'tests_failed', NULL, NULL, (k % 4)::VARCHAR FROM t WHERE form = 'json'
  UNION ALL SELECT 'process_status', NULL, NULL, 'st' || (k % 2) FROM t WHERE form = 'xml' UNION ALL SELECT
    'failure_event', 'c' || (k % 2), NULL, 'boom' FROM t WHERE form = 'xml'
  UNION ALL SELECT 'process_exit', NULL, NULL, (k % 3)::VARCHAR FROM t WHERE form = 'xml'
  UNION ALL SELECT 'stream.a', 'role' || (k % 3), 'phase' || (k % 2), k::VARCHAR FROM t WHERE form = 'lines' UNION ALL
    SELECT 'stream.b_ms', 'role' || (k % 3), 'phase' || (k % 2), (k % 9)::VARCHAR FROM t WHERE form = 'lines'
  UNION ALL SELECT 'hitch_ms', 'host', NULL, k::VARCHAR FROM t WHERE form = 'lines' UNION ALL SELECT 'run_end', 'host',
    NULL, 'true' FROM t WHERE form = 'lines'
  UNION ALL SELECT 'tests_failed', 'host', NULL, (k % 4)::VARCHAR FROM t WHERE form = 'lines' UNION ALL SELECT
    'watcher_end', NULL, NULL, 'true' FROM t WHERE form = 'lines')
SELECT field, role, phase, value, count(*) AS n FROM f GROUP BY 1, 2, 3, 4""",
    ("ev",),
)
def run_facts_query(f: Frames) -> DataFrame:
    """Facts of outputs in three forms: lines with a header, JSON summaries, notifications."""
    texts = f.events.select("event_id", F.expr(_OUTPUT).alias("output"))
    return run_facts.facts(texts, "event_id", "output").groupBy("field", "role", "phase", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "run_completeness",
    "SELECT event_id, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 0 ELSE 1 END::BIGINT AS unparsed_lines, FALSE AS "
    "truncated FROM ev",
    ("ev",),
)
def run_completeness(f: Frames) -> DataFrame:
    texts = f.events.select("event_id", F.expr(_OUTPUT).alias("output"))
    return run_facts.completeness(texts, "event_id", "output")


@query(
    "already_told",
    """WITH c AS (SELECT *, CASE WHEN params = 2 THEN 'state' ELSE 'process_exit' END AS field, CASE WHEN params = 1 THEN category
  END AS phase FROM calls),
n AS (SELECT agent, field, phase, content_fp, params, CASE WHEN call_id % 3 > 0 OR params <> 2 THEN tool ELSE 'unspecified' END
  AS role FROM c WHERE call_id % 4 > 0),
s AS (SELECT *, CASE WHEN call_id % 5 = 0 AND params = 2 THEN 'unspecified' ELSE tool END AS role FROM c WHERE call_id % 6 = 1)
SELECT agent AS run, field, bool_and(call_id % 41 <> 1 AND (call_id % 37 = 1 OR EXISTS (SELECT 1 FROM n WHERE n.agent = s.agent
  AND n.field = s.field AND n.role = s.role AND n.content_fp = s.content_fp AND n.params = s.params AND n.phase IS NOT
  DISTINCT FROM s.phase))) AS told FROM s GROUP BY 1, 2""",
)
def already_told(f: Frames) -> DataFrame:
    """Of each agent and field, whether summaries made of every sixth call say nothing that notices of other calls have not."""
    c = f.calls.select(
        F.col("agent").alias("run"),
        F.when(F.col("params") == 2, "state").otherwise("process_exit").alias("field"),
        F.when(F.col("params") == 1, F.col("category")).alias("phase"),
        F.col("content_fp").alias("at"),
        F.col("params").alias("value"),
        F.col("tool").alias("scope"),
        "call_id",
    )
    number = F.col("call_id")
    notes = c.filter(number % 4 > 0).withColumn("role", F.when(number % 3 > 0, F.col("scope")))
    late = (number % 5 == 0) & (F.col("value") == 2)
    summaries = c.filter(number % 6 == 1).select(
        "*", F.when(late, "unspecified").otherwise(F.col("scope")).alias("role"),
        (number % 37 != 1).alias("has_value"), (number % 41 == 1).alias("conflicting"),
    )
    return evidence.already_told(summaries, notes)
