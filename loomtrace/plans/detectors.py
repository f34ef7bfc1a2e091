"""Queries of the seven rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shell
from ..operators import detectors, repeats
from ..sources.bridge import Frames
from .registry import query

FAILED = "status IN ('error', 'timeout', 'denied', 'interrupted')"

_READ_PAIRS = """
WITH m AS (SELECT *, sum((category = 'edit')::INT) OVER (PARTITION BY session, agent, target ORDER BY aseq ROWS
  UNBOUNDED PRECEDING) AS edits,
  sum((category = 'shell')::INT) OVER (PARTITION BY session, agent ORDER BY aseq ROWS UNBOUNDED PRECEDING) AS unknowns
    FROM calls),
l AS (SELECT *, lag(aseq) OVER w AS p_aseq, lag(start_ns) OVER w AS p_start_ns, lag(content_fp) OVER w AS p_fp,
  lag(status) OVER w AS p_status, lag(edits) OVER w AS p_edits, lag(unknowns) OVER w AS p_unknowns, lag(call_id) OVER w
  AS p_call
  FROM m WHERE category = 'read' WINDOW w AS (PARTITION BY session, agent, epoch, target, params ORDER BY aseq)),
p AS (SELECT *, CASE WHEN p_status <> 'success' OR status <> 'success' THEN 'excluded_status' WHEN p_fp <> content_fp
  THEN 'excluded_content' WHEN edits > p_edits THEN 'excluded_edit'
  WHEN unknowns > p_unknowns THEN 'degraded' ELSE 'clean' END AS verdict FROM l WHERE p_aseq IS NOT NULL AND aseq -
    p_aseq <= 60 AND start_ns - p_start_ns <= 86400000000000)
"""
#: A day: the driver's agents call seldom.
WIDE = (60, 86_400)
WIDE_ERRORS = (40, 86_400)


@query(
    "read_pairs_verdict", _READ_PAIRS + "SELECT session, agent, epoch, target, params, p_call, call_id, verdict FROM p"
)
def read_pairs_verdict(f: Frames) -> DataFrame:
    return detectors.read_pairs(f.calls, WIDE).select(
        "session", "agent", "epoch", "target", "params", "p_call", "call_id", "verdict"
    )


@query(
    "read_clusters",
    _READ_PAIRS
    + """, g AS (SELECT *, lag(call_id) OVER (PARTITION BY session, agent, epoch, target, params ORDER BY aseq) AS prev
  FROM p WHERE verdict IN ('clean', 'degraded')),
i AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> p_call THEN 1 ELSE 0 END) OVER (PARTITION BY session, agent,
  epoch, target, params ORDER BY aseq ROWS UNBOUNDED PRECEDING) AS chain FROM g)
SELECT session, agent, epoch, target, params, count(*) + 1 AS reads, min(p_aseq) AS first_aseq, max(aseq) AS last_aseq,
  sum(bytes)::BIGINT AS wasted_bytes, CASE WHEN bool_and(verdict = 'clean') THEN 'high' ELSE 'medium' END AS confidence
FROM i GROUP BY session, agent, epoch, target, params, chain""",
)
def read_clusters(f: Frames) -> DataFrame:
    return detectors.read_clusters(f.calls, WIDE)


@query(
    "read_batches",
    _READ_PAIRS.replace("86400000000000", "900000000000")
    + "SELECT session, agent, epoch, p_aseq // 2 AS p_emitter, emitter, count(*) AS pairs, count(DISTINCT target) AS targets FROM p WHERE verdict IN ('clean', 'degraded') GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 1",
)
def read_batches(f: Frames) -> DataFrame:
    return detectors.read_batches(f.calls, 1)


@query(
    "rerun_chains",
    """
WITH e AS (SELECT *, sum((category = 'edit')::INT) OVER (PARTITION BY session, agent ORDER BY aseq ROWS UNBOUNDED
  PRECEDING) AS edits FROM calls),
l AS (SELECT *, lag(aseq) OVER w AS pa, lag(start_ns) OVER w AS ps, lag(edits) OVER w AS pe, lag(status) OVER w AS pst
  FROM e WHERE category IN ('shell', 'search') WINDOW w AS (PARTITION BY session, agent, tool, target ORDER BY aseq)),
i AS (SELECT *, sum(CASE WHEN edits > pe OR status <> pst OR aseq - pa > 40 OR start_ns - ps > 86400000000000 THEN 1
  ELSE 0 END) OVER (PARTITION BY session, agent, tool, target ORDER BY aseq ROWS UNBOUNDED PRECEDING) AS chain FROM l)
SELECT session, agent, tool, target, count(*) AS runs, min(aseq) AS first_aseq, max(aseq) AS last_aseq FROM i GROUP BY
  session, agent, tool, target, chain HAVING count(*) >= 2""",
)
def rerun_chains(f: Frames) -> DataFrame:
    return detectors.rerun_chains(f.calls, WIDE_ERRORS)


_FAILURES = f"""
WITH o AS (SELECT *, min(CASE WHEN status = 'success' THEN aseq END) OVER w AS ok_aseq, first_value(CASE WHEN status =
  'success' THEN start_ns END IGNORE NULLS) OVER w AS ok_ns FROM calls
  WINDOW w AS (PARTITION BY session, agent, tool, params ORDER BY aseq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED
    FOLLOWING)),
l AS (SELECT *, lag(aseq) OVER w AS pa, lag(start_ns) OVER w AS ps FROM o WHERE {FAILED} AND status <> 'interrupted'
  WINDOW w AS (PARTITION BY session, agent, tool, params ORDER BY aseq)),
i AS (SELECT *, start_ns - ps AS gap, sum(CASE WHEN aseq - pa > 40 OR start_ns - ps > 86400000000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY session, agent, tool, params ORDER BY aseq ROWS UNBOUNDED PRECEDING) AS chain FROM l),
g AS (SELECT *, row_number() OVER w AS n, lag(gap) OVER w AS pgap FROM i WINDOW w AS (PARTITION BY session, agent, tool,
  params, chain ORDER BY aseq)),
c AS (SELECT session, agent, tool, params, chain, count(*) AS failures, min(aseq) AS first_aseq, max(aseq) AS last_aseq,
  count(DISTINCT target) AS inputs, max(start_ns) AS last_ns, arg_max(ok_aseq, aseq) AS ok_aseq, arg_max(ok_ns, aseq) AS
  ok_ns,
  count(*) FILTER (WHERE n > 2) >= 1 AND coalesce(bool_and(gap >= 1.5 * pgap) FILTER (WHERE n > 2), TRUE) AS backoff
    FROM g GROUP BY 1, 2, 3, 4, 5)
"""


def _error_key(calls: DataFrame) -> DataFrame:
    # the driver's errors repeat by params, not by target: the two change places
    return calls.withColumnsRenamed({"target": "_t", "params": "target"}).withColumnRenamed("_t", "params")


@query(
    "failure_chains",
    _FAILURES
    + """SELECT session, agent, tool, params AS key, failures, first_aseq, last_aseq, inputs, backoff, CASE WHEN
  coalesce(ok_aseq - last_aseq <= 40 AND ok_ns - last_ns <= 86400000000000, FALSE) THEN 'transient_recovered' ELSE
  'persistent' END AS kind,
  CASE WHEN coalesce(ok_aseq - last_aseq <= 40 AND ok_ns - last_ns <= 86400000000000, FALSE) THEN 'low' ELSE 'high' END
    AS confidence FROM c WHERE failures >= 3""",
)
def failure_chains(f: Frames) -> DataFrame:
    # its SQL asks for chains by distance alone; failure_chains_corrected looks at what came between
    return detectors.failure_chains(_error_key(f.calls), window=WIDE_ERRORS, edited=None).withColumnRenamed(
        "target", "key"
    )


@query(
    "failure_chains_corrected",
    f"""
WITH o AS (SELECT *, (category = 'edit')::INT AS is_edit, (category = 'shell')::INT AS is_shell, (category <>
  'read')::INT AS acts, min(CASE WHEN status = 'success' THEN aseq END) OVER w AS ok_aseq,
  first_value(CASE WHEN status = 'success' THEN start_ns END IGNORE NULLS) OVER w AS ok_ns FROM calls WINDOW w AS
    (PARTITION BY session, agent, tool, params ORDER BY aseq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
m AS (SELECT *, CASE WHEN server IS NULL AND target IS NOT NULL THEN sum(is_edit) OVER (PARTITION BY session, agent,
  target ORDER BY aseq ROWS UNBOUNDED PRECEDING) ELSE 0 END AS e,
  CASE WHEN server IS NULL THEN sum(is_shell) OVER (PARTITION BY session, agent ORDER BY aseq ROWS UNBOUNDED PRECEDING)
    ELSE sum(acts) OVER (PARTITION BY session, agent, server ORDER BY aseq ROWS UNBOUNDED PRECEDING) - sum(acts) OVER
      (PARTITION BY session, agent, server, tool ORDER BY aseq ROWS UNBOUNDED PRECEDING) END AS u FROM o),
l AS (SELECT *, lag(aseq) OVER w AS pa, lag(start_ns) OVER w AS ps, e - CASE WHEN server IS NULL AND target IS NOT NULL
  THEN is_edit ELSE 0 END - lag(e) OVER w AS de, u - CASE WHEN server IS NULL THEN is_shell ELSE 0 END - lag(u) OVER w
  AS du
  FROM m WHERE {FAILED} AND status <> 'interrupted' WINDOW w AS (PARTITION BY session, agent, tool, params ORDER BY
    aseq)),
i AS (SELECT *, start_ns - ps AS gap, sum(CASE WHEN aseq - pa > 40 OR start_ns - ps > 86400000000000 OR de > 0 THEN 1
  ELSE 0 END) OVER (PARTITION BY session, agent, tool, params ORDER BY aseq ROWS UNBOUNDED PRECEDING) AS chain FROM l),
g AS (SELECT *, row_number() OVER w AS n, lag(gap) OVER w AS pgap FROM i WINDOW w AS (PARTITION BY session, agent, tool,
  params, chain ORDER BY aseq)),
c AS (SELECT session, agent, tool, params, chain, count(*) AS failures, min(aseq) AS first_aseq, max(aseq) AS last_aseq,
  count(DISTINCT target) AS inputs, max(start_ns) AS last_ns, arg_max(ok_aseq, aseq) AS ok_aseq, arg_max(ok_ns, aseq) AS
  ok_ns,
  count(*) FILTER (WHERE n > 2) >= 1 AND coalesce(bool_and(gap >= 1.5 * pgap) FILTER (WHERE n > 2), TRUE) AS backoff,
    bool_or(n > 1 AND du > 0) AS unknown, arg_min(status, aseq) = 'denied' AS denied FROM g GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT *, coalesce(ok_aseq - last_aseq <= 40 AND ok_ns - last_ns <= 86400000000000, FALSE) AS recovered FROM c
  WHERE failures >= 3)
SELECT session, agent, tool, params AS key, failures, first_aseq, last_aseq, inputs, backoff, CASE WHEN recovered THEN
  'transient_recovered' WHEN denied THEN 'repeated_denial' ELSE 'persistent' END AS kind,
  CASE WHEN recovered THEN 'low' WHEN denied OR unknown THEN 'medium' ELSE 'high' END AS confidence FROM r""",
)
def failure_chains_corrected(f: Frames) -> DataFrame:
    return detectors.failure_chains(_error_key(f.calls), window=WIDE_ERRORS, edited="params").withColumnRenamed(
        "target", "key"
    )


@query(
    "failure_diff_inputs",
    f"""
WITH l AS (SELECT *, lag(aseq) OVER w AS pa, lag(start_ns) OVER w AS ps FROM calls WHERE {FAILED} WINDOW w AS (PARTITION
  BY session, agent, tool ORDER BY aseq)),
i AS (SELECT *, sum(CASE WHEN aseq - pa > 40 OR start_ns - ps > 86400000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY
  session, agent, tool ORDER BY aseq ROWS UNBOUNDED PRECEDING) AS chain FROM l)
SELECT session, agent, tool, count(*) AS failures, count(DISTINCT (target, params)) AS inputs, min(aseq) AS first_aseq
  FROM i GROUP BY session, agent, tool, chain HAVING count(*) >= 3 AND count(DISTINCT (target, params)) >= 2""",
)
def failure_diff_inputs(f: Frames) -> DataFrame:
    return detectors.failures_on_inputs(f.calls, window=WIDE_ERRORS)


@query(
    "failure_recovered",
    f"""
WITH o AS (SELECT session, tool, status, aseq, min(CASE WHEN status = 'success' THEN aseq END) OVER (PARTITION BY
  session, agent, target ORDER BY aseq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ok FROM calls)
SELECT session, tool, count(*) AS failures, count(*) FILTER (WHERE ok - aseq <= 40) AS recovered FROM o WHERE {FAILED}
  GROUP BY 1, 2""",
)
def failure_recovered(f: Frames) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("session", "agent", "target").orderBy("aseq").rowsBetween(1, Window.unboundedFollowing)
    rows = f.calls.withColumn("ok", F.min(F.when(F.col("status") == "success", F.col("aseq"))).over(w)).filter(FAILED)
    return rows.groupBy("session", "tool").agg(
        F.count(F.lit(1)).alias("failures"), F.count_if(F.col("ok") - F.col("aseq") <= 40).alias("recovered")
    )


_BATCH_RUNS = """
WITH RECURSIVE r AS (SELECT agent, aseq, category, emitter, aseq AS first_aseq, [target] AS targets FROM calls WHERE
  aseq = 0
UNION ALL SELECT c.agent, c.aseq, c.category, c.emitter, CASE WHEN c.category = r.category AND c.emitter <> r.emitter
  AND NOT list_contains(r.targets, c.target) THEN r.first_aseq ELSE c.aseq END,
  CASE WHEN c.category = r.category AND c.emitter <> r.emitter AND NOT list_contains(r.targets, c.target) THEN
    list_append(r.targets, c.target) ELSE [c.target] END
  FROM r JOIN calls c ON c.agent = r.agent AND c.aseq = r.aseq + 1)
SELECT agent AS session, agent, first_aseq, max(aseq) AS last_aseq, count(*)::INT AS calls FROM r WHERE category IN
  ('read', 'search') GROUP BY agent, first_aseq HAVING count(*) >= 2"""


@query("batch_runs", _BATCH_RUNS)
def batch_runs(f: Frames) -> DataFrame:
    return detectors.batch_runs(f.calls.withColumn("session", F.col("agent")).withColumn("seq", F.col("aseq")), least=2)


@query(
    "batch_independence",
    """
WITH l AS (SELECT *, list(CASE WHEN category = 'search' THEN target END) OVER (PARTITION BY session, agent ORDER BY aseq
  ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS listed FROM calls)
SELECT session, count(*) AS reads, count(*) FILTER (WHERE list_contains(listed, target)) AS listed FROM l WHERE category
  = 'read' GROUP BY 1""",
)
def batch_independence(f: Frames) -> DataFrame:
    return detectors.batch_independence(f.calls)


@query(
    "ngram_counts",
    """
WITH s AS (SELECT *, category || ':' || coalesce(server, '-') AS shape FROM (SELECT *, row_number() OVER (PARTITION BY
  session, agent ORDER BY aseq DESC) AS back FROM calls) WHERE back <= 2000),
g AS (SELECT session, agent, 2 AS n, [shape, lead(shape, 1) OVER w] AS gram FROM s WINDOW w AS (PARTITION BY session,
  agent ORDER BY aseq)
  UNION ALL SELECT session, agent, 3, [shape, lead(shape, 1) OVER w, lead(shape, 2) OVER w] FROM s WINDOW w AS
    (PARTITION BY session, agent ORDER BY aseq)
  UNION ALL SELECT session, agent, 4, [shape, lead(shape, 1) OVER w, lead(shape, 2) OVER w, lead(shape, 3) OVER w] FROM
    s WINDOW w AS (PARTITION BY session, agent ORDER BY aseq))
SELECT session, agent, n, array_to_string(gram, '>') AS gram, count(*) AS occurrences FROM g WHERE gram[n] IS NOT NULL
  AND len(list_distinct(gram)) >= 2 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3""",
)
def ngram_counts(f: Frames) -> DataFrame:
    return detectors.ngram_counts(f.calls, (2, 3, 4)).drop("starts")


_NGRAMS = ", ".join(f"lead(shape, {k}) OVER w AS s{k}" for k in range(1, 6))
_MINED = f"""
WITH s AS (SELECT *, category || ':' || coalesce(server, '-') AS shape FROM (SELECT *, row_number() OVER (PARTITION BY
  session, agent ORDER BY aseq DESC) AS back FROM calls) WHERE back <= 2000),
e AS (SELECT session, agent, aseq, shape AS s0, {_NGRAMS} FROM s WINDOW w AS (PARTITION BY session, agent ORDER BY
  aseq)),
g AS (SELECT session, agent, aseq, n, [s0, s1, s2, s3, s4, s5][:n] AS gram FROM e, range(2, 7) t(n) WHERE [s0, s1, s2,
  s3, s4, s5][n] IS NOT NULL),
c AS (SELECT session, agent, n, array_to_string(gram, '>') AS gram, list(aseq ORDER BY aseq) AS starts FROM g WHERE
  len(list_distinct(gram)) >= 2 GROUP BY 1, 2, 3, gram HAVING count(*) >= 3),
u AS (SELECT session, agent, n, gram, list_reduce(list_prepend(0::BIGINT, starts), lambda a, x: CASE WHEN x >= a %
  1000000000 THEN (a // 1000000000 + 1) * 1000000000 + x + n ELSE a END) // 1000000000 AS uses FROM c),
f AS (SELECT * FROM u WHERE uses >= 3),
k AS (SELECT *, string_split(gram, '>') AS parts FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.session =
  a.session AND b.agent = a.agent AND b.n > a.n AND b.uses >= a.uses AND contains('>' || b.gram || '>', '>' || a.gram ||
  '>'))),
o AS (SELECT *, list_min(list_transform(range(n), lambda i: array_to_string(parts[i + 1:] || parts[:i], '>'))) AS class
  FROM k),
d AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY session, agent, class ORDER BY uses DESC, n DESC, gram) =
  1)
SELECT * FROM (SELECT session, agent, n::INT AS n, gram, uses, row_number() OVER (PARTITION BY session, agent ORDER BY
  uses DESC, n DESC, gram) AS place FROM d) WHERE place <= 10"""


@query("ngram_mined", _MINED)
def ngram_mined(f: Frames) -> DataFrame:
    return detectors.mined_patterns(f.calls)


_GAP = (
    f"SELECT session, agent, target, count(*) AS n, count(*) FILTER (WHERE {FAILED}) AS failures, count(DISTINCT "
    f"params) AS forms FROM calls WHERE category = 'shell' GROUP BY 1, 2, 3 HAVING count(*) >= 3"
)


@query(
    "tool_gap_clusters",
    f"WITH g AS ({_GAP}) SELECT *, CASE WHEN n >= 6 OR failures > 0 THEN 'medium' ELSE 'low' END AS confidence FROM g",
)
def tool_gap_clusters(f: Frames) -> DataFrame:
    return detectors.tool_gap(f.calls)


@query(
    "tool_gap_related",
    f"""
WITH g AS ({_GAP}), s AS (SELECT DISTINCT 'k' || p_size AS name FROM part)
SELECT session, agent, target, count(*) AS related, min(name) AS first_name FROM g JOIN s ON contains(name, target) OR
  contains(target, name) GROUP BY 1, 2, 3""",
)
def tool_gap_related(f: Frames) -> DataFrame:
    return detectors.tool_gap_related(
        f.calls, f.table("part").select(F.concat(F.lit("k"), F.col("p_size").cast("string")).alias("name"))
    )


_DRIVEN = """CASE call_id % 4 WHEN 0 THEN 'ssh -p 22 host' || params || ' date' WHEN 1 THEN 'curl -s https://api' || params || '.example/x' WHEN 2 THEN 'squeue -u me' ELSE 'FOO=1 sudo docker ps | cat' END"""
_SERVER = "CASE server WHEN 'srv0' THEN 'host1' WHEN 'srv1' THEN 'hub' ELSE 'web' END"
_SERVER_TOOL = "CASE tool WHEN 'view' THEN 'submit_job' ELSE tool END"
_FAMILY_WORDS = " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in shell.SERVICE_WORDS.items())


@query(
    "service_gap",
    f"""
WITH d AS (SELECT session, agent, status, ['ssh', 'http', 'slurm', 'container'][call_id % 4 + 1] AS family, CASE call_id
  % 4 WHEN 0 THEN 'host' || params WHEN 1 THEN 'api' || params || '.example' WHEN 2 THEN 'slurm' ELSE 'docker' END AS
  target,
  ['ssh', 'curl', 'squeue', 'docker'][call_id % 4 + 1] AS head FROM calls WHERE category = 'shell'),
g AS (SELECT session, agent, family, target, count(*) AS n, count(*) FILTER (WHERE status IN ('error', 'timeout',
  'denied')) AS failures, string_agg(DISTINCT head, ',') AS heads FROM d GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3),
s AS (SELECT DISTINCT session, {_SERVER} AS server, {_SERVER_TOOL} AS tool FROM calls WHERE server IS NOT NULL),
r AS (SELECT g.session, family, target, string_agg(DISTINCT server, ',' ORDER BY server) AS related FROM (SELECT
  DISTINCT session, family, target FROM g) g JOIN s USING (session)
  WHERE (target <> family AND (contains(server, target) OR contains(target, server))) OR len(list_filter(CASE family
    {_FAMILY_WORDS} END, lambda w: contains(server, w) OR contains(tool, w))) > 0 GROUP BY 1, 2, 3)
SELECT session, agent, family, target, n, failures, heads, coalesce(related, '') AS related, CASE WHEN related IS NOT
  NULL THEN 'high' WHEN n >= 6 OR failures > 0 THEN 'medium' ELSE 'low' END AS confidence
FROM g LEFT JOIN r USING (session, family, target)""",
)
def service_gap(f: Frames) -> DataFrame:
    calls = f.calls.withColumn("command", F.expr(_DRIVEN))
    servers = f.calls.filter("server IS NOT NULL").select(
        "session", F.expr(_SERVER).alias("server"), F.expr(_SERVER_TOOL).alias("tool")
    )
    found = detectors.service_gap(calls, servers)
    return found.withColumns({"heads": F.array_join("heads", ","), "related": F.array_join("related", ",")})


_REPEATS = """
WITH m AS (SELECT *, sum((category = 'edit')::INT) OVER w AS edits, sum((category = 'agent')::INT) OVER w AS inputs FROM
  calls WINDOW w AS (PARTITION BY session, agent ORDER BY aseq ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, lag(emitter) OVER w AS p_emitter, lag(epoch) OVER w AS p_epoch, lag(inputs) OVER w AS p_inputs,
  lag(edits) OVER w AS p_edits, lag(status) OVER w AS p_status, lag(content_fp) OVER w AS p_fp, lag(end_ns) OVER w AS
  p_end, lag(start_ns) OVER w AS p_start
  FROM m WINDOW w AS (PARTITION BY session, agent, tool, target, params ORDER BY aseq)),
r AS (SELECT *, CASE WHEN p_emitter = emitter THEN 'same_response' WHEN p_epoch <> epoch THEN 'context_loss' WHEN inputs
  - p_inputs > CASE WHEN category = 'agent' THEN 1 ELSE 0 END THEN 'new_input'
  WHEN edits - p_edits > CASE WHEN category = 'edit' THEN 1 ELSE 0 END THEN 'after_change' WHEN p_status = 'open' THEN
    'unavailable' WHEN p_status = 'error' THEN 'after_failure' ELSE 'none' END AS reason,
  CASE WHEN status = 'open' OR p_status = 'open' THEN 'unknown' WHEN p_fp = content_fp THEN 'same' ELSE 'changed' END AS
    outcome FROM l WHERE p_start IS NOT NULL),
v AS (SELECT *, CASE WHEN reason = 'same_response' THEN 'free' WHEN reason IN ('context_loss', 'new_input',
  'after_change') OR outcome = 'changed' THEN 'useful' WHEN outcome = 'same' AND reason <> 'none' THEN
  'explained_no_gain'
  WHEN outcome = 'same' THEN 'no_gain' ELSE 'unknown' END AS value, start_ns - p_start AS interval_ns, greatest(0,
    start_ns - coalesce(p_end, start_ns)) AS idle_ns FROM r)
"""


@query(
    "repeat_pairs_reason",
    _REPEATS + "SELECT session, reason, outcome, value, count(*) AS n, sum(interval_ns)::BIGINT AS interval_ns, sum(idle_ns)::BIGINT AS idle_ns FROM v GROUP BY 1, 2, 3, 4",
)
def repeat_pairs_reason(f: Frames) -> DataFrame:
    return detectors.repeat_pairs(f.calls).groupBy("session", "reason", "outcome", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("interval_ns").alias("interval_ns"), F.sum("idle_ns").alias("idle_ns")
    )


@query(
    "repeat_groups",
    _REPEATS
    + """, g AS (SELECT session, agent, tool, target, params, count(*) + 1 AS calls, count(*) - count(*) FILTER (WHERE
  value = 'free') AS round_trips, count(*) FILTER (WHERE value = 'useful') AS useful, count(*) FILTER (WHERE value =
  'no_gain') AS no_gain,
  count(*) FILTER (WHERE value = 'explained_no_gain') AS explained, count(*) FILTER (WHERE value = 'unknown') AS
    unknowns, count(*) FILTER (WHERE reason = 'after_failure') AS after_failure,
  round(quantile_cont(interval_ns / 1e9, 0.5), 6) AS median_s, round(min(interval_ns / 1e9), 6) AS min_s,
    round(max(interval_ns / 1e9), 6) AS max_s, round(stddev_pop(interval_ns / 1e9) / nullif(avg(interval_ns / 1e9), 0),
    6) AS cv FROM v GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2)
SELECT *, CASE WHEN round_trips = 0 THEN 'free' WHEN no_gain * 2 >= round_trips AND no_gain >= 2 THEN 'agent' WHEN
  after_failure * 2 >= round_trips THEN 'see_errors' WHEN useful * 2 >= round_trips THEN 'justified'
  WHEN unknowns * 2 > round_trips THEN 'indeterminate' ELSE 'mixed' END AS verdict,
  CASE WHEN round_trips >= 5 AND (round_trips - unknowns) * 10 >= round_trips * 8 THEN 'high' WHEN round_trips >= 2 AND
    (round_trips - unknowns) * 2 >= round_trips THEN 'medium' ELSE 'low' END AS confidence FROM g""",
)
def repeat_groups(f: Frames) -> DataFrame:
    return detectors.repeat_groups(f.calls)


# Calls with what rule G asks of results and tools, and inputs between them.
_G_CALLS = {
    "tool": """CASE WHEN server IS NOT NULL THEN 'mcp__' || server || '__' || CASE tool WHEN 'signup' THEN 'wait_job'
  ELSE tool END
      WHEN tool = 'signup' THEN 'jobs.wait' WHEN tool = 'purchase' THEN 'jobs.submit' ELSE tool END""",
    "server_tool": "CASE WHEN server IS NOT NULL THEN CASE tool WHEN 'signup' THEN 'wait_job' ELSE tool END END",
    "category": "CASE WHEN server IS NOT NULL THEN 'mcp' WHEN tool IN ('signup', 'purchase') THEN 'other' ELSE category END",
    "target": "CASE WHEN tool = 'signup' THEN NULL ELSE substr(target, 1, 2) END",
    "params": "CAST(call_id % 2 AS STRING)",
    "result_phase": "CASE call_id % 7 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'in_progress' WHEN 3 THEN 'done' END",
    "timed_out": "CASE WHEN call_id % 11 = 0 THEN TRUE END",
    "delay": "CASE WHEN tool = 'signup' THEN CAST(call_id % 2 * 10 AS DOUBLE) END",
    "op": "CASE WHEN server IS NOT NULL THEN CASE WHEN tool = 'view' THEN 'mcp_read' ELSE 'mcp' END WHEN tool = 'view' THEN 'read' WHEN tool = 'click' THEN 'search' WHEN tool = 'error' THEN 'run_script' END",
}


def _g_calls(f: Frames) -> DataFrame:
    return f.calls.withColumns({c: F.expr(e) for c, e in _G_CALLS.items()})


def _g_inputs(f: Frames) -> DataFrame:
    return f.calls.filter("call_id % 37 = 0").select("session", "agent", F.col("start_ns").alias("ns"))


_G_COLUMNS = ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in _G_CALLS.items())
_G_SAME = "session, agent, tool, target, params, asked"
_G_SQL = f"""
WITH b AS (SELECT session, agent, seq, aseq, server, status, content_fp, start_ns, end_ns, epoch, emitter, call_id,
  {_G_COLUMNS} FROM calls),
p AS (SELECT *, regexp_matches(coalesce(server_tool, tool), '{repeats.WAITS}') AS waits,
  CASE WHEN category IN ('edit', 'write') THEN 'write' WHEN category IN ('read', 'search', 'list') OR op = 'mcp_read'
    THEN 'read' ELSE 'unknown' END AS effect,
  CASE WHEN contains(tool, '.') AND NOT starts_with(tool, 'mcp__') THEN split_part(tool, '.', 1) END AS space,
  CASE WHEN result_phase IS NOT NULL THEN result_phase WHEN timed_out THEN 'in_progress' WHEN status IN ('error',
    'timeout', 'denied', 'interrupted') THEN 'failed' WHEN status = 'success' THEN 'done' ELSE 'unknown' END AS phase,
  (SELECT count(*) FROM calls i WHERE i.call_id % 37 = 0 AND i.session = b.session AND i.agent = b.agent AND i.start_ns
    <= b.start_ns) AS new FROM b),
q AS (SELECT *, CASE WHEN waits THEN coalesce(format('{{:.3f}}', delay), '?') END AS asked,
  (category = 'mcp' AND coalesce(op, '') <> 'mcp_read' AND NOT waits)::INT AS acts, (effect = 'write')::INT AS writes,
  (space IS NOT NULL AND NOT waits AND NOT regexp_matches(tool, '{repeats.READS}'))::INT AS moves, (effect IN
    ('unknown', 'run', 'write') OR coalesce(op, '') IN ('run_tests', 'build', 'run_script'))::INT AS unsure FROM p),
c AS (SELECT *, CASE WHEN category = 'mcp' THEN sum(acts) OVER (PARTITION BY session, server ORDER BY seq) - sum(acts)
  OVER (PARTITION BY session, server, tool ORDER BY seq)
    WHEN (coalesce(op, '') = 'read' OR category = 'read') AND target IS NOT NULL THEN sum(writes) OVER (PARTITION BY
      session, target ORDER BY seq) - sum(writes) OVER (PARTITION BY {_G_SAME} ORDER BY seq)
    WHEN coalesce(op, '') IN ('read', 'search', 'list', 'vcs_read', 'run_tests', 'build', 'run_script') OR category IN
      ('read', 'search', 'list', 'shell')
      THEN sum(writes) OVER (PARTITION BY session ORDER BY seq) - sum(writes) OVER (PARTITION BY {_G_SAME} ORDER BY seq)
    WHEN space IS NOT NULL THEN sum(moves) OVER (PARTITION BY session, agent, space ORDER BY seq) - sum(moves) OVER
      (PARTITION BY session, agent, space, tool ORDER BY seq) ELSE 0 END AS strong,
  sum(unsure) OVER (PARTITION BY session, agent ORDER BY seq) - sum(unsure) OVER (PARTITION BY {_G_SAME} ORDER BY seq)
    AS weak FROM q),
l AS (SELECT *, {", ".join(f"lag({x}) OVER w AS p_{x}" for x in ("emitter", "epoch", "new", "strong", "weak", "phase", "content_fp", "start_ns", "end_ns", "seq"))}
  FROM c WINDOW w AS (PARTITION BY {_G_SAME} ORDER BY seq)),
r AS (SELECT *, CASE WHEN emitter = p_emitter THEN 'same_response' WHEN epoch <> p_epoch THEN 'context_loss' WHEN new >
  p_new THEN 'new_input' WHEN strong > p_strong THEN 'after_change'
    WHEN p_phase = 'unavailable' THEN 'unavailable' WHEN p_phase = 'failed' THEN 'after_failure' WHEN p_phase =
      'in_progress' THEN 'waiting'
    WHEN waits THEN 'waiting' WHEN weak > p_weak OR seq - p_seq - 1 > 400 THEN 'possible_change' ELSE 'none' END AS
      reason,
  CASE WHEN content_fp IS NULL OR p_content_fp IS NULL THEN 'unknown' WHEN content_fp = p_content_fp THEN 'same' ELSE
    'changed' END AS outcome,
  phase <> p_phase AND phase <> 'unknown' AND p_phase <> 'unknown' AS phase_changed FROM l WHERE p_seq IS NOT NULL),
v AS (SELECT *, CASE WHEN reason = 'same_response' THEN 'free' WHEN reason IN ('context_loss', 'new_input',
  'after_change') OR outcome = 'changed' OR phase_changed THEN 'useful'
  WHEN outcome = 'same' THEN CASE WHEN reason = 'none' THEN 'no_gain' ELSE 'explained_no_gain' END ELSE 'unknown' END AS
    value, reason <> 'same_response' AS rt, start_ns - p_start_ns AS gap FROM r)
"""


@query(
    "repeat_reasons",
    _G_SQL + "SELECT session, tool, reason, outcome, value, count(*) AS n, sum(gap)::BIGINT AS interval_ns, sum(greatest(start_ns - p_end_ns, 0))::BIGINT AS idle_ns FROM v GROUP BY 1, 2, 3, 4, 5",
)
def repeat_reasons(f: Frames) -> DataFrame:
    pairs = repeats.reasons(_g_calls(f), _g_inputs(f), n_calls=f.table("events").count())
    return pairs.groupBy("session", "tool", "reason", "outcome", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("interval_ns").alias("interval_ns"), F.sum("idle_ns").alias("idle_ns")
    )


_G_N = ", ".join(f"count(*) FILTER (WHERE rt AND reason = '{r}') AS n_{r}" for r in repeats.REASONS)
_G_V = ", ".join(
    f"count(*) FILTER (WHERE rt AND value = '{x}') AS v_{x}"
    for x in ("useful", "no_gain", "explained_no_gain", "unknown")
)


_G_VERDICTS = f""", s AS (SELECT {_G_SAME}, count(*) FILTER (WHERE rt) AS round_trips, {_G_N}, {_G_V}, count(*) FILTER (WHERE rt
  AND outcome = 'same') AS same, count(*) FILTER (WHERE rt AND outcome <> 'unknown') AS known,
  count(*) FILTER (WHERE rt AND phase_changed) AS phase_changes, quantile_cont(gap / 1e9, 0.5) FILTER (WHERE rt AND gap
    <= 1200000000000) AS median_s, min(gap / 1e9) FILTER (WHERE rt AND gap <= 1200000000000) AS min_s,
  max(gap / 1e9) FILTER (WHERE rt AND gap <= 1200000000000) AS max_s, stddev_pop(gap / 1e9) FILTER (WHERE rt AND gap <=
    1200000000000) / nullif(avg(gap / 1e9) FILTER (WHERE rt AND gap <= 1200000000000), 0) AS cv FROM v GROUP BY ALL),
g AS (SELECT {_G_SAME}, count(*) AS calls, any_value(category) AS category, any_value(server) AS server, any_value(op)
  AS op, any_value(waits) AS waits, count(*) FILTER (WHERE timed_out) AS timed_out,
  count(*) FILTER (WHERE result_phase <> 'unknown') AS phases_known FROM c GROUP BY ALL HAVING count(*) >= 3),
j AS (SELECT g.*, s.* EXCLUDE ({_G_SAME}) FROM g JOIN s ON
  {" AND ".join(f"g.{x.strip()} IS NOT DISTINCT FROM s.{x.strip()}" for x in _G_SAME.split(","))}),
k AS (SELECT *, round_trips AS n, n_waiting + n_unavailable AS polling,
  round_trips >= 5 AND coalesce(cv < 0.5, FALSE) AND (n_none + n_possible_change) * 10 >= round_trips * 6 AND
    phase_changes <= greatest(1, round_trips // 10) AS periodic FROM j),
m AS (SELECT *, (polling * 2 >= n AND polling >= 2) OR periodic AS polls, CASE WHEN category = 'mcp' THEN 'outil' ELSE
  'agent' END AS owner,
  coalesce(op, '') IN ('read', 'search', 'list', 'vcs_read', 'run_tests', 'build', 'run_script') OR category IN ('read',
    'search', 'list') AS local, category = 'mcp' AND NOT waits AND wait_tool IS NOT NULL AS offered
  FROM k LEFT JOIN (SELECT session, server, max(tool) AS wait_tool FROM c WHERE category = 'mcp' AND waits GROUP BY 1,
    2) USING (session, server))
SELECT session, agent, tool, target, params, calls, round_trips, {", ".join(f"n_{r}" for r in repeats.REASONS)},
  v_useful, v_no_gain, v_explained_no_gain, v_unknown, same, known, phase_changes,
  round(median_s, 6) AS median_s, round(min_s, 6) AS min_s, round(max_s, 6) AS max_s, round(cv, 6) AS cv, periodic,
    wait_tool,
  CASE WHEN n = 0 THEN 'gratuit' WHEN polls AND n_unavailable > n_waiting THEN 'environnement' WHEN polls AND offered
    THEN 'agent' WHEN polls AND (waits OR timed_out > 0) THEN CASE WHEN n_new_input + n_after_change + n_context_loss >
    0 THEN 'a_examiner' ELSE owner END
    WHEN polls THEN owner WHEN v_no_gain * 2 >= n AND v_no_gain >= 2 THEN 'agent' WHEN n_after_failure * 2 >= n THEN
      'echec' WHEN v_useful * 2 >= n THEN 'justifie' WHEN known * 2 < n THEN 'indetermine'
    WHEN v_useful >= v_no_gain THEN 'justifie' ELSE 'agent' END AS verdict,
  CASE WHEN n = 0 THEN NULL WHEN polls AND n_unavailable > n_waiting THEN 'retry_cadence' WHEN polls AND offered THEN
    'polling_instead_of_wait' WHEN polls AND (waits OR timed_out > 0) THEN 'wait_timeout' WHEN polls THEN
    'polling_cadence'
    WHEN local OR v_no_gain < 2 THEN NULL WHEN v_no_gain * 2 >= n THEN 'unexplained_repeats' WHEN n_after_failure * 2 >=
      n OR v_useful * 2 >= n OR known * 2 < n OR v_useful >= v_no_gain THEN NULL ELSE 'unexplained_repeats' END AS kind,
  CASE WHEN n >= 5 AND known * 10 >= n * 8 AND (polling = 0 OR phases_known * 10 >= calls * 8) THEN 'high' WHEN n >= 2
    AND known * 2 >= n THEN 'medium' ELSE 'low' END AS confidence FROM m"""


@query("repeat_verdicts", _G_SQL + _G_VERDICTS)
def repeat_verdicts(f: Frames) -> DataFrame:
    """All stand-in calls have fingerprints; tests/test_golden.py has calls without."""
    return repeats.verdicts(_g_calls(f), _g_inputs(f), n_calls=f.table("events").count())


@query(
    "tool_rhythm",
    """
WITH r AS (SELECT *, start_ns - lag(start_ns) OVER (PARTITION BY session, agent, tool ORDER BY start_ns, call_id) AS i,
  count(*) OVER (PARTITION BY session, agent, tool ORDER BY start_ns RANGE BETWEEN 60000000000 PRECEDING AND CURRENT
    ROW) AS p1, count(*) OVER (PARTITION BY session, agent, tool ORDER BY start_ns RANGE BETWEEN 600000000000 PRECEDING
    AND CURRENT ROW) AS p10 FROM calls)
SELECT tool, count(*) AS calls, count(DISTINCT agent) AS agents, max(start_ns) - min(start_ns) AS span_ns,
  quantile_cont(i, 0.5) AS median_ns, max(p1) AS peak_1min, max(p10) AS peak_10min FROM r GROUP BY 1""",
)
def tool_rhythm(f: Frames) -> DataFrame:
    return detectors.tool_rhythm(f.calls)


# One finding a row, of all seven rules with their own limits.
_ALL = f"""
WITH A AS (WITH m AS (SELECT *, sum((category = 'edit')::INT) OVER (PARTITION BY session, agent, target ORDER BY aseq)
  AS edits, sum((category = 'shell')::INT) OVER (PARTITION BY session, agent ORDER BY aseq) AS unknowns FROM calls),
  l AS (SELECT *, lag(aseq) OVER w AS p_aseq, lag(start_ns) OVER w AS p_ns, lag(content_fp) OVER w AS p_fp, lag(status)
    OVER w AS p_status, lag(edits) OVER w AS p_edits, lag(call_id) OVER w AS p_call FROM m WHERE category = 'read'
    WINDOW w AS (PARTITION BY session, agent, epoch, target, params ORDER BY aseq)),
  g AS (SELECT * FROM l WHERE aseq - p_aseq <= 60 AND start_ns - p_ns <= 900000000000 AND p_status = 'success' AND
    status = 'success' AND p_fp = content_fp AND edits = p_edits),
  i AS (SELECT *, lag(call_id) OVER w AS before FROM g WINDOW w AS (PARTITION BY session, agent, epoch, target, params
    ORDER BY aseq)),
  h AS (SELECT *, sum((before IS DISTINCT FROM p_call)::INT) OVER (PARTITION BY session, agent, epoch, target, params
    ORDER BY aseq) AS chain FROM i)
  SELECT 'A' AS rule, session, agent, count(*) + 1 AS n FROM h GROUP BY session, agent, epoch, target, params, chain),
B AS (WITH m AS (SELECT *, CASE WHEN server IS NULL THEN sum((category = 'edit')::INT) OVER (PARTITION BY session,
  agent, target ORDER BY aseq) ELSE 0 END AS e,
    CASE WHEN server IS NULL THEN (category = 'edit')::INT ELSE 0 END AS own FROM calls),
  l AS (SELECT *, lag(aseq) OVER w AS pa, lag(start_ns) OVER w AS ps, lag(e) OVER w AS pe FROM m WHERE {FAILED} AND
    status <> 'interrupted' WINDOW w AS (PARTITION BY session, agent, tool, target ORDER BY aseq)),
  i AS (SELECT *, sum(coalesce((aseq - pa > 40 OR start_ns - ps > 1800000000000 OR e - own > pe)::INT, 0)) OVER
    (PARTITION BY session, agent, tool, target ORDER BY aseq) AS chain FROM l)
  SELECT 'B' AS rule, session, agent, count(*) AS n FROM i GROUP BY session, agent, tool, target, chain HAVING count(*)
    >= 3),
C AS (WITH RECURSIVE o AS (SELECT *, coalesce(lag(agent) OVER (PARTITION BY session ORDER BY seq) <> agent, TRUE) AS
  switched FROM calls),
  r AS (SELECT session, seq, agent, category, emitter, seq AS first_seq, [target] AS targets FROM o WHERE seq = 0
  UNION ALL SELECT o.session, o.seq, o.agent, o.category, o.emitter, CASE WHEN NOT o.switched AND o.category =
    r.category AND o.emitter <> r.emitter AND NOT list_contains(r.targets, o.target) THEN r.first_seq ELSE o.seq END,
    CASE WHEN NOT o.switched AND o.category = r.category AND o.emitter <> r.emitter AND NOT list_contains(r.targets,
      o.target) THEN list_append(r.targets, o.target) ELSE [o.target] END
    FROM r JOIN o ON o.session = r.session AND o.seq = r.seq + 1)
  SELECT 'C' AS rule, session, agent, count(*) AS n FROM r WHERE category IN ('read', 'search') GROUP BY session, agent,
    first_seq HAVING count(*) >= 3),
D AS (SELECT 'D' AS rule, session, agent, uses AS n FROM ({_MINED})),
E AS (SELECT 'E' AS rule, session, agent, count(*) AS n FROM calls WHERE category = 'shell' GROUP BY session, agent,
  target HAVING count(*) >= 3),
F AS (WITH p AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ',
  'g'))) AS p FROM documents),
  t AS (SELECT p, list(doc_id ORDER BY doc_id) AS messages FROM p WHERE length(p) >= 80 GROUP BY p HAVING count(*) >= 2)
  SELECT 'F' AS rule, NULL::BIGINT AS session, NULL::BIGINT AS agent, len(messages) AS n FROM t GROUP BY messages),
G AS (SELECT 'G' AS rule, session, agent, count(*) AS n FROM calls GROUP BY session, agent, tool, target, params HAVING
  count(*) >= 3)
SELECT rule, session, agent, n::BIGINT AS n FROM (SELECT * FROM A UNION ALL SELECT * FROM B UNION ALL SELECT * FROM C
  UNION ALL SELECT * FROM D UNION ALL SELECT * FROM E UNION ALL SELECT * FROM F UNION ALL SELECT * FROM G)"""


@query("all_findings", _ALL)
def all_findings(f: Frames) -> DataFrame:
    return detectors.all_findings(f.calls, f.table("documents").select(F.col("doc_id").alias("message"), "text"))
