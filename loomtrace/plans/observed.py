"""Queries that begin at log lines: payloads written as text, one line an event, read back and analysed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import observe, repeats
from ..sources import logs
from ..sources.bridge import Frames
from ..sources.stored import shared_folder, stored
from ..streaming import analysis
from .detectors import _G_SQL, _G_VERDICTS, _MINED, FAILED
from .registry import query

CLIENT = "claude-code"
LINES_PER_FILE = 25_000


def _payload_lines(f: Frames) -> DataFrame:
    """value: for each event the payloads of a call's start and end, of its prompt or compaction; for each document a prompt."""
    e, k, ident = f.events, F.col("k"), F.col("event_id").cast("string")
    tool = F.col("event_type")
    ended = F.col("ns") + F.round(F.col("value") * 1000).cast("long") * 1_000_000
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    file = text("/w/f", k % 20, ".py")
    server = F.when(k % 3 == 0, "cluster0").otherwise(text("srv", k % 3))
    name = (
        F.when(tool == "view", "Read").when(tool == "click", "Grep").when(tool == "purchase", "Edit")
        .when(tool == "signup", text("mcp__", server, "__job_status")).otherwise("Bash")
    )
    command = F.when(k % 4 == 0, text("ssh host", k % 3, " run")).otherwise(text("python run", k % 6, ".py"))
    is_ = lambda kind, value: F.when(tool == kind, value)
    given = F.struct(
        F.when(tool.isin("view", "purchase"), file).alias("file_path"),
        is_("view", k % 3).alias("offset"),
        is_("click", text("p", k % 20)).alias("pattern"),
        is_("click", k % 3).alias("head_limit"),
        is_("purchase", text("o", ident)).alias("old_string"),
        is_("signup", k % 4).alias("job_id"),
        is_("error", command).alias("command"),
    )
    told = F.when(
        k % 5 == 4, F.to_json(F.struct(F.lit("server is offline").alias("error"), F.col("event_id").alias("elapsed_s")))
    ).otherwise(
        F.to_json(F.struct(F.when(k % 5 == 3, "COMPLETED").otherwise("RUNNING").alias("status"), F.col("event_id").alias("elapsed_s")))
    )
    blocks = F.array(F.struct(F.lit("text").alias("type"), told.alias("text")))
    wrong = (tool == "error") & (F.col("event_id") % 5 != 0)
    response = F.struct(
        F.when(tool == "view", text("body ", k % 5)).when(tool == "click", text("hits ", k % 5)).alias("content"),
        is_("purchase", file).alias("filePath"),
        is_("error", text("ok ", k % 2)).alias("stdout"),
    )
    answer = F.when(tool == "signup", F.to_json(F.struct(blocks.alias("content")))).otherwise(F.to_json(response))

    def line(hook, ns, when=None, **more):
        fields = [F.lit(hook).alias("hook_event_name")] if isinstance(hook, str) else [hook.alias("hook_event_name")]
        fields += [text("s", F.col("user_id") % 10).alias("session_id"), text("a", F.col("user_id")).alias("agent_id")]
        fields += [v.alias(n) for n, v in more.items()]
        one = F.to_json(F.struct(ns.alias("received_ns"), F.struct(*fields).alias("payload")))
        return one if when is None else F.when(when, one)

    of_call = {"tool_name": name, "tool_input": given, "tool_use_id": text("c", ident)}
    done = F.col("event_id") % 17 != 0
    result = F.from_json(answer, "content string, filePath string, stdout string")
    failure = line("PostToolUseFailure", ended, done & wrong, **of_call, error=F.lit("Exit code 1: boom"))
    # blocks of a server's answer and plain fields need another shape of line
    fine = line("PostToolUse", ended, done & ~wrong & (tool != "signup"), **of_call, tool_response=result)
    served = F.from_json(answer, "content array<struct<type:string,text:string>>")
    server_end = line("PostToolUse", ended, done & (tool == "signup"), **of_call, tool_response=served)
    twice = F.col("event_id") % 23 == 0
    every = [
        line("PostCompact", F.col("ns"), F.col("event_id") % 41 == 0, trigger=F.lit("auto"), at=ident),
        line("UserPromptSubmit", F.col("ns"), F.col("event_id") % 37 == 0, prompt=F.lit("go on"), prompt_id=ident),
        line("PreToolUse", F.col("ns"), **of_call),
        *(x for end in (failure, fine, server_end) for x in (end, F.when(twice, end))),
    ]
    rows = e.select(F.explode(F.array(*every)).alias("value")).filter("value IS NOT NULL")
    prompt = F.struct(
        F.lit("UserPromptSubmit").alias("hook_event_name"), F.lit("docs").alias("session_id"),
        F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"),
    )
    docs = f.table("documents").select(F.to_json(F.struct(F.col("doc_id").alias("received_ns"), prompt.alias("payload"))).alias("value"))
    return rows.unionByName(docs)


def _read(f: Frames) -> tuple[DataFrame, DataFrame]:
    """Payloads of the written lines, and their events."""
    path = f"{shared_folder(f.spark)}/loomtrace/hook-lines-{uuid.uuid4().hex}"
    # such lines take a tenth of the disk when packed; files of so many are each read by one task
    _payload_lines(f).write.option("compression", "gzip").option("maxRecordsPerFile", LINES_PER_FILE).text(path)
    payloads = logs.captured(f.spark.read.text(path))
    return payloads, stored(logs.hook_events(payloads, CLIENT), "hook-events", "zstd")


_HOOK_CALLS = f"""
hooked AS (SELECT *, (row_number() OVER (PARTITION BY session, agent ORDER BY start_ns, call_id) - 1)::BIGINT AS aseq,
  (row_number() OVER (PARTITION BY session ORDER BY start_ns, agent, call_id) - 1)::BIGINT AS seq,
  (sum((eid % 41 = 0)::INT) OVER (PARTITION BY session, agent ORDER BY start_ns RANGE BETWEEN UNBOUNDED PRECEDING AND
    CURRENT ROW))::BIGINT AS epoch
FROM (SELECT '{CLIENT}/s' || (user_id % 10) AS session, 'a' || user_id AS agent, 'c' || event_id AS call_id, event_id AS
  eid, ns AS start_ns,
  CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Grep' WHEN 'purchase' THEN 'Edit' WHEN 'signup' THEN 'mcp__'
    || CASE WHEN k % 3 = 0 THEN 'cluster0' ELSE 'srv' || (k % 3) END || '__job_status' ELSE 'Bash' END AS tool,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'mcp'
    ELSE 'shell' END AS category,
  CASE WHEN event_type = 'signup' THEN CASE WHEN k % 3 = 0 THEN 'cluster0' ELSE 'srv' || (k % 3) END END AS server,
  CASE WHEN event_type = 'signup' THEN 'job_status' END AS server_tool,
  CASE WHEN event_type IN ('view', 'purchase') THEN '/w/f' || (k % 20) || '.py' WHEN event_type = 'click' THEN 'p' || (k %
    20) WHEN event_type = 'error' THEN CASE WHEN k % 4 = 0 THEN 'ssh host' || (k % 3) || ' run' ELSE 'python run' || (k %
    6) || '.py' END END AS target,
  CASE event_type WHEN 'purchase' THEN 'o' || event_id WHEN 'signup' THEN 'j' || (k % 4) WHEN 'error' THEN '' ELSE (k %
    3)::VARCHAR END AS params,
  CASE WHEN event_id % 17 = 0 THEN 'open' WHEN event_type = 'error' AND event_id % 5 <> 0 THEN 'error' ELSE 'success' END
    AS status,
  CASE WHEN event_id % 17 <> 0 THEN CASE event_type WHEN 'view' THEN 'body ' || (k % 5) WHEN 'click' THEN 'hits ' || (k %
    5) WHEN 'signup' THEN CASE k % 5 WHEN 4 THEN 'offline' WHEN 3 THEN 'completed' ELSE 'running' END WHEN 'error' THEN
    CASE WHEN event_id % 5 <> 0 THEN 'boom' ELSE 'ok ' || (k % 2) END END END AS content_fp,
  CASE WHEN event_id % 17 <> 0 AND event_type = 'signup' THEN CASE k % 5 WHEN 4 THEN 'unavailable' WHEN 3 THEN 'done'
    ELSE 'in_progress' END END AS result_phase,
  CASE WHEN event_type = 'error' AND k % 4 = 0 THEN 'host' || (k % 3) END AS host,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN
    'mcp_read' ELSE CASE WHEN k % 4 = 0 THEN 'unknown' ELSE 'run_script' END END AS op,
  CASE WHEN event_id % 17 <> 0 THEN ns + round(value * 1000)::BIGINT * 1000000 END AS end_ns, NULL::VARCHAR AS emitter,
  FALSE AS timed_out, NULL::DOUBLE AS delay FROM ev))
"""
# Rule G's own SQL over these calls: results are compared by state, prompts lie at every 37th event, and calls within two
# seconds count as one response.
_G_BODY = (
    _G_SQL[_G_SQL.index("p AS (") :]
    .replace("i.call_id % 37", "i.eid % 37")
    .replace("emitter = p_emitter", "start_ns - p_end_ns < 2000000000")
    .replace("FROM calls i", "FROM hooked i")
)
_HOOK_G = "WITH b AS (SELECT *, NULL AS asked_ FROM hooked),\n" + _G_BODY + _G_VERDICTS
_KIND = "category IN ('read', 'search')"
_FINDINGS = f"""
WITH {_HOOK_CALLS.strip()},
A AS (WITH m AS (SELECT *, sum((category = 'edit')::INT) OVER (PARTITION BY session, agent, target ORDER BY aseq) AS edits,
    sum((category = 'shell')::INT) OVER (PARTITION BY session, agent ORDER BY aseq) AS unknowns FROM hooked),
  l AS (SELECT *, lag(aseq) OVER w AS p_aseq, lag(start_ns) OVER w AS p_ns, lag(content_fp) OVER w AS p_fp, lag(status)
    OVER w AS p_status, lag(edits) OVER w AS p_edits, lag(unknowns) OVER w AS p_unknowns, lag(call_id) OVER w AS p_call
    FROM m WHERE category = 'read' WINDOW w AS (PARTITION BY session, agent, epoch, target, params ORDER BY aseq)),
  g AS (SELECT * FROM l WHERE aseq - p_aseq <= 60 AND start_ns - p_ns <= 900000000000 AND p_status = 'success' AND
    status = 'success' AND p_fp = content_fp AND edits = p_edits),
  i AS (SELECT *, lag(call_id) OVER w AS before FROM g WINDOW w AS (PARTITION BY session, agent, epoch, target, params
    ORDER BY aseq)),
  h AS (SELECT *, sum((before IS DISTINCT FROM p_call)::INT) OVER (PARTITION BY session, agent, epoch, target, params
    ORDER BY aseq) AS chain FROM i)
  SELECT 'A' AS rule, session, agent, target AS subject, count(*) + 1 AS n, NULL AS kind,
    CASE WHEN bool_and(unknowns = p_unknowns) THEN 'high' ELSE 'medium' END AS confidence
  FROM h GROUP BY session, agent, epoch, target, params, chain),
B AS (WITH m AS (SELECT *, sum((category = 'shell')::INT) OVER (PARTITION BY session, agent ORDER BY aseq) AS u FROM
    hooked),
  l AS (SELECT *, lag(aseq) OVER w AS pa, lag(start_ns) OVER w AS ps, lag(u) OVER w AS pu FROM m WHERE {FAILED} WINDOW w AS
    (PARTITION BY session, agent, tool, target ORDER BY aseq)),
  i AS (SELECT *, coalesce(aseq - pa > 40 OR start_ns - ps > 1800000000000, FALSE) AS cut FROM l),
  c AS (SELECT *, sum(cut::INT) OVER (PARTITION BY session, agent, tool, target ORDER BY aseq) AS chain FROM i),
  g AS (SELECT session, agent, tool, target, chain, count(*) AS n, max(aseq) AS last, max(start_ns) AS last_ns,
    bool_or(NOT cut AND coalesce(u - 1 > pu, FALSE)) AS unsure FROM c GROUP BY ALL HAVING count(*) >= 3),
  s AS (SELECT *, (SELECT min(o.aseq) FROM hooked o WHERE o.session = g.session AND o.agent = g.agent AND o.tool = g.tool
    AND o.target = g.target AND o.status = 'success' AND o.aseq > g.last) AS ok FROM g),
  r AS (SELECT s.*, coalesce(s.ok - s.last <= 40 AND o.start_ns - s.last_ns <= 1800000000000, FALSE) AS back FROM s LEFT
    JOIN hooked o ON o.session = s.session AND o.agent = s.agent AND o.aseq = s.ok)
  SELECT 'B', session, agent, target, n, CASE WHEN back THEN 'transient_recovered' ELSE 'persistent' END, CASE WHEN back
    THEN 'low' WHEN unsure THEN 'medium' ELSE 'high' END FROM r),
C AS (WITH RECURSIVE o AS (SELECT *, coalesce(lag(agent) OVER w <> agent, TRUE) OR coalesce(start_ns - lag(end_ns) OVER w <
    2000000000, FALSE) AS switched FROM hooked WINDOW w AS (PARTITION BY session ORDER BY seq)),
  r AS (SELECT session, seq, agent, category, seq AS first_seq, [target] AS targets FROM o WHERE seq = 0
  UNION ALL SELECT o.session, o.seq, o.agent, o.category, CASE WHEN NOT o.switched AND o.category = r.category AND NOT
    list_contains(r.targets, o.target) THEN r.first_seq ELSE o.seq END, CASE WHEN NOT o.switched AND o.category =
    r.category AND NOT list_contains(r.targets, o.target) THEN list_append(r.targets, o.target) ELSE [o.target] END
    FROM r JOIN o ON o.session = r.session AND o.seq = r.seq + 1)
  SELECT 'C', session, agent, NULL, count(*), NULL, NULL FROM r WHERE {_KIND} GROUP BY session, agent, first_seq HAVING
    count(*) >= 3),
D AS (SELECT 'D', session, agent, gram, uses, NULL, NULL FROM ({_MINED.replace("FROM calls", "FROM hooked")})),
E AS (SELECT 'E', session, agent, host, count(*), 'ssh', CASE WHEN EXISTS (SELECT 1 FROM hooked s WHERE s.session = c.session
    AND s.server = 'cluster0') THEN 'high' WHEN count(*) >= 6 OR bool_or(status = 'error') THEN 'medium' ELSE 'low' END
  FROM hooked c WHERE host IS NOT NULL GROUP BY session, agent, host HAVING count(*) >= 3),
F AS (WITH p AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ',
    'g'))) AS p FROM documents),
  t AS (SELECT p, list(doc_id ORDER BY doc_id) AS messages FROM p WHERE length(p) >= 80 GROUP BY p HAVING count(*) >= 2)
  SELECT 'F', NULL, NULL, NULL, len(messages), NULL, NULL FROM t GROUP BY messages),
G AS (SELECT 'G', session, agent, tool, calls, kind, confidence FROM ({_HOOK_G}) WHERE kind IS NOT NULL)
SELECT rule, session, agent, subject, n::BIGINT AS n, kind, confidence FROM (SELECT * FROM A UNION ALL SELECT * FROM B UNION
  ALL SELECT * FROM C UNION ALL SELECT * FROM D UNION ALL SELECT * FROM E UNION ALL SELECT * FROM F UNION ALL SELECT * FROM
  G)"""


#: Rule D over all calls of an agent, and all its patterns.
_ALL_MINED = _MINED.replace(" WHERE back <= 2000", "").replace(" WHERE place <= 10", "")
_ALL_FINDINGS = _FINDINGS.replace(_MINED.replace("FROM calls", "FROM hooked"), _ALL_MINED.replace("FROM calls", "FROM hooked"))


@query("findings_from_logs", _ALL_FINDINGS, ("ev",))
def findings_from_logs(f: Frames) -> DataFrame:
    """From payload lines to the findings of all seven rules: lines are written as text, read, masked and told apart, paired
    into calls, and analysed, recurring sequences among all calls of an agent. The SQL computes the same calls from the
    tables, and the rules over them."""
    payloads, events = _read(f)
    return observe.findings(
        observe.from_hooks(events), observe.inputs_of(events), logs.hook_prompts(payloads), last_calls=None, top=None
    )


@query("findings_of_batches", _FINDINGS.replace("SELECT * FROM F UNION", "SELECT * FROM F WHERE FALSE UNION"), ("ev",))
def findings_of_batches(f: Frames) -> DataFrame:
    """The same lines as a stream of at least three batches, each bringing a part of every session: after each, the sessions
    it touched are analysed again and published. In the end the findings are those of all lines at once. Repeated guidance
    is no finding of a session, and left out."""
    folder = f"{shared_folder(f.spark)}/loomtrace/followed-{uuid.uuid4().hex}"
    # two lines an event, and more; as many files a batch as its lines need
    n = 2 * f.table("events").count() + f.table("documents").count()
    files = -(-n // (3 * LINES_PER_FILE)) or 1
    part = F.pmod(F.xxhash64("value"), F.lit(3 * files)).cast("int")
    _payload_lines(f).repartitionById(3 * files, part).write.option("compression", "gzip").text(f"{folder}/lines")
    lines = f.spark.readStream.option("maxFilesPerTrigger", files).text(f"{folder}/lines")
    analysis.follow(lines, f"{folder}/project", CLIENT, f"{folder}/checkpoint")
    found = analysis.findings(f.spark, f"{folder}/project")
    return found.select(
        "rule", F.concat_ws("/", "client", "session_id").alias("session"), "agent", "subject", "n", "kind", "confidence"
    )


@query(
    "verdicts_from_logs",
    f"WITH {_HOOK_CALLS.strip()}\nSELECT session, agent, tool, target, calls, round_trips, "
    + ", ".join(f"n_{r}" for r in repeats.REASONS)
    + f", v_useful, v_no_gain, v_explained_no_gain, v_unknown, same, known, phase_changes, periodic, verdict, kind, "
    f"confidence FROM ({_HOOK_G})",
    ("ev",),
)
def verdicts_from_logs(f: Frames) -> DataFrame:
    """Repeated calls of payload lines, with the phases that their results tell."""
    _, events = _read(f)
    found = repeats.verdicts(stored(observe.from_hooks(events), "observed-calls"), observe.inputs_of(events))
    return found.drop("params", "median_s", "min_s", "max_s", "cv", "wait_tool")
