"""From events of logs to the calls that all analyses take, and the findings of all rules on them.

Calls have session (client and session id), agent (`main` where none is named), call_id, tool, category (writes count as
edits), server, server_tool, target, params (parameters without delays, as text), command, cwd, status, start_ns, end_ns,
duration_ms, bytes, content_fp, state_fp, result_phase, timed_out, delay, effect, op, epoch, seq (in the session), aseq (of
the agent), emitter (response that made it, null where logs do not tell), duplicate_phases, orphan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intents, results, shell, tools
from ..functions import text as texts_of
from ..sources import rollouts
from ..sources.stored import dealt, stored
from . import detectors, repeats
from .messages import repeated_guidance
from .windows import placed

ENDS = ("end", "failure")
#: What an end tells of its call, besides its instant.
_RESULT = (
    "status", "duration_ms", "output_size_bytes", "content_fp", "state_fp", "result_phase", "timed_out", "exit_code",
    "error_summary",
)
_INPUT = ("tool_name", "tool_category", "mcp_server", "mcp_tool", "target", "command", "cwd", "params", "effect")


def with_ids(events: DataFrame) -> DataFrame:
    """Events of calls, those without a call_id with one made up: an end belongs to the start of the same agent, tool and
    input that was opened last and is still open. Like brackets: both lie at one depth, as the same occurrence there."""
    by = ["session", "agent", "tool_name", "input_fp"]
    none = events.filter("call_id IS NULL")
    is_end = F.col("phase").isin(*ENDS).cast("int")
    w = Window.partitionBy(*by).orderBy("ns", is_end, "event_id")
    deep = none.withColumns({"_end": is_end, "_open": F.sum(1 - 2 * is_end).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    # ends without a start lower the ground on which later starts stand; they alone lie at depth 0
    ground = F.least(F.lit(0), F.min("_open").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    deep = deep.withColumn("_depth", F.col("_open") + F.col("_end") - ground).drop("_open")
    nth = F.row_number().over(Window.partitionBy(*by, "_depth", "_end").orderBy("ns", "event_id"))
    made = F.concat(F.lit("~"), F.sha2(F.concat_ws("|", *by[2:], F.col("_depth").cast("string"), nth.cast("string")), 256))
    told = events.filter("call_id IS NOT NULL")
    return told.unionByName(deep.withColumn("call_id", made).drop("_end", "_depth"))


MARKS = ("compact_end", "session_start")


def _paired(rows: DataFrame) -> DataFrame:
    """One row per (session, agent, _mark, call_id) of events, each of which counts once. Rows are looked at as they lie, so
    they must be dealt by session and agent, or by more."""
    key = ["session", "agent", "_mark", "call_id"]
    before = F.lag("event_id").over(Window.partitionBy(*key).orderBy("event_id"))
    once = rows.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col("event_id")))
    is_end, is_start = F.col("phase").isin(*ENDS), F.col("phase") == "start"
    # hooks give the same input with a call's start and its end; an instant that is not known comes last
    order = F.struct(F.col("ns").isNull(), "ns", "event_id")
    least = lambda cond, *columns: F.min_by(F.struct(*columns), F.when(cond, order))
    return once.groupBy(*key).agg(
        F.min_by(F.struct("phase", "ns", *_INPUT), F.struct(is_end, order)).alias("i"),
        least(is_start, "ns").alias("s"),
        least(is_end, "ns", *_RESULT).alias("e"),
        F.count_if(is_start).alias("_starts"),
        F.count_if(is_end).alias("_ends"),
    )


def from_hooks(events: DataFrame) -> DataFrame:
    """Calls from hook events (logs.hook_events). An event counts once, however often it was recorded. A call's first start
    and first end count, further ones are counted; without an end it is open, without a start an orphan.

    Events are shuffled once, by agent, to leave out copies, to pair, and to number an agent's calls beside its marks
    (compactions, starts of the session), which are rows of the same frame.
    """
    # ids are hashes: their bytes order them as their digits do
    short = F.when(F.col("event_id").rlike("^[0-9a-f]{64}$"), F.unhex("event_id")).otherwise(F.col("event_id").cast("binary"))
    is_mark = F.col("phase").isin(*MARKS)
    acts = events.filter(F.col("phase").isin("start", *ENDS, *MARKS)).select(
        F.concat_ws("/", "client", "session_id").alias("session"), F.coalesce("agent_id", F.lit("main")).alias("agent"),
        is_mark.alias("_mark"), F.when(is_mark, F.col("event_id")).otherwise(F.col("call_id")).alias("call_id"),
        short.alias("event_id"), "phase", "ns", "input_fp", *_INPUT, *_RESULT,
    ).filter("NOT _mark OR ns IS NOT NULL")
    n = events.count()
    pairs = _paired(dealt(acts.filter("call_id IS NOT NULL").drop("input_fp"), n, "session", "agent"))
    nameless = acts.filter("call_id IS NULL")
    if not nameless.isEmpty():
        # the ids that are made are like no other
        made = with_ids(dealt(nameless, n, "session", "agent").dropDuplicates(["session", "agent", "event_id"]))
        pairs = dealt(pairs.unionByName(_paired(made)), n, "session", "agent")
    span = F.floor((F.col("e.ns") - F.col("s.ns")) / 1_000_000)
    rows = pairs.select(
        "session", "agent", "_mark", "call_id",
        F.when(F.col("_mark"), F.col("i.phase")).alias("_phase"),
        F.when(F.col("_mark"), F.col("i.ns")).otherwise(F.coalesce("s.ns", "e.ns")).alias("start_ns"),
        F.col("i.tool_name").alias("tool"),
        F.when(F.col("i.tool_category") == "write", "edit").otherwise(F.col("i.tool_category")).alias("category"),
        F.col("i.mcp_server").alias("server"), F.col("i.mcp_tool").alias("server_tool"),
        "i.target", F.col("i.params").alias("_params"), "i.command", "i.cwd",
        F.when(F.col("_ends") == 0, "open").otherwise(F.col("e.status")).alias("status"),
        F.col("e.ns").alias("end_ns"),
        F.coalesce("e.duration_ms", F.greatest(span, F.lit(0))).cast("long").alias("duration_ms"),
        F.col("e.output_size_bytes").alias("bytes"),
        "e.content_fp", "e.state_fp", "e.result_phase", "e.timed_out", "i.effect",
        F.lit(None).cast("string").alias("emitter"),
        (F.greatest(F.col("_starts") - 1, F.lit(0)) + F.greatest(F.col("_ends") - 1, F.lit(0))).alias("duplicate_phases"),
        (F.col("_starts") == 0).alias("orphan"),
    )
    so_far = Window.partitionBy("session", "agent").orderBy("start_ns", F.desc("_mark"), "call_id").rowsBetween(
        Window.unboundedPreceding, 0
    )
    numbered = rows.withColumns({
        "_cuts": F.count_if(F.col("_phase") == "compact_end").over(so_far),
        "_begun": F.count_if(F.col("_phase") == "session_start").over(so_far),
        "aseq": F.count_if(~F.col("_mark")).over(so_far) - 1,
    }).filter("NOT _mark")
    numbered = numbered.withColumns({
        "epoch": F.col("_cuts") + F.greatest(F.col("_begun") - 1, F.lit(0)),
        "params": tools.comparison_key(F.col("_params")),
        "delay": tools.requested_delay(F.col("_params")),
    }).drop("_mark", "_phase", "_params", "_cuts", "_begun")
    # three readers follow: distinct commands, the calls, and their numbers by stretch of time
    calls = stored(numbered, "paired-calls", "zstd")
    return placed(with_op(calls), ["session"], "start_ns", ["agent", "call_id"], sizes_of=calls)


#: What is read of a rollout line beside its role; all values as text, whatever they are.
_GIVEN = (
    "type string, timestamp string, payload struct<type: string, arguments: string, input: string, output: string, "
    "item: struct<command: string, arguments: string, path: string, query: string, changes: string, "
    "aggregated_output: string, output: string, result: string>>"
)


def _rollout_facts(rows: DataFrame, key: str) -> DataFrame:
    """file, line, given (a call's input as JSON text), command, path, told (its output): masked but for told."""
    j = rows.select("file", "line", F.from_json("value", _GIVEN).alias("j"))
    at = lambda x: F.col(f"j.payload.{x}")
    given = F.coalesce(at("arguments"), at("item.arguments"))
    words = lambda c: F.coalesce(
        F.when(c.startswith("["), F.array_join(F.from_json(c, "array<string>"), " ")), c
    )
    asked = F.from_json(given, "command string, cmd string, path string, file_path string")
    rows = j.select(
        "file", "line", "j", given.alias("given"), asked.alias("asked"),
        F.coalesce(at("output"), at("item.aggregated_output"), at("item.output"), at("item.result")).alias("answer"),
    )
    patched = F.try_element_at(texts_of.patch_paths(F.coalesce(at("input"), F.col("given"))), F.lit(1))
    first_change = F.try_element_at(F.map_keys(F.from_json(at("item.changes"), "map<string,string>")), F.lit(1))
    mark = lambda c: texts_of.mark_secrets(c, key)
    is_text = ~F.coalesce(F.col("answer").rlike(r"^\s*[{\[]"), F.lit(False))
    out = rows.select(
        "file", "line", F.coalesce("given", at("input")).alias("given"),
        mark(words(F.coalesce(at("item.command"), "asked.command", "asked.cmd"))).alias("command"),
        mark(F.coalesce(patched, first_change, at("item.path"), at("item.query"), "asked.path", "asked.file_path")).alias("path"),
        F.coalesce(results.primary_text(F.col("answer"), is_text), "answer").alias("told"),
    )
    known = F.coalesce("given", "command", "path", "told").isNotNull()
    return out.filter(known)


def from_rollouts(rows: DataFrame, roots: DataFrame | None = None, client: str = "codex", key: str = "") -> DataFrame:
    """Calls from the lines of rollout logs (file, line, value): the session is the log's root (roots: file, root; the log
    itself where none is known), the agent the log. Scripts stand for what ran in them and are no calls of their own."""
    known = rollouts.parsed(rows)
    facts = stored(_rollout_facts(rows, key), "rollout-facts")
    made = rollouts.calls(known).filter("made_as <> 'script'")
    given = facts.select("file", F.col("line").alias("start_line"), "given", "command", "path")
    told = facts.select("file", F.col("line").alias("end_line"), "told")
    met = made.join(given, ["file", "start_line"], "left").join(told, ["file", "end_line"], "left")
    category = tools.category(F.lit(client), F.col("tool"))
    met = met.withColumns({
        "category": F.when(category == "write", "edit").otherwise(category),
        "parts": shell.parsed(F.col("command")),
    })
    met = met.withColumns({
        "effect": F.when(F.col("category") == "shell", shell.kind_of(F.col("parts"))),
        "heads": F.coalesce(shell.heads_of(F.col("parts")), F.array().cast("array<string>")),
        "ended": F.col("status") != "open",
    })
    kind = results.facts_kind(F.col("category"), F.col("tool"), F.col("heads"), F.col("effect"))
    met = met.withColumn("kind", kind)
    waits = F.lower("tool").rlike("|".join(results.WAIT_TOOLS))
    text = F.col("told")
    params = tools.pick_params(F.from_json("given", "map<string,string>"), tools.clear_parameters(client, F.col("tool")))
    plain_input = F.when(F.from_json("given", "map<string,string>").isNull(), F.substring(F.sha2("given", 256), 1, 16))
    masked = F.transform_values(params, lambda k, v: texts_of.mark_secrets(v, key))
    calls = met.select(
        F.col("file"), F.lit(None).cast("string").alias("_"),
        "call_id", "tool", "category",
        tools.server(F.col("tool")).alias("server"), tools.server_tool(F.col("tool")).alias("server_tool"),
        F.when(F.col("category") == "shell", F.col("command")).otherwise(F.col("path")).alias("target"),
        F.coalesce(tools.comparison_key(masked), plain_input, F.lit("{}")).alias("params"),
        "command", F.lit(None).cast("string").alias("cwd"), "status", "start_ns",
        F.when(F.col("ended"), F.col("end_ns")).alias("end_ns"), F.when(F.col("ended"), F.col("duration_ms")).alias("duration_ms"),
        F.when(F.col("ended"), F.octet_length("told")).cast("long").alias("bytes"),
        F.when(
            F.col("ended") & F.col("category").isin("read", "search", "list", "shell", "mcp"), results.content_fingerprint(text)
        ).alias("content_fp"),
        F.when(
            F.col("ended") & F.col("kind").isin("status", "run"), results.state_fingerprint(F.coalesce(text, F.lit("")))
        ).alias("state_fp"),
        F.when(F.col("ended"), results.phase(text, F.col("status"), waits=waits, kind=F.col("kind"))).alias("result_phase"),
        "timed_out", tools.requested_delay(params).alias("delay"), "effect", "emitter",
        F.lit(0).cast("long").alias("duplicate_phases"), F.lit(False).alias("orphan"),
    ).drop("_")
    marks = rows.select("file", F.from_json("value", "type string, timestamp string").alias("j")).filter("j.type = 'compacted'")
    marks = marks.select("file", F.lit("compact_end").alias("phase"), tools.iso_to_ns(F.col("j.timestamp")).alias("ns"))

    def of_root(frame: DataFrame) -> DataFrame:
        if roots is None:
            return frame.withColumns({"session": F.col("file"), "agent": F.lit("main")}).drop("file")
        rooted = frame.join(roots.select("file", "root"), "file", "left")
        return rooted.withColumns({"session": F.coalesce("root", "file"), "agent": F.col("file")}).drop("file", "root")

    return ordered(with_op(of_root(calls)), of_root(marks))


def with_op(calls: DataFrame) -> DataFrame:
    """calls with the operation (op) that their tool or shell command stands for; each distinct command is parsed once."""
    said = calls.filter("category = 'shell' AND command IS NOT NULL").select("command", "cwd").distinct()
    said = said.select(
        "command", "cwd", F.lit("shell").alias("category"), F.lit("Bash").alias("tool"), F.col("command").alias("target"),
        F.lit("").alias("params"), F.lit(None).cast("string").alias("server_tool"), F.col("cwd").alias("project"),
    )
    known = intents.with_intent(said).select(F.col("command").alias("_c"), F.col("cwd").alias("_d"), F.col("op").alias("_o"))
    on = (calls["command"] == known["_c"]) & calls["cwd"].eqNullSafe(known["_d"]) & (calls["category"] == "shell")
    reads = intents.reads_by_name(F.col("server_tool"))
    by_tool = F.when(F.col("category") == "mcp", F.when(reads, "mcp_read").otherwise("mcp")).when(
        F.col("category").isin("read", "search", "list", "edit", "agent", "web", "other"), F.col("category")
    )
    return calls.join(known, on, "left").withColumn("op", F.coalesce("_o", by_tool, F.lit("unknown"))).drop(
        "_c", "_d", "_o"
    )


def ordered(calls: DataFrame, marks: DataFrame) -> DataFrame:
    """calls with epoch (compactions, and starts of the session but the first, of the agent so far), seq and aseq. marks:
    session, agent, phase, ns."""
    agent, tie = Window.partitionBy("session", "agent"), ["start_ns", "_call", "call_id"]
    marks = marks.filter(F.col("phase").isin("compact_end", "session_start") & F.col("ns").isNotNull())
    first = F.row_number().over(agent.orderBy("ns")) == 1
    starts = marks.filter("phase = 'session_start'").withColumn("_new", (~first).cast("int"))
    cuts = marks.filter("phase = 'compact_end'").withColumn("_new", F.lit(1)).unionByName(starts)
    cuts = cuts.select("session", "agent", F.col("ns").alias("start_ns"), "_new", F.lit(False).alias("_call"))
    every = calls.withColumns({"_new": F.lit(0), "_call": F.lit(True)}).unionByName(cuts, allowMissingColumns=True)
    so_far = agent.orderBy(*tie).rowsBetween(Window.unboundedPreceding, 0)
    numbered = every.withColumns({
        "epoch": F.sum("_new").over(so_far),
        "aseq": F.sum(F.col("_call").cast("long")).over(so_far) - 1,
    }).filter("_call").drop("_new", "_call")
    # the calls before a stretch of time are counted on the unnumbered calls, so that the windows above run once
    return placed(numbered, ["session"], "start_ns", ["agent", "call_id"], sizes_of=calls)


def inputs_of(events: DataFrame) -> DataFrame:
    """session, agent, ns of what an agent was told anew: prompts."""
    return events.filter("phase = 'turn_start'").dropDuplicates(["event_id"]).select(
        F.concat_ws("/", "client", "session_id").alias("session"), F.coalesce("agent_id", F.lit("main")).alias("agent"), "ns"
    )


#: Of each rule: the finding's size, and what tells its kind and confidence, where the rule has them.
_COLUMNS: dict[str, tuple[str, str | None, str | None]] = {
    "A": ("reads", None, "confidence"), "B": ("failures", "kind", "confidence"), "C": ("calls", None, None),
    "D": ("uses", None, None), "E": ("n", "family", "confidence"), "F": ("messages", None, None),
    "G": ("calls", "kind", "confidence"),
}


def findings(
    calls: DataFrame, inputs: DataFrame | None = None, texts: DataFrame | None = None, last_calls: int | None = 2_000,
    top: int | None = 10
) -> DataFrame:
    """rule, session, agent, subject (target, service, gram or tool), n (counted calls; of F, messages), kind, confidence of
    all rules on observed calls. The rule on hand-driven services looks at commands and the session's servers; the one on
    repeated guidance at texts (message, text), and knows neither session nor agent. Of repeated calls, those with a verdict
    that something could be better are findings. Recurring sequences are looked for among an agent's last calls, and the best
    of them kept (last_calls, top; None: all). The calls are written once, for all rules read them."""
    calls = stored(calls, "observed-calls", "zstd")
    n = calls.count()
    # a rule's windows by agent and more need no other shuffle then
    by_agent = dealt(calls, n, "session", "agent")
    servers = calls.filter("server IS NOT NULL").select("session", "server", F.col("server_tool").alias("tool")).distinct()
    made = {
        "A": detectors.read_clusters(by_agent),
        "B": detectors.failure_chains(by_agent),
        "C": detectors.batch_runs(by_agent),
        "D": detectors.mined_patterns(by_agent, top=top, last_calls=last_calls),
        "E": detectors.service_gap(calls, servers),
        "G": repeats.verdicts(calls, inputs, n_calls=n).filter("kind IS NOT NULL"),
    }
    subject = {"A": "target", "B": "target", "C": None, "D": "gram", "E": "target", "F": None, "G": "tool"}
    if texts is not None:
        named = {x: F.lit(None).cast("string") for x in ("session", "agent")}
        made["F"] = repeated_guidance(texts, "message", "text").withColumns(named)
    text = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    out = None
    for rule, found in sorted(made.items()):
        size, kind, confidence = _COLUMNS[rule]
        one = found.select(
            F.lit(rule).alias("rule"), "session", "agent", text(subject[rule]).alias("subject"),
            F.col(size).cast("long").alias("n"), text(kind).alias("kind"), text(confidence).alias("confidence"),
        )
        out = one if out is None else out.unionByName(one)
    return out
