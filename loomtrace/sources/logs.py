"""Readers of activity logs: hook payloads, session transcripts, rollout logs, usage lines. JSON Lines in, frames out.

Lines keep their number in the file although files are read in splits: rows of a split are in order, and the splits before
it are counted first.  Nothing is inferred; a line that is not a JSON object is counted, never fatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import results, shell, text, tools
from .stored import stored

# The longest target that is kept, and the form and place of an exit code in plain output.
MAX_TARGET, EXIT_TAIL = 2_000, 400
EXIT_LINE = r"(?im)^\s*(?:process\s+)?exit(?:ed)?(?:\s+with)?(?:\s+code)?\s*[:=]?\s*(-?\d+)\s*$"
#: Splits up to which their table is broadcast (it has one small row per split of the input).
MAX_SPLITS = 100_000


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (from 1), value of text files."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at")]
    rows = spark.read.text(path).select(*meta, F.monotonically_increasing_id().alias("_id"), "value")
    # a split's lines lie in one task, in order: one row per split says where it begins and how many lines are before it
    splits = rows.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    splits = stored(splits.select("file", "_at", "_first", F.coalesce(before, F.lit(0)).alias("_before")), "splits")
    if splits.count() <= MAX_SPLITS:
        splits = F.broadcast(splits)
    line = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return rows.join(splits, ["file", "_at"]).select("file", line.cast("long").alias("line"), "value")


def is_object(value: Column) -> Column:
    return F.coalesce(F.trim(value).startswith("{") & F.try_parse_json(value).isNotNull(), F.lit(False))


def at(path: str, value: str = "value") -> Column:
    return F.get_json_object(value, f"$.{path}")


def captured(rows: DataFrame) -> DataFrame:
    """Lines of a capture, {"received_ns": ..., "payload": {...}}, as ns and value, the payload's text. A line without
    payload is one itself, without an instant of its own."""
    payload = F.get_json_object("value", "$.payload")
    return rows.select(
        *[c for c in rows.columns if c != "value"],
        at("received_ns").try_cast("long").alias("ns"),
        F.coalesce(payload, F.col("value")).alias("value"),
    )


#: What is read of a payload, parsed once; all values as text, whatever they are.
_HOOK = ", ".join(
    f"{x} string"
    for x in (
        "hook_event_name", "session_id", "turn_id", "prompt_id", "agent_id", "agent_type", "tool_use_id", "tool_name",
        "tool_input", "tool_response", "cwd", "error", "is_interrupt", "duration_ms", "timestamp",
    )
)


def hook_events(payloads: DataFrame, client: str, key: str = "", home: str | None = None) -> DataFrame:
    """Hook payloads (value: JSON text; ns: when it came, where known, else what the payload's own timestamp says) as
    events. The id is a hash of client, instant and payload, so reading again adds nothing.

    Commands, targets, errors and parameters are masked before anything is kept: secrets stand as keyed fingerprints
    (`key`), the `home` folder as ~. Of results, fingerprints of content and state and the phase they tell are kept, never
    their text.
    """
    good = payloads.filter(is_object(F.col("value"))).withColumn("_j", F.from_json("value", _HOOK))
    good = good.withColumn("_input", F.from_json("_j.tool_input", "map<string,string>"))
    at = lambda field: F.col(f"_j.{field}")
    tool, response = at("tool_name"), at("tool_response")
    command = F.col("_input")["command"]

    def masked(value: Column) -> Column:
        out = text.mark_secrets(value, key)
        return text.mask_home(out, home) if home else out

    is_text = F.col("value").rlike(r'(?<!\\)"tool_response"\s*:\s*"')
    named = [
        F.nullif(F.trim(F.col("_input")[k]), F.lit(""))
        for k in ("file_path", "path", "notebook_path", "url", "pattern")
    ]
    # a client that hands out plain text may state an exit code in a line of its own at the end
    plain = F.when(
        ~F.coalesce(response.startswith("{"), F.lit(False)),
        F.regexp_extract(F.substring(response, -EXIT_TAIL, EXIT_TAIL), EXIT_LINE, 1),
    )
    came = [F.col("ns").cast("string")] if "ns" in good.columns else []
    rows = good.select(
        F.sha2(F.concat_ws("|", F.lit(client), *came, "value"), 256).alias("event_id"),
        F.lit(client).alias("client"),
        (F.coalesce("ns", tools.iso_to_ns(at("timestamp"))) if "ns" in good.columns else tools.iso_to_ns(at("timestamp")))
        .alias("ns"),
        at("session_id").alias("session_id"),
        F.coalesce(at("turn_id"), at("prompt_id")).alias("turn_id"),
        at("agent_id").alias("agent_id"),
        at("agent_type").alias("agent_type"),
        at("tool_use_id").alias("call_id"),
        tools.phase(at("hook_event_name")).alias("phase"),
        tool.alias("tool_name"),
        F.when(tool.isNotNull(), tools.category(F.lit(client), tool)).alias("tool_category"),
        tools.server(tool).alias("mcp_server"),
        tools.server_tool(tool).alias("mcp_tool"),
        F.transform_values(
            tools.pick_params(
                F.col("_input"), tools.clear_parameters(client, tool)
            ),
            lambda k, v: masked(v),
        ).alias("params"),
        F.substring(F.sha2(F.concat_ws("|", F.lit(key), tool, at("tool_input")), 256), 1, 16).alias("input_fp"),
        at("cwd").alias("cwd"),
        F.coalesce(*named).alias("_named"),
        command.alias("_command"),
        shell.parsed(command).alias("_parts"),
        response.alias("_response"),
        F.when(response.isNotNull(), tools.ending(response)).alias("_ending"),
        is_text.alias("_is_text"),
        plain.alias("_plain"),
        at("error").alias("_error"),
        (at("is_interrupt") == "true").alias("_interrupt"),
        at("duration_ms").try_cast("long").alias("duration_ms"),
    )
    code = F.coalesce("_ending.exit_code", F.nullif("_plain", F.lit("")).try_cast("int"))
    by_code = F.when(F.col("_plain") != "", F.when(code == 0, "success").otherwise("error"))
    ended = F.col("phase") == "end"
    status = F.when(F.col("phase") == "failure", results.failure_status(F.col("_error"), F.col("_interrupt"))).when(
        ended, F.coalesce(by_code, F.col("_ending.status"))
    )
    has_command = F.col("_command").isNotNull()
    rows = rows.withColumns({
        "exit_code": code,
        "status": status,
        "effect": F.when(has_command, shell.kind_of(F.col("_parts"))),
        "_heads": F.coalesce(shell.heads_of(F.col("_parts")), F.array().cast("array<string>")),
        "_text": F.when(ended, results.primary_text(F.col("_response"), F.col("_is_text"))),
    })
    kind = results.facts_kind(F.col("tool_category"), F.col("tool_name"), F.col("_heads"), F.col("effect"))
    # what a result is read from: its main text, the whole of it without one, or the error of a failed call
    told = F.when(F.col("phase") == "failure", F.col("_error")).otherwise(F.coalesce("_text", "_response"))
    rows = rows.withColumns({"_kind": kind, "_told": told})
    waits = F.lower("tool_name").rlike("|".join(results.WAIT_TOOLS))
    told_of = F.col("phase").isin("end", "failure") & F.col("tool_name").isNotNull()
    hint = F.when((F.col("tool_category") == "mcp") & (F.col("status") == "success"), results.hidden_error(F.col("_text")))
    tail = F.when(F.col("status") == "error", F.substring("_text", -EXIT_TAIL, EXIT_TAIL))
    target = F.substring(masked(F.coalesce("_named", "_command")), 1, MAX_TARGET)
    return rows.select(
        "event_id", "client", "ns", "session_id", "turn_id", "agent_id", "agent_type", "call_id", "phase", "tool_name",
        "tool_category", "mcp_server", "mcp_tool", "params", "input_fp", "cwd",
        target.alias("target"),
        F.when(has_command, "command").when(F.col("_named").isNotNull(), "path").alias("target_kind"),
        F.substring(masked(F.col("_command")), 1, MAX_TARGET).alias("command"),
        "effect", "status", "exit_code",
        F.substring(masked(F.coalesce("_error", hint, tail)), 1, MAX_TARGET).alias("error_summary"),
        "duration_ms",
        F.octet_length("_response").cast("long").alias("output_size_bytes"),
        F.when(
            ended & F.col("tool_category").isin("read", "search", "list", "shell", "mcp"),
            results.content_fingerprint(F.col("_text")),
        ).alias("content_fp"),
        F.when(
            told_of & F.col("_kind").isin("status", "run"), results.state_fingerprint(F.coalesce("_told", F.lit("")))
        ).alias("state_fp"),
        F.when(told_of, results.phase(F.col("_told"), F.col("status"), waits=waits, kind=F.col("_kind"))).alias(
            "result_phase"
        ),
        F.when(ended, F.get_json_object("_told", "$.timed_out") == "true").alias("timed_out"),
    )


def hook_prompts(payloads: DataFrame) -> DataFrame:
    """The texts of the prompts in payloads (message: the payload's hash, text), for the one rule that reads them; no event
    keeps them."""
    good = payloads.filter(is_object(F.col("value"))).filter(at("hook_event_name") == "UserPromptSubmit")
    prompt = F.coalesce(at("user_input"), at("prompt"))
    return good.select(F.sha2("value", 256).alias("message"), prompt.alias("text")).filter("text IS NOT NULL")


def rejected(payloads: DataFrame) -> DataFrame:
    """Lines that hold no JSON object, with the reason."""
    return payloads.filter(~is_object(F.col("value"))).select(
        "*", F.when(F.try_parse_json("value").isNull(), "invalid_json").otherwise("not_an_object").alias("reason")
    )


USAGE = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")


def transcript_requests(rows: DataFrame) -> DataFrame:
    """One row per request of transcripts (file, line, value): first and last line, calls emitted, results consumed, usage.

    A result belongs to the request of the next assistant line behind it, one that exists already included; lines of the
    client itself (model <synthetic>) are skipped. A usage value counts if all lines of the request agree on it.
    """
    kind = at("type")
    parsed = rows.filter(is_object(F.col("value"))).select(
        "file",
        "line",
        kind.alias("kind"),
        F.when(
            (kind == "assistant") & F.coalesce(at("message.model") != "<synthetic>", F.lit(True)),
            F.coalesce(at("requestId"), at("message.id"), at("uuid")),
        ).alias("rid"),
        at("message.model").alias("model"),
        F.from_json(at("message.content"), "array<struct<type:string,id:string,name:string,tool_use_id:string>>").alias(
            "blocks"
        ),
        *[at(f"message.usage.{k}").try_cast("long").alias(k) for k in USAGE],
    )
    ahead = Window.partitionBy("file").orderBy("line").rowsBetween(0, Window.unboundedFollowing)
    owned = parsed.withColumn("owner", F.first("rid", ignorenulls=True).over(ahead)).filter("owner IS NOT NULL")
    of = lambda t, field: F.transform(
        F.filter("blocks", lambda b: (b["type"] == t) & b[field].isNotNull()), lambda b: b[field]
    )
    rows = owned.withColumn("_uses", F.when(F.col("rid").isNotNull(), of("tool_use", "id"))).withColumn(
        "_results", F.when(F.col("kind") == "user", of("tool_result", "tool_use_id"))
    )
    mine = F.col("rid").isNotNull()
    agreed = lambda c: F.when(F.count_distinct(c) == 1, F.max(c)).alias(c)
    return rows.groupBy("file", F.col("owner").alias("request_id")).agg(
        F.min(F.when(mine, F.col("line"))).alias("first_line"),
        F.max(F.when(mine, F.col("line"))).alias("last_line"),
        F.max("model").alias("model"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_uses")))).alias("tool_uses"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_results")))).alias("consumed"),
        *[agreed(c) for c in USAGE],
    )


def attributed(requests: DataFrame) -> DataFrame:
    """Per call: the request that emitted it and the one that consumed its result, with the tokens of each divided by how
    many calls share it (rounded down)."""
    emit = requests.filter(F.size("tool_uses") > 0).select(
        "file",
        F.explode("tool_uses").alias("call_id"),
        F.col("request_id").alias("emitter"),
        F.expr("output_tokens div size(tool_uses)").alias("output_share"),
    )
    take = requests.filter(F.size("consumed") > 0).select(
        "file",
        F.explode("consumed").alias("call_id"),
        F.col("request_id").alias("consumer"),
        F.expr("(input_tokens + cache_creation_input_tokens) div size(consumed)").alias("input_share"),
    )
    return emit.join(take, ["file", "call_id"], "full")


def rollout_events(rows: DataFrame) -> DataFrame:
    """Lines of rollout logs as events: calls (function_call and its output, completed items), usage, turns, compactions.
    What has no meaning here is kept as phase `uninterpreted`, so that it can be counted."""
    kind, sub = at("type"), at("payload.type")
    item = at("payload.item.type")
    phase = (
        F.when((kind == "response_item") & sub.isin("function_call", "custom_tool_call"), "start")
        .when((kind == "response_item") & sub.isin("function_call_output", "custom_tool_call_output"), "end")
        .when((kind == "response_item") & sub.isin("message", "agent_message"), "message")
        .when((kind == "response_item") & (sub == "reasoning"), "activity")
        .when(kind == "token_usage_record", "usage")
        .when(
            (kind == "event_msg") & (sub == "item_completed") & item.isin(
                "CommandExecution", "McpToolCall", "FileChange", "WebSearch", "ImageView"
            ),
            "end",
        )
        .when((kind == "event_msg") & (sub == "task_started"), "turn_start")
        .when((kind == "event_msg") & sub.isin("task_complete", "turn_aborted"), "turn_end")
        .when(kind == "compacted", "compact_end")
        .when(kind == "session_meta", "session_start")
        .when(kind.isin("turn_context", "world_state"), "activity")
        .otherwise("uninterpreted")
    )
    good = rows.filter(is_object(F.col("value")))
    usage = lambda k: at(f"payload.usage.{k}").try_cast("long").alias(k)
    code = at("payload.item.exit_code").try_cast("int")
    span = at("payload.item.duration.secs").try_cast("long") * 1_000 + F.expr(
        "get_json_object(value, '$.payload.item.duration.nanos')"
    ).try_cast("long") / 1_000_000
    return good.select(
        F.sha2(F.concat_ws("|", "file", F.col("line").cast("string")), 256).alias("event_id"),
        "file",
        "line",
        tools.iso_to_ns(at("timestamp")).alias("ns"),
        phase.alias("phase"),
        F.coalesce(at("payload.call_id"), at("payload.item.id"), at("payload.response_id")).alias("call_id"),
        F.coalesce(at("payload.name"), at("payload.item.tool"), item).alias("tool_name"),
        at("payload.item.server").alias("mcp_server"),
        F.when(code == 0, "success").when(code.isNotNull(), "error").when(
            at("payload.item.status") == "completed", "success"
        ).when(at("payload.item.status") == "failed", "error").alias("status"),
        code.alias("exit_code"),
        F.floor(span).cast("long").alias("duration_ms"),
        usage("input_tokens"),
        usage("cached_input_tokens"),
        usage("output_tokens"),
        usage("total_tokens"),
    )


def usage_lines(rows: DataFrame) -> DataFrame:
    """Generic usage lines; rows without client, session or source are left out; without a call they concern the session."""
    names = ("client", "session_id", "scope", "tool_use_id", "model", "source")
    u = rows.filter(is_object(F.col("value"))).select(
        *[at(n).alias(n) for n in names],
        *[
            at(n).try_cast("long").alias(n)
            for n in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
        ],
    )
    ok = u.filter("client IS NOT NULL AND session_id IS NOT NULL AND source IS NOT NULL")
    return ok.withColumn("phase", F.when(F.col("tool_use_id").isNull(), "usage").otherwise("observation"))


def problems(events: DataFrame) -> DataFrame:
    """events with the list of what makes a row invalid (empty: valid)."""
    required = ("event_id", "client", "session_id", "phase")
    return events.withColumn(
        "problems", F.array_compact(F.array(*[F.when(F.col(c).isNull(), f"missing {c}") for c in required]))
    )
