"""Rollout logs read with what lies around each line: calls with their two ends, the script they ran in, the response that
emitted them and the one that read their output; shares of tokens; messages told twice; what was not interpreted.

What a reader line by line would hold as state is asked of the whole file by windows over its lines, grouping by call, and
joins by call and by stretches of lines, so files are split over tasks by call and stretch where they can be, and the same
lines give the same rows however often they are read. rows: file, line, value (see logs.lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tools
from ..operators.usage import split_exact
from .logs import at, is_object
from .stored import stored

# Types of items that are calls of tools, of lines with nothing to tell, heads of texts that a client puts
# into a user's message, and what an image weighs in characters.
TOOL_ITEMS = (
    "CommandExecution", "McpToolCall", "FileChange", "ImageView", "Extension", "WebSearch", "FunctionCallOutput"
)
KNOWN_ITEMS = (
    "CollabAgentToolCall", "SubAgentActivity", "Reasoning", "AgentMessage", "UserMessage", "ContextCompaction"
)
KNOWN_RESPONSES = (
    "function_call", "function_call_output", "custom_tool_call", "custom_tool_call_output", "message", "agent_message",
    "reasoning", "tool_search_call", "tool_search_output", "web_search_call", "image_generation_call",
)
KNOWN_EVENTS = (
    "task_started", "task_complete", "turn_aborted", "thread_settings_applied", "token_count", "item_completed"
)
KNOWN_LINES = (
    "session_meta", "world_state", "turn_context", "compacted", "token_usage_record", "event_msg", "response_item"
)
INJECTED_HEADS = ("<", "# agents.md instructions", "# agents.md")
IMAGE_WEIGHT = 6_000
#: Lines after which an item without a line of the same text counts as a message of its own.
MATCH_LINES = 10
#: Lines of a stretch, by which calls and the scripts around them are joined.
STRETCH = 1_000


_NAMED = ("type", "id", "name", "namespace", "status")
#: What is read of a line, parsed once; all values as text, whatever they are.
_LINE = (
    "type string, timestamp string, payload struct<"
    + ", ".join(
        f"{x}: string" for x in (*_NAMED, "call_id", "response_id", "output", "started_at_ms", "completed_at_ms")
    )
    + ", usage: struct<input_tokens: string, cached_input_tokens: string, output_tokens: string>, item: struct<"
    + ", ".join(f"{x}: string" for x in (*_NAMED, "server", "tool", "kind", "exit_code", "duration_ms"))
    + ", aggregated_output: string, results: string, output: string, result: struct<content: string>"
    + ", duration: struct<secs: string, nanos: string>>>"
)


def _lines(rows: DataFrame) -> DataFrame:
    """The facts of each line that the steps below share; lines that are no JSON objects have none."""
    # out of a list of one, so that a line is parsed once, not by the filter of roles as often as it names a field
    rows = rows.select("file", "line", F.explode_outer(F.array(F.from_json("value", _LINE))).alias("j"))
    at = lambda path: F.col(f"j.{path}")
    ms = lambda path: at(path).try_cast("long") * 1_000_000
    kind, sub, item = at("type"), at("payload.type"), at("payload.item.type")
    response, event = kind == "response_item", kind == "event_msg"
    role = (
        F.when(response & sub.isin("function_call", "tool_search_call"), "fn")
        .when(response & sub.isin("function_call_output", "tool_search_output"), "fn_out")
        .when(response & (sub == "custom_tool_call"), "exec")
        .when(response & (sub == "custom_tool_call_output"), "exec_out")
        .when(response & sub.isin("web_search_call", "image_generation_call"), "hosted")
        .when(event & (sub == "item_completed") & item.isin(*TOOL_ITEMS), "item")
        .when(event & (sub == "item_completed") & (item == "CollabAgentToolCall"), "collab")
        .when(kind == "token_usage_record", "usage")
    )
    space = at("payload.namespace")
    name = F.coalesce(at("payload.name"), F.when(sub == "tool_search_call", "tool_search"), F.lit("?"))
    of_function = F.when(space.isNull(), name).when(
        space.startswith("mcp__"), F.concat(space, F.lit("__"), name)
    ).otherwise(F.concat(space, F.lit("."), name))
    of_item = (
        F.when(item == "CommandExecution", "Bash")
        .when(
            item == "McpToolCall",
            F.concat(F.lit("mcp__"), at("payload.item.server"), F.lit("__"), at("payload.item.tool")),
        )
        .when(item == "FileChange", "apply_patch")
        .when(item == "ImageView", "view_image")
        .when(item == "CollabAgentToolCall", F.concat(F.lit("collaboration."), at("payload.item.tool")))
        .when(item == "FunctionCallOutput", F.concat_ws(".", at("payload.item.namespace"), at("payload.item.name")))
        .when(
            (item == "Extension") & ~F.coalesce(at("payload.item.kind"), F.lit("")).startswith("web."),
            at("payload.item.kind"),
        )
        .otherwise("web_search")
    )
    hosted = F.when(sub == "web_search_call", "web_search").otherwise("image_generation")
    code, state = at("payload.item.exit_code").try_cast("int"), F.coalesce(
        at("payload.item.status"), at("payload.status")
    )
    status = (
        F.when(code == 0, "success").when(code.isNotNull(), "error")
        .when(state.isin("failed", "declined", "incomplete", "cancelled"), "error")
        .when(role.isin("item", "hosted", "collab"), "success")
    )
    length = lambda p: F.coalesce(F.length(at(p)), F.lit(0))
    delivered = (
        F.when(item == "ImageView", F.lit(IMAGE_WEIGHT))
        .when(item == "CommandExecution", length("payload.item.aggregated_output"))
        .when(item == "McpToolCall", length("payload.item.result.content"))
        .when(item.isin("WebSearch", "Extension"), length("payload.item.results"))
        .when(item == "FunctionCallOutput", length("payload.item.output"))
        .otherwise(length("payload.output"))
    )
    span = at("payload.item.duration.secs").try_cast("long") * 1_000 + F.floor(
        at("payload.item.duration.nanos").try_cast("long") / 1_000_000
    )
    output = at("payload.output")
    return rows.select(
        "file", "line", kind.alias("kind"), sub.alias("sub"), item.alias("item"), role.alias("role"),
        tools.iso_to_ns(at("timestamp")).alias("ns"), ms("payload.started_at_ms").alias("began_ns"),
        ms("payload.completed_at_ms").alias("ended_ns"),
        F.coalesce(at("payload.call_id"), at("payload.item.id"), F.when(role == "hosted", at("payload.id"))).alias(
            "call_id"
        ),
        F.when(role == "fn", of_function).when(role == "exec", name).when(role == "hosted", hosted).when(
            role.isin("item", "collab"), of_item
        ).alias("tool"),
        status.alias("status"), code.alias("exit_code"),
        F.coalesce(span, at("payload.item.duration_ms").try_cast("long")).alias("duration_ms"),
        delivered.cast("long").alias("chars"), (F.get_json_object(output, "$.timed_out") == "true").alias("timed_out"),
        F.when(
            role == "fn_out",
            output.rlike(r"(?i)^\s*(?:error|unknown agent|invalid)") | F.get_json_object(output, "$.error").isNotNull(),
        ).alias("wrong"),
        at("payload.response_id").alias("response_id"),
        *[
            at(f"payload.usage.{k}").try_cast("long").alias(k)
            for k in ("input_tokens", "cached_input_tokens", "output_tokens")
        ],
    )


def parsed(rows: DataFrame) -> DataFrame:
    """The lines that tell of calls and responses, each parsed once and stored: all that calls, responses and allocation
    read of a log."""
    return stored(_lines(rows).filter("role IS NOT NULL"), "rollout-lines")


def calls(known: DataFrame) -> DataFrame:
    """One row per call (of parsed lines): file, call_id, tool, made_as (function, script, item, hosted), start_line, end_line, start_ns,
    end_ns, status, exit_code, duration_ms, chars (delivered), timed_out, parent (the script it ran in), identity,
    emitter and consumer (responses), told_twice (lines that repeat what another told).

    A function's end comes from the item of the same id where that came before its output; items of searches and of
    collaboration only add to it. An item of no function lies in the script that was opened last and is still open. A
    script hands its emitter and consumer to what ran in it. Calls without an end are open, ends without a start keep their
    own line as start. Lines without an id, and ids of an empty file, give none.
    """
    facts = F.struct(
        "line",
        "ns",
        "began_ns",
        "ended_ns",
        "tool",
        "status",
        "exit_code",
        "duration_ms",
        "chars",
        "timed_out",
        "wrong",
        "item",
    )
    of = lambda role: F.min(F.when(F.col("role") == role, facts)).alias(role)
    roles = ("fn", "fn_out", "exec", "exec_out", "item", "hosted", "collab")
    grouped = known.filter("role <> 'usage' AND call_id IS NOT NULL").groupBy("file", "call_id").agg(
        *[of(r) for r in roles]
    )
    is_fn, is_exec = F.col("fn").isNotNull() | F.col("fn_out").isNotNull(), F.col("exec").isNotNull() | F.col(
        "exec_out"
    ).isNotNull()
    told = F.coalesce("item", "collab")
    # the item ends a function that is still open; a search or a collaboration only adds to it
    ends_it = is_fn & F.col("item").isNotNull() & (F.col("item.item") != "WebSearch") & (
        F.col("fn_out").isNull() | (F.col("item.line") < F.col("fn_out.line"))
    )
    first = F.when(is_fn, F.coalesce("fn", "fn_out")).when(is_exec, F.coalesce("exec", "exec_out")).when(
        F.col("hosted.line") < told["line"], F.col("hosted")
    ).otherwise(F.coalesce(told, F.col("hosted")))
    last = F.when(ends_it, F.col("item")).when(is_fn, F.col("fn_out")).when(is_exec, F.col("exec_out")).otherwise(first)
    single = ~is_fn & ~is_exec
    status = (
        F.when(ends_it | single, last["status"])
        .when(F.col("fn_out").isNotNull(), F.when(F.col("fn_out.wrong"), "error").otherwise("success"))
        .when(F.col("exec_out").isNotNull(), "success")
        .otherwise("open")
    )
    began = F.when(single, F.coalesce(first["began_ns"], first["ns"])).otherwise(first["ns"])
    ended = F.when(ends_it | single, F.coalesce(last["ended_ns"], last["ns"])).otherwise(last["ns"])
    made = grouped.select(
        "file", "call_id",
        F.coalesce(F.col("fn.tool"), F.col("exec.tool"), told["tool"], F.col("hosted.tool"), F.lit("?")).alias("tool"),
        F.when(is_fn, "function").when(is_exec, "script").when(told.isNull(), "hosted").otherwise("item").alias(
            "made_as"
        ),
        first["line"].alias("start_line"), last["line"].alias("end_line"), began.alias("start_ns"),
        ended.alias("end_ns"), status.alias("status"),
        last["exit_code"].alias("exit_code"),
        F.coalesce(last["duration_ms"], F.floor((ended - began) / 1_000_000)).alias("duration_ms"),
        F.coalesce(F.when(is_fn, F.col("fn_out.chars")), last["chars"], F.lit(0)).alias("chars"),
        F.coalesce(F.col("fn_out.timed_out"), F.lit(False)).alias("timed_out"),
        # what the next response reads: a function's output, a script's output, or the item itself
        F.when(is_fn, F.col("fn_out.line")).when(is_exec, F.col("exec_out.line")).otherwise(last["line"]).alias(
            "output_line"
        ),
        F.when(is_fn, F.col("fn.line")).when(is_exec, F.col("exec.line")).alias("call_line"),
        (
            (is_fn & told.isNotNull()).cast("int")
            + (single & told.isNotNull() & F.col("hosted").isNotNull()).cast("int")
        ).alias("told_twice"),
        ends_it.alias("same_id"),
    )
    made = stored(made, "rollout-made")  # read four times below

    scripts = made.filter("made_as = 'script'").select(
        "file",
        F.col("call_id").alias("parent"),
        F.col("start_line").alias("opened"),
        F.col("output_line").alias("closed"),
    )
    end = known.groupBy("file").agg(F.max("line").alias("last_line"))
    scripts = scripts.join(end, "file").withColumn("closed", F.coalesce("closed", F.col("last_line") + 1)).drop(
        "last_line"
    )
    stretch = lambda c: F.floor(c / STRETCH)
    scripts = scripts.withColumn("stretch", F.explode(F.sequence(stretch(F.col("opened")), stretch(F.col("closed")))))
    items = made.filter("made_as = 'item'").select(
        "file", "call_id", "start_line", stretch(F.col("start_line")).alias("stretch")
    )
    inside = (F.col("opened") < F.col("start_line")) & (F.col("start_line") < F.col("closed"))
    around = items.join(scripts, ["file", "stretch"]).filter(inside).groupBy("file", "call_id").agg(
        F.max_by("parent", "opened").alias("parent")
    )
    made = made.join(around, ["file", "call_id"], "left")
    identity = F.when(F.col("same_id"), "matching_function_call_id").when(
        F.col("parent").isNotNull(), "last_open_exec_in_log"
    ).when(F.col("made_as") == "item", "standalone_item_id")

    # the next response behind a call emitted it, the next behind an output read it
    marks = made.filter("parent IS NULL").select(
        "file",
        "call_id",
        F.explode(
            F.array(
                F.struct(F.lit("call").alias("what"), F.col("call_line").alias("line")),
                F.struct(F.lit("output").alias("what"), F.col("output_line").alias("line")),
            )
        ).alias("m"),
    )
    marks = marks.select("file", "call_id", "m.what", "m.line").filter("line IS NOT NULL")
    behind = Window.partitionBy("file").orderBy("line").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    met = marks.withColumn("rid", F.lit(None).cast("string")).unionByName(
        responses(known).select(
            "file",
            F.lit(None).cast("string").alias("call_id"),
            F.lit("usage").alias("what"),
            "line",
            F.col("response_id").alias("rid"),
        )
    )
    met = met.withColumn("next", F.first("rid", ignorenulls=True).over(behind)).filter("what <> 'usage'")
    ends = met.groupBy("file", "call_id").agg(
        F.max(F.when(F.col("what") == "call", F.col("next"))).alias("emitter"),
        F.max(F.when(F.col("what") == "output", F.col("next"))).alias("consumer"),
    )
    own = ends.select("file", F.col("call_id").alias("holder"), "emitter", "consumer")
    held = made.withColumn("holder", F.coalesce("parent", "call_id")).join(own, ["file", "holder"], "left")
    return held.withColumn("identity", identity).select(
        "file", "call_id", "tool", "made_as", "start_line", "end_line", "start_ns", "end_ns", "status", "exit_code",
        "duration_ms", "chars",
        "timed_out", "parent", "identity", "emitter", "consumer", "told_twice",
    )


def responses(known: DataFrame) -> DataFrame:
    """One row per response of the model (of parsed lines): file, line, index, response_id (made up of the index where none is written),
    input_tokens, cached_input_tokens, output_tokens."""
    found = known.filter("role = 'usage'")
    index = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    rid = F.coalesce("response_id", F.concat(F.lit("resp-"), F.col("index").cast("string")))
    return found.withColumn("index", index).select(
        "file", "line", "index", rid.alias("response_id"), "input_tokens", "cached_input_tokens", "output_tokens"
    )


def allocation(known: DataFrame) -> DataFrame:
    """Shares of tokens (of parsed lines): file, call_id, emitter, consumer, input_share, output_share, siblings.

    The uncached input of a response is split over the outputs that appeared since the one before, by their sizes (one at
    least), exactly; a script's share again over what ran in it. A response's output is divided by how many calls it
    emitted, and a script's part split like its input. Shares are by rule, not what a tool truly cost.
    """
    made, said = stored(calls(known), "rollout-calls"), responses(known)
    uncached = F.greatest(F.coalesce("input_tokens", F.lit(0)) - F.coalesce("cached_input_tokens", F.lit(0)), F.lit(0))
    read = said.select("file", F.col("response_id").alias("consumer"), uncached.cast("long").alias("uncached"))
    top = made.filter("parent IS NULL").withColumn("weight", F.greatest("chars", F.lit(1)).cast("long"))
    shares = top.filter("consumer IS NOT NULL").join(read, ["file", "consumer"]).withColumn(
        "pot", F.concat_ws("|", "file", "consumer")
    )
    # outputs are told apart by where they stand
    shares = split_exact(shares, "pot", "uncached", "weight", "end_line").select(
        "file", "call_id", F.col("share").alias("input_share")
    )
    wrote = said.select("file", F.col("response_id").alias("emitter"), F.col("output_tokens").alias("written"))
    emitted = top.filter("emitter IS NOT NULL AND made_as IN ('function', 'script')").join(wrote, ["file", "emitter"])
    n = F.count(F.lit(1)).over(Window.partitionBy("file", "emitter"))
    emitted = emitted.withColumn("_n", n).select("file", "call_id", F.expr("written div _n").alias("output_share"))
    tops = top.join(shares, ["file", "call_id"], "left").join(emitted, ["file", "call_id"], "left")
    alone = tops.filter("made_as <> 'script'").select(
        "file", "call_id", "emitter", "consumer", "input_share", "output_share", F.lit(1).cast("long").alias("siblings")
    )
    scripts = tops.filter("made_as = 'script'").select(
        "file", F.col("call_id").alias("parent"), F.col("input_share").alias("i"), F.col("output_share").alias("o")
    )
    inner = made.filter("parent IS NOT NULL").withColumn("weight", F.greatest("chars", F.lit(1)).cast("long")).join(
        scripts, ["file", "parent"]
    )
    inner = inner.withColumn("pot", F.concat_ws("|", "file", "parent")).withColumn(
        "siblings", F.count(F.lit(1)).over(Window.partitionBy("pot"))
    )
    inner = split_exact(inner, "pot", "i", "weight", "start_line").withColumnRenamed("share", "input_share")
    inner = split_exact(inner, "pot", "o", "weight", "start_line").withColumnRenamed("share", "output_share")
    return alone.unionByName(inner.select(*alone.columns))


def _content(path: str) -> Column:
    """The text of a message: a string, or the texts of its blocks with blank lines between."""
    raw = at(path)
    blocks = F.from_json(raw, "array<struct<text:string>>")
    joined = F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull()), "\n\n")
    return F.when(raw.startswith("["), joined).otherwise(F.coalesce(raw, F.lit("")))


def is_injected(block: Column) -> Column:
    """Whether a block of a user's message was put there by the client."""
    head = F.lower(F.substring(F.ltrim(block), 1, 40))
    starts = [head.startswith(h) for h in INJECTED_HEADS]
    return starts[0] | starts[1] | starts[2] | F.lower(F.substring(block, 1, 400)).contains("<instructions>")


def split_injected(blocks: Column) -> tuple[Column, Column]:
    """The blocks (array of texts) that a user wrote, and those that the client put in; blank ones are neither."""
    told = F.filter(blocks, lambda b: b.isNotNull() & (F.trim(b) != ""))
    return F.filter(told, lambda b: ~is_injected(b)), F.filter(told, is_injected)


def messages(rows: DataFrame) -> DataFrame:
    """Messages of a log: file, line, role, text, told_by (line or item). An item is the same message as a line near it
    (MATCH_LINES lines ahead, 2 x MATCH_LINES behind) whose text is equal or holds it, and then not told again."""
    kind, sub, item = at("type"), at("payload.type"), at("payload.item.type")
    by_line = (kind == "response_item") & sub.isin("message", "agent_message")
    by_item = (kind == "event_msg") & (sub == "item_completed") & item.isin("AgentMessage", "UserMessage")
    role = F.when(sub == "agent_message", "agent").when(by_line, at("payload.role")).when(
        item == "AgentMessage", "assistant"
    ).otherwise("user")
    found = rows.filter(is_object(F.col("value"))).filter(by_line | by_item).select(
        "file", "line", role.alias("role"),
        F.when(by_line, _content("payload.content")).otherwise(_content("payload.item.content")).alias("text"),
        F.when(by_line, "line").otherwise("item").alias("told_by")
    )
    found = found.withColumn("plain", F.trim(F.regexp_replace("text", r"\s+", " ")))
    lines, items = found.filter("told_by = 'line'"), found.filter("told_by = 'item' AND plain <> ''")
    near = F.floor(F.col("line") / MATCH_LINES)
    other = lines.select(
        "file",
        F.col("line").alias("at_line"),
        F.col("plain").alias("told"),
        F.explode(F.array(near - 1, near, near + 1, near + 2)).alias("slot"),
    )
    close = (F.col("at_line") >= F.col("line") - 2 * MATCH_LINES) & (F.col("at_line") <= F.col("line") + MATCH_LINES)
    same = items.withColumn("slot", near).join(other, ["file", "slot"]).filter(
        close & F.contains("told", F.col("plain"))
    ).select("file", "line").distinct()
    return lines.unionByName(items.join(same, ["file", "line"], "left_anti")).drop("plain")


def image_fingerprints(rows: DataFrame) -> DataFrame:
    """file, call_id, fingerprint of each image that was viewed in a script: by place, where the script hands out as many
    images as it viewed, else none."""
    made = calls(parsed(rows))
    views = made.filter("tool = 'view_image' AND parent IS NOT NULL")
    views = views.groupBy("file", "parent").agg(
        F.array_sort(F.collect_list(F.struct("start_line", "call_id"))).alias("views")
    )
    outputs = rows.filter((at("type") == "response_item") & (at("payload.type") == "custom_tool_call_output"))
    parts = F.from_json(at("payload.output"), "array<struct<type:string,image_url:string>>")
    urls = F.transform(F.filter(parts, lambda x: x["type"] == "input_image"), lambda x: x["image_url"])
    outputs = outputs.select("file", at("payload.call_id").alias("parent"), urls.alias("urls"))
    both = views.join(outputs, ["file", "parent"]).filter(F.size("views") == F.size("urls"))
    pairs = both.select("file", F.explode(F.arrays_zip("views", "urls")).alias("p")).filter("p.urls IS NOT NULL")
    return pairs.select("file", F.col("p.views.call_id").alias("call_id"), F.sha2("p.urls", 256).alias("fingerprint"))


def uninterpreted(rows: DataFrame) -> DataFrame:
    """What the reader does not know, and how often: file, what, lines."""
    kind, sub, item = at("type"), at("payload.type"), at("payload.item.type")
    label = lambda word, c: F.concat(F.lit(word), F.coalesce(c, F.lit("?")))
    what = (
        F.when(~F.coalesce(kind.isin(*KNOWN_LINES), F.lit(False)), label("line ", kind))
        .when((kind == "event_msg") & ~F.coalesce(sub.isin(*KNOWN_EVENTS), F.lit(False)), label("event_msg ", sub))
        .when(
            (kind == "response_item") & ~F.coalesce(sub.isin(*KNOWN_RESPONSES), F.lit(False)),
            label("response_item ", sub),
        )
        .when(
            (sub == "item_completed") & ~F.coalesce(item.isin(*TOOL_ITEMS, *KNOWN_ITEMS), F.lit(False)),
            label("item ", item),
        )
    )
    odd = rows.filter(is_object(F.col("value"))).select("file", what.alias("what")).filter("what IS NOT NULL")
    return odd.groupBy("file", "what").agg(F.count(F.lit(1)).alias("lines"))
