"""Rollout logs: pairing, scripts around calls, responses, shares, messages told twice, images, what is unknown."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomtrace.sources import rollouts


def log(spark, entries, file="f"):
    rows = [
        (file, k, x if isinstance(x, str) else json.dumps({"timestamp": f"2026-01-01T00:00:{k:02d}Z"} | x))
        for k, x in enumerate(entries, start=1)
    ]
    return spark.createDataFrame(rows, "file string, line long, value string")


def response(kind, **more):
    return {"type": "response_item", "payload": {"type": kind, **more}}


def item(kind, ident, **more):
    return {"type": "event_msg", "payload": {"type": "item_completed", "item": {"type": kind, "id": ident, **more}}}


def usage(rid, taken, written, cached=0):
    return {
        "type": "token_usage_record",
        "payload": {
            "response_id": rid,
            "usage": {"input_tokens": taken, "cached_input_tokens": cached, "output_tokens": written},
        },
    }


def by_id(df):
    return {r.call_id: r for r in df.collect()}


def test_functions_items_and_scripts(spark):
    rows = log(spark, [
        response("function_call", call_id="a", name="shell"),
        usage("r1", 100, 30, 20),
        item("CommandExecution", "a", exit_code=1, duration={"secs": 2, "nanos": 500_000_000}),
        response("function_call_output", call_id="a", output="x" * 10),
        response("custom_tool_call", call_id="e", name="exec"),
        usage("r2", 200, 9, 100),
        item("CommandExecution", "n1", exit_code=0, aggregated_output="y" * 30),
        item("McpToolCall", "n2", server="hub", tool="get", status="failed"),
        response("custom_tool_call_output", call_id="e", output="z"),
        item("ImageView", "s", path="p.png"),
        usage("r3", 7_000, 5),
        response("function_call", call_id="w", name="run", namespace="web"),
        item("WebSearch", "w", query="q"),
        response("function_call_output", call_id="w", output='{"error": "no"}'),
        response("function_call", call_id="open", name="wait"),
        "not json",
    ])
    got = by_id(rollouts.calls(rollouts.parsed(rows)))
    assert set(got) == {"a", "e", "n1", "n2", "s", "w", "open"}
    assert (got["a"].status, got["a"].exit_code, got["a"].duration_ms, got["a"].identity, got["a"].end_line) == (
        "error", 1, 2_500, "matching_function_call_id", 3
    )
    assert (got["a"].emitter, got["a"].consumer, got["a"].told_twice) == ("r1", "r2", 1)
    assert (got["n1"].parent, got["n1"].tool, got["n1"].status, got["n1"].emitter, got["n1"].consumer) == (
        "e", "Bash", "success", "r2", "r3"
    )
    assert (got["n2"].tool, got["n2"].status, got["n2"].identity) == ("mcp__hub__get", "error", "last_open_exec_in_log")
    assert (got["s"].parent, got["s"].identity, got["s"].consumer) == (None, "standalone_item_id", "r3")
    assert (got["w"].tool, got["w"].status, got["w"].end_line, got["w"].consumer) == ("web.run", "error", 14, None)
    assert (got["open"].status, got["open"].end_line) == ("open", None)
    shares = by_id(rollouts.allocation(rollouts.parsed(rows)))
    # r2 reads only a's output; r3 reads the script (1 character) and the image (6000), 7000 tokens
    assert shares["a"].input_share == 100 and shares["a"].output_share == 30
    assert shares["s"].input_share + shares["n1"].input_share + shares["n2"].input_share == 7_000
    assert shares["n1"].output_share + shares["n2"].output_share == 9 and shares["n1"].siblings == 2
    assert rollouts.calls(rollouts.parsed(rows.limit(0))).count() == 0


def test_overlapping_scripts(spark):
    rows = log(
        spark,
        [
            response("custom_tool_call", call_id="e1", name="exec"),
            response("custom_tool_call", call_id="e2", name="exec"),
            response("custom_tool_call_output", call_id="e1", output=""),
            item("FileChange", "i1"),
            response("custom_tool_call_output", call_id="e2", output=""),
            item("FileChange", "i2"),
            response("custom_tool_call", call_id="e3", name="exec"),
            item("FileChange", "i3"),
        ],
    )
    got = by_id(rollouts.calls(rollouts.parsed(rows)))
    assert [got[k].parent for k in ("i1", "i2", "i3")] == ["e2", None, "e3"]


def test_hosted_calls_are_told_once(spark):
    rows = log(
        spark,
        [
            item("WebSearch", "h", query="q"),
            response("web_search_call", id="h", status="completed"),
            response("image_generation_call", id="g", status="failed"),
        ],
    )
    got = by_id(rollouts.calls(rollouts.parsed(rows)))
    assert (got["h"].told_twice, got["h"].status, got["g"].status, got["g"].made_as) == (
        1, "success", "error", "hosted"
    )


def test_messages_are_told_once(spark):
    said = lambda t: [{"type": "text", "text": t}]
    rows = log(
        spark,
        [
            item("AgentMessage", "1", content=said("hello  there")),
            response("message", role="assistant", content=said("hello there")),
        ] + [response("reasoning")] * 30 + [
            item("AgentMessage", "2", content=said("only here")), item("UserMessage", "3", content=said(" "))
        ] + [response("reasoning")] * 30 + [
            response("message", role="user", content=said("a long text that holds it")),
            item("UserMessage", "4", content=said("text that holds")),
        ],
    )
    got = sorted((r.line, r.role, r.told_by) for r in rollouts.messages(rows).collect())
    assert got == [(2, "assistant", "line"), (33, "assistant", "item"), (65, "user", "line")]


def test_injected_blocks(spark):
    df = spark.createDataFrame(
        [(["# AGENTS.md instructions for x", "do this", " <env>", "", None, "see <INSTRUCTIONS> here"],)],
        "b array<string>",
    )
    human, injected = rollouts.split_injected(F.col("b"))
    r = df.select(human.alias("h"), injected.alias("i")).first()
    assert r.h == ["do this"] and len(r.i) == 3


def test_images_and_unknown_lines(spark):
    out = lambda *urls: [{"type": "input_image", "image_url": u} for u in urls]
    rows = log(
        spark,
        [
            response("custom_tool_call", call_id="e", name="exec"),
            item("ImageView", "v1"),
            item("ImageView", "v2"),
            response("custom_tool_call_output", call_id="e", output=out("u1", "u2")),
            response("custom_tool_call", call_id="d", name="exec"),
            item("ImageView", "v3"),
            response("custom_tool_call_output", call_id="d", output=out("u1", "u2")),
            {"type": "novelty"},
            item("Strange", "q"),
            response("odd"),
        ],
    )
    assert set(by_id(rollouts.image_fingerprints(rows))) == {"v1", "v2"}
    assert sorted((r.what, r.lines) for r in rollouts.uninterpreted(rows).collect()) == [
        ("item Strange", 1), ("line novelty", 1), ("response_item odd", 1)
    ]
