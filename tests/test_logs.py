"""Readers and the store on small logs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomtrace.functions import tools
from loomtrace.sources import logs, store


def write(path, rows):
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in rows))
    return str(path)


def hook(name, **more):
    return {
        "session_id": "s1",
        "hook_event_name": name,
        "tool_name": "Read",
        "tool_use_id": "t1",
        "tool_input": {"file_path": "/a/b.py"},
    } | more


def test_hook_payloads(spark, tmp_path):
    rows = [
        hook("PreToolUse"),
        hook("PostToolUse", tool_response={"file": {"numLines": 3}, "content": "x"}),
        hook("PostToolUseFailure", error="boom", is_interrupt=True),
        hook("PostToolUse", tool_name="mcp__srv__do__it", tool_response={"isError": True}),
        hook(
            "PostToolUse", tool_name="Bash", tool_input={"command": "ls"}, tool_response={"stdout": "", "exit_code": 2}
        ),
        hook("Odd"),
        "[1, 2]",
        "{broken",
    ]
    raw = logs.lines(spark, write(tmp_path / "h.jsonl", rows))
    assert [r.line for r in raw.orderBy("line").collect()] == list(range(1, 9))
    got = logs.hook_events(raw.orderBy("line"), "claude-code").collect()
    assert [(r.phase, r.status) for r in got] == [
        ("start", None),
        ("end", "success"),
        ("failure", "interrupted"),
        ("end", "error"),
        ("end", "error"),
        ("unknown", None),
    ]
    assert (got[3].tool_category, got[3].mcp_server, got[3].mcp_tool) == ("mcp", "srv", "do__it")
    assert (got[4].tool_category, got[4].target, got[4].target_kind, got[4].exit_code) == ("shell", "ls", "command", 2)
    assert sorted(r.reason for r in logs.rejected(raw).collect()) == ["invalid_json", "not_an_object"]
    assert logs.problems(logs.hook_events(raw, "codex")).filter(F.size("problems") > 0).count() == 0


def test_status_by_first_clue(spark):
    cases = [
        ('{"exit_code":0}', "success"),
        ('{"returncode":3}', "error"),
        ('{"interrupted":true,"exit_code":0}', "interrupted"),
        ('{"isError":false}', "success"),
        ('{"success":false}', "error"),
        ('{"error":"x"}', "error"),
        ('{"stdout":""}', "success"),
        ('{"output":"x"}', "unknown"),
        ("{}", "unknown"),
        ('"text"', "unknown"),
        (None, "unknown"),
    ]
    df = spark.createDataFrame(cases, "r string, want string").withColumn("got", tools.status(F.col("r")))
    assert [(r.r, r.got) for r in df.collect()] == cases


def test_iso_keeps_nanoseconds(spark):
    df = spark.createDataFrame(
        [("2026-09-19T12:00:00Z",), ("2026-09-19T14:00:00+02:00",), ("2026-09-19T12:00:00.123456789Z",), ("x",)],
        "t string",
    )
    base = 1789819200 * 10**9
    assert [r[0] for r in df.select(tools.iso_to_ns(F.col("t"))).collect()] == [base, base, base + 123456789, None]


def assistant(rid, uses=(), **usage):
    return {
        "type": "assistant",
        "requestId": rid,
        "message": {
            "model": "m", "usage": usage, "content": [{"type": "tool_use", "id": u, "name": "Read"} for u in uses]
        },
    }


def results(*ids):
    return {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i} for i in ids]}}


def test_transcript(spark, tmp_path):
    rows = [
        assistant("r1", ["a", "b"], input_tokens=10, output_tokens=7),
        results("a", "b"),
        {"type": "assistant", "message": {"model": "<synthetic>", "content": []}},
        assistant("r2", ["c"], input_tokens=30, cache_creation_input_tokens=5, output_tokens=4),
        results("c"),
        assistant("r1", ["a"], input_tokens=10, output_tokens=8),
        "oops",
        results("z"),
    ]
    req = logs.transcript_requests(logs.lines(spark, write(tmp_path / "t.jsonl", rows)))
    got = {r.request_id: r for r in req.collect()}
    assert set(got) == {"r1", "r2"}
    assert (got["r1"].tool_uses, got["r1"].consumed, got["r1"].first_line, got["r1"].last_line) == (
        ["a", "b"], ["c"], 1, 6
    )
    assert (got["r1"].input_tokens, got["r1"].output_tokens) == (10, None)
    assert got["r2"].consumed == ["a", "b"]
    shares = {r.call_id: r for r in logs.attributed(req).collect()}
    assert (shares["a"].emitter, shares["a"].consumer, shares["a"].input_share) == ("r1", "r2", 17)
    assert shares["c"].output_share == 4


def test_rollout_and_usage(spark, tmp_path):
    rows = [
        {"timestamp": "2026-09-19T12:00:00Z", "type": "session_meta", "payload": {}},
        {
            "timestamp": "2026-09-19T12:00:01Z",
            "type": "response_item",
            "payload": {"type": "function_call", "call_id": "c1", "name": "shell"},
        },
        {
            "timestamp": "2026-09-19T12:00:02Z",
            "type": "event_msg",
            "payload": {
                "type": "item_completed",
                "item": {
                    "type": "CommandExecution", "id": "c1", "exit_code": 1, "duration": {"secs": 1, "nanos": 500000000}
                },
            },
        },
        {
            "timestamp": "2026-09-19T12:00:03Z",
            "type": "token_usage_record",
            "payload": {"response_id": "x", "usage": {"input_tokens": 5, "output_tokens": 2}},
        },
        {"timestamp": "2026-09-19T12:00:04Z", "type": "novelty", "payload": {}},
    ]
    got = logs.rollout_events(logs.lines(spark, write(tmp_path / "r.jsonl", rows))).orderBy("line").collect()
    assert [r.phase for r in got] == ["session_start", "start", "end", "usage", "uninterpreted"]
    assert (got[2].status, got[2].duration_ms, got[3].input_tokens, got[3].total_tokens) == ("error", 1500, 5, None)
    lines = [
        {"client": "c", "session_id": "s", "source": "x", "input_tokens": 3},
        {"client": "c", "session_id": "s", "source": "x", "tool_use_id": "t"},
        {"client": "c"},
    ]
    u = logs.usage_lines(logs.lines(spark, write(tmp_path / "u.jsonl", lines))).collect()
    assert sorted(r.phase for r in u) == ["observation", "usage"]


def test_store_is_idempotent(spark, tmp_path):
    e = spark.createDataFrame(
        [("c", "s1", "e1", 5), ("c", "s1", "e2", 9), ("c", "s2", "e3", 1), ("c", "s2", "e3", 1)],
        "client string, session_id string, event_id string, ns long",
    )
    path = str(tmp_path / "store")
    assert store.append(e, path) == 3 and store.append(e, path) == 0
    assert {(r.session_id, r.events) for r in store.sessions(spark, path).collect()} == {("s1", 2), ("s2", 1)}
    assert store.find_session(spark, path, "s1") == ("c", "s1")
    store.merge_files(spark, path, str(tmp_path / "merged"))
    assert spark.read.parquet(str(tmp_path / "merged")).count() == 3
    assert [r.session_id for r in store.expired(spark, path, "ns", 6).collect()] == ["s2"]
    first = store.upsert_sessions(
        spark.createDataFrame(
            [], "client string, session_id string, revision int, first_ns long, last_ns long, events long"
        ),
        e,
    )
    again = {
        r.session_id: r
        for r in store.upsert_sessions(
            first.withColumn("revision", F.col("revision").cast("int")), e.filter("ns > 5")
        ).collect()
    }
    assert (again["s1"].revision, again["s1"].events, again["s2"].revision) == (2, 3, 1)


def test_exit_codes_at_the_end_of_plain_output(spark):
    rows = [
        {
            "hook_event_name": "PostToolUse",
            "tool_name": "Bash",
            "session_id": "s",
            "tool_input": {"command": "x" * 3_000},
            "tool_response": r,
        }
        for r in (
            "done\nProcess exited with code 3\n", "fine\nexit code: 0", "exit 5\n" + "y" * 500, '{"exit_code": 2}'
        )
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    got = logs.hook_events(df, "codex").collect()
    assert [(r.exit_code, r.status) for r in got] == [(3, "error"), (0, "success"), (None, "unknown"), (2, "error")]
    assert all(len(r.target) == 2_000 for r in got)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"line {k}\n" for k in range(1, 20_001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = logs.lines(spark, str(path))
        assert got.rdd.getNumPartitions() > 3
        assert got.filter(F.col("value") != F.concat(F.lit("line "), "line")).count() == 0 and got.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parameters_that_may_be_kept(spark):
    given = {"command": "secret text", "timeout": 7, "run_in_background": True}
    rows = [
        {"hook_event_name": "PreToolUse", "tool_name": t, "session_id": "s", "tool_input": given}
        for t in ("Bash", "Novel")
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    first, second = (r.params for r in logs.hook_events(df, "claude-code").collect())
    assert first["timeout"] == "7" and first["run_in_background"] == "true" and len(first["command_fp"]) == 10
    # timing parameters are kept of every tool
    assert set(second) == {"timeout", "command_fp", "run_in_background_fp"}
