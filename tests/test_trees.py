"""Usage of trees of threads, and context boundaries against a walk line by line."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import boundaries, evidence, trees

FULL = dict(zip(trees.FIELDS, (10, 4, 0, 6, 2, 16), strict=True))
LINES = "file string, line long, value string"


def meta(ident, root, parent=None, path="/root/a"):
    source = {"subagent": {"thread_spawn": {"parent_thread_id": parent, "agent_path": path}}} if parent else "cli"
    return {"type": "session_meta", "payload": {"id": ident, "session_id": root, "source": source}}


def record(thread, root, ident, usage=None, total=None, **more):
    payload = {"thread_id": thread, "session_id": root, "response_id": ident, "usage": FULL if usage is None else usage,
               "thread_token_usage": FULL if total is None else total} | more
    return {"type": "token_usage_record", "payload": payload}


def times(n):
    return {k: v * n for k, v in FULL.items()}


def read(spark, files, starts=None, agents=""):
    rows = [
        (name, i, v if isinstance(v, str) else json.dumps(v, separators=(",", ":")))
        for name, values in files.items() for i, v in enumerate(values, 1)
    ]
    lines = spark.createDataFrame(rows, LINES)
    metas = trees.threads(lines)
    given = spark.createDataFrame(starts, "root_id string, start_line long") if starts else None
    found = trees.records(lines, metas, given, agents)
    return metas, found, trees.responses(found)


def test_each_reason_not_to_count(spark):
    files = {
        "r": [meta("r", "r"), record("r", "r", "a"), record("r", "r", "b"), "{broken \"token_usage_record\"",
              {"type": "event_msg", "payload": {"type": "token_count"}}, record("x", "r", "c"), record("r", "y", "d")],
        "k": [meta("k", "r", "r"), meta("r", "r"), record("r", "r", "a"), record("k", "r", "e")],
        "o": [meta("o", "r", "r", "/b"), record("o", "r", "f")],
        "n": [record("n", "r", "g")],
    }
    _, found, told = read(spark, files, [("r", 3)], "/root/")
    got = {(r.file, r.line): r.why for r in found.collect()}
    assert got == {
        ("r", 2): "before_start", ("r", 3): None, ("r", 5): "token_count", ("r", 6): "other_thread",
        ("r", 7): "other_session", ("k", 3): "parent_copy", ("k", 4): None, ("o", 2): "other_agent",
    }
    assert sorted(r.response_id for r in told.collect()) == ["b", "e"]


def test_copies_of_one_response(spark):
    odd = FULL | {"output_tokens": 7}
    missing = {k: v for k, v in FULL.items() if k != "total_tokens"}
    files = {
        "r": [meta("r", "r"), record("r", "r", "same"), record("r", "r", "same"), record("r", "r", "differs"),
              record("r", "r", "differs", odd), record("r", "r", "differs", odd), record("r", "r", None),
              record("r", "r", None), record("r", "r", "lacks"), record("r", "r", "lacks", missing),
              record("r", "r", "turns", turn_id="1"), record("r", "r", "turns", turn_id="2")],
        "a": [meta("a", "r", "r"), record("a", "r", "same")],
    }
    told = {(r.file, r.line): r for r in read(spark, files)[2].collect()}
    assert sorted(told) == [("r", 2), ("r", 4), ("r", 7), ("r", 8), ("r", 9), ("r", 11)]
    # the same numbers told by two threads: which thread made it is in conflict
    same = told["r", 2]
    assert (same.copies, same.conflict, same.response_id, same.output_tokens, same.complete) == (3, True, None, 6, False)
    differs = told["r", 4]
    assert (differs.copies, differs.output_tokens, differs.input_tokens, differs.response_id) == (3, None, 10, None)
    assert told["r", 7].complete and not told["r", 7].conflict
    assert told["r", 9].total_tokens is None and told["r", 9].conflict
    assert told["r", 11].conflict and told["r", 11].output_tokens == 6


def test_numbers_and_violations(spark):
    values = {"input_tokens": 5, "cached_input_tokens": 6, "cache_write_input_tokens": "3", "output_tokens": -1,
              "reasoning_output_tokens": True, "total_tokens": 7.0}
    broken = {"input_tokens": 5, "cached_input_tokens": 1, "cache_write_input_tokens": 0, "output_tokens": 2,
              "reasoning_output_tokens": 3, "total_tokens": 9}
    files = {"r": [meta("r", "r"), record("r", "r", "a", values), record("r", "r", "b", broken), record("r", "r", "c", [])]}
    a, b, c = sorted(read(spark, files)[2].collect(), key=lambda r: r.line)
    assert [a[k] for k in trees.FIELDS] == [5, 6, 3, None, None, 7]
    assert a.violations == ["cached_input_gt_input"]
    assert b.violations == ["reasoning_output_gt_output", "total_ne_input_plus_output"] and not b.complete
    assert [c[k] for k in trees.FIELDS] == [None] * 6


def test_checks_against_cumulative_usage(spark):
    files = {
        "r": [meta("r", "r"), record("r", "r", "a", total=times(4)), record("r", "r", "b", total=times(5))],
        "k": [meta("k", "r", "r"), record("k", "r", "c"), record("k", "r", "d", total=times(3))],
        "e": [meta("e", "r", "r")],
        # the last record is where its response was first told, and the copies differ on the cumulative usage
        "l": [meta("l", "r", "r"), record("l", "r", "x", total=times(2))],
        "m": [meta("m", "r", "r"), record("l", "r", "x")],
        "z": [meta("z", "z"), record("z", "z", "a", total=times(1))],
    }
    metas, found, told = read(spark, files, [("r", 3), ("z", 1)])
    got = {r.file: r for r in trees.verified(metas, found, told).collect()}
    assert (got["r"].responses, got["r"].checked, got["r"].full_match) == (1, 6, True)
    assert (got["k"].delta_total_tokens, got["k"].sum_total_tokens, got["k"].full_match) == (48, 32, False)
    assert (got["e"].responses, got["e"].checked, got["e"].full_match) == (0, 0, None)
    assert (got["l"].delta_total_tokens, got["l"].full_match) == (32, False)
    # nothing was seen before the start of z, so what it grew by is unknown
    assert (got["z"].delta_total_tokens, got["z"].sum_total_tokens, got["z"].full_match) == (None, 16, None)


def test_last_record_in_conflict_is_unknown(spark):
    twice = [record("l", "r", "x", total=times(2)), record("l", "r", "y"), record("l", "r", "y", total=times(9))]
    files = {"r": [meta("r", "r")], "l": [meta("l", "r", "r"), *twice[:1]], "m": [meta("l", "r", "r"), record("l", "r", "x")]}
    metas, found, told = read(spark, files)
    got = {r.file: r for r in trees.verified(metas, found, told).collect()}
    assert got["l"].delta_input_tokens is None and got["l"].delta_cache_write_input_tokens == 0
    assert got["m"].delta_input_tokens == 10


def test_subtrees_of_random_forests(spark):
    rng = random.Random(5)
    for size in (0, 1, 60):
        parent = {n: rng.choice([None, n - 1, rng.randrange(n), 10_000]) if n else None for n in range(size)}
        value = {n: rng.randrange(9) for n in range(size)}
        want = dict(value)
        for n in reversed(range(size)):
            if parent[n] in want:
                want[parent[n]] += want[n]
        df = spark.createDataFrame([(n, parent[n], value[n]) for n in range(size)], "n long, p long, v long")
        assert {r.n: r.v for r in trees.roll_up(df, "n", "p", ["v"]).collect()} == want
    ring = spark.createDataFrame([(0, None, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1)], "n long, p long, v long")
    with pytest.raises(ValueError, match="3 nodes lie on cycles"):
        trees.roll_up(ring, "n", "p", ["v"])


def test_subtree_totals_are_strict(spark):
    files = {
        "r": [meta("r", "r"), record("r", "r", "a")],
        "k": [meta("k", "r", "r"), record("k", "r", "b"), record("k", "r", "c")],
        "g": [meta("g", "r", "k"), record("g", "r", "d", {"input_tokens": 1})],
        "s": [meta("s", "r", "r")],
    }
    metas, _, told = read(spark, files)
    got = {r.thread_id: r for r in trees.subtree_totals(metas, told).collect()}
    assert (got["r"].threads, got["r"].responses, got["r"].complete) == (4, 4, 3)
    assert (got["r"].input_tokens, got["r"].output_tokens) == (31, None)
    assert (got["k"].threads, got["k"].input_tokens, got["g"].input_tokens) == (2, 21, 1)
    assert (got["s"].responses, got["s"].input_tokens) == (0, None)


NODES = "file string, line long, uid string, parent string, compaction boolean, ns long"
ASKED = "id string, file string, line long, uid string, ns long"


def walked(nodes, request):
    """What the contract says, line by line: parents as of the request's line, then recorded compactions."""
    _, file, cutoff, uid, ns = request
    here = [n for n in nodes if n[0] == file]
    seen, end, reason = set(), None, None
    while reason is None and end is None:
        held = [n for n in here if n[2] == uid and n[1] <= cutoff]
        if uid is None:
            reason = "no_uid"
        elif uid in seen:
            reason = "cycle"
        elif not held:
            reason = "absent"
        elif max(held, key=lambda n: n[1])[4]:
            end = uid
        elif max(held, key=lambda n: n[1])[3] is None:
            end, reason = f"initial:{uid}", "initial"
        else:
            seen.add(uid)
            uid = max(held, key=lambda n: n[1])[3]
    graph, marks = end, [n for n in here if n[4]]
    name = lambda n: n[2] or f"{n[0]}:{n[1]}"
    told = [n for n in marks if n[1] <= cutoff and None not in (ns, n[5]) and n[5] <= ns]
    if told:
        end = name(max(told, key=lambda n: (n[5], n[1])))
    first = min((n for n in marks if name(n) == end), key=lambda n: n[1], default=None)
    if first and None not in (ns, first[5]) and ns < first[5]:
        end, reason = None, "before_copied_boundary"
    return end, reason, graph, "recorded" if told else "pointers"


@pytest.mark.parametrize("seed", range(4))
def test_boundaries_against_a_walk(spark, seed):
    rng = random.Random(seed)
    nodes, asked = [], []
    for file in ("a", "b", "c"):
        names = [f"u{k}" for k in range(rng.choice([4, 12, 40]))]
        for line in range(1, 61):
            at = rng.choice([None, line * 10, line * 10, rng.randrange(600)])
            to = rng.choice([None, "gone", *names, *names, *names])
            nodes.append((file, line, rng.choice([None, *names, *names]), to, rng.random() < 0.08, at))
        for _ in range(40):
            one = (file, rng.randrange(0, 64), rng.choice([None, "gone", *names]), rng.choice([None, rng.randrange(650)]))
            asked.append((str(len(asked)), *one))
    got = boundaries.boundaries(spark.createDataFrame(nodes, NODES), spark.createDataFrame(asked, ASKED)).collect()
    assert len(got) == len(asked)
    found = {r.id: (r.boundary, r.reason, r.graph_boundary, r.basis) for r in got}
    for a in asked:
        assert found[a[0]] == walked(nodes, a), a


def test_long_chains_and_empty_transcripts(spark):
    chain = spark.range(1, 3001).select(
        F.lit("a").alias("file"), F.col("id").alias("line"), F.col("id").cast("string").alias("uid"),
        F.when(F.col("id") > 1, (F.col("id") - 1).cast("string")).alias("parent"), F.lit(False).alias("compaction"),
        F.lit(None).cast("long").alias("ns"),
    )
    asked = spark.createDataFrame([("x", "a", 3000, "3000", 1)], ASKED)
    assert [r.boundary for r in boundaries.boundaries(chain, asked).collect()] == ["initial:1"]
    nothing = boundaries.boundaries(chain.limit(0), asked).collect()
    assert [(r.boundary, r.reason) for r in nothing] == [(None, "absent")]


def test_contents_fall_into_half_open_windows(spark):
    contents = spark.createDataFrame(
        [("a", "b", 1), ("c", "b", 5), ("d", "b", 9), ("e", "b", None), ("f", "z", 5)], "content_id string, boundary string, ns long"
    )
    windows = spark.createDataFrame(
        [("w", "b", None, 5), ("x", "b", 5, None), ("y", "q", None, None)],
        "window_id string, boundary string, since_ns long, until_ns long",
    )
    got = boundaries.contents_of_windows(contents, windows).collect()
    assert sorted((r.window_id, r.content_id) for r in got) == [("w", "a"), ("x", "c"), ("x", "d")]


def test_summaries_already_told(spark):
    fact = "run string, field string, role string, at long, phase string, value string"
    notes = spark.createDataFrame(
        [("a", "x", "p", 1, None, "v", "s"), ("a", "process_exit", None, 1, "e", "0", "cell"), ("a", "y", "", 1, None, None, "s"),
         ("c", "x", "p", 1, None, "v", "s"), ("d", "x", "p", 1, None, "v", "s")],
        fact + ", scope string",
    )
    asked = spark.createDataFrame(
        [("a", "x", "p", 1, None, "v", True, False), ("a", "process_exit", "cell", 1, "e", "0", True, False),
         ("a", "y", "unspecified", 1, None, None, True, False), ("a", "z", "p", None, None, None, False, False),
         ("b", "x", "p", 1, None, "v", True, False), ("c", "x", "p", 1, None, "v", True, False),
         ("c", "x", "p", 2, None, "v", True, False), ("d", "x", "p", 1, None, "v", True, True)],
        fact + ", has_value boolean, conflicting boolean",
    )
    got = {(r.run, r.field): r.told for r in evidence.already_told(asked, notes).collect()}
    assert got == {("a", "x"): True, ("a", "process_exit"): True, ("a", "y"): True, ("a", "z"): True, ("b", "x"): False,
                   ("c", "x"): False, ("d", "x"): False}
    assert evidence.already_told(asked.limit(0), notes).count() == 0
