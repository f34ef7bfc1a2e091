"""What queries do at size: work that is done once, and results that do not depend on how rows are dealt."""

import re
from collections import Counter
from random import Random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from loomtrace.operators import detectors, messages, observe, repeats, run_facts, trees
from loomtrace.plans import catalog
from loomtrace.plans import observed as plans_observed
from loomtrace.plans import rollouts as plans_rollouts
from loomtrace.plans import trees as plans_trees
from loomtrace.sources import rollouts
from loomtrace.sources.bridge import Frames


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_paragraph_signatures_stay_within_a_document_and_are_worked_out_once(spark, tmp_path):
    one, two = "alpha beta gamma delta epsilon zeta eta theta iota", "kappa lambda omicron sigma upsilon omega alpha beta"
    rows = [(7, f"{one}\n{two}"), (7, f"{two}\nshort\n{one}"), (8, one), (9, None), (None, two), (None, one), (10, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.queries()["paragraph_signatures"](spark, str(tmp_path))
    got = df.collect()
    assert [(r.doc_id, r.pos) for r in got] == [(7, 1), (7, 1)] and got[0].similarity == got[1].similarity
    assert physical(df).count("xxhash64") == 1 and "Exchange" not in physical(df)


def test_usage_lines_are_built_and_read_once(spark, monkeypatch):
    f = Frames(spark, SMOKE_DIR)
    with monkeypatch.context() as m:
        m.setattr(plans_trees, "stored", lambda df, label: df)
        log = plans_trees._usage_lines(f)
    assert len(re.findall(r"FileScan parquet [^\n]*l_orderkey", physical(log))) == 1
    lines = spark.createDataFrame(
        [("t", 1, '{"type":"session_meta","payload":{"id":"t"}}'),
         ("t", 2, '{"type":"token_usage_record","payload":{"thread_id":"t","session_id":"t","usage":{"input_tokens":"3","output_tokens":4.0}}}'),
         ("t", 3, '{"type":"token_usage_record","payload":"odd"}'), ("t", 4, '{"token_usage_record": ')],
        "file string, line long, value string",
    )
    found = trees.records(lines, trees.threads(lines))
    assert "get_json_object" not in physical(found) and physical(found).count("from_json") == 1
    got = {r.line: r for r in found.collect()}
    assert sorted(got) == [2, 3] and (got[2].why, got[2].input_tokens, got[2].output_tokens) == (None, 3, 4)
    assert (got[3].why, got[3].input_tokens) == ("other_thread", None)


def test_rollout_lines_are_parsed_once(spark):
    log = plans_rollouts._log(Frames(spark, SMOKE_DIR))
    assert physical(rollouts._lines(log).filter("role IS NOT NULL")).count("from_json") == 1
    odd = spark.createDataFrame([("a", 1, "{broken"), ("a", 2, None), ("a", 3, '{"type":"token_usage_record"}')], "file string, line long, value string")
    assert [(r.line, r.role) for r in rollouts._lines(odd).orderBy("line").collect()] == [(1, None), (2, None), (3, "usage")]


def test_facts_of_runs_are_worked_out_once(spark):
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "mystery"), (4, "run finished\nhost 1.0 hitch 3 ms")], "id long, t string")
    df = run_facts.facts(texts, "id", "t")
    assert physical(df).count("watcher_end") == 1
    assert [(r.id, r.field, r.value) for r in df.orderBy("id", "line").collect()] == [(4, "watcher_end", "true"), (4, "hitch_ms", "3")]
    assert {r.id: r.unparsed_lines for r in run_facts.completeness(texts, "id", "t").collect()} == {1: 0, 2: 0, 3: 1, 4: 0}


def test_paths_of_one_last_part_do_not_meet(spark, tmp_path):
    paths = ["i.html", "a/i.html", "b/a/i.html", "c/i.html", "x//i.html", "/i.html", "x/", "y/x/", "x", "i.html?q=1", "a/i.html#t"]
    urls = [(f"http://h.org/{p}",) for p in paths] + [(None,), ("odd",)]
    spark.createDataFrame(urls, "url string").write.parquet(f"{tmp_path}/pages.parquet")
    df = catalog.queries()["path_touch_join"](spark, str(tmp_path))
    known = {p.split("?")[0].split("#")[0] for p in paths}
    want = {a: sum(a == b or a.endswith("/" + b) or b.endswith("/" + a) for b in known) for a in known}
    assert {r.path: r.touching for r in df.collect()} == want
    assert "endswith" not in physical(df).lower()


def test_repeated_guidance_shuffles_no_text_and_compares_sets(spark):
    one, two, rare = "never push to main " * 6, "always  run the tests " * 6, "only told here " * 7
    rows = [(1, one), (1, one), (1, two), (2, f"{two}\n{one}"), (3, rare), (3, rare), (4, None)]
    texts = spark.createDataFrame(rows, "id long, t string")
    df = messages.repeated_guidance(texts, "id", "t")
    got = df.collect()
    assert [(r.messages, r.first_message, r.last_message, r.paragraphs, r.chars) for r in got] == [(2, 1, 2, 2, 113 + 125)]
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", physical(df))
    assert moved and not any("_p#" in keys for keys in moved) and "_digest#" in moved[-1]


@pytest.mark.parametrize("least", [1, 2, 3, 4])
def test_grams_that_are_too_rare_are_never_made(spark, least):
    draw, rows = Random(least), []
    for agent in (1, 2, None):
        shapes = [draw.choice(["a", "b", "b", "c"]) for _ in range(60)] + ["a", "b", "c", "a", "b", "c"] * 4
        rows += [(1, agent, k, x, None) for k, x in enumerate(shapes)]
    frame = spark.createDataFrame(rows, "session long, agent long, aseq long, category string, server string")
    want = Counter()
    for agent in (1, 2, None):
        shapes = [f"{r[3]}:-" for r in rows if r[1] == agent][-50:]
        grams = [tuple(shapes[i : i + n]) for n in (2, 4, 6) for i in range(len(shapes) - n + 1)]
        want.update((agent, ">".join(g)) for g in grams if len(set(g)) > 1)
    got = detectors.ngram_counts(frame, (2, 4, 6), least, 50)
    assert {(r.agent, r.gram): r.occurrences for r in got.collect()} == {k: n for k, n in want.items() if n >= least}
    if least > 1:
        assert "_often" in physical(got)


def test_all_findings_work_out_calls_once(spark):
    f = Frames(spark, SMOKE_DIR)
    texts = f.table("documents").select("doc_id", "text").toDF("message", "text")
    plan = physical(detectors.all_findings(f.calls, texts))
    assert "FileScan" in plan and "event_id" not in plan
    # patterns of an agent are compared with each other, not joined with themselves
    rows = [(1, a, k, x, None) for a in (1, None) for k, x in enumerate("abc" * 4)]
    frame = spark.createDataFrame(rows, "session long, agent long, aseq long, category string, server string")
    found = detectors.mined_patterns(frame)
    assert "Join" not in physical(found)
    # where the agent is not known, what a longer one holds stays, but for rotations of one length
    got = {(r.agent, r.n, r.uses) for r in found.collect()}
    assert (1, 3, 4) in got and (1, 2, 4) not in got and (None, 2, 4) in got


def test_findings_mine_all_calls_and_keep_all_patterns(spark):
    # what recurs lies before an agent's last 2000 calls, and there are more than ten patterns
    shapes = [c for k in range(12) for _ in range(3) for c in ("read", f"mcp{k}")] + ["shell"] * 2_100
    rows = [("s", "a", k, x) for k, x in enumerate(shapes)]
    frame = spark.createDataFrame(rows, "session string, agent string, aseq long, category string")
    calls = frame.withColumn("server", F.lit(None).cast("string"))
    pairs = lambda found: {frozenset(r.gram.split(">")) for r in found.collect() if r.n == 2}
    assert pairs(detectors.mined_patterns(calls)) == set()
    every = pairs(detectors.mined_patterns(calls, top=None, last_calls=None))
    assert every == {frozenset(("read:-", f"mcp{k}:-")) for k in range(12)}
    assert detectors.mined_patterns(calls, last_calls=None).count() == 10


def test_query_from_logs_mines_all():
    sql = catalog.oracle_sql()
    assert "back <= 2000" not in sql["findings_from_logs"] and "place <= 10" not in sql["findings_from_logs"]
    assert "back <= 2000" in sql["findings_of_batches"] and "back <= 2000" in sql["ngram_mined"]


def test_events_are_shuffled_once_and_lines_are_packed(spark, tmp_path, monkeypatch):
    written, keep = [], observe.stored
    monkeypatch.setattr(observe, "stored", lambda df, label, *more: (written.append((label, physical(df))), keep(df, label, *more))[1])
    f = Frames(spark, SMOKE_DIR)
    payloads, events = plans_observed._read(f)
    observe.from_hooks(events)
    # copies are left out, calls paired and numbered in one shuffle
    (label, plan), = written
    assert label == "paired-calls" and plan.count("Exchange ") == 1
    assert all(x.endswith(".gz") for x in payloads.inputFiles()) and any("zstd" in x for x in events.inputFiles())


def test_a_call_alone_is_not_judged(spark):
    rows = [("s", "a", k, "shell", x, "0", k) for k, x in enumerate("xyzxyx")]
    frame = spark.createDataFrame(rows, "session string, agent string, seq long, tool string, target string, params string, aseq long")
    none = ["server", "content_fp", "epoch", "emitter"]
    calls = frame.withColumns({c: F.lit(None).cast("string") for c in none} | {
        "category": F.lit("shell"), "status": F.lit("success"), "start_ns": F.col("seq") * 10**10, "end_ns": F.col("seq") * 10**10
    })
    inputs = spark.createDataFrame([("s", "a", 35 * 10**9), ("s", "b", 0)], "session string, agent string, ns long")
    got = repeats.verdicts(calls, inputs)
    assert [(r.target, r.calls, r.round_trips, r.n_new_input) for r in got.collect()] == [("x", 3, 2, 1)]
    pairs = {(r.target, r.seq): r.reason for r in repeats.reasons(calls, inputs).collect()}
    assert pairs == {("x", 3): "possible_change", ("y", 4): "new_input", ("x", 5): "new_input"}
