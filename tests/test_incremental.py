"""Analysis of touched sessions only: batches against all at once, repeated batches, sessions that become empty."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomtrace.operators import observe
from loomtrace.sources import logs, store
from loomtrace.streaming import analysis
from test_observed import Session

CLIENT = "claude-code"


def lines_of(spark, rows):
    return spark.createDataFrame([(json.dumps(x),) for x in rows], "value string")


def shown(rows):
    return sorted((r.session_id, r.rule, r.subject, r.n, r.confidence) for r in rows.collect())


def test_batches_give_what_all_lines_give(spark, tmp_path):
    one, two, quiet = Session("one"), Session("two"), Session("quiet")
    for _ in range(4):
        one.bash("python run.py", error="Exit code 1: boom")
    two.read("a.py", "x"), two.read("a.py", "x")
    quiet.read("b.py", "x")
    every = one.lines + two.lines + quiet.lines
    project = str(tmp_path / "p")
    # the second batch brings the rest of one session, and lines that came before once more
    first, second = one.lines[:6] + two.lines + quiet.lines, one.lines[4:]
    assert analysis.take(lines_of(spark, first), 0, project, CLIENT) == 3
    after_first = shown(analysis.findings(spark, project))
    assert [x[0] for x in after_first] == ["two"]
    assert analysis.take(lines_of(spark, second), 1, project, CLIENT) == 1
    got = shown(analysis.findings(spark, project))
    events = logs.hook_events(logs.captured(lines_of(spark, every)), CLIENT)
    whole = observe.findings(observe.from_hooks(events), observe.inputs_of(events))
    assert got == shown(whole.withColumn("session_id", F.split_part("session", F.lit("/"), F.lit(2))))
    assert any(x[:2] == ("one", "B") for x in got)
    revisions = {r.session_id: r.revision for r in spark.read.parquet(f"{project}/findings").collect()}
    assert revisions == {"one": 2, "two": 1, "quiet": 1}
    # a batch that comes again changes nothing
    assert analysis.take(lines_of(spark, second), 1, project, CLIENT) == 0
    assert shown(analysis.findings(spark, project)) == got
    # one that failed before it was published is finished when it comes again
    late = Session("late")
    late.read("c.py", "x"), late.read("c.py", "x")
    events = logs.hook_events(logs.captured(lines_of(spark, late.lines)), CLIENT).withColumn("batch", F.lit(2).cast("long"))
    store.append(events, f"{project}/events")
    assert analysis.take(lines_of(spark, late.lines), 2, project, CLIENT) == 1
    assert ("late", "A") in [x[:2] for x in shown(analysis.findings(spark, project))]
    state = spark.read.parquet(f"{project}/state").filter("batch = 2")
    assert sorted(r.session_id for r in state.collect()) == ["late", "one", "quiet", "two"]


def test_findings_that_later_lines_explain_go(spark, tmp_path):
    """Two equal reads are a finding until a line that comes late tells of an edit between them."""
    one = Session("s")
    one.read("a.py", "x")
    at = len(one.lines)
    one.edit("a.py")
    edit = one.lines[at:]
    one.read("a.py", "x")
    project = str(tmp_path / "p")
    before = [x for x in one.lines if x not in edit]
    assert analysis.take(lines_of(spark, before), 0, project, CLIENT) == 1
    assert [x[1] for x in shown(analysis.findings(spark, project))] == ["A"]
    assert analysis.take(lines_of(spark, edit), 1, project, CLIENT) == 1
    assert shown(analysis.findings(spark, project)) == []


def test_empty_and_broken_batches(spark, tmp_path):
    project = str(tmp_path / "p")
    assert analysis.take(spark.createDataFrame([], "value string"), 0, project, CLIENT) == 0
    assert analysis.take(spark.createDataFrame([("{broken",), ("[]",)], "value string"), 1, project, CLIENT) == 0


def test_an_analysis_without_rows_is_published(spark, tmp_path):
    path = str(tmp_path / "calls")
    state = spark.createDataFrame([("c", "a", 3), ("c", "b", 3)], "client string, session_id string, revision long")
    rows = "client string, session_id string, revision long, n long"
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    store.publish(spark.createDataFrame([("c", "a", 1, 7), ("c", "b", 1, 8)], rows), state, path)
    seen = lambda: sorted((r.session_id, r.n) for r in store.published(spark.read.parquet(path)).collect())
    assert seen() == [("a", 7), ("b", 8)]
    none, analysed = spark.createDataFrame([], rows), spark.createDataFrame(
        [("c", "a", 2), ("c", "x", 1)], "client string, session_id string, revision long"
    )
    refused = store.publish(none, state, path, analysed).collect()
    assert [tuple(r) for r in refused] == [("c", "x", 1)]
    assert seen() == [("b", 8)]
    assert {r.session_id: r.analysed for r in store.pending(state, spark.read.parquet(path)).collect()} == {"a": 2, "b": 1}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def test_calls_are_numbered_without_a_task_that_sees_a_session(spark):
    """Places in a session are counted by stretches of time, copies of events are left out with the pairing, and runs of
    calls need no sort of a session."""
    from loomtrace.operators import detectors

    one = Session("one")
    for k in range(30):
        one.read(f"{k}.py", "x")
    events = logs.hook_events(logs.captured(lines_of(spark, one.lines + one.lines[:20])), CLIENT)
    calls = observe.from_hooks(events)
    rows = calls.orderBy("start_ns", "agent", "call_id").collect()
    assert [r.seq for r in rows] == list(range(len(rows))) and len(rows) == 30
    assert not any(r.duplicate_phases for r in rows)
    plan = detectors.batch_runs(calls)._jdf.queryExecution().optimizedPlan().toString()
    # the sizes of stretches, few beside the calls, are summed by session
    windows = [x for x in plan.splitlines() if "Window" in x and "_size" not in x]
    assert windows and not [x for x in windows if x.split("], [")[1].count("#") == 1 and "session" in x.split("], [")[1]]


def test_a_batch_copies_no_events_and_works_out_findings_once(spark, tmp_path, monkeypatch):
    written, keep = [], analysis.stored
    monkeypatch.setattr(analysis, "stored", lambda df, label, *more: (written.append(label), keep(df, label, *more))[1])
    one = Session("one")
    one.read("a.py", "x"), one.read("a.py", "x")
    assert analysis.take(lines_of(spark, one.lines), 0, str(tmp_path / "p"), CLIENT) == 1
    assert written == ["batch-events", "touched-sessions", "pending-sessions", "batch-findings"]
