"""Facts of run outputs, and the smaller operators of services, publishing, ranks and health."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import compare, detectors, messages, run_facts
from loomtrace.sources import store


def facts_of(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    rows = run_facts.facts(df, "id", "t").orderBy("block", "line").collect()
    end = run_facts.completeness(df, "id", "t").first()
    return rows, end.unparsed_lines, end.truncated


def values(rows, field):
    return [r.value for r in rows if r.field == field]


def test_events_and_streams(spark):
    rows, odd, cut = facts_of(spark, """host   169.8 hitch 104864 ms 104864 ms
host 9.2 ok carte Island apres0.1s(ListenServer)
host 9.5 ok arrivee admise apres0.3s
======================== host
169.8 HITCH 104864 ms
9.3 STREAM carte_chargee prof=Region in=True out=True lv=35 MB=5014 maxFrame=6719ms
10.0 FAIL une raison conservee
11.0 END failures=2
""")
    assert (odd, cut) == (0, False)
    hitches = [r for r in rows if r.field == "hitch_ms"]
    assert [(r.value, r.role, r.at) for r in hitches] == [("104864", "host", 169.8)] * 2
    first, second = (json.loads(x) for x in values(rows, "arrival"))
    assert first == {"kind": "map_loaded", "map": "Island", "after_s": 0.1, "mode": "ListenServer"} and second == {
        "kind": "arrival_admitted", "after_s": 0.3
    }
    assert values(rows, "stream.MB") == ["5014"] and values(rows, "stream.maxFrame_ms") == ["6719"] and values(
        rows, "stream.in"
    ) == ["True"]
    assert [r.phase for r in rows if r.field == "stream.lv"] == ["carte_chargee"]
    assert values(rows, "tests_failed") == ["2"] and values(rows, "failure_event") == [
        "une raison conservee"
    ] and values(rows, "run_end") == ["true"]


def test_counters_ends_and_cuts(spark):
    rows, _, _ = facts_of(
        spark, "host 11.0 fail walkto : encore a 13 m\nhost 12.0 end 0 echec(s)\n13.0 PENDING P3 unplaced=0"
    )
    assert values(rows, "tests_failed") == ["0"] and values(rows, "pending.unplaced") == ["0"] and [
        r.phase for r in rows if r.field == "pending.unplaced"
    ] == ["P3"]
    rows, odd, _ = facts_of(spark, "run finished\nsomething odd\n\n")
    assert values(rows, "watcher_end") == ["true"] and not values(rows, "run_end") and odd == 1
    rows, odd, cut = facts_of(spark, "host 2.0 hitch 12 ms\noutput truncated\nhost 3.0 END ...")
    assert cut and odd == 0 and values(rows, "hitch_ms") == ["12"] and values(rows, "run_end") == [
        "true"
    ] and not values(rows, "event_text")


def test_summaries_and_notifications(spark):
    rows, odd, _ = facts_of(
        spark,
        json.dumps({"status": "completed", "exit_code": 0, "end": True, "failures": 0, "unrelated": "x"}, indent=1),
    )
    assert sorted((r.field, r.value) for r in rows) == [
        ("process_exit", "0"), ("process_status", "completed"), ("run_end", "true"), ("tests_failed", "0")
    ] and odd == 0
    rows, _, _ = facts_of(spark, '{"failures":[],"ended":true,"exitcode":0}')
    assert values(rows, "failure_details") == ["[]"] and not values(rows, "tests_failed")
    rows, odd, _ = facts_of(spark, """<system-reminder>
status=success and exit_code=0 are no events here
<task-notification>
<summary>Monitor: prose; exit_code=7</summary>
<event>client 18.4 ok arrivee admise apres 3.7 s</event>
<status>running</status>
</task-notification>
</system-reminder>""")
    assert values(rows, "process_exit") == ["7"] and values(rows, "process_status") == ["running"] and odd == 0
    assert [(r.role, r.at) for r in rows if r.field == "arrival"] == [("client", 18.4)]
    rows, _, _ = facts_of(spark, "<summary>process ended (exit code 0)</summary>")
    assert values(rows, "process_exit") == ["0"]
    empty = spark.createDataFrame([(1, None), (2, "")], "id long, t string")
    assert run_facts.facts(empty, "id", "t").count() == 0 and run_facts.completeness(empty, "id", "t").count() == 2


def test_services_driven_by_hand(spark):
    def call(session, command, status="success"):
        return (session, 1, "shell", command, status, 0)

    rows = [
        call(1, "ssh node7 'squeue -u me'"),
        call(1, "scp job.sh node7:/home/me/"),
        call(1, "ssh node7 'sbatch job.sh'"),
        call(1, "ls ~/.ssh"),
    ]
    rows += [call(2, "curl -s https://svc.example/health")] * 3 + [
        call(3, "gh pr view 1", "error" if k == 1 else "success") for k in range(3)
    ] + [call(4, "squeue -u me")] * 3 + [call(5, "docker ps")] * 6
    calls = spark.createDataFrame(
        rows, "session long, agent long, category string, command string, status string, start_ns long"
    )
    servers = spark.createDataFrame(
        [(1, "node7", "status"), (4, "hub", "submit_job"), (5, "hub", "submit_job")],
        "session long, server string, tool string",
    )
    got = {r.session: r for r in detectors.service_gap(calls, servers).collect()}
    assert {k: (r.family, r.target, r.n, r.confidence, r.related) for k, r in got.items()} == {
        1: ("ssh", "node7", 3, "high", ["node7"]), 2: ("http", "svc.example", 3, "low", []),
        3: ("github", "github", 3, "medium", []),
        4: ("slurm", "slurm", 3, "high", ["hub"]), 5: ("container", "docker", 6, "medium", []),
    }
    assert got[1].heads == ["scp", "ssh"]


def test_publishing_by_revision(spark, tmp_path):
    path = str(tmp_path / "calls")
    state = spark.createDataFrame(
        [("c", "a", 2), ("c", "b", 5), ("c", "d", 1)], "client string, session_id string, revision long"
    )
    first = spark.createDataFrame(
        [("c", "a", 2, "x"), ("c", "b", 5, "y"), ("c", "b", 5, "z")],
        "client string, session_id string, revision long, call string",
    )
    assert store.publish(first, state, path).count() == 0
    again = spark.createDataFrame(
        [("c", "b", 5, "w"), ("c", "a", 9, "stale"), ("c", "?", 1, "q")],
        "client string, session_id string, revision long, call string",
    )
    assert sorted((r.session_id, r.revision) for r in store.publish(again, state, path).collect()) == [
        ("?", 1), ("a", 9)
    ]
    held = spark.read.parquet(path)
    assert sorted((r.session_id, r.call) for r in held.collect()) == [("a", "x"), ("b", "w")]
    newer = spark.createDataFrame([("c", "a", 3), ("c", "b", 5), ("c", "d", 1)], state.schema)
    assert sorted((r.session_id, r.analysed) for r in store.pending(newer, held).collect()) == [("a", 2), ("d", None)]


def test_marks_keys_and_health(spark):
    schema = "finding string, mark string, note string, at_ns long"
    marks = spark.createDataFrame([("f1", "useful", None, 1), ("f2", "noise", "n", 1)], schema)
    changes = spark.createDataFrame([("f1", None, None, 2), ("f2", "useful", "m", 2), ("f3", "noise", None, 2)], schema)
    assert sorted((r.finding, r.mark) for r in store.marked(marks, changes).collect()) == [
        ("f2", "useful"), ("f3", "noise")
    ]
    keys = [
        r[0]
        for r in spark.createDataFrame([("plain-1",), ("a/b",), ("x" * 80,), (None,)], "s string").select(
            store.session_key(F.col("s"))
        ).collect()
    ]
    assert keys[0] == "plain-1" and keys[1].startswith("a_b-") and len(keys[2]) == 61 and keys[3] == "_no-session"
    fine = dict(
        configured_at=0.0,
        activity_at=100.0,
        received_at=90.0,
        installed=True,
        complete=True,
        disabled=False,
        interpreter_exists=True,
        entry_current=True,
        config_readable=True,
    )
    cases = {
        "fine": {},
        "silent": {"activity_at": 9_000.0},
        "never": {"activity_at": 9_000.0, "received_at": None},
        "partial": {"complete": False, "disabled": True},
        "gone": {"interpreter_exists": False, "config_readable": False},
    }
    names = list(fine)
    rows = [(c, *[(fine | x)[n] for n in names]) for c, x in cases.items()]
    types = ["double" if n.endswith("_at") else "boolean" for n in names]
    df = spark.createDataFrame(
        rows, "client string, " + ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    )
    assert sorted(tuple(r) for r in store.collection_health(df).collect()) == [
        ("gone", "config_unreadable"),
        ("gone", "interpreter_missing"),
        ("never", "never_received"),
        ("partial", "hooks_disabled"),
        ("partial", "hooks_partial"),
        ("silent", "silent_since_activity"),
    ]


def test_rank_agreement(spark):
    rows = [
        (1, "a", 3.0, 30.0),
        (1, "b", 2.0, 20.0),
        (1, "c", 1.0, 20.0),
        (1, "d", 0.5, 1.0),
        (2, "a", 1.0, 5.0),
        (2, "b", 1.0, 6.0),
        (3, "a", 0.0, 1.0),
        (3, "b", 0.0, 2.0),
    ]
    got = {
        r.g: r
        for r in compare.rank_agreement(
            spark.createDataFrame(rows, "g long, i string, l double, r double"), ["g"], "i", "l", "r", 2
        ).collect()
    }
    assert got[1].spearman == pytest.approx(0.9486833) and got[1].top_jaccard == pytest.approx(2 / 3)
    assert got[2].spearman is None and got[2].top_jaccard == 1.0
    assert got[3].spearman is None and got[3].top_jaccard is None


def test_words_and_payloads(spark):
    df = spark.createDataFrame(
        [("Relire ÉTÉ les résultats complets du déploiement",), ("the and for",), (None,)], "t string"
    )
    got = [r[0] for r in df.select(messages.useful_words(F.col("t"))).collect()]
    assert got[0] == ["relire", "ete", "result", "comple", "deploi"] and got[1] is None and got[2] is None
    told = spark.createDataFrame([("a  b\n",), ("a b",), ("gAAAA" + "x" * 50,), (" ",)], "t string").select(
        *[c.alias(n) for n, c in messages.payload_facts(F.col("t")).items()]
    ).collect()
    assert told[0].payload_fp == told[1].payload_fp and told[2].encrypted and not told[0].encrypted and told[
        3
    ].payload_fp is None
    kind, body = messages.received_payload(F.col("t"))
    r = spark.createDataFrame([("Message Type: NEW_TASK\nPayload:\ndo it",)], "t string").select(kind, body).first()
    assert tuple(r) == ("NEW_TASK", "do it")
