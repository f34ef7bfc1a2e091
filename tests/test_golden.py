"""Numbers that are known for small cases."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.functions import shell, text
from loomtrace.operators import compare, detectors, evidence, forecast, graph, metrics, repeats, usage, windows
from loomtrace.plans import evidence as evidence_plans

NS = 10**9
CALLS = (
    "session long, agent long, call_id long, tool string, category string, server string, target string, params long, "
    "status string, content_fp long, start_ns long, end_ns long, duration_ms long, bytes long, epoch long, seq long, "
    "aseq long, emitter long"
)


def calls(spark, rows):
    """Calls from dicts; times in seconds, one agent unless said."""
    out = []
    for k, r in enumerate(rows):
        d = {
            "session": 1,
            "agent": 1,
            "call_id": k,
            "tool": r.get("category", "read"),
            "category": "read",
            "server": None,
            "target": "t",
            "params": 0,
            "status": "success",
            "content_fp": 1,
            "start_ns": int(r.get("at", k * 10) * NS),
            "duration_ms": 1000,
            "bytes": 10,
            "epoch": 0,
            "seq": k,
            "aseq": k,
            "emitter": k,
        } | {a: b for a, b in r.items() if a != "at"}
        d["end_ns"] = None if d["duration_ms"] is None else d["start_ns"] + d["duration_ms"] * 10**6
        out.append(tuple(d[c.split()[0]] for c in CALLS.split(", ")))
    return spark.createDataFrame(out, CALLS)


def test_tool_metrics(spark):
    rows = [{"server": "s", "tool": "ab"[k % 2], "duration_ms": 10 * k, "bytes": k} for k in range(20)]
    rows += [
        {"server": "s", "tool": "a", "duration_ms": None, "bytes": None, "status": "open"},
        {"server": "s", "tool": "a", "duration_ms": None, "bytes": None, "status": "error"},
    ]
    got = {(r.server, r.tool): r for r in metrics.tool_metrics(calls(spark, rows)).collect()}
    a = got[None, None]
    assert (a.calls, a.measured, a.unmeasured, a.median_ms, a.p95_ms, a.max_ms, a.total_ms, a.output_bytes) == (
        22, 20, 2, 95.0, 180, 190, 1900, 190
    )
    assert a.failure_pct == pytest.approx(100 / 21, abs=1e-6)
    assert (got["s", "a"].p95_ms, got["s", "b"].p95_ms) == (180, 190)
    only_open = metrics.tool_metrics(
        calls(spark, [{"server": "s", "duration_ms": None, "bytes": None, "status": "open"}])
    ).filter("server IS NULL").first()
    assert (
        only_open.median_ms, only_open.p95_ms, only_open.total_ms, only_open.output_bytes, only_open.failure_pct
    ) == (None,) * 5


def test_timeline_and_union(spark):
    c = calls(spark, [{"at": 0, "duration_ms": 3000}, {"at": 1, "duration_ms": 3000}])
    assert windows.active_union(c).first()[1:] == (4 * NS, 6 * NS)
    assert [r.tool_ns // 10**6 for r in windows.timeline(c, NS).orderBy("bucket").collect()] == [1000, 2000, 2000, 1000]


@pytest.mark.parametrize(
    ("delay", "times", "served"),
    [
        (30, [1, 11, 31], [1, 31]),
        (30, [200, 205], [200, 230]),
        (10, [1, 2, 3, 4], [1, 11]),
        (30, [1], [1]),
        (30, [0, 30, 60], [0, 30, 60]),
    ],
)
def test_cooldown(spark, delay, times, served):
    df = spark.createDataFrame([([float(t) for t in times],)], "t array<double>")
    assert df.select(windows.cooldown(F.col("t"), delay)).first()[0] == [float(x) for x in served]


def test_split_exact_adds_up(spark):
    df = spark.createDataFrame(
        [(1, k, 10, w) for k, w in enumerate((1, 1, 1))] + [(2, k, 7, 0) for k in range(2)],
        "g long, k long, total long, w long",
    )
    got = {}
    for r in usage.split_exact(df, "g", "total", "w", "k").collect():
        got.setdefault(r.g, {})[r.k] = r.share
    assert got == {1: {0: 4, 1: 3, 2: 3}, 2: {0: 4, 1: 3}}


def test_rate_ratio(spark):
    def ratio(*v):
        df = spark.createDataFrame(
            [tuple(map(float, v))], "k1 double, n1 double, k2 double, n2 double, c1 double, c2 double"
        )
        return df.select(*[c.alias(n) for n, c in compare.rate_ratio(*map(F.col, df.columns)).items()]).first()

    r = ratio(100, 1000, 50, 1000, 100, 50)
    assert r.ratio == pytest.approx(0.5) and r.high < 1
    r = ratio(20, 1000, 0, 1000, 20, 0)
    assert 0 < r.ratio < r.high < 1
    said = spark.range(1).select(
        compare.conclusion(F.lit(0.5), F.lit(0.9), F.lit(4), F.lit(500), F.lit(9)),
        compare.conclusion(F.lit(0.5), F.lit(0.9), F.lit(40), F.lit(500), F.lit(9)),
        compare.conclusion(F.lit(0.5), F.lit(1.9), F.lit(40), F.lit(500), F.lit(9)),
    ).first()
    assert tuple(said) == ("too_few", "decrease", "no_difference")


def test_slope_of_window_starts(spark):
    rows = []
    for w, (first, before) in enumerate([(40_190, 1_000), (40_570, 3_000), (40_760, 4_000)], start=1):
        rows.append((1, w, w, first, None if w == 3 else [2_000, 1_000][w - 1], "x", 10 * w))
    head = [(1, 0, 0, 5, 1_000, "x", 0)]
    df = spark.createDataFrame(
        head + rows,
        "thread long, ctx long, idx long, input_tokens long, output_tokens long, tier string, response_id long",
    )
    r = usage.window_slope(df).first()
    assert (r.windows, r.slope, r.r) == (3, 0.19, 1.0)


def test_redundant_reads(spark):
    edit, other = {"category": "edit"}, {"category": "search", "target": "x"}
    one = detectors.read_clusters(calls(spark, [{}, other, {}])).collect()
    assert [(r.reads, r.confidence) for r in one] == [(2, "high")]
    assert detectors.read_clusters(calls(spark, [{}, edit, {}])).count() == 0
    assert detectors.read_clusters(calls(spark, [{}, {"content_fp": 2}])).count() == 0
    assert detectors.read_clusters(calls(spark, [{}, {"epoch": 1}])).count() == 0
    assert detectors.read_clusters(calls(spark, [{}, {"agent": 2}])).count() == 0
    assert detectors.read_clusters(calls(spark, [{}, {"at": 2_000}])).count() == 0
    assert [
        r.confidence
        for r in detectors.read_clusters(calls(spark, [{}, {"category": "shell", "target": "y"}, {}])).collect()
    ] == ["medium"]
    broken = detectors.read_clusters(calls(spark, [{}, {}, {"content_fp": 2}, {"content_fp": 2}])).orderBy(
        "first_aseq"
    ).collect()
    assert [(r.reads, r.first_aseq) for r in broken] == [(2, 0), (2, 2)]


def test_named_work_knows_ascii_boundaries_as_its_sql(spark, tmp_path):
    import duckdb

    from loomtrace.plans import catalog

    texts = ["testä", "ätest", "teſt", "test_", "atest", "ötests.", "réview", "éreview", "plané", "éfixe", "runé", "run9", " ſearch",
             "aſearch", "teſtſ", "ßfind", "lancé", "lance", "RUN", "Übertest", "", None, "waité", "ADD", "ßadd"]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    got = {r.conv_id: r.intents for r in catalog.queries()["declared_intents"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = {r[0]: r[2] for r in con.sql(catalog.oracle_sql()["declared_intents"]).fetchall()}
    assert got == want
    assert (got[0], got[1], got[2]) == ("test", "test", "test")


def test_declared_intents(spark):
    said = {
        "Roméo n'est pas encore actif, je retente dans 30 s": ["retry", "unavailable", "wait"],
        "RÉESSAYONS": ["retry"],
        "trying it once more": ["retry"],
        "Connection refused": ["unavailable"],
        "le serveur ne répond pas": ["unavailable"],
        "the build is still running": ["in_progress"],
        "c'est en cours d'exécution": ["in_progress"],
        "Je vais m'assurer du résultat": ["verify"],
        "let me double-check": ["verify"],
        "maintenant que le fichier existe": ["after_change"],
        "after my edit": ["after_change"],
        "je répare": ["fix"],
        "the patch applies": ["fix"],
        "je regarde le code": ["explore"],
        "polling every 5 minutes": ["wait"],
        "surveillance du journal": ["wait"],
        "prefix, dispatch, éfix and breakdown": [],
        "a test plan to review, write and run": [],
        "x" * 3_999 + " again": [],
        "x" * 3_993 + " again": ["retry"],
    }
    df = spark.createDataFrame([(t,) for t in [*said, None]], "t string")
    got = {r.t: r.i for r in df.select("t", text.declared_intents(F.col("t")).alias("i")).collect()}
    assert got == said | {None: []}


def test_failures(spark):
    bad = {"category": "shell", "status": "error"}
    r = detectors.failure_chains(calls(spark, [bad] * 3)).first()
    assert (r.failures, r.kind, r.confidence, r.backoff) == (3, "persistent", "high", False)
    r = detectors.failure_chains(calls(spark, [bad, bad, bad, {"category": "shell"}])).first()
    assert (r.kind, r.confidence) == ("transient_recovered", "low")
    assert detectors.failure_chains(calls(spark, [bad, bad])).count() == 0
    assert detectors.failure_chains(calls(spark, [bad | {"at": t} for t in (0, 10, 30, 70)])).first().backoff
    r = detectors.failures_on_inputs(calls(spark, [bad | {"target": str(k)} for k in range(3)])).first()
    assert (r.failures, r.inputs) == (3, 3)


def test_failures_and_what_came_between(spark):
    bad, run = {"category": "shell", "tool": "run", "status": "error"}, {
        "category": "shell", "tool": "other", "target": "y"
    }
    edit = {"category": "edit", "tool": "edit"}

    def found(rows):
        return [
            (r.failures, r.kind, r.confidence)
            for r in detectors.failure_chains(calls(spark, rows)).orderBy("first_aseq").collect()
        ]

    assert found([bad, bad, bad, edit, bad, bad, bad]) == [(3, "persistent", "high")] * 2
    assert found([bad, bad, edit, bad]) == []
    assert found([bad, bad, bad, edit | {"target": "z"}, bad]) == [(4, "persistent", "high")]
    assert found([bad, edit | {"agent": 2}, bad, bad]) == [(3, "persistent", "high")]
    assert found([bad, run, bad, bad]) == [(3, "persistent", "medium")]
    assert found([run, bad, bad, bad, run]) == [(3, "persistent", "high")]
    assert found([bad | {"status": "denied"}] * 3) == [(3, "repeated_denial", "medium")]
    assert found([edit | {"status": "error"}] * 3) == [(3, "persistent", "high")]
    served = {"category": "mcp", "tool": "a", "server": "s", "status": "error"}
    assert found([served, edit, run, served, {"category": "mcp", "tool": "b", "server": "q"}, served]) == [
        (3, "persistent", "high")
    ]
    assert found([served, {"category": "mcp", "tool": "b", "server": "s"}, served, served]) == [
        (3, "persistent", "medium")
    ]


def test_all_findings_hold_every_rule(spark):
    rows = [
        {"category": x, "target": "t", "status": "error" if x == "shell" else "success"}
        for x in ("shell", "read", "search") * 4
    ]
    rows += [{"target": str(k)} for k in range(3)]
    texts = spark.createDataFrame([(k, "remember this rule " * 8) for k in range(3)], "message long, text string")
    got = detectors.all_findings(calls(spark, rows), texts).collect()
    assert {r.rule for r in got} == set("ABCDEFG")
    assert [(r.session, r.agent, r.n) for r in got if r.rule == "F"] == [(None, None, 3)]
    assert {r.rule for r in detectors.all_findings(calls(spark, rows), texts, ("D",)).collect()} == {"D"}


def test_batches(spark):
    read = [{"target": str(k)} for k in range(3)]
    assert [r.calls for r in detectors.batch_runs(calls(spark, [{"category": "list"}, *read])).collect()] == [3]
    assert detectors.batch_runs(
        calls(spark, [read[0], {"category": "edit"}, read[1], {"category": "edit"}, read[2]])
    ).count() == 0
    assert detectors.batch_runs(calls(spark, [r | {"emitter": 1} for r in read])).count() == 0
    assert detectors.batch_runs(calls(spark, [read[0], {"agent": 2, "aseq": 0, "target": "z"}, *read[1:]])).count() == 0


def test_patterns_do_not_overlap(spark):
    c = calls(spark, [{"category": x} for x in ("shell", "read", "shell") * 4])
    got = {r.gram: r.uses for r in detectors.mined_patterns(c).collect()}
    assert got and max(got.values()) >= 4 and all(len(set(g.split(">"))) >= 2 for g in got)


def test_repeats(spark):
    poll = [{"category": "shell", "at": 20 * k, "content_fp": 1} for k in range(14)]
    r = detectors.repeat_groups(calls(spark, poll)).first()
    assert (r.calls, r.round_trips, r.no_gain, r.median_s, r.verdict, r.confidence) == (
        14, 13, 13, 20.0, "agent", "high"
    )
    useful = [
        x for k in range(4) for x in ({"category": "edit", "target": "f"}, {"category": "shell", "content_fp": k})
    ]
    assert {r.verdict for r in detectors.repeat_groups(calls(spark, useful)).filter("tool = 'shell'").collect()} == {
        "justified"
    }


def test_three_valued_verdicts(spark):
    df = spark.createDataFrame([(True, True), (True, None), (None, False)], "a boolean, b boolean")
    assert [r[0] for r in df.select(graph.validity([F.col("a"), F.col("b")])).collect()] == [
        "admissible", "indeterminate", "rejected"
    ]


def test_bins(spark):
    c = calls(spark, [{"category": x} for x in ["read"] * 5 + ["agent"] + ["edit"] * 8])
    assert [(r.chunk, r.bin, r.reads, r.edits) for r in forecast.bins(c).orderBy("chunk", "bin").collect()] == [
        (0, 0, 4, 0), (1, 0, 0, 4), (1, 1, 0, 4)
    ]


@pytest.mark.parametrize(
    ("command", "kind"),
    [
        ("cat a.txt | grep x", "read"),
        ("git commit -m x", "write"),
        ("cat a > b", "write"),
        ("sed -i s/a/b/ f", "write"),
        ("sed -n 1,5p f", "read"),
        ("python run.py", "run"),
        ("frobnicate", "unknown"),
        ("A=1 sudo ls && git log", "read"),
        ("ls 2>&1", "read"),
        ("", "unknown"),
    ],
)
def test_shell(spark, command, kind):
    assert spark.createDataFrame([(command,)], "c string").select(shell.classify(F.col("c"))).first()[0] == kind


def test_shell_parts(spark):
    commands = [
        "FOO=1 sudo /usr/bin/ls -l a/b.txt",
        "curl -s https://x.y/z | jq .",
        "cd src && squeue -u me",
        "https://x.y/z?token=1 && ls",
        "git",
        "git stash",
        "Get-Content a.md > b.md",
        "tool.exe x",
        "python.exe run.py",
        "  ",
    ]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(commands)], "k int, c string").withColumn(
        "p", shell.parsed(F.col("c"))
    ).orderBy("k")
    got = df.select(
        shell.kind_of(F.col("p")), shell.heads_of(F.col("p")), shell.family_of(F.col("p")), shell.paths(F.col("c"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("read", ["ls"], None, ["a/b.txt"]), ("write", ["curl", "jq"], "http", []),
        ("unknown", ["cd", "squeue"], "slurm", []),
        ("unknown", ["<url>", "ls"], None, []), ("unknown", ["git"], None, []), ("write", ["git"], None, []),
        ("write", ["get-content"], None, ["a.md", "b.md"]),
        ("unknown", ["tool"], None, []), ("run", ["python"], None, ["run.py"]), ("unknown", [], None, []),
    ]


def test_intents(spark):
    from loomtrace.functions import intents

    base = {
        "category": "shell",
        "tool": "Bash",
        "target": None,
        "params": None,
        "server_tool": None,
        "cwd": "/p",
        "project": "/p",
    }
    shells = [
        "cat src/a.py",
        "Get-Content src/a.py",
        "sed -n '1,5p' src/a.py",
        "cat src/a.py | mystery-filter",
        "cd src && cat a.py",
        "cd src && cd .. && cat src/a.py",
        'cd "src" && python -m pytest -q',
        "rg TODO src",
        "pytest tests/test_x.py -q",
        "python -m pytest tests/test_x.py -q",
        "git status",
        "python build.py --release",
        "weird-tool --do things",
        "head -n 5 src/a.py",
        "head -5 src/a.py",
        "make all",
        "python -m pkg.mod x",
        "ls src",
        "cat src/a.py | wc -l",
        "sed s/a/b/ f",
    ]
    rows = [base | {"command": c} for c in shells]
    rows.append(base | {"category": "read", "tool": "Read", "target": "src/a.py", "params": "{}", "command": None})
    rows.append(
        base
        | {
            "category": "mcp",
            "tool": "mcp__s__job_status",
            "server_tool": "job_status",
            "target": None,
            "params": '{"id":1}',
            "command": None,
        }
    )
    rows.append(
        base
        | {
            "category": "mcp",
            "tool": "mcp__s__submit",
            "server_tool": "submit",
            "target": None,
            "params": "{}",
            "command": None,
        }
    )
    schema = (
        "category string, tool string, target string, params string, server_tool string, cwd string, project string, "
        "command string"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    df = spark.createDataFrame([(*[r[n] for n in names], k) for k, r in enumerate(rows)], f"{schema}, k int")
    got = [(r.op, r.op_target, r.op_key) for r in intents.with_intent(df).orderBy("k").collect()]
    keys = [k for *_, k in got]
    assert keys[0] == keys[1] == keys[4] == keys[5] == keys[20] and len(
        {keys[0], keys[2], keys[13], keys[18]}
    ) == 4 and keys[13] == keys[14]
    assert [o for o, *_ in got] == [
        "read",
        "read",
        "read",
        "unknown",
        "read",
        "read",
        "run_tests",
        "search",
        "run_tests",
        "run_tests",
        "vcs_read",
        "run_script",
        "unknown",
        "read",
        "read",
        "build",
        "run_script",
        "list",
        "read",
        "unknown",
        "read",
        "mcp_read",
        "mcp",
    ]
    assert (got[7][1], got[11][1], got[16][1]) == ("src", "build.py", "module:pkg.mod")
    assert keys[8] == keys[9] and "/p/src" in keys[6]


def test_hypotheses_and_proofs(spark):
    got = spark.createDataFrame(
        [("Permission denied (publickey), ssh session",), ("odd",), (None,)], "s string"
    ).select(text.hypotheses(F.col("s"))).collect()
    assert [len(r[0]) for r in got] == [4, 1, 1] and got[1][0] == [text.NO_HINT] and got[2][0] == [text.NO_SIGNATURE]
    rows = [
        ("doc", "seen", [("a" * 64, "f", 1, 2)]),
        ("doc", " ", [("a" * 64, "f", 1, 2)]),
        ("doc", "seen", []),
        ("doc", "seen", [("xyz", "f", 1, 2)]),
        ("other", "seen", [("a" * 64, "f", 1, 2)]),
        ("doc", "seen", [("a" * 64, "f", 3, 2)]),
        (None, None, None),
    ]
    df = spark.createDataFrame(
        rows, "k string, b string, s array<struct<sha256:string,locator:string,line_start:int,line_end:int>>"
    )
    assert [r[0] for r in df.select(text.is_proof(F.col("k"), F.col("b"), F.col("s"), ("doc", "test"))).collect()] == [
        True
    ] + [False] * 6
    home = spark.createDataFrame([("see /home/me/x and token=abcdefgh",)], "t string").select(
        text.scrubbed(F.col("t"), "/home/me", 12)
    ).first()[0]
    assert home == "see ~/x and …"


@pytest.mark.parametrize(
    ("command", "host"),
    [
        ("ssh -p 2222 -i k node7 'squeue'", "node7"),
        ("scp ./job.sh u@node7.example.org:/x", "node7.example.org"),
        ("curl -s https://api.github.com/r", "api.github.com"),
        ("ls", None),
    ],
)
def test_service_target(spark, command, host):
    assert spark.createDataFrame([(command,)], "c string").select(shell.service_target(F.col("c"))).first()[0] == host


def test_text_functions(spark):
    row = spark.createDataFrame(
        [
            (
                r"Exit code 7: curl: (7) Failed to connect to C:\x\y port 443",
                "https://h.com/p/a?token=abc#f",
                r"'a\b/./c//../d'",
                "*** Update File: a.py \n*** Add File: b c\nx",
                "token=abc, Bearer abcdefghijk",
            )
        ],
        "e string, u string, p string, d string, s string",
    )
    got = row.select(
        text.error_signature(F.col("e")),
        text.strip_url(F.col("u")),
        text.normalize_path(F.col("p")),
        text.patch_paths(F.col("d")),
        text.mask_secrets(F.col("s")),
    ).first()
    assert got[0] == "Exit code <n>: curl: (<n>) Failed to connect to <path> port <n>"
    assert got[1] == "https://h.com/p/a" and got[2] == "a/b/d" and got[3] == ["a.py", "b c"] and got[
        4
    ] == "<secret>, <secret>"


def test_hmac(spark):
    import hashlib
    import hmac

    got = spark.createDataFrame([("key", "message"), ("k" * 64, "é")], "k string, m string").select(
        text.hmac_sha256(F.col("k").cast("binary"), F.col("m"))
    ).collect()
    assert [r[0] for r in got] == [
        hmac.new(k.encode(), m.encode(), hashlib.sha256).hexdigest() for k, m in (("key", "message"), ("k" * 64, "é"))
    ]


def test_parameters(spark):
    from loomtrace.functions import tools

    rows = [
        ({"path": "a", "body": "secret text", "delay_ms": "1500", "wait_s": "3", "timeout_s": "99"},),
        ({"body": "other", "wait_s": "7"},),
        ({},),
    ]
    df = spark.createDataFrame(rows, "m map<string,string>")
    got = df.select(
        tools.pick_params(F.col("m"), ["path"]).alias("p"),
        tools.requested_delay(F.col("m")).alias("d"),
        tools.comparison_key(F.col("m")).alias("k"),
    ).collect()
    assert set(got[0].p) == {"path", "body_fp", "delay_ms", "wait_s", "timeout_s"} and len(got[0].p["body_fp"]) == 10
    assert [r.d for r in got] == [3.0, 7.0, None]
    assert got[0].k == '{"body":"secret text","path":"a"}' and got[1].k == '{"body":"other"}'
    times = spark.createDataFrame([(7500.0,), (187.0,), (4.24,), (None,)], "s double").select(
        tools.format_duration(F.col("s"))
    ).collect()
    assert [r[0] for r in times] == ["2 h 05 min", "3 min 07 s", "4.2 s", None]


def test_results(spark):
    from loomtrace.functions import results

    same = spark.createDataFrame([("a  \r\nb\n",), ("a\nb",), ("  ",)], "t string").select(
        results.content_fingerprint(F.col("t"))
    ).collect()
    assert same[0][0] == same[1][0] and same[2][0] is None
    states = [
        r[0]
        for r in spark.createDataFrame(
            [
                ("job 12 RUNNING since 12:00:01, 3 min",),
                ("job 12 RUNNING since 12:05:44, 8 min",),
                ("job 12 DONE",),
                (" ",),
            ],
            "t string",
        ).select(results.state_fingerprint(F.col("t"))).collect()
    ]
    assert states[0] == states[1] != states[2] and states[3] == "empty"
    phases = [
        ('{"status": "RUNNING"}', "success", "in_progress"),
        ('{"state":"COMPLETED"}', "success", "done"),
        ('{"status":"failed"}', "success", "failed"),
        ("connection refused", "success", "unavailable"),
        ("still waiting", "success", "in_progress"),
        ("hello", "success", "done"),
        ("hello", "error", "failed"),
        (None, None, "unknown"),
        ('{"error": "not active yet"}', "success", "unavailable"),
        ('{"data": {"connected": false}}', "success", "unavailable"),
        ('{"timed_out": true, "status": {}}', "success", "in_progress"),
        ("the job is still running", "success", "in_progress"),
        ("le service n'est pas lancé", "success", "unavailable"),
    ]
    assert [
        r[0]
        for r in spark.createDataFrame(phases, "t string, s string, w string").select(
            results.phase(F.col("t"), F.col("s"))
        ).collect()
    ] == [p[2] for p in phases]
    hidden = [
        ('{"erreur": null, "x": 1}', None),
        ('{"error": "boom"}', "error: boom"),
        ('{"a": {"status": "failed"}}', "status: failed"),
        ('[{"a": [{"result": "Crashed"}]}]', "result: Crashed"),
        ("all fine", None),
        ("ok\nsession failed here\n", "session failed here"),
    ]
    assert [
        r[0]
        for r in spark.createDataFrame(hidden, "t string, w string").select(results.hidden_error(F.col("t"))).collect()
    ] == [h[1] for h in hidden]
    cases = [
        ("error", 1, "rg", "rg x", "", "success"),
        ("error", 1, "rg", "rg x", "y" * 400, "unknown"),
        ("error", 1, "rg", "rg x", "rg: bad regex", "error"),
        ("error", 2, "rg", "rg x", "", "error"),
        ("error", 1, "git", "git diff --no-index a b", "", "success"),
        ("error", 1, "python", "python x", None, "error"),
        ("error", None, "rg", "rg x", "", "error"),
    ]
    got = spark.createDataFrame(cases, "s string, c int, h string, m string, e string, w string").select(
        results.reinterpreted(*map(F.col, "schme"))
    ).collect()
    assert [r[0] for r in got] == [c[5] for c in cases]


def test_pointer_walk_of_long_threads(spark):
    sizes = {1: 140_000, 2: 1_500}
    rows = spark.range(1, 140_001).selectExpr("1L AS thread", "id AS idx").union(
        spark.range(1, 1_501).selectExpr("2L AS thread", "id AS idx")
    )
    got = evidence_plans.pointer_walk(SimpleNamespace(responses=rows)).collect()
    assert sorted((r.node, r.root, r.steps) for r in got) == sorted(
        (t * 1_000 + i, t * 1_000 + 1, i.bit_length() - 1) for t, n in sizes.items() for i in range(1, n + 1)
    )


def test_walk_ends_at_the_fixpoint(spark):
    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(41)], "n long, p long")
    assert sorted((r.n, r.root, r.steps) for r in evidence.walk(chain, "n", "p").collect()) == [
        (k, 0, k) for k in range(41)
    ]
    assert evidence.walk(chain.filter("n <= 16"), "n", "p", rounds=4).count() == 17
    with pytest.raises(ValueError, match="no fixpoint"):
        evidence.walk(chain, "n", "p", rounds=4)
    with pytest.raises(ValueError, match="no fixpoint"):
        evidence.walk(spark.createDataFrame([(1, 2), (2, 1)], "n long, p long"), "n", "p", rounds=3)


def repeated(spark, rows: list[dict]):
    """Calls of one agent, one after the other, for rule G: times in seconds."""
    out, at = [], 0.0
    for k, r in enumerate(rows):
        at += r.get("after", 20.0)
        span = r.get("lasts", 0.1)
        server = r.get("server")
        name = r.get("name", "job_status")
        tool = f"mcp__{server}__{name}" if server else name
        out.append(
            (
                1,
                1,
                k,
                k,
                r.get("tool", tool),
                r.get("category", "mcp" if server else "other"),
                server,
                r.get("target"),
                r.get("params", "{}"),
                r.get("status", "success"),
                int(at * 1e9),
                int((at + span) * 1e9),
                r.get("epoch", 0),
                r.get("emitter", k),
                r.get("content"),
                name if server else None,
                r.get("op"),
                r.get("phase"),
                r.get("state"),
                r.get("timed_out"),
                r.get("delay"),
            )
        )
        at += span
    schema = (
        "session long, agent long, seq long, aseq long, tool string, category string, server string, target string, "
        "params string, status string, start_ns long, end_ns long, epoch long, emitter long, content_fp string, "
        "server_tool string, op string, result_phase string, state_fp string, timed_out boolean, delay double"
    )
    return spark.createDataFrame(out, schema)


def verdict_of(spark, rows, tool=None, **more):
    got = [
        r for r in repeats.verdicts(repeated(spark, rows), **more).collect() if tool is None or r.tool.endswith(tool)
    ]
    assert len(got) == 1
    return got[0]


def test_polling_a_running_job(spark):
    poll = {"server": "hub", "op": "mcp_read", "params": '{"job":42}', "phase": "in_progress", "state": "r"}
    g = verdict_of(spark, [poll] * 13 + [poll | {"phase": "done", "state": "c"}])
    assert (g.calls, g.n_waiting, g.same, g.phase_changes) == (14, 13, 12, 1)
    assert (g.verdict, g.kind, g.confidence) == ("outil", "polling_cadence", "high")
    wait = {"server": "hub", "name": "wait_for_job", "phase": "done"}
    g = verdict_of(spark, [wait] + [poll | {"after": 15.0}] * 6, "job_status")
    assert (g.verdict, g.kind, g.wait_tool) == ("agent", "polling_instead_of_wait", "mcp__hub__wait_for_job")


def test_one_repeat_in_progress_is_no_polling(spark):
    wait = {"server": "hub", "name": "wait_for_job", "phase": "done"}
    poll = {"server": "hub", "op": "mcp_read", "params": '{"job":42}', "phase": "in_progress", "state": "p"}
    g = verdict_of(
        spark,
        [
            wait,
            poll,
            poll | {"state": "r"},
            {"server": "hub", "name": "submit_job", "op": "mcp"},
            poll | {"state": "c", "phase": "done"},
        ],
        "job_status",
    )
    assert (g.verdict, g.kind, g.n_after_change, g.n_waiting) == ("justifie", None, 1, 1)


def test_retrying_what_is_away(spark):
    away = {"server": "hub", "op": "mcp_read", "phase": "unavailable", "state": "x", "after": 5.0}
    g = verdict_of(spark, [away] * 8 + [away | {"phase": "done", "state": "y"}])
    assert (g.n_unavailable, g.verdict, g.kind) == (8, "environnement", "retry_cadence")


def test_waits_that_run_out(spark):
    wait = {
        "name": "collaboration.wait_agent",
        "target": "worker",
        "timed_out": True,
        "delay": 30.0,
        "lasts": 30.0,
        "after": 2.5,
        "state": "t",
    }
    g = verdict_of(spark, [wait] * 5)
    assert (g.verdict, g.kind, g.n_waiting) == ("agent", "wait_timeout", 4)
    g = verdict_of(
        spark,
        [
            {
                "server": "hub",
                "name": "wait_for_job",
                "timed_out": True,
                "phase": "in_progress",
                "state": "r",
                "after": 3.0,
                "lasts": 60.0,
            }
        ] * 5,
    )
    assert (g.verdict, g.kind) == ("outil", "wait_timeout")
    sleep = {"name": "clock.sleep", "delay": 30.0, "lasts": 30.0, "after": 3.0, "state": "empty"}
    g = verdict_of(spark, [sleep] * 5)
    assert (g.verdict, g.kind, g.n_waiting) == ("indetermine", None, 4)
    assert repeats.verdicts(repeated(spark, [sleep | {"delay": float(k)} for k in range(5)])).count() == 0


def test_periodic_monitoring(spark):
    run = {
        "tool": "Bash",
        "category": "shell",
        "op": "run_script",
        "target": "python monitor.py",
        "after": 55.0,
        "phase": "done",
    }
    g = verdict_of(spark, [run | {"state": f"s{k}"} for k in range(10)])
    assert (g.periodic, g.verdict, g.kind) == (True, "agent", "polling_cadence")


def test_asking_again_for_what_is_known(spark):
    ask = {"server": "game", "name": "asset_info", "op": "mcp_read", "state": "a", "after": 4.0, "phase": "done"}
    g = verdict_of(spark, [ask] * 4)
    assert (g.n_none, g.verdict, g.kind) == (3, "agent", "unexplained_repeats")
    status = {"tool": "Bash", "category": "shell", "op": "vcs_read", "target": "git status", "state": "m", "after": 4.0}
    edit = {"tool": "Edit", "category": "edit", "op": "edit", "target": "f"}
    g = verdict_of(
        spark, [x | {"params": str(k)} if x is edit else x for k in range(4) for x in (status, edit)], "Bash"
    )
    assert (g.n_after_change, g.verdict, g.kind) == (3, "justifie", None)
    g = verdict_of(spark, [status | {"emitter": 7}] * 5)
    assert (g.round_trips, g.verdict) == (0, "gratuit")


def test_inputs_compactions_and_declarations(spark):
    ask = {"server": "hub", "name": "quota", "op": "mcp_read", "state": "u", "after": 4.0}
    rows = [ask, ask, ask | {"epoch": 1}]
    at = repeated(spark, rows).orderBy("seq").collect()
    inputs = spark.createDataFrame([(1, 1, at[1].start_ns - 1)], "session long, agent long, ns long")
    g = verdict_of(spark, rows, inputs=inputs)
    assert (g.n_new_input, g.n_context_loss, g.verdict) == (1, 1, "justifie")
    rows = [{"server": "game", "name": "editor", "op": "mcp", "state": "f", "after": 30.0}] * 4
    at = repeated(spark, rows).orderBy("seq").collect()
    said = spark.createDataFrame(
        [(1, 1, r.start_ns - 1_000_000, ["in_progress"]) for r in at[1:]],
        "session long, agent long, ns long, labels array<string>",
    )
    got = repeats.reasons(repeated(spark, rows), declared=said).collect()
    assert [(r.reason, r.basis, r.declared) for r in got] == [("waiting", "declared", ["in_progress"])] * 3


def test_allocation_tasks_grow_with_the_lines(spark, monkeypatch):
    """With more lines come more tasks, not larger ones."""
    from loomtrace.plans import catalog
    from loomtrace.sources import stored

    monkeypatch.setattr(stored, "ROWS_PER_TASK", 200)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    for name in ("allocation_floor", "allocation_largest_remainder"):
        got = catalog.queries()[name](spark, "/root/testdata/sf0.001")
        rows = got.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        assert len(rows) == -(-lines // 200)
        assert max(rows) < 2_000


def test_repeats_of_a_session_in_blocks(spark, monkeypatch):
    """A session counted in blocks of a few calls gives what it gives as a whole, and no task takes all of it."""
    from loomtrace.operators import repeats
    from loomtrace.sources import stored
    from loomtrace.sources.bridge import Frames

    f = Frames(spark, "/root/testdata/sf0.001")
    # servers, files and local work of several agents in one session
    calls = f.calls.withColumns({
        "session": F.lit(0), "category": F.when(F.col("server").isNotNull(), "mcp").otherwise(F.col("category")),
        "seq": (F.row_number().over(Window.orderBy("start_ns", "call_id")) - 1).cast("long"),
    })
    shown = lambda: sorted((r.call_id, r.reason, r.strong, r.p_strong) for r in repeats.reasons(calls).collect())
    whole = shown()
    assert {"after_change", "none"} <= {x[1] for x in whole}
    monkeypatch.setattr(repeats, "BLOCK", 7)
    monkeypatch.setattr(stored, "ROWS_PER_TASK", 10)
    assert shown() == whole
    flag = F.col("effect") == "write"
    held = repeats._in_session(repeats._prepared(calls), 100, [("_writes", flag, ())])
    want = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    parts = held.withColumn("_part", F.spark_partition_id())
    assert parts.select("_part").distinct().count() > 1
    assert held.withColumn("_want", F.sum(flag.cast("long")).over(want)).filter("_want <> _writes").isEmpty()
