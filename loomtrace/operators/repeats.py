"""Rule G in full: calls made again, why, with what gain, and what could be better.

A group is one call (agent, tool, target, parameters without delays) made several times. Each repeat gets the first reason
that was observed between it and the call before, else what the agent announced, and whether its result brought anything.
What lies between two calls is told by differences of running counts, so no repeat is joined with the calls between.

Calls need session, agent, seq (in the session), aseq (of the agent), tool, category, server, target, params, status,
start_ns, end_ns, epoch, emitter, content_fp. Known where given, else null: server_tool, op (operation), result_phase,
state_fp, timed_out, delay (seconds asked for), effect (read, write, run or unknown). A reason that was not observed stays
`none`, a gain without fingerprints stays unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import dealt
from .windows import NS

# Reasons in the order in which the first that holds is taken, what an agent may announce, and names that
# say that a tool waits or reads.
REASONS = (
    "same_response", "context_loss", "new_input", "after_change", "unavailable", "after_failure", "waiting",
    "possible_change", "none",
)
DECLARED = ("retry", "wait", "unavailable", "in_progress", "verify", "after_change", "fix", "explore")
WAITS = r"(?i)(?:^|[_.])(?:wait|await|poll|watch|sleep)"
READS = r"(?i)(?:^|[_.])(?:list|get|read|status|show|info)"
READ_OPS, RUN_OPS = ("read", "search", "list", "vcs_read"), ("run_tests", "build", "run_script")
FAILED = ("error", "timeout", "denied", "interrupted")
#: Calls between two repeats beyond which an unknown effect is taken for possible.
MANY = 400
_OPTIONAL = {
    "server_tool": "string", "op": "string", "result_phase": "string", "state_fp": "string", "timed_out": "boolean",
    "delay": "double", "effect": "string",
}


def _prepared(calls: DataFrame) -> DataFrame:
    """calls with all optional columns, and what the rules ask of them."""
    calls = calls.withColumns({c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in calls.columns})
    name = F.coalesce("server_tool", "tool")
    by_category = F.when(F.col("category").isin("edit", "write"), "write").when(
        F.col("category").isin("read", "search", "list"), "read"
    )
    by_category = by_category.when(F.col("op") == "mcp_read", "read").otherwise("unknown")
    phase = (
        F.when(F.col("result_phase").isin("unavailable", "in_progress", "failed", "done"), F.col("result_phase"))
        .when(F.col("timed_out"), "in_progress")
        .when(F.col("status").isin(*FAILED), "failed")
        .when(F.col("status") == "success", "done")
        .otherwise("unknown")
    )
    tool = F.col("tool")
    tells = F.col("target").isNotNull() | F.col("timed_out").isNotNull() | F.col("result_phase").isin(
        "in_progress", "unavailable", "failed"
    )
    tells = tells | ~F.coalesce("state_fp", F.lit("empty")).isin("", "empty") | F.col("content_fp").isNotNull()
    return calls.withColumns({
        "tells": F.coalesce(tells, F.lit(False)),
        "waits": F.coalesce(name.rlike(WAITS), F.lit(False)),
        "effect": F.coalesce("effect", by_category),
        "space": F.when(~tool.startswith("mcp__") & tool.contains("."), F.split_part(tool, F.lit("."), F.lit(1))),
        "phase": phase,
        "state": F.coalesce(
            F.concat(F.lit("state:"), "state_fp"), F.concat(F.lit("content:"), F.col("content_fp").cast("string"))
        ),
    }).withColumn("asked", F.when(F.col("waits"), F.coalesce(F.format_number("delay", 3), F.lit("?"))))


GROUP = ["session", "agent", "tool", "target", "params", "asked"]


#: Calls of a session that one task counts at once.
BLOCK = 1 << 16


def _in_session(rows: DataFrame, n: int, counts: list[tuple[str, Column, tuple[str, ...]]]) -> DataFrame:
    """rows with running counts of flags along a session: (name, flag, further columns by which they are counted). A session
    is counted in blocks of calls: what the blocks before one hold is a row of its own at its start, so that no task sees a
    whole session and the calls are shuffled once."""
    every = sorted({k for _, _, by in counts for k in by})
    null = lambda k: F.lit(None).cast(rows.schema[k].dataType)
    rows = rows.withColumn("_block", F.floor(F.col("seq") / BLOCK).cast("long"))
    cells = F.array(*[
        F.struct(
            F.lit(name).alias("_count"), *[(F.col(k) if k in by else null(k)).alias(k) for k in every],
            F.coalesce(flag, F.lit(False)).cast("long").alias("_n"),
        )
        for name, flag, by in counts
    ])
    cell = rows.select("session", "_block", F.explode(cells).alias("c")).select("session", "_block", "c.*")
    held = cell.groupBy("session", "_count", *every, "_block").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy("session", "_count", *every).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("_n", F.sum("_n").over(w)).filter("_n > 0").withColumn("seq", F.lit(-1).cast("long"))
    both = dealt(rows.unionByName(before, allowMissingColumns=True), n, "session", "_block")
    out = {}
    for name, flag, by in counts:
        told = F.when(F.col("_count") == name, F.col("_n")).when(F.col("_count").isNull(), flag.cast("long"))
        along = Window.partitionBy("session", "_block", *by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        out[name] = F.sum(F.coalesce(told, F.lit(0))).over(along)
    return both.withColumns(out).filter("_count IS NULL").drop("_count", "_n", "_block")


def _between(rows: DataFrame, n: int, marks: list[DataFrame]) -> DataFrame:
    """rows with running counts of what may change a call's result (strong) or perhaps does (weak), each without the calls
    of the row's own group, so that the difference of two rows of a group counts what lies between them. What concerns all
    agents of a session is counted in blocks, the rest by agent. Rows of `marks` are added before these are dealt by agent;
    they are no calls, and null in all that is counted."""
    writes, own = F.col("effect") == "write", GROUP[2:]
    mcp, op = F.col("category") == "mcp", F.coalesce(F.col("op"), F.lit(""))
    # of a server: other tools that act; of a file: writes to it; of local work: any write; of a name space: other tools
    acts = mcp & (op != "mcp_read") & ~F.col("waits")
    rows = _in_session(rows, n, [
        ("_server", acts, ("server",)), ("_tool", acts, ("server", "tool")), ("_target", writes, ("target",)),
        ("_writes", writes, ()),
    ])
    for more in marks:
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = dealt(rows, n, "session", "agent")

    def so_far(flag: Column, *by: str) -> Column:
        w = Window.partitionBy("session", "agent", *by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        return F.sum(flag.cast("long")).over(w)

    written = so_far(writes, *own)
    moves = F.col("space").isNotNull() & ~F.col("waits") & ~F.coalesce(F.col("tool").rlike(READS), F.lit(False))
    space = so_far(moves, "space") - so_far(moves, "space", "tool")
    reads_file = ((op == "read") | (F.col("category") == "read")) & F.col("target").isNotNull()
    is_local = op.isin(*READ_OPS, *RUN_OPS) | F.col("category").isin("read", "search", "list", "shell")
    strong = F.when(mcp, F.col("_server") - F.col("_tool")).when(reads_file, F.col("_target") - written).when(
        is_local, F.col("_writes") - written
    ).when(F.col("space").isNotNull(), space).otherwise(F.lit(0))
    unsure = F.col("effect").isin("unknown", "run", "write") | op.isin(*RUN_OPS)
    weak = so_far(unsure) - so_far(unsure, *own)
    return rows.withColumns({"strong": strong, "weak": weak}).drop("_server", "_tool", "_target", "_writes")


def _with_marks(rows: DataFrame, n: int, inputs: DataFrame | None, declared: DataFrame | None) -> DataFrame:
    """rows with the counts of _between, and running ones, by agent and time, of inputs (session, agent, ns) and of announced
    reasons (session, agent, ns, labels). Marks at a call's very start count as before it."""
    key = ["session", "agent"]
    zero = {"new": F.lit(0)} | {f"said_{d}": F.lit(0) for d in DECLARED}
    marks, counted = [], []
    if inputs is not None:
        marks.append(inputs.select(*key, F.col("ns").alias("start_ns"), F.lit(1).alias("new")))
        counted.append("new")
    if declared is not None:
        said = {f"said_{d}": F.array_contains("labels", d).cast("int") for d in DECLARED}
        marks.append(
            declared.select(*key, F.col("ns").alias("start_ns"), "labels").withColumns(said).drop("labels")
        )
        counted.extend(said)
    if not marks:
        return _between(rows, n, []).withColumns(zero)
    every = _between(rows.withColumn("_call", F.lit(True)), n, marks)
    w = Window.partitionBy(*key).orderBy("start_ns").rangeBetween(Window.unboundedPreceding, 0)
    # calls have no marks of their own
    told = {c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in counted}
    return every.withColumns(told).filter("_call").withColumns({c: x for c, x in zero.items() if c not in told}).drop("_call")


def reasons(
    calls: DataFrame, inputs: DataFrame | None = None, declared: DataFrame | None = None, gap_ms: int = 2_000,
    n_calls: int | None = None
) -> DataFrame:
    """Each repeat of a call: reason, basis (observed, nature or declared), outcome, value, prev_phase, phase_changed,
    round_trip, interval_ns, idle_ns. n_calls: how many calls there are, counted where not given."""
    return _judged(calls, inputs, declared, gap_ms, n_calls).filter("p_seq IS NOT NULL")


def _judged(
    calls: DataFrame, inputs: DataFrame | None, declared: DataFrame | None, gap_ms: int = 2_000, n_calls: int | None = None,
    least_calls: int = 2
) -> DataFrame:
    """The calls of groups of at least so many with what reasons() says of repeats; of the first of a group it says nothing
    (p_seq is null)."""
    n = calls.count() if n_calls is None else n_calls
    rows = _with_marks(_prepared(calls), n, inputs, declared)
    before = {
        f"p_{c}": c
        for c in (
            "emitter",
            "epoch",
            "new",
            "strong",
            "weak",
            "phase",
            "state",
            "start_ns",
            "end_ns",
            "seq",
            *(f"said_{d}" for d in DECLARED),
        )
    }
    # most calls are like no other: what is asked of repeats is not asked of them
    size = F.count(F.lit(1)).over(
        Window.partitionBy(*GROUP).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    if declared is None:
        before = {k: v for k, v in before.items() if not v.startswith("said_")}
    w = Window.partitionBy(*GROUP).orderBy("seq")
    pairs = rows.withColumns({"_size": size} | {k: F.lag(v).over(w) for k, v in before.items()})
    pairs = pairs.filter(F.col("_size") >= least_calls).drop("_size")
    if declared is None:
        pairs = pairs.withColumns({f"p_said_{d}": F.lit(0) for d in DECLARED})
    both = F.col("emitter").isNotNull() & F.col("p_emitter").isNotNull()
    close = F.coalesce((F.col("start_ns") - F.col("p_end_ns")) / 1_000_000 < gap_ms, F.lit(False))
    same = F.when(both, F.col("emitter") == F.col("p_emitter")).otherwise(close)
    more = lambda c: F.col(c) > F.col(f"p_{c}")
    many = F.col("seq") - F.col("p_seq") - 1 > MANY
    seen = (
        F.when(same, "same_response")
        .when(F.col("epoch") != F.col("p_epoch"), "context_loss")
        .when(more("new"), "new_input")
        .when(more("strong"), "after_change")
        .when(F.col("p_phase") == "unavailable", "unavailable")
        .when(F.col("p_phase") == "failed", "after_failure")
        .when(F.col("p_phase") == "in_progress", "waiting")
        .when(more("weak") | many, "possible_change")
        .otherwise("none")
    )
    pairs = pairs.withColumn("seen", seen)
    open_reason = F.col("seen").isin("none", "possible_change")
    told = F.when(F.col("waits"), "waiting").when(more("said_unavailable"), "unavailable").when(
        more("said_in_progress") | more("said_wait"), "waiting"
    )
    pairs = pairs.withColumn("reason", F.when(open_reason, F.coalesce(told, F.col("seen"))).otherwise(F.col("seen")))
    kind = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(1))
    comparable = F.coalesce(kind("state") == kind("p_state"), F.lit(False))
    outcome = F.when(~comparable, "unknown").when(F.col("state") == F.col("p_state"), "same").otherwise("changed")
    changed = (F.col("phase") != F.col("p_phase")) & (F.col("phase") != "unknown") & (F.col("p_phase") != "unknown")
    pairs = pairs.withColumns({"outcome": outcome, "phase_changed": changed})
    useful = F.col("reason").isin("context_loss", "new_input", "after_change") | (
        F.col("outcome") == "changed"
    ) | F.col("phase_changed")
    value = (
        F.when(F.col("reason") == "same_response", "free")
        .when(useful, "useful")
        .when(F.col("outcome") == "same", F.when(F.col("reason") == "none", "no_gain").otherwise("explained_no_gain"))
        .otherwise("unknown")
    )
    return pairs.withColumns({
        "value": value,
        "basis": F.when(~open_reason | told.isNull(), "observed").when(F.col("waits"), "nature").otherwise("declared"),
        "round_trip": F.col("reason") != "same_response",
        "interval_ns": F.col("start_ns") - F.col("p_start_ns"),
        "idle_ns": F.greatest(F.col("start_ns") - F.col("p_end_ns"), F.lit(0)),
        "declared": F.filter(F.array(*[F.when(more(f"said_{d}"), F.lit(d)) for d in DECLARED]), lambda x: x.isNotNull()),
    })


def verdicts(
    calls: DataFrame, inputs: DataFrame | None = None, declared: DataFrame | None = None, least_calls: int = 3,
    episode_s: int = 1_200, n_calls: int | None = None
) -> DataFrame:
    """Groups of equal calls with what their repeats say: calls, round_trips, repeats by reason and value, intervals within
    episodes, whether they are periodic, verdict, kind and confidence.

    agent or outil: could be better on the agent's or the tool's side (kind: polling_cadence, polling_instead_of_wait,
    wait_timeout, unexplained_repeats); environnement: a service was away; echec: repeats after failures (rule B);
    justifie, gratuit (no round trip), indetermine, a_examiner (facts without a culprit).
    """
    rows = _judged(calls, inputs, declared, n_calls=n_calls, least_calls=least_calls)
    rt = F.col("p_seq").isNotNull() & F.col("round_trip")
    inside = rt & (F.col("interval_ns") <= episode_s * NS)
    seconds = F.when(inside, F.col("interval_ns") / NS)
    of_reason = {f"n_{r}": F.count_if(rt & (F.col("reason") == r)) for r in REASONS}
    of_value = {
        f"v_{v}": F.count_if(rt & (F.col("value") == v)) for v in ("useful", "no_gain", "explained_no_gain", "unknown")
    }
    # one grouping for what concerns a group's calls and for what its repeats say
    groups = rows.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("calls"), F.first("category").alias("category"), F.first("server").alias("server"),
        F.first("op").alias("op"),
        F.first("waits").alias("waits"), F.count_if(F.col("timed_out")).alias("timed_out"), F.bool_or("tells").alias("tells"),
        F.count_if(F.col("result_phase") != "unknown").alias("phases_known"),
        F.count_if(rt).alias("round_trips"), F.count_if(rt & F.col("phase_changed")).alias("phase_changes"),
        F.count_if(rt & (F.col("outcome") != "unknown")).alias("known"),
        F.count_if(rt & (F.col("outcome") == "same")).alias("same"),
        *[c.alias(n) for n, c in (of_reason | of_value).items()],
        F.percentile(seconds, 0.5).alias("median_s"), F.min(seconds).alias("min_s"), F.max(seconds).alias("max_s"),
        F.try_divide(F.stddev_pop(seconds), F.avg(seconds)).alias("cv"),
    ).filter(F.col("calls") >= least_calls)
    # a waiting tool of the same server in the session; one row per session and server
    tools = _prepared(calls).filter("category = 'mcp' AND waits").groupBy("session", "server", "tool").agg(
        F.count(F.lit(1)).alias("n")
    )
    alternative = tools.groupBy("session", "server").agg(F.max_by("tool", F.struct("n", "tool")).alias("wait_tool"))
    joined = groups.join(alternative, ["session", "server"], "left")

    n = F.col("round_trips")
    polling = F.col("n_waiting") + F.col("n_unavailable")
    quiet = F.col("n_none") + F.col("n_possible_change")
    periodic = (n >= 5) & F.coalesce(F.col("cv") < 0.5, F.lit(False)) & (quiet * 10 >= n * 6) & (
        F.col("phase_changes") <= F.greatest(F.lit(1), F.floor(n / 10))
    )
    joined = joined.withColumns({"periodic": periodic, "polling": polling})
    polls = ((F.col("polling") * 2 >= n) & (F.col("polling") >= 2)) | F.col("periodic")
    owner = F.when(F.col("category") == "mcp", "outil").otherwise("agent")
    op = F.coalesce("op", F.lit(""))
    local = op.isin(*READ_OPS, *RUN_OPS) | F.col("category").isin("read", "search", "list")
    explained = F.col("n_new_input") + F.col("n_after_change") + F.col("n_context_loss") > 0
    waiting = F.col("waits") | (F.col("timed_out") > 0)
    offered = (F.col("category") == "mcp") & ~F.col("waits") & F.col("wait_tool").isNotNull()
    idle = (F.col("v_no_gain") * 2 >= n) & (F.col("v_no_gain") >= 2)
    made = lambda verdict, kind=None: F.struct(
        (verdict if isinstance(verdict, Column) else F.lit(verdict)).alias("verdict"),
        (kind if isinstance(kind, Column) else F.lit(kind).cast("string")).alias("kind"),
    )
    unexplained = F.when(~local, "unexplained_repeats")
    end = (
        F.when(F.col("waits") & ~F.col("tells") & (n > 0), made("indetermine"))
        .when(n == 0, made("gratuit"))
        .when(polls & (F.col("n_unavailable") > F.col("n_waiting")), made("environnement", "retry_cadence"))
        .when(polls & offered, made("agent", "polling_instead_of_wait"))
        .when(polls & waiting, made(F.when(explained, "a_examiner").otherwise(owner), "wait_timeout"))
        .when(polls, made(owner, "polling_cadence"))
        .when(idle, made("agent", unexplained))
        .when(F.col("n_after_failure") * 2 >= n, made("echec"))
        .when(F.col("v_useful") * 2 >= n, made("justifie"))
        .when(F.col("known") * 2 < n, made("indetermine"))
        .when(F.col("v_useful") >= F.col("v_no_gain"), made("justifie"))
        .otherwise(made("agent", F.when(F.col("v_no_gain") >= 2, unexplained)))
    )
    sure = (F.col("polling") == 0) | (F.col("phases_known") * 10 >= F.col("calls") * 8)
    confidence = F.when((n >= 5) & (F.col("known") * 10 >= n * 8) & sure, "high").when(
        (n >= 2) & (F.col("known") * 2 >= n), "medium"
    ).otherwise("low")
    out = joined.withColumns({"_end": end, "confidence": confidence})
    return out.select(
        "session", "agent", "tool", "target", "params", "calls", "round_trips", *of_reason, *of_value, "same", "known",
        "phase_changes",
        *[F.round(c, 6).alias(c) for c in ("median_s", "min_s", "max_s", "cv")], "periodic", "wait_tool",
        "_end.verdict", "_end.kind", "confidence",
    )
