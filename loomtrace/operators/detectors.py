"""The seven rules: redundant reads, error loops, batchable calls, recurring sequences, hand-driven services, repeated
guidance, repeated calls. Each takes calls (or texts) and returns findings; agents are never compared with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shell
from ..sources.stored import dealt, stored
from .messages import repeated_guidance
from .metrics import failed
from .repeats import verdicts
from .windows import NS, islands, lagged

#: Ranges in which two calls are looked at together, by rule.
READ_WINDOW = (60, 900)
ERROR_WINDOW = (40, 1_800)
KEY = ["session", "agent"]


def _near(df: DataFrame, window: tuple[int, int]) -> Column:
    """The previous row (columns p_aseq, p_start_ns) is within so many calls and seconds."""
    return (F.col("aseq") - F.col("p_aseq") <= window[0]) & (F.col("start_ns") - F.col("p_start_ns") <= window[1] * NS)


def _unsure(calls: DataFrame) -> Column:
    """Shell calls of unknown effect: all, but for those whose command is known only to read (effect, where given)."""
    shell = F.col("category") == "shell"
    return shell & ~F.coalesce(F.col("effect") == "read", F.lit(False)) if "effect" in calls.columns else shell


def read_pairs(calls: DataFrame, window: tuple[int, int] = READ_WINDOW) -> DataFrame:
    """A: pairs of consecutive equal reads of an agent in an epoch, and the verdict on each.

    Excluded where the first or second did not succeed, the content differs, or the target was edited between (by a
    running count of edits, so nothing is joined by range); degraded where something of unknown effect ran between.
    """
    so_far = Window.partitionBy(*KEY).orderBy("aseq").rowsBetween(Window.unboundedPreceding, 0)
    on_target = Window.partitionBy(*KEY, "target").orderBy("aseq").rowsBetween(Window.unboundedPreceding, 0)
    marked = calls.withColumn("edits", F.sum((F.col("category") == "edit").cast("long")).over(on_target)).withColumn(
        "unknowns", F.sum(_unsure(calls).cast("long")).over(so_far)
    )
    reads = marked.filter("category = 'read'")
    pairs = lagged(
        reads,
        [*KEY, "epoch", "target", "params"],
        ["aseq"],
        p_aseq="aseq",
        p_start_ns="start_ns",
        p_fp="content_fp",
        p_status="status",
        p_edits="edits",
        p_unknowns="unknowns",
        p_call="call_id",
    )
    pairs = pairs.filter("p_aseq IS NOT NULL").filter(_near(pairs, window))
    verdict = (
        F.when((F.col("p_status") != "success") | (F.col("status") != "success"), "excluded_status")
        .when(F.col("p_fp") != F.col("content_fp"), "excluded_content")
        .when(F.col("edits") > F.col("p_edits"), "excluded_edit")
        .when(F.col("unknowns") > F.col("p_unknowns"), "degraded")
        .otherwise("clean")
    )
    return pairs.withColumn("verdict", verdict)


def read_clusters(calls: DataFrame, window: tuple[int, int] = READ_WINDOW) -> DataFrame:
    """A: chains of redundant reads. All pairs clean: high; a degraded one: medium."""
    by = [*KEY, "epoch", "target", "params"]
    pairs = read_pairs(calls, window)
    # a chain goes on only where this pair begins with the call that ended the last redundant one
    good = pairs.filter("verdict IN ('clean', 'degraded')")
    good = lagged(good, by, ["aseq"], _prev="call_id")
    chained = islands(good, by, ["aseq"], F.col("_prev").isNull() | (F.col("_prev") != F.col("p_call")), "chain")
    return chained.groupBy(*by, "chain").agg(
        (F.count(F.lit(1)) + 1).alias("reads"),
        F.min("p_aseq").alias("first_aseq"),
        F.max("aseq").alias("last_aseq"),
        F.sum("bytes").alias("wasted_bytes"),
        F.when(F.every(F.col("verdict") == "clean"), "high").otherwise("medium").alias("confidence"),
    ).drop("chain")


def read_batches(calls: DataFrame, least: int = 2) -> DataFrame:
    """A: re-read pairs of the same two responses, together."""
    pairs = read_pairs(calls).filter("verdict IN ('clean', 'degraded')").withColumn(
        "p_emitter", F.floor(F.col("p_aseq") / 2)
    )
    return pairs.groupBy(*KEY, "epoch", "p_emitter", "emitter").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("target").alias("targets")
    ).filter(F.col("pairs") >= least)


def rerun_chains(calls: DataFrame, window: tuple[int, int] = ERROR_WINDOW) -> DataFrame:
    """A: the same command run again with the same outcome and no edit of the agent between."""
    so_far = Window.partitionBy(*KEY).orderBy("aseq").rowsBetween(Window.unboundedPreceding, 0)
    runs = calls.withColumn("edits", F.sum((F.col("category") == "edit").cast("long")).over(so_far)).filter(
        "category IN ('shell', 'search')"
    )
    by = [*KEY, "tool", "target"]
    pairs = lagged(runs, by, ["aseq"], p_aseq="aseq", p_start_ns="start_ns", p_edits="edits", p_status="status")
    broken = F.coalesce(
        (F.col("edits") > F.col("p_edits")) | (F.col("status") != F.col("p_status")) | ~_near(pairs, window),
        F.lit(False),
    )
    return islands(pairs, by, ["aseq"], broken, "chain").groupBy(*by, "chain").agg(
        F.count(F.lit(1)).alias("runs"), F.min("aseq").alias("first_aseq"), F.max("aseq").alias("last_aseq")
    ).filter("runs >= 2").drop("chain")


def _interventions(calls: DataFrame, edited: str) -> DataFrame:
    """calls with running counts of what may have corrected a failure: edits of its target (`edited` names the column), and
    calls of unknown effect; each once with the row itself (e_to, u_to) and once without (e_before, u_before). Local calls
    do not correct a server's failure: there, other tools of the same server that do not only read are of unknown effect."""
    so_far = lambda *by: Window.partitionBy(*KEY, *by).orderBy("aseq").rowsBetween(Window.unboundedPreceding, 0)
    local = F.col("server").isNull()
    edit = (F.col("category") == "edit").cast("long")
    shell = _unsure(calls).cast("long")
    acts = (F.col("category") != "read").cast("long")
    edits = F.when(local & F.col(edited).isNotNull(), F.sum(edit).over(so_far(edited))).otherwise(F.lit(0))
    unknowns = F.when(local, F.sum(shell).over(so_far())).otherwise(
        F.sum(acts).over(so_far("server")) - F.sum(acts).over(so_far("server", "tool"))
    )
    out = calls.withColumns({"e_to": edits, "u_to": unknowns})
    return out.withColumns(
        {
            "e_before": F.col("e_to") - F.when(local & F.col(edited).isNotNull(), edit).otherwise(F.lit(0)),
            "u_before": F.col("u_to") - F.when(local, shell).otherwise(F.lit(0)),
        }
    )


def failure_chains(
    calls: DataFrame, least: int = 3, window: tuple[int, int] = ERROR_WINDOW, edited: str | None = "target"
) -> DataFrame:
    """B: repeated failures of the same call; an edit of the target (the column `edited`) between two ends the chain. A later
    success within the window makes it a recovery of low confidence, a denial at first a repeated denial of medium; else
    it persists: medium where something of unknown effect came between, else high. Growing gaps (each at least 1.5 times
    the one before, two at least) are a backoff. Without `edited`, neither edits, unknown effects nor denials are looked at."""
    by = [*KEY, "tool", "target"]
    later = Window.partitionBy(*by).orderBy("aseq").rowsBetween(1, Window.unboundedFollowing)
    success = F.min(F.when(F.col("status") == "success", F.struct("aseq", "start_ns"))).over(later)
    seen = _interventions(calls, edited) if edited else calls.withColumns(
        {x: F.lit(0) for x in ("e_to", "e_before", "u_to", "u_before")}
    )
    bad = seen.withColumn("_ok", success).filter(failed() & (F.col("status") != "interrupted"))
    bad = lagged(bad, by, ["aseq"], p_aseq="aseq", p_start_ns="start_ns", p_e="e_to", p_u="u_to")
    bad = bad.withColumn("gap", F.col("start_ns") - F.col("p_start_ns"))
    cut = islands(bad, by, ["aseq"], ~_near(bad, window) | (F.col("e_before") > F.col("p_e")), "chain")
    cut = lagged(cut, [*by, "chain"], ["aseq"], p_gap="gap")
    first = F.row_number().over(Window.partitionBy(*by, "chain").orderBy("aseq"))
    cut = cut.withColumn("_n", first).withColumn(
        "_grows", F.when(F.col("_n") > 2, F.col("gap") >= 1.5 * F.col("p_gap"))
    ).withColumn("_unknown", (F.col("_n") > 1) & (F.col("u_before") > F.col("p_u")))
    last = F.max(F.struct("aseq", "start_ns", F.col("_ok.aseq").alias("ok_aseq"), F.col("_ok.start_ns").alias("ok_ns")))
    chains = cut.groupBy(*by, "chain").agg(
        F.count(F.lit(1)).alias("failures"),
        F.min("aseq").alias("first_aseq"),
        last.alias("l"),
        F.count_distinct("params").alias("inputs"),
        F.coalesce((F.count("_grows") >= 1) & F.every(F.coalesce("_grows", F.lit(True))), F.lit(False)).alias("backoff"),
        F.max("_unknown").alias("unknown"),
        F.min_by("status", "aseq").alias("status"),
    )
    chains = chains.filter(F.col("failures") >= least)
    recovered = F.coalesce(
        (F.col("l.ok_aseq") - F.col("l.aseq") <= window[0]) & (F.col("l.ok_ns") - F.col("l.start_ns") <= window[1] * NS),
        F.lit(False),
    )
    denied = (F.col("status") == "denied") & F.lit(edited is not None)
    kind = F.when(recovered, "transient_recovered").when(denied, "repeated_denial").otherwise("persistent")
    confidence = F.when(recovered, "low").when(denied | F.col("unknown"), "medium").otherwise("high")
    return chains.select(
        *by,
        "failures",
        "first_aseq",
        F.col("l.aseq").alias("last_aseq"),
        "inputs",
        "backoff",
        kind.alias("kind"),
        confidence.alias("confidence"),
    )


def failures_on_inputs(calls: DataFrame, least: int = 3, window: tuple[int, int] = ERROR_WINDOW) -> DataFrame:
    """B: one tool fails in a row on different inputs."""
    by = [*KEY, "tool"]
    bad = lagged(calls.filter(failed()), by, ["aseq"], p_aseq="aseq", p_start_ns="start_ns")
    cut = islands(bad, by, ["aseq"], ~_near(bad, window), "chain")
    return cut.groupBy(*by, "chain").agg(
        F.count(F.lit(1)).alias("failures"),
        F.count_distinct("target", "params").alias("inputs"),
        F.min("aseq").alias("first_aseq"),
    ).filter((F.col("failures") >= least) & (F.col("inputs") >= 2)).drop("chain")


def batch_runs(calls: DataFrame, least: int = 3) -> DataFrame:
    """C: runs of calls that could have gone out together: same agent and kind, one after the other, targets all different,
    each from another response; calls of other agents break runs in the session's order.

    What surely breaks a run (another kind, another agent between, the same response) cuts the calls into stretches. Within
    one, a run that starts at a place ends where a target of it comes again: of the places from there on, the least next
    place of an equal target, which is a running minimum from behind. Only the hops from start to start are followed in
    order, by a fold over those of one stretch.
    """
    # seq counts all calls of the session, so that no other agent's call lies between two whose numbers follow each other:
    # the agent's own calls tell all, and none need be sorted by session
    order = Window.partitionBy(*KEY).orderBy("seq")
    kind = F.col("category").isin("read", "search")
    # the same response: known of both calls, or else one call within two seconds of the other's end
    soon = F.col("start_ns") - F.lag("end_ns").over(order) < 2 * NS
    together = F.coalesce(F.lag("emitter").over(order) == F.col("emitter"), soon, F.lit(False))
    breaks = (F.lag("seq").over(order) != F.col("seq") - 1) | (F.lag("category").over(order) != F.col("category"))
    rows = calls.withColumn("_break", F.coalesce(breaks, F.lit(True)) | together)
    rows = islands(rows, KEY, ["seq"], F.col("_break"), "stretch").filter(kind)
    by = ["session", "agent", "stretch"]
    again = F.lead("aseq").over(Window.partitionBy(*by, "target").orderBy("aseq"))
    rows = rows.withColumn("_again", again)
    ends = F.min("_again").over(
        Window.partitionBy(*by).orderBy(F.desc("aseq")).rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("_end", ends)
    stretches = rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("aseq", "_end"))).alias("rows"), F.max("aseq").alias("last"),
        F.count("_again").alias("hops")
    )
    start = F.struct(
        F.array().cast("array<bigint>").alias("starts"),
        F.lit(None).cast("bigint").alias("next"),
        F.lit(True).alias("first"),
    )
    hop = lambda s, x: F.when(
        s["first"] | (x["aseq"] == s["next"]),
        F.struct(
            F.concat(s["starts"], F.array(x["aseq"])).alias("starts"),
            x["_end"].alias("next"),
            F.lit(False).alias("first"),
        ),
    ).otherwise(s)
    # most stretches repeat no target: one run
    starts = F.when(F.col("hops") == 0, F.array(F.col("rows")[0]["aseq"])).otherwise(
        F.aggregate("rows", start, hop, lambda s: s["starts"])
    )
    runs = stretches.withColumn("_starts", starts).select(
        *by, "last", "_starts", F.posexplode("_starts").alias("_k", "first_aseq")
    )
    last = F.coalesce(F.try_element_at("_starts", F.col("_k") + 2) - 1, F.col("last"))
    out = runs.withColumn("last_aseq", last).withColumn(
        "calls", (F.col("last_aseq") - F.col("first_aseq") + 1).cast("int")
    )
    return out.filter(F.col("calls") >= least).select("session", "agent", "first_aseq", "last_aseq", "calls")


def batch_independence(calls: DataFrame) -> DataFrame:
    """C: reads whose target was listed by one of the agent's three calls before (here: searches that name it)."""
    w = Window.partitionBy(*KEY).orderBy("aseq").rowsBetween(-3, -1)
    listed = F.collect_list(F.when(F.col("category") == "search", F.col("target"))).over(w)
    return calls.withColumn("_l", listed).filter("category = 'read'").groupBy("session").agg(
        F.count(F.lit(1)).alias("reads"), F.count_if(F.array_contains("_l", F.col("target"))).alias("listed")
    )


def shape(category: str = "category") -> Column:
    return F.concat_ws(":", category, F.coalesce("server", F.lit("-")))


def ngram_counts(
    calls: DataFrame, lengths: tuple[int, ...] = (2, 3, 4, 5, 6), least: int = 3, last_calls: int | None = 2_000
) -> DataFrame:
    """D: n-grams of call shapes of an agent's last calls (None: all) that occur often and have two distinct shapes at least.

    An agent's calls are sorted by the shapes that follow, so that calls whose grams are equal lie together: of neighbours,
    what they begin with alike tells for each call the longest gram that occurs often enough. No rarer one is made.
    """
    recent = calls.withColumn("shape", shape())
    if last_calls is not None:
        back = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("aseq")))
        recent = recent.withColumn("_back", back).filter(F.col("_back") <= last_calls)
    # one window gives the shapes ahead; the grams of all lengths are its beginnings
    w = Window.partitionBy(*KEY).orderBy("aseq")
    ahead = F.array("shape", *[F.lead("shape", i).over(w) for i in range(1, max(lengths))])
    each = recent.select(*KEY, "aseq", ahead.alias("ahead"))
    alike, n_often = F.lit(0), F.lit(max(lengths))
    for i in reversed(range(max(lengths))):
        same = F.coalesce(F.col("ahead")[i] == F.col("_before")[i], F.lit(False))
        alike = F.when(same, alike + 1).otherwise(F.lit(0))
    if least > 1:
        # equal to all of the least - 1 calls before it in this order; one of the least - 1 behind it, or itself, is that
        near = Window.partitionBy(*KEY).orderBy("ahead", "aseq")
        each = lagged(each, KEY, ["ahead", "aseq"], _before="ahead").withColumn("_alike", alike)
        each = each.withColumn("_ended", F.min("_alike").over(near.rowsBetween(2 - least, 0)))
        n_often = F.max("_ended").over(near.rowsBetween(0, least - 1))
    each = each.withColumn("_often", n_often).filter(F.col("_often") >= min(lengths))
    each = each.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).filter(
        (F.col("n") <= F.col("_often")) & F.col("ahead")[F.col("n") - 1].isNotNull()
    )
    grams = each.select(*KEY, "n", "aseq", F.slice("ahead", 1, F.col("n")).alias("gram"))
    grams = grams.filter(F.size(F.array_distinct("gram")) >= 2)
    return grams.groupBy(*KEY, "n", F.concat_ws(">", "gram").alias("gram")).agg(
        F.count(F.lit(1)).alias("occurrences"), F.collect_list("aseq").alias("starts")
    ).filter(F.col("occurrences") >= least)


def mined_patterns(
    calls: DataFrame, least: int = 3, top: int | None = 10, last_calls: int | None = 2_000
) -> DataFrame:
    """D: patterns: occurrences chosen from the left without overlap (a fold), those contained in a longer one that is as
    frequent left out, one of each class of rotations kept, the best of an agent kept (top; None: all). They are looked for
    among an agent's last calls (None: among all)."""
    lengths = (2, 3, 4, 5, 6)
    counts = ngram_counts(calls, lengths, least, last_calls)
    chosen = F.expr(
        "aggregate(array_sort(starts), named_struct('n', 0L, 'until', -1L), (s, x) -> IF(x > s.until, "
        "named_struct('n', s.n + 1, 'until', x + n - 1), s), s -> s.n)"
    )
    found = counts.withColumn("uses", chosen).filter(F.col("uses") >= least).select(*KEY, "n", "gram", "uses")
    # a pattern meets those that hold it under its own name: each names all that it holds, so none is compared with all
    parts = F.split("gram", ">")
    held = F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda k: F.transform(
            F.sequence(F.lit(1), F.size(parts) - k + 1), lambda i: F.array_join(F.slice(parts, i, k), ">")
        ),
    ))
    named = found.withColumn("_held", F.explode(F.array_distinct(held)))
    own = F.when(F.col("_held") == F.col("gram"), F.struct("n", "gram", "uses"))
    longer = [F.max(F.when(F.col("n") > k, F.col("uses"))).alias(f"_longer{k}") for k in lengths[:-1]]
    met = named.groupBy(*KEY, "_held").agg(F.collect_list(own).alias("_own"), *longer)
    met = met.select(*KEY, *[f"_longer{k}" for k in lengths[:-1]], F.inline("_own"))
    most = F.coalesce(*[F.when(F.col("n") == k, F.col(f"_longer{k}")) for k in lengths[:-1]])
    # of a session or agent that is not known, all patterns stay
    known = F.col("session").isNotNull() & F.col("agent").isNotNull()
    closed = met.filter(~(known & F.coalesce(most >= F.col("uses"), F.lit(False)))).select(*KEY, "n", "gram", "uses")
    turns = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.concat_ws(">", F.slice(F.concat(parts, parts), i + 1, F.col("n"))),
    )
    order = Window.partitionBy(*KEY, "_class").orderBy(F.desc("uses"), F.desc("n"), "gram")
    one = closed.withColumn("_class", F.array_min(turns)).withColumn("_r", F.row_number().over(order)).filter("_r = 1")
    best = Window.partitionBy(*KEY).orderBy(F.desc("uses"), F.desc("n"), "gram")
    placed = one.withColumn("place", F.row_number().over(best))
    if top is not None:
        placed = placed.filter(F.col("place") <= top)
    return placed.select(*KEY, "n", "gram", "uses", "place")


def tool_gap(calls: DataFrame, least: int = 3) -> DataFrame:
    """E: services driven by hand: many shell calls of an agent at one target."""
    shell = calls.filter("category = 'shell'")
    groups = shell.groupBy(*KEY, "target").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed()).alias("failures"), F.count_distinct("params").alias("forms")
    ).filter(F.col("n") >= least)
    return groups.withColumn(
        "confidence", F.when((F.col("n") >= 6) | (F.col("failures") > 0), "medium").otherwise("low")
    )


def service_gap(calls: DataFrame, servers: DataFrame, least: int = 3, strong: int = 6) -> DataFrame:
    """E: services driven by hand: shell commands of an agent (column command) by family and host, the programs used, and
    the servers that seem related, by name or by a word of the family in their name or tools. servers: session, server, tool.

    Related servers seen in the session: high; many commands or a failure: medium; else low. Servers are matched with the
    few distinct services of their session, never with calls.
    """
    parsed = calls.filter("category = 'shell'").withColumn("parts", shell.parsed(F.col("command")))
    family, heads = shell.family_of(F.col("parts")), F.transform("parts", lambda x: x["head"])
    useful = F.try_element_at(F.filter(heads, lambda h: ~h.isin(*shell.SERVICE_WRAPPERS)), F.lit(1))
    named = parsed.select(
        *KEY,
        "status",
        "start_ns",
        family.alias("family"),
        useful.alias("head"),
        shell.service_target(F.col("command")).alias("host"),
    ).filter("family IS NOT NULL")
    target = F.when(F.col("family").isin("ssh", "http"), F.coalesce("host", "head")).when(
        F.col("family").isin("slurm", "github"), F.col("family")
    ).otherwise(F.col("head"))
    groups = named.withColumn("target", target).groupBy(*KEY, "family", "target").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin("error", "timeout", "denied")).alias("failures"),
        F.array_sort(F.collect_set("head")).alias("heads")
    )
    groups = groups.filter(F.col("n") >= least)
    words = F.create_map(*[F.lit(x) for k, v in shell.SERVICE_WORDS.items() for x in (k, list(v))])
    services = groups.select("session", "family", "target").distinct()
    name, tool = F.lower("server"), F.lower(F.coalesce("tool", F.lit("")))
    by_name = (F.col("target") != F.col("family")) & (
        F.contains(name, F.col("target")) | F.contains(F.col("target"), name)
    )
    by_word = F.exists(words[F.col("family")], lambda w: F.contains(name, w) | F.contains(tool, w))
    met = services.join(servers.select("session", "server", "tool").distinct(), "session").filter(by_name | by_word)
    related = met.groupBy("session", "family", "target").agg(F.array_sort(F.collect_set("server")).alias("related"))
    out = groups.join(related, ["session", "family", "target"], "left").withColumn(
        "related", F.coalesce("related", F.array().cast("array<string>"))
    )
    confidence = F.when(F.size("related") > 0, "high").when(
        (F.col("n") >= strong) | (F.col("failures") > 0), "medium"
    ).otherwise("low")
    return out.select(*KEY, "family", "target", "n", "failures", "heads", "related", confidence.alias("confidence"))


def tool_gap_related(calls: DataFrame, servers: DataFrame, max_servers: int = 10_000) -> DataFrame:
    """E: servers whose name holds the target, or the reverse. servers: name.

    The longer of the two is cut into pieces as long as the shorter may be, and joined with it by equality: distinct targets
    are matched with distinct names, never row by row. Lengths of names are few (they are counted: at most `max_servers`).
    """
    groups = tool_gap(calls)
    names = servers.select("name").filter("name <> ''").distinct()
    targets = groups.select("target").filter("target <> ''").distinct()
    at = lambda c, k: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substr(F.col(c), i, k))
    whole = F.flatten(F.transform(F.sequence(F.lit(1), F.length("name")), lambda k: at("name", k)))
    in_name = names.select("name", F.explode(F.array_distinct(whole)).alias("target")).join(targets, "target")
    lengths = sorted(r[0] for r in names.select(F.length("name")).distinct().limit(max_servers).collect())
    fits = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= F.length("target"))
    pieces = F.flatten(F.transform(fits, lambda k: at("target", k)))
    in_target = targets.select("target", F.explode(F.array_distinct(pieces)).alias("name")).join(names, "name").select(
        "name", "target"
    )
    met = in_name.select("name", "target").unionByName(in_target).distinct()
    return groups.join(met, "target").groupBy(*KEY, "target").agg(
        F.count(F.lit(1)).alias("related"), F.min("name").alias("first_name")
    )


def repeat_pairs(calls: DataFrame) -> DataFrame:
    """G: each repeat of a call (same agent, tool, target, params): its reason, the first that holds of a fixed order, and
    its outcome."""
    by = [*KEY, "tool", "target", "params"]
    so_far = Window.partitionBy(*KEY).orderBy("aseq").rowsBetween(Window.unboundedPreceding, 0)
    edits = F.sum((F.col("category") == "edit").cast("long")).over(so_far)
    inputs = F.sum((F.col("category") == "agent").cast("long")).over(so_far)
    pairs = lagged(
        calls.withColumn("edits", edits).withColumn("inputs", inputs),
        by,
        ["aseq"],
        p_emitter="emitter",
        p_epoch="epoch",
        p_inputs="inputs",
        p_edits="edits",
        p_status="status",
        p_fp="content_fp",
        p_end="end_ns",
        p_start="start_ns",
    ).filter("p_start IS NOT NULL")
    reason = (
        F.when(F.col("p_emitter") == F.col("emitter"), "same_response")
        .when(F.col("p_epoch") != F.col("epoch"), "context_loss")
        .when(F.col("inputs") - F.col("p_inputs") > F.when(F.col("category") == "agent", 1).otherwise(0), "new_input")
        .when(F.col("edits") - F.col("p_edits") > F.when(F.col("category") == "edit", 1).otherwise(0), "after_change")
        .when(F.col("p_status") == "open", "unavailable")
        .when(F.col("p_status") == "error", "after_failure")
        .otherwise("none")
    )
    outcome = F.when((F.col("status") == "open") | (F.col("p_status") == "open"), "unknown").when(
        F.col("p_fp") == F.col("content_fp"), "same"
    ).otherwise("changed")
    out = pairs.withColumn("reason", reason).withColumn("outcome", outcome)
    value = (
        F.when(F.col("reason") == "same_response", "free")
        .when(
            F.col("reason").isin("context_loss", "new_input", "after_change") | (F.col("outcome") == "changed"),
            "useful",
        )
        .when((F.col("outcome") == "same") & (F.col("reason") != "none"), "explained_no_gain")
        .when(F.col("outcome") == "same", "no_gain")
        .otherwise("unknown")
    )
    return out.withColumn("value", value).withColumn("interval_ns", F.col("start_ns") - F.col("p_start")).withColumn(
        "idle_ns", F.greatest(F.lit(0), F.col("start_ns") - F.coalesce("p_end", "start_ns"))
    )


def repeat_groups(calls: DataFrame, least_calls: int = 3) -> DataFrame:
    """G: per group of equal calls: repeats by value, intervals, a verdict from the first rule that holds, a confidence."""
    by = [*KEY, "tool", "target", "params"]
    pairs = repeat_pairs(calls)
    n_of = lambda v: F.count_if(F.col("value") == v)
    seconds = F.col("interval_ns") / NS
    g = pairs.groupBy(*by).agg(
        (F.count(F.lit(1)) + 1).alias("calls"),
        (F.count(F.lit(1)) - n_of("free")).alias("round_trips"),
        n_of("useful").alias("useful"),
        n_of("no_gain").alias("no_gain"),
        n_of("explained_no_gain").alias("explained"),
        n_of("unknown").alias("unknowns"),
        F.count_if(F.col("reason") == "after_failure").alias("after_failure"),
        F.round(F.percentile(seconds, 0.5), 6).alias("median_s"),
        F.round(F.min(seconds), 6).alias("min_s"),
        F.round(F.max(seconds), 6).alias("max_s"),
        F.round(F.try_divide(F.stddev_pop(seconds), F.avg(seconds)), 6).alias("cv"),
    ).filter(F.col("calls") >= least_calls)
    rt = F.col("round_trips")
    verdict = (
        F.when(rt == 0, "free")
        .when((F.col("no_gain") * 2 >= rt) & (F.col("no_gain") >= 2), "agent")
        .when(F.col("after_failure") * 2 >= rt, "see_errors")
        .when(F.col("useful") * 2 >= rt, "justified")
        .when(F.col("unknowns") * 2 > rt, "indeterminate")
        .otherwise("mixed")
    )
    known = rt - F.col("unknowns")
    confidence = F.when((rt >= 5) & (known * 10 >= rt * 8), "high").when(
        (rt >= 2) & (known * 2 >= rt), "medium"
    ).otherwise("low")
    return g.withColumn("verdict", verdict).withColumn("confidence", confidence)


def tool_rhythm(calls: DataFrame) -> DataFrame:
    """Per tool: calls, agents, span, median interval, most calls in one and in ten minutes of any agent."""
    w = Window.partitionBy(*KEY, "tool").orderBy("start_ns", "call_id")
    peak = lambda s: F.count(F.lit(1)).over(
        Window.partitionBy(*KEY, "tool").orderBy("start_ns").rangeBetween(-s * NS, 0)
    )
    rows = calls.withColumn("_i", F.col("start_ns") - F.lag("start_ns").over(w)).withColumn("_p1", peak(60)).withColumn(
        "_p10", peak(600)
    )
    return rows.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_distinct("agent").alias("agents"),
        (F.max("start_ns") - F.min("start_ns")).alias("span_ns"),
        F.percentile("_i", 0.5).alias("median_ns"),
        F.max("_p1").alias("peak_1min"),
        F.max("_p10").alias("peak_10min"),
    )


REGISTRY = {
    "A": read_clusters,
    "B": failure_chains,
    "C": batch_runs,
    "D": mined_patterns,
    "E": tool_gap,
    "F": repeated_guidance,
    "G": verdicts,
}


def all_findings(calls: DataFrame, texts: DataFrame, only: tuple[str, ...] = tuple(REGISTRY)) -> DataFrame:
    """The findings of all rules as rule, session, agent, n (counted calls; of F, messages). F reads texts (message, text) and
    knows neither session nor agent. The calls are written once, for several rules read them."""
    size = {"A": "reads", "B": "failures", "C": "calls", "D": "uses", "E": "n", "F": "messages", "G": "calls"}
    if len(set(only) - {"F"}) > 1:
        calls = stored(calls, "calls")
    n_calls = calls.count() if set(only) - {"F"} else 0
    by_agent = dealt(calls, n_calls, *KEY)
    out = None
    for rule in only:
        if rule == "F":
            none = {x: F.lit(None).cast(calls.schema[x].dataType) for x in KEY}
            found = REGISTRY[rule](texts, "message", "text").withColumns(none)
        else:
            # G deals its rows itself
            found = REGISTRY[rule](calls, n_calls=n_calls) if rule == "G" else REGISTRY[rule](by_agent)
        one = found.select(F.lit(rule).alias("rule"), *KEY, F.col(size[rule]).cast("long").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
