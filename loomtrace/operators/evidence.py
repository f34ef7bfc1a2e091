"""Smaller joins and aggregates over calls, responses and messages: existence between rows, argmax links, bands, walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

from .windows import islands

KEY = ["session", "agent"]


def shared_references(calls: DataFrame) -> DataFrame:
    """Targets that several agents of a session read, with their edits."""
    g = calls.filter("category IN ('read', 'edit')").groupBy("session", "target").agg(
        F.count_distinct(F.when(F.col("category") == "read", F.col("agent"))).alias("readers"),
        F.count_if(F.col("category") == "read").alias("reads"),
        F.count_if(F.col("category") == "edit").alias("edits"),
    )
    return g.filter("readers >= 2")


def inputs_between(calls: DataFrame) -> DataFrame:
    """Of consecutive equal calls of an agent: how many of the session's inputs came between, by a running count."""
    so_far = F.sum((F.col("category") == "agent").cast("long")).over(
        Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    )
    w = Window.partitionBy(*KEY, "tool", "target").orderBy("aseq")
    rows = calls.withColumn("_n", so_far).withColumn("_p", F.lag("_n").over(w)).filter(
        "_p IS NOT NULL AND category <> 'agent'"
    )
    return rows.select("session", "agent", "call_id", (F.col("_n") - F.col("_p")).alias("inputs"))


def busiest(responses: DataFrame, group: Column) -> DataFrame:
    """Per group, the thread with most responses and its last usage; ties to the smaller thread."""
    t = responses.groupBy(group.alias("grp"), "thread").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("input_tokens", "idx").alias("input_tokens")
    )
    best = F.max_by(F.struct("thread", "n", "input_tokens"), F.struct("n", -F.col("thread"))).alias("_b")
    return t.groupBy("grp").agg(best).select("grp", "_b.thread", "_b.n", "_b.input_tokens")


def gauge(calls: DataFrame, value: str) -> DataFrame:
    """First, last and greatest reading of a gauge per agent."""
    order = F.struct("start_ns", "call_id")
    return calls.filter(F.col(value).isNotNull()).groupBy(*KEY).agg(
        F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.max(value).alias("greatest")
    )


def once_per_response(calls: DataFrame, value: str) -> DataFrame:
    """A value summed once per emitting response (that of its first call), not once per call."""
    one = calls.groupBy(*KEY, "emitter").agg(F.min_by(value, "aseq").alias("_v"), F.count(F.lit(1)).alias("_n"))
    return one.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("responses"), F.sum("_n").alias("calls"), F.sum("_v").alias(value)
    )


def by_index(calls: DataFrame, by: str, value: str) -> DataFrame:
    """Quantiles by position in the sorted values: n / 2 and 9 n / 10, both rounded down, and the greatest."""
    w = Window.partitionBy(by)
    rows = calls.filter(F.col(value).isNotNull()).withColumn(
        "_i", F.row_number().over(w.orderBy(value, "call_id")) - 1
    ).withColumn("_n", F.count(F.lit(1)).over(w))
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col(value)))
    return rows.groupBy(by).agg(
        at(F.floor(F.col("_n") / 2)).alias("mid"),
        at(F.floor(F.col("_n") * 9 / 10)).alias("p90"),
        F.max(value).alias("greatest"),
    )


def changes_only(responses: DataFrame, total: Column) -> DataFrame:
    """Records whose cumulative total differs from that of the record before, and by how much."""
    w = Window.partitionBy("thread").orderBy("idx")
    rows = responses.withColumn("total", total).withColumn("_p", F.lag("total").over(w))
    return rows.filter("_p IS NULL OR _p <> total").select(
        "thread", "idx", "total", (F.col("total") - F.coalesce("_p", F.lit(0))).alias("delta")
    )


def until_next(calls: DataFrame, ends: Column) -> DataFrame:
    """Calls gathered up to and with the next one that ends a group (those behind the last end form a group of their own)."""
    back = Window.partitionBy(*KEY).orderBy(F.desc("aseq"))
    rows = calls.withColumn("_e", ends.cast("long")).withColumn(
        "_g", F.sum("_e").over(back.rowsBetween(Window.unboundedPreceding, 0))
    )
    return rows.groupBy(*KEY, "_g").agg(
        F.min("aseq").alias("first_aseq"),
        F.count(F.lit(1)).alias("calls"),
        F.sum("bytes").alias("bytes"),
        F.max("_e").alias("ended"),
    ).drop("_g")


def versions(calls: DataFrame) -> DataFrame:
    return calls.groupBy("target", "content_fp").agg(
        F.min("start_ns").alias("first_ns"),
        F.max("start_ns").alias("last_ns"),
        F.count_distinct("session").alias("sessions"),
    )


def steps(calls: DataFrame) -> DataFrame:
    """Of each two-step pattern, per position: whether target, content and status vary; a step with none of them varying but
    the target is mechanical."""
    w = Window.partitionBy(*KEY).orderBy("aseq")
    nxt = F.lead(F.struct("category", "target", "content_fp", "status")).over(w)
    pairs = calls.withColumn("_x", nxt).filter("_x IS NOT NULL").withColumn(
        "pattern", F.concat_ws(">", "category", "_x.category")
    )
    own = F.struct("target", "content_fp", "status")
    each = pairs.select(
        "pattern", F.posexplode(F.array(own, F.struct("_x.target", "_x.content_fp", "_x.status"))).alias("pos", "s")
    )
    g = each.groupBy("pattern", "pos").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("s.target").alias("targets"),
        F.count_distinct("s.content_fp").alias("contents"),
        F.count_distinct("s.status").alias("statuses"),
    )
    return g.withColumn(
        "kind", F.when((F.col("contents") <= 1) & (F.col("statuses") <= 1), "mechanical").otherwise("judgment")
    )


def with_listed_events(calls: DataFrame, listed: Column, events: DataFrame) -> DataFrame:
    """Calls of which at least one event, of those listed as a JSON array of ids, exists."""
    ids = calls.select("session", "call_id", F.explode(F.from_json(listed, "array<bigint>")).alias("event_id"))
    return ids.join(events.select("event_id"), "event_id", "left_semi").groupBy("session", "call_id").agg(
        F.count(F.lit(1)).alias("events")
    )


def wait_alternatives(calls: DataFrame) -> DataFrame:
    """Per server of a session, its most used tool; ties by name."""
    n = calls.filter("server IS NOT NULL").groupBy("session", "server", "tool").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("session", "server").orderBy(F.desc("n"), "tool")
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def near_lines(left: DataFrame, right: DataFrame, by: str, line: str, text: str, width: int = 10) -> DataFrame:
    """Rows of left with a row of right of the same text at most `width` lines off: an equi-join on text and band; a row
    looks into its own band and the two beside it."""
    band = F.floor(F.col(line) / width)
    l3 = left.withColumn("_b", F.explode(F.array(band - 1, band, band + 1)))
    r = right.select(F.col(by).alias("_by"), F.col(text).alias("_t"), F.col(line).alias("_l"), band.alias("_rb"))
    ok = (F.col(by) == F.col("_by")) & (F.col(text) == F.col("_t")) & (F.col("_b") == F.col("_rb")) & (
        F.abs(F.col(line) - F.col("_l")) <= width
    )
    return l3.join(r, ok, "left_semi").drop("_b").distinct()


def unique_prefix(ids: DataFrame, column: str, least: int) -> DataFrame:
    """The length of the shortest prefix, `least` at least, that no other id has. Only ids that share the least prefix are
    compared, each with its neighbours in order."""
    w = Window.partitionBy(F.substring(column, 1, least)).orderBy(column)
    size = F.length(column)

    def common(other: Column) -> Column:
        n = F.aggregate(
            F.sequence(F.lit(1), size),
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
            lambda s, i: F.struct(
                (
                    s["n"]
                    + (s["go"] & (F.substr(F.col(column), i, F.lit(1)) == F.substr(other, i, F.lit(1)))).cast("int")
                ).alias("n"),
                (s["go"] & (F.substr(F.col(column), i, F.lit(1)) == F.substr(other, i, F.lit(1)))).alias("go"),
            ),
            lambda s: s["n"],
        )
        return F.when(other.isNull(), 0).otherwise(n)

    rows = ids.select(column).distinct().withColumn("_a", F.lag(column).over(w)).withColumn(
        "_b", F.lead(column).over(w)
    )
    return rows.select(
        column,
        F.greatest(F.lit(least), F.least(size, F.greatest(common(F.col("_a")), common(F.col("_b"))) + 1)).alias("chars"),
    )


def walk(links: DataFrame, node: str, parent: str, rounds: int = 24) -> DataFrame:
    """The root of each node and how many steps it is away, by pointer doubling: each round joins the frame with itself and
    doubles the steps, until no root changes; an error if `rounds` rounds (chains of 2^rounds) do not suffice, as in a cycle.
    parent is null at roots."""
    state = links.select(
        node, F.coalesce(parent, node).alias("root"), F.col(parent).isNotNull().cast("long").alias("steps")
    )
    for _ in range(rounds + 1):
        up = state.select(F.col(node).alias("root"), F.col("root").alias("_r"), F.col("steps").alias("_s"))
        # a root is its own root at no distance, so a row whose steps stay has reached it
        state = state.join(up, "root").select(
            node,
            F.col("_r").alias("root"),
            (F.col("steps") + F.col("_s")).alias("steps"),
            (F.col("_s") > 0).alias("_moved"),
        )
        state = stored(state, "walk")
        if state.filter("_moved").isEmpty():
            return state.drop("_moved")
        state = state.drop("_moved")
    raise ValueError(f"no fixpoint of the walk after {rounds} rounds")


def context_windows(responses: DataFrame) -> DataFrame:
    """Per context window: first, last and greatest input, growth, how often it fell."""
    w = Window.partitionBy("thread", "ctx").orderBy("idx")
    rows = responses.withColumn("_d", F.col("input_tokens") - F.lag("input_tokens").over(w))
    return rows.groupBy("thread", "ctx").agg(
        F.min_by("input_tokens", "idx").alias("first"),
        F.max_by("input_tokens", "idx").alias("last"),
        F.max("input_tokens").alias("peak"),
        F.sum(F.greatest("_d", F.lit(0))).alias("growth"),
        F.count_if(F.col("_d") < 0).alias("falls"),
    )


def contract_match(calls: DataFrame, contracts: DataFrame) -> DataFrame:
    """Calls whose scope (tool and target) has a contract, found by the hash of the scope. contracts: scope_hash, kind."""
    scope = F.sha2(F.concat_ws("|", "tool", "target"), 256)
    return calls.withColumn("scope_hash", scope).join(contracts.select("scope_hash", "kind"), "scope_hash").groupBy(
        "tool", "kind"
    ).agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("target").alias("targets"))


def habits(calls: DataFrame, least: int = 5, n: int = 8) -> DataFrame:
    return calls.groupBy("tool", "target").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(
        F.desc("n"), "tool", "target"
    ).limit(n)


def bulk_threads(calls: DataFrame, least: int = 20, span_ns: int = 2_000_000_000) -> DataFrame:
    """Agents whose many calls fall into an impossibly short time, and the measured time of the others."""
    g = calls.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("start_ns") - F.min("start_ns")).alias("span_ns"),
        F.sum("duration_ms").alias("ms"),
    )
    bulk = (F.col("n") >= least) & (F.col("span_ns") < span_ns)
    return g.select(*KEY, "n", bulk.alias("bulk"), F.when(~bulk, F.col("ms")).alias("measured_ms"))


def key_values(rows: DataFrame, text: str) -> DataFrame:
    """key=value pairs of lines, numbers with their unit: posexploded, one row each."""
    pairs = F.regexp_extract_all(text, F.lit(r"([A-Za-z]\w*=-?\d+(?:ms|s)?)"), 1)
    kv = rows.select("*", F.posexplode(pairs).alias("pos", "_kv"))
    return kv.withColumn("key", F.split_part("_kv", F.lit("="), F.lit(1))).withColumn(
        "number", F.regexp_extract(F.split_part("_kv", F.lit("="), F.lit(2)), r"^-?\d+", 0).cast("long")
    ).withColumn("unit", F.regexp_extract("_kv", r"(ms|s)$", 1)).drop("_kv")


def segments_of(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Half-open segments in which a value stays the same."""
    w = Window.partitionBy(*by).orderBy(*order)
    cut = islands(rows.withColumn("_p", F.lag(value).over(w)), by, order, F.col("_p") != F.col(value), "segment")
    s = cut.groupBy(*by, "segment").agg(
        F.min(order[0]).alias("start"), F.count(F.lit(1)).alias("n"), F.max(value).alias(value)
    )
    return s.withColumn("end", F.lead("start").over(Window.partitionBy(*by).orderBy("segment")))


def already_told(summaries: DataFrame, notes: DataFrame) -> DataFrame:
    """Per (run, field): told, whether a summary says nothing that notes have not: of each of its values a note has the same
    role, at, phase and value (unknown equals unknown), and no role has conflicts. summaries (run, field, role, at, phase,
    value, has_value, conflicting); rows without a value ask for nothing. notes (run, field, role, scope, at, phase, value);
    a role that is not given is the scope for the exit and status of a process, else unspecified. Equal facts of both sides
    are counted in one group, so nothing is joined and copies cost nothing after the first sum."""
    fact = ["run", "field", "role", "at", "phase", "value"]
    of_process = F.col("field").isin("process_exit", "process_status")
    role = F.coalesce(F.when(F.col("role") != "", F.col("role")), F.when(of_process, F.col("scope")).otherwise("unspecified"))
    said = notes.withColumn("role", role).select(
        *fact, F.lit(False).alias("_in"), F.lit(False).alias("_asks"), F.lit(True).alias("_said"), F.lit(False).alias("_bad")
    )
    asked = summaries.select(
        *fact, F.lit(True).alias("_in"), F.col("has_value").alias("_asks"), F.lit(False).alias("_said"),
        F.col("conflicting").alias("_bad"),
    )
    each = asked.unionByName(said).groupBy(*fact).agg(*[F.bool_or(c).alias(c) for c in ("_in", "_asks", "_said", "_bad")])
    return each.filter("_in").groupBy("run", "field").agg(
        F.every((~F.col("_asks") | F.col("_said")) & ~F.col("_bad")).alias("told")
    )
