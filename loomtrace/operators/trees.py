"""Token usage of trees of threads: which records count, responses told more than once, totals of subtrees, cumulative checks.

Lines are (file, line, value), a file holds one thread. Unknown values stay null, conflicts are never resolved by guessing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

#: The fields of a usage record.
FIELDS = (
    "input_tokens",
    "cached_input_tokens",
    "cache_write_input_tokens",
    "output_tokens",
    "reasoning_output_tokens",
    "total_tokens",
)
_META_LINES = 40
_ID = r"([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\.jsonl$"
_TEXTS = ("thread_id", "parent_id", "agent_path", "root_turn_id", "turn_id")
#: What is read of a usage line, parsed once; all values as text, whatever they are.
_USAGE = "struct<" + ", ".join(f"{k}: string" for k in FIELDS) + ">"
_LINE = (
    "type string, payload struct<type: string, thread_id: string, session_id: string, response_id: string, "
    f"root_turn_id: string, turn_id: string, usage: {_USAGE}, thread_token_usage: {_USAGE}>"
)


def _at(path: str) -> Column:
    return F.get_json_object("value", path)


def _number(text: Column) -> Column:
    """A count of tokens: whole and not negative, else unknown."""
    return F.when(text.rlike(r"^[0-9]+(\.0+)?$"), F.substring_index(text, ".", 1)).try_cast("long")


def threads(lines: DataFrame) -> DataFrame:
    """One row per file with thread metadata in its first 40 lines: thread_id, root_id, parent_id, agent_path, is_root. The
    first metadata of the file's own thread count (a child copies its parent's); files without any give no row."""
    own = F.regexp_extract("file", _ID, 1)
    head = lines.filter((F.col("line") <= _META_LINES) & F.contains("value", F.lit('"session_meta"')))
    ident, source = _at("$.payload.id"), _at("$.payload.source")
    spawn = lambda key: F.get_json_object(source, f"$.subagent.thread_spawn.{key}")
    parent, session = spawn("parent_thread_id"), F.nullif(_at("$.payload.session_id"), F.lit(""))
    metas = head.filter(_at("$.type") == "session_meta").filter((own == "") | (ident == own)).select(
        "file",
        F.struct(
            "line",
            ident.alias("thread_id"),
            F.coalesce(session, parent, ident).alias("root_id"),
            parent.alias("parent_id"),
            F.nullif(F.substring(spawn("agent_path"), 1, 120), F.lit("")).alias("agent_path"),
        ).alias("m"),
    )
    one = metas.groupBy("file").agg(F.min("m").alias("m")).select("file", "m.*").drop("line")
    return one.withColumn("is_root", F.col("thread_id").eqNullSafe(F.col("root_id")))


def records(lines: DataFrame, metas: DataFrame, starts: DataFrame | None = None, agents: str = "") -> DataFrame:
    """The usage lines of files with metadata, each with `why` it does not count (null: it does): token_count (a running
    total), other_agent (a child whose agent_path does not begin with `agents`), parent_copy, other_thread,
    other_session, before_start (in a root's own file before its start_line; starts: root_id, start_line).
    Usage is in the fields' names, the thread's cumulative usage in thread_ and the fields' names."""
    if starts is None:
        known = metas.withColumn("start_line", F.lit(None).cast("long"))
    else:
        known = metas.join(starts.select("root_id", "start_line"), "root_id", "left")
    known = stored(known, "threads")  # one row a file; written, so that a file with most lines can be split in the join
    either = F.contains("value", F.lit('"token_usage_record"')) | F.contains("value", F.lit('"token_count"'))
    at = lambda path: F.col(f"j.{path}")
    running = (F.coalesce(at("type"), F.lit("")) == "token_count") | (F.coalesce(at("payload.type"), F.lit("")) == "token_count")
    # out of a list of one, so that a line is parsed once, not by the filter and by each column again
    one = F.explode_outer(F.array(F.from_json("value", _LINE)))
    read = lines.filter(either).select("file", "line", one.alias("j"))
    said = read.filter(running | (at("type") == "token_usage_record")).select(
        "file", "line", running.alias("_running"),
        at("payload.thread_id").alias("_thread"), at("payload.session_id").alias("_session"),
        *[at(f"payload.{k}").alias(k) for k in ("response_id", "root_turn_id", "turn_id")],
        *[_number(at(f"payload.usage.{k}")).alias(k) for k in FIELDS],
        *[_number(at(f"payload.thread_token_usage.{k}")).alias(f"thread_{k}") for k in FIELDS],
    )
    rows = said.join(known, "file")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    chosen = F.col("is_root") | F.coalesce(F.startswith("agent_path", F.lit(agents)), F.lit(agents == ""))
    why = (
        F.when(~chosen, "other_agent").when(F.col("_running"), "token_count")
        .when(~same("_thread", "thread_id"), F.when(F.col("_thread") == F.col("root_id"), "parent_copy").otherwise("other_thread"))
        .when(~same("_session", "root_id"), "other_session")
        .when(F.col("is_root") & (F.col("line") < F.col("start_line")), "before_start")
    )
    return rows.withColumn("why", why).drop("_running", "_thread", "_session", "start_line")


def _violations() -> Column:
    c = {k: F.col(k) for k in FIELDS}
    rules = {
        "cached_input_gt_input": c["cached_input_tokens"] > c["input_tokens"],
        "reasoning_output_gt_output": c["reasoning_output_tokens"] > c["output_tokens"],
        "total_ne_input_plus_output": c["total_tokens"] != c["input_tokens"] + c["output_tokens"],
    }
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))


def responses(rows: DataFrame) -> DataFrame:
    """One row per response of a tree, of the records that count. Copies with one response_id are one response, placed where
    it was first told (the root's file before others, then by file and line); a number on which copies differ is unknown,
    a response with any difference keeps no response_id. Records without an id stand for themselves."""
    kept = rows.filter("why IS NULL").withColumn("_violations", _violations())
    alone = F.col("response_id").isNull()
    kept = kept.withColumn("_alone", F.when(alone, F.struct("file", "line")))
    numbers = [*FIELDS, *[f"thread_{k}" for k in FIELDS]]
    n = F.count(F.lit(1))
    equal = lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(True)) & F.count(c).isin(F.lit(0), n)
    first = F.min(F.struct(~F.col("is_root"), "file", "line", *_TEXTS, "_violations"))
    one = kept.groupBy("root_id", "response_id", "_alone").agg(
        first.alias("_first"),
        n.alias("copies"),
        *[F.when(equal(c), F.min(c)).alias(c) for c in numbers],
        (~reduce(lambda a, b: a & b, [equal(c) for c in [*numbers, *_TEXTS]])).alias("conflict"),
    )
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in numbers])
    return one.select(
        "root_id",
        *[F.col(f"_first.{k}").alias(k) for k in (*_TEXTS, "file", "line")],
        F.when(~F.col("conflict"), F.col("response_id")).alias("response_id"),
        "copies", "conflict", *numbers,
        F.col("_first._violations").alias("violations"),
        (known & ~F.col("conflict") & (F.size("_first._violations") == 0)).alias("complete"),
    )


def _counted(told: DataFrame, *by: str) -> DataFrame:
    """Sums that can be added up again: of each field its sum and in how many responses it is known."""
    return told.groupBy(*by).agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if(F.col("complete")).alias("complete"),
        *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in FIELDS],
        *[F.count(k).alias(f"_{k}") for k in FIELDS],
    )


def _strict(field: str) -> Column:
    """A total is known where there are responses and all of them tell the field."""
    n = F.col("responses")
    return F.when((n > 0) & (F.col(f"_{field}") == n), F.col(field)).alias(field)


def roll_up(nodes: DataFrame, key: str, parent: str, sums: list[str]) -> DataFrame:
    """Sums over each node and all below it, by pointer doubling: after k rounds a node holds its sums down to 2^k - 1 steps
    and points 2^k steps up; a round adds what points to it and doubles the pointers, so it takes log2(depth) rounds of
    plain sums, and no pairs of nodes and ancestors. nodes has one row per key. A parent that is no node ends the tree.
    Cycles are an error: depths are without gaps, so a round in which no pointer ends leaves nothing but cycles."""
    known = nodes.select(F.col(key).alias("_up"))
    state = stored(nodes.join(known, F.col(parent) == F.col("_up"), "left").select(key, "_up", *sums), "rollup")
    left = state.filter("_up IS NOT NULL").count()
    while left:
        gained = state.filter("_up IS NOT NULL").groupBy(F.col("_up").alias(key)).agg(*[F.sum(s).alias(f"_+{s}") for s in sums])
        further = state.select(F.col(key).alias("_up"), F.col("_up").alias("_next"))
        state = stored(
            state.join(further, "_up", "left").join(gained, key, "left").select(
                key, F.col("_next").alias("_up"), *[(F.col(s) + F.coalesce(F.col(f"`_+{s}`"), F.lit(0))).alias(s) for s in sums]
            ),
            "rollup",
        )
        now = state.filter("_up IS NOT NULL").count()
        if now == left:
            raise ValueError(f"{now} nodes lie on cycles of parents or below them")
        left = now
    return state.drop("_up")


def subtree_totals(metas: DataFrame, told: DataFrame) -> DataFrame:
    """Per thread: how many threads are in its subtree, their responses, complete ones, and strict totals of all fields. A
    thread whose files name different parents stands alone."""
    key = F.struct("root_id", "thread_id")
    agreed = F.when(F.min("parent_id") == F.max("parent_id"), F.min("parent_id"))
    nodes = metas.groupBy("root_id", "thread_id").agg(agreed.alias("parent_id"))
    sums = ["responses", "complete", *FIELDS, *[f"_{k}" for k in FIELDS]]
    own = nodes.join(_counted(told, "root_id", "thread_id"), ["root_id", "thread_id"], "left").select(
        key.alias("node"),
        F.when(F.col("parent_id").isNotNull(), F.struct("root_id", F.col("parent_id").alias("thread_id"))).alias("parent"),
        F.lit(1).cast("long").alias("threads"),
        *[F.coalesce(s, F.lit(0)).alias(s) for s in sums],
    )
    total = roll_up(own, "node", "parent", ["threads", *sums])
    return total.select("node.root_id", "node.thread_id", "threads", "responses", "complete", *[_strict(k) for k in FIELDS])


def verified(metas: DataFrame, rows: DataFrame, told: DataFrame) -> DataFrame:
    """Per file: strict sums of its responses (sum_), what the thread's cumulative usage grew by (delta_), how many fields
    could be compared, and whether all agree (null unless all are known). A child starts at zero; a root at its last record
    before its start, unknown without one."""
    cumulative = F.struct("line", *[f"thread_{k}" for k in FIELDS])
    at = lambda cond: F.max(F.when(cond, cumulative))
    ends = rows.groupBy("file").agg(
        at(F.col("why").isNull()).alias("last"), at(F.col("why") == "before_start").alias("before")
    )
    # a file's last record may be where a response was first told, of which copies differ: what they differ in is unknown
    place = told.select("file", F.col("line").alias("_line"), F.struct(*[f"thread_{k}" for k in FIELDS]).alias("_agreed"))
    ends = ends.join(place.withColumnRenamed("file", "_file"), (F.col("file") == F.col("_file")) & (F.col("last.line") == F.col("_line")), "left")
    sums = _counted(told, "file").select("file", F.col("responses").alias("_n"), *[
        F.when(F.col(f"_{k}") == F.col("responses"), F.col(k)).alias(f"sum_{k}") for k in FIELDS
    ])
    joined = metas.select("file", "root_id", "thread_id", "is_root").join(ends, "file", "left").join(sums, "file", "left")

    def delta(k: str) -> Column:
        last = F.when(F.col("_line").isNotNull(), F.col(f"_agreed.thread_{k}")).otherwise(F.col(f"last.thread_{k}"))
        base = F.when(F.col("is_root"), F.col(f"before.thread_{k}")).otherwise(F.lit(0))
        return F.when(last >= base, last - base).alias(f"delta_{k}")

    out = joined.select(
        "file", "root_id", "thread_id", "is_root", F.coalesce("_n", F.lit(0)).alias("responses"),
        *[f"sum_{k}" for k in FIELDS], *[delta(k) for k in FIELDS],
    )
    same = [F.col(f"sum_{k}") == F.col(f"delta_{k}") for k in FIELDS]
    checked = reduce(lambda a, b: a + b, [s.isNotNull().cast("int") for s in same])
    return out.withColumn("checked", checked).withColumn(
        "full_match", F.when(checked == len(FIELDS), reduce(lambda a, b: a & b, same))
    )
