"""Context boundaries: parent pointers as they existed at a line, recorded compactions before it, content of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

_END = (1 << 63) - 1


def _versions(nodes: DataFrame) -> DataFrame:
    """Each occurrence of a node holds from its line until the next one of the same uid in its file."""
    w = Window.partitionBy("file", "uid").orderBy("line")
    return nodes.filter("uid IS NOT NULL").select(
        "file", "uid", F.col("line").alias("since"), F.coalesce(F.lead("line").over(w), F.lit(_END)).alias("until"),
        "parent", "compaction",
    )


def _first_edges(versions: DataFrame) -> DataFrame:
    """Of each version, for each stretch of lines: `end` (found, initial, absent) with the node it was decided at, or a
    pointer (to_uid, to_since) to the version of its parent that held then."""
    v = versions.withColumn(
        "end", F.when(F.col("compaction"), "found").when(F.col("parent").isNull(), "initial")
    )
    own = ["file", "uid", "since"]
    ended = v.filter("end IS NOT NULL").select(
        *own, F.col("since").alias("lo"), F.col("until").alias("hi"), "end", F.col("uid").alias("at"),
        F.lit(None).cast("string").alias("to_uid"), F.lit(None).cast("long").alias("to_since"),
    )
    going = v.filter("end IS NULL")
    up = versions.select(
        "file", F.col("uid").alias("parent"), F.col("since").alias("_since"), F.col("until").alias("_until")
    )
    lo, hi = F.greatest("since", "_since"), F.least("until", "_until")
    met = going.join(up, ["file", "parent"]).filter(lo < hi).select(
        *own, lo.alias("lo"), hi.alias("hi"), F.lit(None).cast("string").alias("end"),
        F.lit(None).cast("string").alias("at"), F.col("parent").alias("to_uid"), F.col("_since").alias("to_since"),
    )
    # before its parent's first line, if ever, a pointer leads nowhere
    born = up.groupBy("file", "parent").agg(F.min("_since").alias("_born"))
    late = F.coalesce(F.least("until", "_born"), F.col("until"))
    before = going.join(born, ["file", "parent"], "left").filter(F.col("since") < late).select(
        *own, F.col("since").alias("lo"), late.alias("hi"), F.lit("absent").alias("end"), F.col("parent").alias("at"),
        F.lit(None).cast("string").alias("to_uid"), F.lit(None).cast("long").alias("to_since"),
    )
    return ended.unionByName(met).unionByName(before)


def resolved(nodes: DataFrame) -> DataFrame:
    """Where the walk along parents ends, of each version of a node and each stretch [lo, hi) of lines as of which it is
    walked: end (found at a compaction, initial, absent, cycle) and the node `at`. By pointer doubling over versioned edges:
    a round follows each pointer's own pointer, cut to the lines for which both hold, so chains of 2^k take k rounds.
    Distances have no gaps, so a round in which no pointer ends leaves only those that lead into cycles."""
    edges = stored(_first_edges(_versions(nodes)), "edges")
    key = ["file", "uid", "since"]
    while True:
        open_ = edges.filter("end IS NULL")
        if open_.isEmpty():
            return edges.drop("to_uid", "to_since")
        far = edges.select(
            "file", F.col("uid").alias("to_uid"), F.col("since").alias("to_since"), F.col("lo").alias("_lo"),
            F.col("hi").alias("_hi"), F.col("end").alias("_end"), F.col("at").alias("_at"),
            F.col("to_uid").alias("_to"), F.col("to_since").alias("_ts"),
        )
        lo, hi = F.greatest("lo", "_lo"), F.least("hi", "_hi")
        moved = open_.join(far, ["file", "to_uid", "to_since"]).filter(lo < hi).select(
            *key, lo.alias("lo"), hi.alias("hi"), F.col("_end").alias("end"), F.col("_at").alias("at"),
            F.col("_to").alias("to_uid"), F.col("_ts").alias("to_since"),
        )
        moved = stored(moved, "edges")
        done = edges.filter("end IS NOT NULL")
        if moved.filter("end IS NOT NULL").isEmpty():
            cyclic = open_.withColumn("end", F.lit("cycle"))
            return done.unionByName(cyclic).drop("to_uid", "to_since")
        edges = stored(done.unionByName(moved), "edges")


def _recorded(requests: DataFrame, compactions: DataFrame) -> DataFrame:
    """id, _compaction: the latest compaction (by ns, then line) of the file not after the request in line and in time. One
    pass in order of time finds the latest before it in time; only where that one lies on a later line (times that run
    against the lines) is the request compared with the compactions of its file."""
    timed = compactions.filter("ns IS NOT NULL")
    none = lambda kind: F.lit(None).cast(kind)
    marks = timed.select("file", "ns", "line", F.lit(0).alias("_k"), none("string").alias("id"), F.struct("ns", "line", "boundary").alias("_c"))
    asked = requests.filter("ns IS NOT NULL").select(
        "file", "ns", "line", F.lit(1).alias("_k"), F.col("id").cast("string").alias("id"),
        none("struct<ns:bigint,line:bigint,boundary:string>").alias("_c"),
    )
    w = Window.partitionBy("file").orderBy("ns", "_k", "line").rowsBetween(Window.unboundedPreceding, 0)
    last = marks.unionByName(asked).withColumn("_c", F.last("_c", ignorenulls=True).over(w)).filter("_k = 1 AND _c IS NOT NULL")
    last = stored(last.select("file", "id", "ns", "line", "_c"), "recorded")
    good = last.filter(F.col("_c.line") <= F.col("line")).select("id", "_c")
    c = timed.select("file", F.struct("ns", "line", "boundary").alias("_d"))
    rest = last.filter(F.col("_c.line") > F.col("line")).drop("_c").join(c, "file").filter(
        (F.col("_d.line") <= F.col("line")) & (F.col("_d.ns") <= F.col("ns"))
    )
    return good.unionByName(rest.groupBy("id").agg(F.max("_d").alias("_c")))


def boundaries(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (id string, each once; file, line, uid, ns) with boundary, reason (null: a compaction was found; initial, absent, cycle,
    no_uid, before_copied_boundary), graph_boundary (what the pointers alone tell) and basis (pointers, recorded).
    nodes (file, line, uid, parent, compaction, ns): lines of a transcript. A recorded compaction before the request, in
    line and in time, overrides the pointers. A boundary that began after the request (a copied one) is none."""
    ends = resolved(nodes)
    asked = requests.select("id", "file", "line", "uid", "ns")
    walked = asked.join(ends.select("file", "uid", "lo", "hi", "end", "at"), ["file", "uid"]).filter(
        (F.col("lo") <= F.col("line")) & (F.col("line") < F.col("hi"))
    ).select("id", "end", "at")
    compactions = nodes.filter("compaction").select(
        "file", "line", "ns", F.coalesce("uid", F.concat_ws(":", "file", "line")).alias("boundary")
    )
    began = compactions.groupBy("file", "boundary").agg(F.min_by("ns", "line").alias("_began"))
    known = F.when(F.col("end") == "found", F.col("at")).when(F.col("end") == "initial", F.concat(F.lit("initial:"), "at"))
    why = F.when(F.col("uid").isNull(), "no_uid").when(F.col("end").isNull(), "absent").when(F.col("end") != "found", F.col("end"))
    rows = asked.join(walked, "id", "left").join(_recorded(asked, compactions), "id", "left").select(
        *asked.columns,
        known.alias("graph_boundary"),
        why.alias("_why"),
        F.coalesce("_c.boundary", known).alias("boundary"),
        F.when(F.col("_c").isNotNull(), "recorded").otherwise("pointers").alias("basis"),
    )
    copied = F.col("ns") < F.col("_began")
    return stored(rows, "bounds").join(began, ["file", "boundary"], "left").select(
        *asked.columns,
        F.when(~F.coalesce(copied, F.lit(False)), F.col("boundary")).alias("boundary"),
        F.when(copied, "before_copied_boundary").otherwise(F.col("_why")).alias("reason"),
        "graph_boundary",
        "basis",
    )


def contents_of_windows(contents: DataFrame, windows: DataFrame) -> DataFrame:
    """contents (content_id, boundary, ns) that fall into windows (window_id, boundary, since_ns, until_ns): the same boundary
    and since <= ns < until; a bound that is null is open, a content without time falls into none."""
    lo = F.col("since_ns").isNull() | (F.col("since_ns") <= F.col("ns"))
    hi = F.col("until_ns").isNull() | (F.col("ns") < F.col("until_ns"))
    return contents.filter("ns IS NOT NULL").join(windows, "boundary").filter(lo & hi)
