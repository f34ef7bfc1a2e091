"""The event store: Parquet by client and session; idempotent appends, merges, retention, session state, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def held(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet folder's rows; None where nothing was written to it yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def append(events: DataFrame, path: str) -> int:
    """Adds the events whose id the store does not hold; returns how many. Only ids of the touched sessions are read."""
    spark = events.sparkSession
    fresh = events.dropDuplicates(["client", "event_id"])
    if (old := held(spark, path)) is not None:
        touched = fresh.select("client", "session_id").distinct()
        ids = old.join(touched, ["client", "session_id"], "left_semi").select("client", "event_id")
        fresh = fresh.join(ids, ["client", "event_id"], "left_anti")
    seen = Observation()
    fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("client", "session_id").parquet(
        path
    )
    return seen.get["n"]


def sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("client", "session_id").agg(F.count(F.lit(1)).alias("events"))


def find_session(spark: SparkSession, path: str, prefix: str) -> tuple[str, str]:
    """The one session whose id is, or begins with, prefix."""
    found = spark.read.parquet(path).select("client", "session_id").filter(
        F.col("session_id").startswith(prefix)
    ).distinct().limit(2).collect()
    exact = [r for r in found if r.session_id == prefix]
    if len(exact or found) != 1:
        raise ValueError(f"{len(found) or 'no'} sessions begin with {prefix!r}")
    return tuple((exact or found)[0])


def merge_files(spark: SparkSession, path: str, target: str, files_per_session: int = 1) -> None:
    """The store written anew, each event once and each session in few files; it can then take the old one's place."""
    once = spark.read.parquet(path).dropDuplicates(["client", "event_id"])
    slot = F.pmod(F.xxhash64("event_id"), F.lit(files_per_session))
    once.repartition("client", "session_id", slot).write.mode("overwrite").partitionBy("client", "session_id").parquet(
        target
    )


def expired(spark: SparkSession, path: str, time: str, before_ns: int) -> DataFrame:
    """Sessions whose newest event is older than an instant."""
    return spark.read.parquet(path).groupBy("client", "session_id").agg(F.max(time).alias("last_ns")).filter(
        F.col("last_ns") < before_ns
    )


def upsert_sessions(state: DataFrame, events: DataFrame, time: str = "ns") -> DataFrame:
    """Session state (client, session_id, revision, first_ns, last_ns, events) after a batch of new events."""
    batch = events.groupBy("client", "session_id").agg(
        F.lit(1).alias("revision"),
        F.min(time).alias("first_ns"),
        F.max(time).alias("last_ns"),
        F.count(F.lit(1)).alias("events"),
    )
    both = state.unionByName(batch)
    return both.groupBy("client", "session_id").agg(
        F.sum("revision").alias("revision"),
        F.min("first_ns").alias("first_ns"),
        F.max("last_ns").alias("last_ns"),
        F.sum("events").alias("events"),
    )


def reports(findings: DataFrame) -> DataFrame:
    """One JSON document per session: findings by rule, the counted calls, each array sorted."""
    by_rule = findings.groupBy("session", "rule").agg(F.count(F.lit(1)).alias("findings"), F.sum("n").alias("calls"))
    return by_rule.groupBy("session").agg(
        F.to_json(
            F.struct(
                F.lit("1.1").alias("report_version"),
                F.col("session"),
                F.array_sort(F.collect_list(F.struct("rule", "findings", "calls"))).alias("rules"),
            )
        ).alias("report")
    )


def session_key(session_id: Column) -> Column:
    """A name for a session's folder: its id where that is plain and short, else cut and marked with a hash of it."""
    safe = F.regexp_replace(session_id, r"[^A-Za-z0-9._-]", "_")
    odd = (safe != session_id) | (F.length(safe) > 64)
    marked = F.concat(F.substring(safe, 1, 48), F.lit("-"), F.substring(F.sha2(session_id, 256), 1, 12))
    return F.when(F.coalesce(session_id, F.lit("")) == "", "_no-session").when(odd, marked).otherwise(safe)


def publish(calls: DataFrame, state: DataFrame, path: str, analysed: DataFrame | None = None) -> DataFrame:
    """Replaces what was published of analysed sessions by a new analysis. calls: client, session_id, revision and any more;
    analysed: the sessions that were analysed (client, session_id, revision), those of calls where not given.

    Every analysed session is written, one without rows as a row of its own (`nothing`), so that it loses what it had;
    published() leaves such rows out. Sessions whose state is older than the analysed revision, or unknown, are refused and
    returned. Only the folders of published sessions are written anew, so analyses of other sessions run beside; of two
    analyses of one session the later one stays.
    """
    key = ["client", "session_id"]
    analysed = (calls if analysed is None else analysed).select(*key, "revision").distinct()
    known = state.select(*key, F.col("revision").alias("known"))
    judged = analysed.join(known, key, "left").withColumn("ok", F.coalesce(F.col("known") >= F.col("revision"), F.lit(False)))
    good = judged.filter("ok").select(*key, "revision")
    rows = calls.join(good, [*key, "revision"], "left_semi").withColumn("nothing", F.lit(False))
    empty = good.join(calls.select(*key).distinct(), key, "left_anti").withColumn("nothing", F.lit(True))
    every = rows.unionByName(empty, allowMissingColumns=True)
    # a session's rows come from many tasks: few files of each
    every.hint("rebalance", *key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(path)
    return judged.filter("NOT ok").select(*key, "revision")


def published(rows: DataFrame) -> DataFrame:
    """The published rows without those that only say that a session has none."""
    return rows.filter("NOT nothing").drop("nothing")


def pending(state: DataFrame, published: DataFrame) -> DataFrame:
    """Sessions whose state is newer than what was published of them: client, session_id, revision, analysed."""
    done = published.groupBy("client", "session_id").agg(F.max("revision").alias("analysed"))
    met = state.join(done, ["client", "session_id"], "left")
    return met.filter(F.coalesce(F.col("revision") > F.col("analysed"), F.lit(True))).select(
        "client", "session_id", "revision", "analysed"
    )


def marked(marks: DataFrame, changes: DataFrame) -> DataFrame:
    """Feedback marks (finding, mark, note, at_ns) after changes: the latest of each finding counts, one without a mark is
    taken away."""
    both = marks.unionByName(changes)
    last = both.groupBy("finding").agg(F.max_by(F.struct("mark", "note", "at_ns"), "at_ns").alias("m"))
    return last.select("finding", "m.mark", "m.note", "m.at_ns").filter("mark IS NOT NULL")


def collection_health(clients: DataFrame, silence_s: int = 1_800) -> DataFrame:
    """Warnings on the collection: client, code. clients: client, configured_at, activity_at, received_at (seconds, null:
    never) and installed, complete, disabled, interpreter_exists, entry_current, config_readable (flags)."""
    since = F.col("activity_at") > F.coalesce(F.col("configured_at") + silence_s, F.lit(float("-inf")))
    checks = {
        "interpreter_missing": ~F.col("interpreter_exists"),
        "entry_moved": ~F.col("entry_current"),
        "hooks_missing": F.col("config_readable") & ~F.col("installed"),
        "hooks_partial": F.col("config_readable") & F.col("installed") & ~F.col("complete"),
        "hooks_disabled": F.col("config_readable") & F.col("disabled"),
        "config_unreadable": ~F.col("config_readable"),
        "never_received": since & F.col("received_at").isNull(),
        "silent_since_activity": since & (F.col("activity_at") - F.col("received_at") > silence_s),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in checks.items()]))
    return clients.select("client", F.explode(found).alias("code"))
