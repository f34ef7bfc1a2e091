"""Analysis that follows a stream of payload lines: only sessions that got new events are analysed again.

A project is a shared folder: `events` (the store, by client and session, each event with the batch that brought it),
`state` (a table of sessions for each batch: revision, first and last instant, number of events), `findings` (by client and
session, replaced whole). Every step may be repeated: events are known by id, a session's revision is the last batch that
brought it an event, and sessions are pending as long as what is published is of an older revision. So a batch that failed
half way is finished when it comes again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import observe
from ..sources import logs, store
from ..sources.stored import stored

KEY = ["client", "session_id"]


def _state(spark: SparkSession, project: str, before: int) -> DataFrame | None:
    """The session table of the last batch before one."""
    tables = store.held(spark, f"{project}/state")
    if tables is None:
        return None
    last = tables.filter(F.col("batch") < before).agg(F.max("batch")).first()[0]
    return None if last is None else tables.filter(F.col("batch") == last).drop("batch")


def take(batch: DataFrame, batch_id: int, project: str, client: str) -> int:
    """Stores the events of a batch of payload lines (value), analyses the sessions they change, and publishes their findings.
    Returns how many sessions were analysed."""
    spark = batch.sparkSession
    # a stream's own session plans without looking at sizes; what follows is no stream
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    events = logs.hook_events(logs.captured(batch), client).filter("session_id IS NOT NULL")
    events = stored(events.withColumn("batch", F.lit(batch_id).cast("long")), "batch-events", "zstd")
    if events.isEmpty():
        return 0
    store.append(events, f"{project}/events")
    # sessions of a batch, few beside all: they alone are read from the store
    touched = events.select(*KEY).distinct()
    whole = spark.read.parquet(f"{project}/events").join(touched, KEY, "left_semi")
    now = whole.groupBy(*KEY).agg(
        (F.max("batch") + 1).alias("revision"), F.min("ns").alias("first_ns"), F.max("ns").alias("last_ns"),
        F.count(F.lit(1)).alias("events"),
    )
    now = stored(now, "touched-sessions")
    old = _state(spark, project, batch_id)
    state = now if old is None else now.unionByName(old.join(now, KEY, "left_anti"))
    state.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch").parquet(f"{project}/state")
    done = store.held(spark, f"{project}/findings")
    waiting = now if done is None else store.pending(now, done.join(touched, KEY, "left_semi"))
    waiting = stored(waiting.select(*KEY, "revision"), "pending-sessions")
    n = waiting.count()
    if n:
        own = spark.read.parquet(f"{project}/events").join(waiting.select(*KEY), KEY, "left_semi")
        # written first, for publishing reads them twice
        found = stored(observe.findings(observe.from_hooks(own), observe.inputs_of(own)), "batch-findings")
        names = waiting.withColumn("session", F.concat_ws("/", *KEY))
        store.publish(found.join(names, "session").drop("session"), now, f"{project}/findings", waiting)
    return n


def follow(lines: DataFrame, project: str, client: str, checkpoint: str) -> None:
    """Takes a stream of payload lines to its end, batch by batch."""
    query = (
        lines.writeStream.foreachBatch(lambda batch, k: take(batch, k, project, client) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def findings(spark: SparkSession, project: str) -> DataFrame:
    """The published findings of all sessions: client, session_id, revision, rule, agent, subject, n, kind, confidence."""
    return store.published(spark.read.parquet(f"{project}/findings"))
