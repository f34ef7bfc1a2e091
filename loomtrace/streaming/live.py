"""Structured Streaming forms: deduplication in bounded state, windowed counts, inactivity sessions, live pairing.

Each takes a streaming frame of events and returns a streaming frame; run_available runs one to the end of its input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, with an event time and a number of seconds since the epoch."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def recent(events: DataFrame, now_ns: int, older_s: int = 120, ahead_s: int = 60) -> DataFrame:
    """Events (column ns) that are neither older than older_s nor more than ahead_s in the future, seen from an instant; for
    a stream, the instant of its micro-batch."""
    ns = F.col("ns")
    return events.filter((ns >= now_ns - older_s * 1_000_000_000) & (ns <= now_ns + ahead_s * 1_000_000_000))


def deduplicated(stream: DataFrame, key: list[str], late: str = "30 days") -> DataFrame:
    """The first event of each key within the watermark; the state holds no older keys."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(key)


def window_counts(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    w = F.window("at", width)
    counts = stream.withWatermark("at", late).groupBy(w, "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )
    return counts.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Stretches of a user's events without a gap as long as `gap`."""
    s = stream.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return s.select(
        "user_id",
        F.unix_micros("session_window.start").alias("start_us"),
        F.unix_micros("session_window.end").alias("end_us"),
        "n",
    )


def phases(stream: DataFrame) -> DataFrame:
    """Start and end rows of calls from a stream of events, in one stream: session, agent, call_id, phase, tool, ns, at."""
    start = F.struct(F.lit("start").alias("phase"), (F.unix_micros("at") * 1_000).alias("ns"))
    end = F.struct(
        F.lit("end").alias("phase"),
        (F.unix_micros("at") * 1_000 + F.round(F.col("value") * 1_000).cast("long") * 1_000_000).alias("ns"),
    )
    both = F.when(F.col("event_id") % 17 == 0, F.array(start)).otherwise(F.array(start, end))
    rows = stream.select("event_id", "user_id", "event_type", "at", F.explode(both).alias("p"))
    return rows.select(
        (F.col("user_id") % 10).alias("session"),
        F.col("user_id").alias("agent"),
        F.col("event_id").alias("call_id"),
        F.col("event_type").alias("tool"),
        F.col("p.phase").alias("phase"),
        F.col("p.ns").alias("ns"),
        "at",
    )


def paired(stream: DataFrame, late: str = "1 hour", wait: str = "1 hour") -> DataFrame:
    """Live pairing of starts and ends, in whatever order they come: a join of the stream with itself by call, in the JVM.
    A call is emitted once both are seen; one whose other half has not come within `wait` of event time is emitted alone,
    as open (or orphan), when the watermark has passed, and its state dropped."""
    half = lambda phase, names: stream.filter(F.col("phase") == phase).select(*names).withWatermark("at", late)
    starts = half("start", ["session", "agent", "call_id", "tool", F.col("ns").alias("start_ns"), "at"])
    ends = half(
        "end",
        [
            F.col("session").alias("_s"),
            F.col("agent").alias("_a"),
            F.col("call_id").alias("_c"),
            F.col("tool").alias("_t"),
            F.col("ns").alias("end_ns"),
            "at",
        ],
    )
    ends = ends.withColumnRenamed("at", "ended")
    same = (F.col("session") == F.col("_s")) & (F.col("agent") == F.col("_a")) & (F.col("call_id") == F.col("_c"))
    near = (F.col("ended") >= F.col("at") - F.expr(f"INTERVAL {wait}")) & (
        F.col("ended") <= F.col("at") + F.expr(f"INTERVAL {wait}")
    )
    both = starts.join(ends, same & near, "full_outer")
    status = F.when(F.col("end_ns").isNull(), "open").when(F.col("start_ns").isNull(), "orphan").otherwise("done")
    keys = [
        F.coalesce(x, y).alias(x) for x, y in (("session", "_s"), ("agent", "_a"), ("call_id", "_c"), ("tool", "_t"))
    ]
    return both.select(*keys, "start_ns", "end_ns", status.alias("status"))


def run_available(stream: DataFrame, spark: SparkSession, folder: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all its input and returns what it wrote, as Parquet by the executors. Append writes exactly-once
    files; complete writes the whole result of each batch to a folder of its own, of which the last counts."""
    name = f"stream_{uuid.uuid4().hex}"
    out = f"{folder}/{name}/out"
    writer = stream.writeStream.trigger(availableNow=True).option(
        "checkpointLocation", f"{folder}/{name}/checkpoint"
    ).outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    last = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last.append(number)

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/{last[-1]}") if last else spark.createDataFrame(
        [], stream.schema
    )
