"""Queries that run a stream to the end of its input; their SQL counterparts are those of the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.bridge import Frames
from ..sources.stored import shared_folder as folder
from ..streaming import live
from .registry import query


@query(
    "stream_dedup",
    "SELECT event_type, count(DISTINCT (user_id, event_type, event_id % 50)) AS kept FROM events GROUP BY 1",
    (),
)
def stream_dedup(f: Frames) -> DataFrame:
    s = live.events(f.spark, f.sf_dir).withColumn("slot", F.col("event_id") % 50)
    once = live.deduplicated(s, ["user_id", "event_type", "slot"], "60 days").select("event_type")
    return live.run_available(once, f.spark, folder(f.spark)).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


_NOW = 500_000_000_000


@query(
    "recent_events",
    f"SELECT event_id, event_type, ns FROM ev WHERE ns BETWEEN {_NOW} - 120000000000 AND {_NOW} + 60000000000",
    ("ev",),
)
def recent_events(f: Frames) -> DataFrame:
    return live.recent(f.events, _NOW).select("event_id", "event_type", "ns")


@query(
    "stream_window_counts",
    "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total "
    "FROM events GROUP BY 1, 2",
    (),
)
def stream_window_counts(f: Frames) -> DataFrame:
    return live.run_available(live.window_counts(live.events(f.spark, f.sf_dir)), f.spark, folder(f.spark), "complete")


@query(
    "stream_sessions",
    """WITH l AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER
  BY ts) >= 43200000000 AS b FROM events),
s AS (SELECT *, sum(coalesce(b, FALSE)::INT) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM
  l)
SELECT user_id, min(us) AS start_us, max(us) + 43200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, s""",
    (),
)
def stream_sessions(f: Frames) -> DataFrame:
    return live.run_available(live.sessions(live.events(f.spark, f.sf_dir)), f.spark, folder(f.spark), "complete")


@query(
    "stream_pairs",
    "SELECT user_id % 10 AS session, event_type AS tool, count(*) AS pairs, sum(round(value * 1000)::BIGINT)::BIGINT "
    "AS total_ms FROM events WHERE event_id % 17 <> 0 GROUP BY 1, 2",
    (),
)
def stream_pairs(f: Frames) -> DataFrame:
    done = live.run_available(
        live.paired(live.phases(live.events(f.spark, f.sf_dir))), f.spark, folder(f.spark)
    ).filter("status = 'done'")
    return done.groupBy("session", "tool").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(F.expr("(end_ns - start_ns) div 1000000")).alias("total_ms")
    )
