"""Queries on log files that grow: byte offsets, cursors, and lines found again by file and offset."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files
from ..sources.bridge import Frames
from ..sources.stored import shared_folder
from .registry import query


def _written(f: Frames) -> str:
    """A log for each tenth user: of each event a line, in order of time."""
    e = f.events.withColumn("log", F.col("user_id") % 10)
    payload = F.struct(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("call_id"), F.col("k"))
    value = F.to_json(F.struct(F.col("event_type").alias("type"), payload.alias("payload")))
    path = f"{shared_folder(f.spark)}/loomtrace/growing-{uuid.uuid4().hex}"
    lines = e.select("log", "ns", "event_id", value.alias("value")).repartition("log").sortWithinPartitions("log", "ns", "event_id")
    lines.select("log", "value").write.partitionBy("log").text(path)
    return path


_LINES = """
WITH l AS (SELECT user_id % 10 AS log, ns, event_id, event_type, k, '{"type":"' || event_type || '","payload":{"call_id":"c' ||
  event_id || '","k":' || k || '}}' AS value FROM ev),
o AS (SELECT *, coalesce(sum(strlen(value) + 1) OVER w, 0)::BIGINT AS place, row_number() OVER (PARTITION BY log ORDER BY ns,
  event_id) AS line FROM l WINDOW w AS (PARTITION BY log ORDER BY ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1
  PRECEDING))
"""
_LOG = r"/log=(\d+)/"


def _logs_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("log", F.regexp_extract("file", _LOG, 1).cast("long"))


@query(
    "lines_behind_cursors",
    _LINES + "SELECT log, place AS \"offset\", strlen(value)::BIGINT AS size, value FROM o WHERE line > 40 + log",
    ("ev",),
)
def lines_behind_cursors(f: Frames) -> DataFrame:
    """Of each log, some lines were taken before: the rest, by where they begin."""
    path = _written(f)
    now = files.states(f.spark, f"{path}/log=*/*.txt")
    first = files.lines_at(f.spark, f"{path}/log=*/*.txt")
    place = F.row_number().over(Window.partitionBy("file").orderBy("offset"))
    taken = _logs_of(first.withColumn("_line", place)).filter(F.col("_line") <= 40 + F.col("log"))
    ends = taken.groupBy(files.plain(F.col("file")).alias("_key")).agg(F.max(F.col("offset") + F.col("size") + 1).alias("offset"))
    cursors = now.join(ends, files.plain(F.col("file")) == F.col("_key")).select(
        "file", "offset", F.col("offset").alias("size"), "modified_us"
    )
    rest = files.tail(f.spark, files.changed(now, cursors))
    return _logs_of(rest).select("log", "offset", "size", "value")


@query(
    "calls_found_again",
    _LINES
    + "SELECT log, event_id, place AS \"offset\", CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 5 = 0 THEN 'changed' "
    "ELSE 'yes' END AS found, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN value END AS value FROM o",
    ("ev",),
)
def calls_found_again(f: Frames) -> DataFrame:
    """Calls joined to their source lines by file and offset: some references point into a line, some name another call."""
    path = _written(f)
    lines = files.lines_at(f.spark, f"{path}/log=*/*.txt")
    known = lines.withColumn("event_id", F.regexp_extract("value", r'"call_id":"c(\d+)"', 1).cast("long"))
    off, other = F.col("event_id") % 7 == 0, F.col("event_id") % 5 == 0
    refs = known.select(
        "file", (F.col("offset") + F.when(off, 1).otherwise(0)).alias("offset"), "event_id",
        F.get_json_object("value", "$.type").alias("kind"),
        F.concat(F.lit("c"), (F.col("event_id") + F.when(other, 1).otherwise(0)).cast("string")).alias("ident"),
        F.col("offset").alias("at"),
    )
    again = files.found_again(refs, lines)
    return _logs_of(again).select("log", "event_id", F.col("at").alias("offset"), "found", "value")
