"""Canonical frames of the engine, built from the driver's tables.

The operators of this package work on calls, raw events, responses and messages of sessions; the test tables hold none,
so these deterministic mappings stand in for the readers. Each has a twin in SQL, by which results are checked. Time is
scaled down by 60, so that the analysis windows (minutes) hold several calls.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import placed

EPOCH_US = 1_704_067_200_000_000
TIME_SCALE = 60
#: Tool -> category of a call.
CATEGORIES = {"view": "read", "click": "search", "purchase": "edit", "signup": "agent", "error": "shell"}


class Frames:
    """The frames of one data directory; each is a plan, read when a query uses it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        """events with ns (scaled) and k, the number in props."""
        us = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US
        return self.table("events").select(
            "event_id",
            "user_id",
            "event_type",
            "value",
            (F.floor(us * 1000 / TIME_SCALE)).cast("long").alias("ns"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )

    @cached_property
    def calls(self) -> DataFrame:
        """One row per call: session, agent, call_id, tool, category, server, target, params, status, content_fp, start_ns,
        end_ns, duration_ms (null while open), bytes, epoch, seq (in the session), aseq (of the agent), emitter."""
        is_open = F.col("event_id") % 17 == 0
        category = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])[F.col("event_type")]
        status = F.when(is_open, "open").when(F.col("event_type") == "error", "error").when(
            F.col("event_id") % 13 == 0, "unknown"
        ).otherwise("success")
        base = self.events.select(
            (F.col("user_id") % 10).alias("session"),
            F.col("user_id").alias("agent"),
            F.col("event_id").alias("call_id"),
            F.col("event_type").alias("tool"),
            category.alias("category"),
            F.when(F.col("k") % 4 == 0, F.concat(F.lit("srv"), (F.col("k") % 3).cast("string"))).alias("server"),
            F.concat(F.lit("k"), (F.col("k") % 20).cast("string")).alias("target"),
            (F.col("k") % 3).alias("params"),
            status.alias("status"),
            (F.col("k") % 5).alias("content_fp"),
            F.col("ns").alias("start_ns"),
            F.when(~is_open, F.round(F.col("value") * 1000).cast("long")).alias("duration_ms"),
            F.when(~is_open, F.col("k") * 10 + F.col("event_id") % 7).alias("bytes"),
        )
        agent = Window.partitionBy("session", "agent").orderBy("start_ns", "call_id")
        starts = F.sum((F.col("tool") == "signup").cast("long")).over(agent.rowsBetween(Window.unboundedPreceding, 0))
        return (
            placed(base, ["session"], "start_ns", ["call_id"])
            .withColumn("end_ns", F.col("start_ns") + F.col("duration_ms") * 1_000_000)
            .withColumn("epoch", F.greatest(starts - 1, F.lit(0)))
            .withColumn("aseq", (F.row_number().over(agent) - 1).cast("long"))
            .withColumn("emitter", F.floor(F.col("aseq") / 2).cast("long"))
        )

    @cached_property
    def raw(self) -> DataFrame:
        """Start and end events of calls: some ends are missing, some events come twice."""
        e = self.events
        start = e.select(
            (F.col("user_id") % 10).alias("session"),
            F.col("user_id").alias("agent"),
            F.col("event_id").alias("call_id"),
            F.lit("start").alias("phase"),
            F.col("ns"),
            F.col("event_type").alias("tool"),
            F.col("k"),
            F.lit(None).cast("string").alias("status"),
        )
        ended = e.filter(F.col("event_id") % 17 != 0)
        end = ended.select(
            (F.col("user_id") % 10).alias("session"),
            F.col("user_id").alias("agent"),
            F.col("event_id").alias("call_id"),
            F.lit("end").alias("phase"),
            (F.col("ns") + F.round(F.col("value") * 1000).cast("long") * 1_000_000).alias("ns"),
            F.col("event_type").alias("tool"),
            F.col("k"),
            F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        )
        both = start.unionByName(end)
        every = both.unionByName(both.filter(F.col("call_id") % 23 == 0))
        return every.withColumn("event_key", F.concat_ws("-", "phase", F.col("call_id").cast("string")))

    @cached_property
    def responses(self) -> DataFrame:
        """Model responses with token usage: thread, idx (from 1), ctx (context window), ns, input_tokens, output_tokens (some unknown)."""
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.sum("l_quantity").cast("long").alias("output_tokens")
        )
        w = Window.partitionBy("thread").orderBy("ns", "response_id")
        base = self.table("orders").select(
            F.col("o_orderkey").alias("response_id"),
            F.col("o_custkey").alias("thread"),
            (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ns"),
            F.floor("o_totalprice").cast("long").alias("input_tokens"),
            F.col("o_orderstatus").alias("mark"),
            F.col("o_orderpriority").alias("tier"),
        )
        joined = base.join(lines, base["response_id"] == lines["o_orderkey"], "left").drop("o_orderkey")
        return joined.withColumn("idx", F.row_number().over(w).cast("long")).withColumn(
            "ctx", F.sum((F.col("mark") == "F").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        )

    @cached_property
    def messages(self) -> DataFrame:
        """Messages between agents: conv, turn, author, recipient, text, ns (one second a turn)."""
        rows = self.table("conversations")
        text = F.coalesce("text", F.lit(""))
        return rows.select(
            F.col("conv_id").alias("conv"),
            "turn",
            F.col("role").alias("author"),
            F.when(F.col("role") == "user", "assistant").otherwise("user").alias("recipient"),
            text.alias("text"),
            F.xxhash64(text).alias("fp"),
            F.length(text).cast("long").alias("chars"),
            (F.col("conv_id") * 1_000_000_000_000 + F.col("turn") * 1_000_000_000).alias("ns"),
        )


_EVENTS = f"""
SELECT event_id, user_id, event_type, value, ((epoch_us(ts) - {EPOCH_US}) * 1000 // {TIME_SCALE})::BIGINT AS ns,
  (props::JSON->>'k')::BIGINT AS k FROM events
"""
_CALLS = """
SELECT *, start_ns + duration_ms * 1000000 AS end_ns,
  greatest(sum(CASE WHEN tool = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session, agent ORDER BY start_ns, call_id
    ROWS UNBOUNDED PRECEDING) - 1, 0)::BIGINT AS epoch,
  (row_number() OVER (PARTITION BY session ORDER BY start_ns, call_id) - 1)::BIGINT AS seq,
  (row_number() OVER (PARTITION BY session, agent ORDER BY start_ns, call_id) - 1)::BIGINT AS aseq,
  ((row_number() OVER (PARTITION BY session, agent ORDER BY start_ns, call_id) - 1) // 2)::BIGINT AS emitter
FROM (SELECT user_id % 10 AS session, user_id AS agent, event_id AS call_id, event_type AS tool,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN
    'agent' WHEN 'error' THEN 'shell' END AS category,
  CASE WHEN k % 4 = 0 THEN 'srv' || (k % 3) END AS server, 'k' || (k % 20) AS target, k % 3 AS params,
  CASE WHEN event_id % 17 = 0 THEN 'open' WHEN event_type = 'error' THEN 'error' WHEN event_id % 13 = 0 THEN 'unknown'
    ELSE 'success' END AS status,
  k % 5 AS content_fp, ns AS start_ns, CASE WHEN event_id % 17 <> 0 THEN round(value * 1000)::BIGINT END AS duration_ms,
  CASE WHEN event_id % 17 <> 0 THEN k * 10 + event_id % 7 END AS bytes FROM ev)
"""
_RAW = """
SELECT *, phase || '-' || call_id AS event_key FROM (
  SELECT b.* FROM rawbase b UNION ALL SELECT b.* FROM rawbase b WHERE call_id % 23 = 0)
"""
_RAWBASE = """
SELECT user_id % 10 AS session, user_id AS agent, event_id AS call_id, 'start' AS phase, ns, event_type AS tool, k, NULL
  AS status FROM ev
UNION ALL SELECT user_id % 10, user_id, event_id, 'end', ns + round(value * 1000)::BIGINT * 1000000, event_type, k, CASE
  WHEN event_type = 'error' THEN 'error' ELSE 'success' END FROM ev WHERE event_id % 17 <> 0
"""
_RESPONSES = """
SELECT *, row_number() OVER (PARTITION BY thread ORDER BY ns, response_id)::BIGINT AS idx,
  sum(CASE WHEN mark = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY ns, response_id ROWS UNBOUNDED
    PRECEDING)::BIGINT AS ctx
FROM (SELECT o_orderkey AS response_id, o_custkey AS thread, epoch_us(o_orderdate) * 1000 AS ns,
  floor(o_totalprice)::BIGINT AS input_tokens,
  o_orderstatus AS mark, o_orderpriority AS tier, l.output_tokens FROM orders LEFT JOIN (SELECT l_orderkey,
    sum(l_quantity)::BIGINT AS output_tokens FROM lineitem GROUP BY 1) l ON l.l_orderkey = o_orderkey)
"""
_MESSAGES = """
SELECT conv_id AS conv, turn, role AS author, CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END AS recipient,
  coalesce(text, '') AS text,
  coalesce(text, '') AS fp, length(coalesce(text, ''))::BIGINT AS chars, conv_id * 1000000000000 + turn * 1000000000 AS
    ns FROM conversations
"""
#: Of each frame: the frames it reads, and its SQL.
ORACLE_FRAMES = {
    "ev": ((), _EVENTS),
    "calls": (("ev",), _CALLS),
    "rawbase": (("ev",), _RAWBASE),
    "raw": (("rawbase",), _RAW),
    "responses": ((), _RESPONSES),
    "messages": ((), _MESSAGES),
}
