"""Queries over rollout logs that are written from the events: one log per user, a few lines per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import rollouts
from ..sources.bridge import Frames
from .registry import query


def _log(f: Frames) -> DataFrame:
    """file, line, value: for each event a call (every third a script with a command in it), the usage of the response that
    made it, sometimes an action of its own, the output, and now and then a line of an unknown kind."""
    e = f.events.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ns", "event_id")) - 1)
    ident, k = F.col("event_id").cast("string"), F.col("k")
    script = F.col("event_id") % 3 == 0

    def line(kind: str, when=None, **payload):
        fields = F.struct(*[v.alias(n) for n, v in payload.items()])
        text = F.to_json(F.struct(F.lit(kind).alias("type"), fields.alias("payload")))
        return text if when is None else F.when(when, text)

    call = F.when(
        script,
        line("response_item", type=F.lit("custom_tool_call"), call_id=F.concat(F.lit("e"), ident), name=F.lit("exec"))
    ).otherwise(line("response_item", type=F.lit("function_call"), call_id=F.concat(F.lit("c"), ident), name=F.col("event_type")))
    tokens = F.struct(
        (k * 10 + 1_000).alias("input_tokens"), k.alias("cached_input_tokens"), (k + 50).alias("output_tokens")
    )
    usage = line("token_usage_record", response_id=F.concat(F.lit("r"), ident), usage=tokens)
    command = F.struct(
        F.lit("CommandExecution").alias("type"),
        F.concat(F.lit("i"), ident).alias("id"),
        (k % 2).alias("exit_code"),
        F.repeat(F.lit("y"), k.cast("int")).alias("aggregated_output"),
    )
    inner = line("event_msg", script, type=F.lit("item_completed"), item=command)
    change = F.struct(F.lit("FileChange").alias("type"), F.concat(F.lit("s"), ident).alias("id"))
    own = line("event_msg", (F.col("event_id") % 5 == 0) & ~script, type=F.lit("item_completed"), item=change)
    output = F.when(
        script,
        line(
            "response_item",
            type=F.lit("custom_tool_call_output"),
            call_id=F.concat(F.lit("e"), ident),
            output=F.lit(""),
        )
    ).otherwise(line("response_item", type=F.lit("function_call_output"), call_id=F.concat(F.lit("c"), ident), output=F.repeat(F.lit("x"), (k % 50).cast("int"))))
    odd = line("novelty", F.col("event_id") % 11 == 0, note=ident)
    every = e.select(
        "user_id", "r", F.posexplode(F.array(call, usage, inner, own, output, odd)).alias("n", "value")
    ).filter("value IS NOT NULL")
    return every.select(
        F.col("user_id").cast("string").alias("file"),
        (F.col("r") * 6 + F.col("n") + 1).cast("long").alias("line"),
        "value",
    )


_CALLS = """
WITH e AS (SELECT *, user_id::VARCHAR AS file, event_id % 3 = 0 AS script, 'r' || event_id AS rid, 'r' || lead(event_id)
  OVER (PARTITION BY user_id ORDER BY ns, event_id) AS consumer,
  lead(k) OVER (PARTITION BY user_id ORDER BY ns, event_id) AS next_k FROM ev),
c AS (SELECT file, 'c' || event_id AS call_id, event_type AS tool, 'function' AS made_as, 'success' AS status, NULL AS
  parent, rid AS emitter, consumer, greatest(k % 50, 1) AS weight, 2 AS place, next_k, k + 50 AS written FROM e WHERE
  NOT script
  UNION ALL SELECT file, 'e' || event_id, 'exec', 'script', 'success', NULL, rid, consumer, 1, 2, next_k, k + 50 FROM e
    WHERE script
  UNION ALL SELECT file, 'i' || event_id, 'Bash', 'item', CASE WHEN k % 2 = 0 THEN 'success' ELSE 'error' END, 'e' ||
    event_id, rid, consumer, 1, 2, next_k, k + 50 FROM e WHERE script
  UNION ALL SELECT file, 's' || event_id, 'apply_patch', 'item', 'success', NULL, NULL, consumer, 1, 1, next_k, NULL
    FROM e WHERE event_id % 5 = 0 AND NOT script)
"""


@query(
    "rollout_calls", _CALLS + "SELECT file, call_id, tool, made_as, status, parent, emitter, consumer FROM c", ("ev",)
)
def rollout_calls(f: Frames) -> DataFrame:
    return rollouts.calls(rollouts.parsed(_log(f))).select(
        "file", "call_id", "tool", "made_as", "status", "parent", "emitter", "consumer"
    )


@query(
    "rollout_allocation",
    _CALLS
    + """, t AS (SELECT *, next_k * 10 + 1000 - next_k AS uncached, sum(weight) OVER (PARTITION BY file, consumer) AS
  total FROM c WHERE made_as <> 'script' AND consumer IS NOT NULL),
b AS (SELECT *, uncached * weight // total AS base, uncached * weight % total AS rest FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY file, consumer ORDER BY rest DESC, place) <= uncached - sum(base) OVER
  (PARTITION BY file, consumer) AS more FROM b)
SELECT file, call_id, emitter, consumer, (base + more::INT)::BIGINT AS input_share, written AS output_share FROM n
UNION ALL SELECT file, call_id, emitter, consumer, NULL, written FROM c WHERE made_as <> 'script' AND consumer IS
  NULL""",
    ("ev",),
)
def rollout_allocation(f: Frames) -> DataFrame:
    """A script's only action takes all of its share, so the SQL needs no second split."""
    return rollouts.allocation(rollouts.parsed(_log(f))).select(
        "file", "call_id", "emitter", "consumer", "input_share", "output_share"
    )


@query(
    "rollout_uninterpreted",
    "SELECT user_id::VARCHAR AS file, 'line novelty' AS what, count(*) AS lines FROM events WHERE event_id % 11 = 0 "
    "GROUP BY 1",
    (),
)
def rollout_uninterpreted(f: Frames) -> DataFrame:
    return rollouts.uninterpreted(_log(f))
