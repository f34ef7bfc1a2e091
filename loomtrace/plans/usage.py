"""Queries of token accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import usage
from ..sources.bridge import Frames
from ..sources.stored import dealt
from .registry import query

R = ("responses",)


@query(
    "latest_usage_per_thread",
    "SELECT thread, count(*) AS responses, arg_max(input_tokens, idx) AS input_tokens, last(output_tokens ORDER BY "
    "idx) AS output_tokens FROM responses GROUP BY 1",
    R,
)
def latest_usage_per_thread(f: Frames) -> DataFrame:
    return usage.latest_usage(f.responses)


@query(
    "strict_totals",
    """SELECT thread, count(*) AS responses, count(output_tokens) AS known, CASE WHEN count(output_tokens) = count(*)
  THEN sum(output_tokens) END::BIGINT AS strict_output, sum(output_tokens)::BIGINT AS partial_output,
  CASE WHEN count(output_tokens) = count(*) THEN 'complete' WHEN count(output_tokens) > 0 THEN 'partial' ELSE 'missing'
    END AS status FROM responses GROUP BY 1""",
    R,
)
def strict_totals(f: Frames) -> DataFrame:
    return usage.strict_totals(f.responses, "thread")


@query(
    "consensus_usage",
    "SELECT thread, ctx, CASE WHEN count(DISTINCT tier) = 1 THEN max(tier) END AS tier, count(DISTINCT tier) > 1 AS "
    "conflict, count(DISTINCT tier) AS n_values FROM responses GROUP BY 1, 2",
    R,
)
def consensus_usage(f: Frames) -> DataFrame:
    return usage.consensus(f.responses, ["thread", "ctx"], "tier")


def _lines(f: Frames) -> DataFrame:
    orders = f.table("orders").select(
        F.col("o_orderkey").alias("order_key"), F.floor("o_totalprice").cast("long").alias("total")
    )
    lines = f.table("lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        (F.col("l_linenumber").cast("long") * 100_000_000 + F.col("l_partkey")).alias("line"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").cast("long").alias("weight"),
    )
    # the join, the sums and the windows by order all work on this one shuffle
    rows = f.table("lineitem").count()
    lines, orders = dealt(lines, rows, "order_key"), dealt(orders, rows, "order_key")
    return lines.join(orders.hint("merge"), "order_key").groupBy("order_key", "line", "supp").agg(
        F.max("total").alias("total"), F.sum("weight").alias("weight")
    )


_LINES = """WITH lines AS (SELECT l_orderkey AS order_key, l_linenumber::BIGINT * 100000000 + l_partkey AS line,
  l_suppkey AS supp, max(floor(o_totalprice)::BIGINT) AS total, sum(l_quantity::BIGINT)::BIGINT AS weight
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)"""


@query(
    "allocation_floor",
    _LINES
    + """, s AS (SELECT *, (total * weight // sum(weight) OVER (PARTITION BY order_key))::BIGINT AS share FROM lines)
SELECT order_key, line, supp, share, (max(total) OVER (PARTITION BY order_key) - sum(share) OVER (PARTITION BY
  order_key))::BIGINT AS lost FROM s""",
    (),
)
def allocation_floor(f: Frames) -> DataFrame:
    return usage.split_floor(_lines(f), "order_key", "total", "weight").select(
        "order_key", "line", "supp", "share", "lost"
    )


@query(
    "allocation_largest_remainder",
    _LINES
    + """, b AS (SELECT *, (total * weight // sum(weight) OVER w)::BIGINT AS base, (total * weight % sum(weight) OVER
  w)::BIGINT AS rest FROM lines WINDOW w AS (PARTITION BY order_key)),
r AS (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY rest DESC, line * 1000000 + supp) AS rk, total -
  sum(base) OVER (PARTITION BY order_key) AS remaining FROM b)
SELECT order_key, line, supp, base + CASE WHEN rk <= remaining THEN 1 ELSE 0 END AS share FROM r""",
    (),
)
def allocation_largest_remainder(f: Frames) -> DataFrame:
    lines = _lines(f).withColumn("pos", F.col("line") * 1_000_000 + F.col("supp"))
    return usage.split_exact(lines, "order_key", "total", "weight", "pos").select("order_key", "line", "supp", "share")


_GROWTH = """WITH l AS (SELECT *, lag(input_tokens) OVER w AS pi, lag(output_tokens) OVER w AS po, lag(ctx) OVER w AS pc
  FROM responses WINDOW w AS (PARTITION BY thread ORDER BY idx)),
g AS (SELECT *, CASE WHEN pc = ctx AND input_tokens - pi - po > 0 THEN input_tokens - pi - po END AS added, max(idx)
  OVER (PARTITION BY thread, ctx) - idx AS residence FROM l)"""


@query("context_growth", _GROWTH + " SELECT thread, response_id, ctx, idx, added FROM g", R)
def context_growth(f: Frames) -> DataFrame:
    return usage.growth(f.responses).select("thread", "response_id", "ctx", "idx", "added")


@query(
    "context_residence",
    _GROWTH + " SELECT thread, response_id, added, residence, added * residence AS reread FROM g WHERE added IS NOT NULL",
    R,
)
def context_residence(f: Frames) -> DataFrame:
    return usage.residence(f.responses).filter("added IS NOT NULL").select(
        "thread", "response_id", "added", "residence", "reread"
    )


@query(
    "context_families",
    _GROWTH + ", s AS (SELECT tier, count(*) AS n, sum(added)::BIGINT AS added, sum(added * residence)::BIGINT AS reread FROM g WHERE added IS NOT NULL GROUP BY 1) SELECT *, round(100 * added / sum(added) OVER (), 6) AS share_pct FROM s",
    R,
)
def context_families(f: Frames) -> DataFrame:
    return usage.families(f.responses, "tier")


_STARTS = """WITH b AS (SELECT *, coalesce(sum(output_tokens) OVER (PARTITION BY thread ORDER BY idx ROWS BETWEEN
  UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM responses),
s AS (SELECT thread, ctx, arg_min(input_tokens, idx) AS first_input, arg_min(before, idx) AS before FROM b WHERE ctx > 0
  GROUP BY 1, 2),
k AS (SELECT thread, count(*) AS windows, round(regr_slope(first_input, before), 6) AS slope, round(CASE WHEN count(*) >
  1 THEN corr(first_input, before) END, 6) AS r, min(first_input) AS least_input FROM s GROUP BY 1 HAVING count(*) >=
  3)"""


@query("window_slope_correlation", _STARTS + " SELECT * FROM k", R)
def window_slope_correlation(f: Frames) -> DataFrame:
    return usage.window_slope(f.responses)


@query(
    "retained_estimate",
    _STARTS + " SELECT s.thread, k.r, sum(s.first_input - k.least_input)::BIGINT AS surplus, count(*) AS windows FROM s JOIN k USING (thread) WHERE k.r >= 0.5 AND k.windows >= 5 GROUP BY 1, 2",
    R,
)
def retained_estimate(f: Frames) -> DataFrame:
    return usage.retained(f.responses)


@query(
    "boundary_asof",
    """WITH p AS (SELECT thread, ns, response_id FROM responses WHERE mark = 'P'), c AS (SELECT thread, ns,
  max(response_id) AS cut FROM responses WHERE mark = 'F' GROUP BY 1, 2)
SELECT p.thread, p.ns, p.response_id, CASE WHEN p.ns - c.ns <= 17280000000000000 THEN c.cut END AS asof_cut FROM p ASOF
  LEFT JOIN c ON p.thread = c.thread AND p.ns >= c.ns""",
    R,
)
def boundary_asof(f: Frames) -> DataFrame:
    r = f.responses
    left = r.filter("mark = 'P'").select("thread", "ns", "response_id")
    right = r.filter("mark = 'F'").select("thread", "ns", F.col("response_id").alias("cut"))
    return usage.asof_before(left, right, "thread", "ns", "cut", 17_280_000_000_000_000)


@query(
    "settings_changes",
    "WITH l AS (SELECT thread, tier, coalesce(lag(tier) OVER (PARTITION BY thread ORDER BY idx) <> tier, FALSE)::INT "
    "AS c FROM responses) SELECT thread, sum(c)::BIGINT AS changes, count(DISTINCT tier) AS tiers FROM l GROUP BY 1",
    R,
)
def settings_changes(f: Frames) -> DataFrame:
    return usage.tier_changes(f.responses)


@query(
    "token_coverage_reasons",
    """WITH j AS (SELECT c.*, r.thread, r.output_tokens, count(*) OVER (PARTITION BY c.session, c.agent, c.emitter) AS n
  FROM calls c LEFT JOIN responses r ON c.agent = r.thread AND c.emitter + 1 = r.idx)
SELECT tool, CASE WHEN status = 'open' THEN 'open' WHEN thread IS NULL THEN 'no_response' WHEN output_tokens IS NULL
  THEN 'no_usage' WHEN n > 1 THEN 'shared' ELSE 'own' END AS reason, count(*) AS calls, sum(output_tokens)::BIGINT AS
  output_tokens FROM j GROUP BY 1, 2""",
    ("calls", "responses"),
)
def token_coverage_reasons(f: Frames) -> DataFrame:
    return usage.coverage_reasons(f.calls, f.responses)


@query(
    "request_dedup_windows",
    "WITH d AS (SELECT thread, ctx, input_tokens // 10000 AS bin, count(*) AS copies, min(idx) AS first_idx, "
    "sum(output_tokens)::BIGINT AS output_tokens FROM responses GROUP BY 1, 2, 3) SELECT thread, ctx, count(*) AS "
    "requests, sum(copies - 1)::BIGINT AS copies, min(first_idx) AS first_idx FROM d GROUP BY 1, 2",
    R,
)
def request_dedup_windows(f: Frames) -> DataFrame:
    once = f.responses.groupBy("thread", "ctx", F.floor(F.col("input_tokens") / 10_000).alias("bin")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("idx").alias("first_idx")
    )
    return once.groupBy("thread", "ctx").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.col("copies") - 1).alias("copies"),
        F.min("first_idx").alias("first_idx"),
    )
