"""Queries across sessions, and of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, forecast
from ..sources.bridge import Frames
from .registry import query


def _findings(f: Frames) -> DataFrame:
    """Orders as findings: pattern by priority and status, session by month, project by nation, client by segment."""
    o = f.table("orders")
    c = f.table("customer").select(
        "c_custkey", F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("client")
    )
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("pattern"),
        F.date_format("o_orderdate", "yyyy-MM").alias("session"),
        "project",
        "client",
        (F.col("o_orderkey") % 9 + 1).alias("n"),
        rank.alias("confidence"),
    )


_FIND = """WITH found AS (SELECT o_orderpriority || ':' || o_orderstatus AS pattern, strftime(o_orderdate, '%Y-%m') AS
  session, c_nationkey AS project, c_mktsegment AS client, o_orderkey % 9 + 1 AS n,
  CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END AS confidence FROM orders JOIN customer ON o_custkey =
    c_custkey)"""
_SETS = (
    _FIND
    + ", g AS (SELECT pattern, project, client, count(DISTINCT session) AS sessions, count(*) AS occurrences, sum(n)::BIGINT AS calls, max(confidence) AS confidence, grouping_id(pattern, project, client)::INT AS grain FROM found GROUP BY GROUPING SETS ((pattern), (pattern, project), (pattern, client)))"
)


@query(
    "trends_patterns", _SETS + " SELECT pattern, sessions, occurrences, calls, confidence FROM g WHERE grain = 3", ()
)
def trends_patterns(f: Frames) -> DataFrame:
    return compare.patterns(_findings(f)).filter("grain = 3").select(
        "pattern", "sessions", "occurrences", "calls", "confidence"
    )


@query("trends_by_project", _SETS + " SELECT * FROM g", ())
def trends_by_project(f: Frames) -> DataFrame:
    return compare.patterns(_findings(f))


@query(
    "trends_ranked",
    _SETS + " SELECT pattern, sessions, occurrences, calls, confidence FROM g WHERE grain = 3 AND sessions >= 2 ORDER BY sessions DESC, confidence DESC, occurrences DESC, calls DESC, pattern LIMIT 5",
    (),
)
def trends_ranked(f: Frames) -> DataFrame:
    return compare.ranked(compare.patterns(_findings(f)).filter("grain = 3")).select(
        "pattern", "sessions", "occurrences", "calls", "confidence"
    )


@query(
    "compare_measure_merge",
    "SELECT category, count(*) AS calls, count(*) FILTER (WHERE status = 'error') AS failures, count(*) FILTER (WHERE "
    "category = 'read') AS reads, sum(duration_ms)::BIGINT AS known_ms, count(duration_ms) AS timed, count(DISTINCT "
    "(session, agent)) AS agents FROM calls GROUP BY 1",
)
def compare_measure_merge(f: Frames) -> DataFrame:
    return compare.merge(
        compare.measure(f.calls, "session", "category").withColumnRenamed("session", "part"), "category"
    )


_SPLIT = 21_600_000_000_000
_RATES = f"""WITH s AS (SELECT tool, count(*) FILTER (WHERE start_ns < {_SPLIT} AND params = 1) AS k1, count(*) FILTER
  (WHERE start_ns < {_SPLIT}) AS n1, count(*) FILTER (WHERE start_ns >= {_SPLIT} AND params = 1) AS k2, count(*) FILTER
  (WHERE start_ns >= {_SPLIT}) AS n2,
  count(DISTINCT CASE WHEN start_ns < {_SPLIT} AND params = 1 THEN agent END) AS c1, count(DISTINCT CASE WHEN start_ns
    >= {_SPLIT} AND params = 1 THEN agent END) AS c2 FROM calls GROUP BY 1),
r AS (SELECT *, ((k2 + h) / n2) / ((k1 + h) / n1) AS ratio, sqrt(1 / (c1 + hc) + 1 / (c2 + hc)) AS se FROM (SELECT *,
  CASE WHEN k1 = 0 OR k2 = 0 THEN 0.5 ELSE 0 END AS h, CASE WHEN c1 = 0 OR c2 = 0 THEN 0.5 ELSE 0 END AS hc FROM s))
SELECT tool, k1, n1, k2, n2, c1, c2, round(ratio, 6) AS ratio, round(ratio * exp(-1.96 * se), 6) AS low, round(ratio *
  exp(1.96 * se), 6) AS high,
  CASE WHEN k1 + k2 < 10 OR least(n1, n2) < 200 OR least(c1, c2) < 5 THEN 'too_few' WHEN ratio * exp(1.96 * se) < 1 THEN
    'decrease' WHEN ratio * exp(-1.96 * se) > 1 THEN 'increase' ELSE 'no_difference' END AS conclusion FROM r"""


@query("rate_ratio_ci", _RATES)
def rate_ratio_ci(f: Frames) -> DataFrame:
    return compare.compare_rates(f.calls, _SPLIT)


@query(
    "proportion_ci",
    f"""WITH s AS (SELECT session, count(*) FILTER (WHERE start_ns < {_SPLIT} AND status = 'success') AS x1, count(*)
  FILTER (WHERE start_ns < {_SPLIT}) AS m1, count(*) FILTER (WHERE start_ns >= {_SPLIT} AND status = 'success') AS x2,
  count(*) FILTER (WHERE start_ns >= {_SPLIT}) AS m2
  FROM calls WHERE status IN ('success', 'error') GROUP BY 1),
p AS (SELECT *, x1 / nullif(m1, 0) AS p1, x2 / nullif(m2, 0) AS p2 FROM s), e AS (SELECT *, sqrt(p1 * (1 - p1) /
  nullif(m1, 0) + p2 * (1 - p2) / nullif(m2, 0)) AS se, m1 >= 20 AND m2 >= 20 AS ok FROM p)
SELECT session, x1, m1, x2, m2, CASE WHEN ok THEN round(p2 - p1, 6) END AS difference, CASE WHEN ok THEN round(p2 - p1 -
  1.96 * se, 6) END AS low, CASE WHEN ok THEN round(p2 - p1 + 1.96 * se, 6) END AS high FROM e""",
)
def proportion_ci(f: Frames) -> DataFrame:
    return compare.proportion_difference(f.calls, _SPLIT, "session")


_BINS = """WITH o AS (SELECT *, sum(CASE WHEN category = 'agent' THEN 1 ELSE 0 END) OVER (PARTITION BY session, agent
  ORDER BY aseq ROWS UNBOUNDED PRECEDING) AS chunk FROM calls),
n AS (SELECT *, row_number() OVER (PARTITION BY session, agent, chunk ORDER BY aseq) - 1 AS rn, count(*) OVER (PARTITION
  BY session, agent, chunk) AS size FROM o WHERE category <> 'agent'),
b AS (SELECT session, agent, chunk::BIGINT AS chunk, rn // 4 AS bin, count(*) FILTER (WHERE category = 'read') AS reads,
  count(*) FILTER (WHERE category = 'search') AS searches, count(*) FILTER (WHERE category = 'edit') AS edits, count(*)
  FILTER (WHERE category = 'shell') AS shells
  FROM n WHERE rn // 4 < size // 4 GROUP BY 1, 2, 3, 4)"""


@query("forecast_bins", _BINS + " SELECT * FROM b")
def forecast_bins(f: Frames) -> DataFrame:
    return forecast.bins(f.calls)


@query(
    "forecast_graph",
    _BINS
    + """, u AS (UNPIVOT b ON reads, searches, edits, shells INTO NAME family VALUE n), p AS (SELECT a.session, a.family
  AS source, c.family AS target, sum(a.n * c.n)::DOUBLE AS dot FROM u a JOIN u c ON a.session = c.session AND a.agent =
  c.agent AND a.chunk = c.chunk AND a.bin + 1 = c.bin GROUP BY 1, 2, 3),
l AS (SELECT session, source, target, dot / nullif(sum(dot) OVER (PARTITION BY session), 0) AS w FROM p), m AS (SELECT
  source, target, avg(w) AS w FROM l GROUP BY 1, 2)
SELECT source, target, round(w / nullif(sum(w) OVER (PARTITION BY source), 0), 6) AS weight FROM m""",
)
def forecast_graph(f: Frames) -> DataFrame:
    return forecast.lag_graph(forecast.bins(f.calls))


@query(
    "forecast_baselines",
    _BINS
    + """, u AS (UNPIVOT b ON reads, searches, edits, shells INTO NAME family VALUE n), t AS (SELECT family, avg(n) AS
  mean FROM u WHERE session % 2 = 0 GROUP BY 1),
r AS (SELECT u.*, t.mean, avg(n) OVER (PARTITION BY session, agent, chunk, family ORDER BY bin ROWS BETWEEN 8 PRECEDING
  AND 1 PRECEDING) AS recent FROM u JOIN t USING (family) WHERE session % 2 = 1),
s AS (SELECT session, avg(abs(n - mean)) AS mean_error, avg(abs(n - recent)) AS recent_error, count(*) AS targets FROM r
  WHERE recent IS NOT NULL GROUP BY 1)
SELECT session, round(mean_error, 6) AS mean_error, round(recent_error, 6) AS recent_error, targets FROM s""",
)
def forecast_baselines(f: Frames) -> DataFrame:
    return forecast.baselines(forecast.bins(f.calls))


@query("bootstrap_ci")
def bootstrap_ci(f: Frames) -> DataFrame:
    return forecast.bootstrap(forecast.baselines(forecast.bins(f.calls)))
