"""Queries over messages between agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import messages
from ..sources.bridge import Frames
from .registry import query

M = ("messages",)
#: Of the driver's messages, every turn but each third arrives, two seconds later.
_PAIRS = """WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv, fp ORDER BY ns, turn) AS n FROM messages),
v AS (SELECT conv, fp, ns + 2000000000 + turn % 2 * 1000000 AS rns, row_number() OVER (PARTITION BY conv, fp ORDER BY
  ns, turn) AS n FROM messages WHERE turn % 3 <> 2),
p AS (SELECT s.*, CASE WHEN s.ns <= v.rns + 5000000000 THEN v.rns END AS received_ns FROM s LEFT JOIN v ON s.conv =
  v.conv AND s.fp = v.fp AND s.n = v.n)"""


def _pairs(f: Frames) -> DataFrame:
    m = f.messages
    got = m.filter(F.col("turn") % 3 != 2).withColumn("ns", F.col("ns") + 2_000_000_000 + F.col("turn") % 2 * 1_000_000)
    return messages.pair(m, got)


@query("message_pairs", _PAIRS + " SELECT conv, turn, author, recipient, ns, received_ns FROM p", M)
def message_pairs(f: Frames) -> DataFrame:
    return _pairs(f).select("conv", "turn", "author", "recipient", "ns", "received_ns")


@query("undelivered", _PAIRS + " SELECT conv, turn, author, chars FROM p WHERE received_ns IS NULL", M)
def undelivered(f: Frames) -> DataFrame:
    return _pairs(f).filter("received_ns IS NULL").select("conv", "turn", "author", "chars")


@query(
    "crossed_messages",
    _PAIRS + " SELECT conv, turn, author, recipient FROM p WHERE EXISTS (SELECT 1 FROM p o WHERE o.conv = p.conv AND o.author = p.recipient AND o.ns < p.ns AND p.ns < o.received_ns)",
    M,
)
def crossed_messages(f: Frames) -> DataFrame:
    return messages.crossed(_pairs(f))


@query(
    "message_routes",
    _PAIRS + " SELECT author, recipient, count(*) AS sent, count(received_ns) AS paired, sum(chars)::BIGINT AS chars, quantile_cont((received_ns - ns) / 1e6, 0.5) AS median_ms, max((received_ns - ns) // 1000000) AS max_ms FROM p GROUP BY 1, 2",
    M,
)
def message_routes(f: Frames) -> DataFrame:
    return messages.routes(_pairs(f))


@query(
    "first_reaction",
    "WITH r AS (SELECT *, min(CASE WHEN author = 'assistant' THEN ns END) OVER w AS xns, min(CASE WHEN author = "
    "'assistant' THEN turn END) OVER w AS xt FROM messages WINDOW w AS (PARTITION BY conv ORDER BY ns, turn ROWS "
    "BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT conv, turn, xt AS reaction_turn, xns - ns AS wait_ns FROM r "
    "WHERE author <> 'assistant'",
    M,
)
def first_reaction(f: Frames) -> DataFrame:
    return messages.reactions(f.messages)


@query(
    "message_chains",
    """WITH b AS (SELECT *, coalesce(lag(author) OVER (PARTITION BY conv ORDER BY ns, turn) = author, FALSE)::INT AS b
  FROM messages), c AS (SELECT *, sum(b) OVER (PARTITION BY conv ORDER BY ns, turn ROWS UNBOUNDED PRECEDING)::BIGINT AS
  chain FROM b)
SELECT conv, chain, count(*) AS length, min(turn) AS first_turn, sum(chars)::BIGINT AS chars FROM c GROUP BY 1, 2 HAVING
  count(*) >= 2""",
    M,
)
def message_chains(f: Frames) -> DataFrame:
    return messages.chains(f.messages)


@query(
    "message_requests",
    "SELECT conv, bool_and(author = 'user') AS only_user, count(*) AS messages, count(*) FILTER (WHERE author = "
    "'assistant') AS answers, sum(chars)::BIGINT AS chars FROM messages GROUP BY 1",
    M,
)
def message_requests(f: Frames) -> DataFrame:
    return f.messages.groupBy("conv").agg(
        F.every(F.col("author") == "user").alias("only_user"),
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("author") == "assistant").alias("answers"),
        F.sum("chars").alias("chars"),
    )


@query(
    "repeated_paragraphs",
    r"""WITH e AS (SELECT DISTINCT doc_id AS k, p FROM (SELECT doc_id,
  lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g'))) AS p FROM documents) WHERE length(p)
  >= 80),
t AS (SELECT p, count(*) AS messages, list_sort(list(k)) AS ks FROM e GROUP BY 1 HAVING count(*) >= 2)
SELECT messages, ks[1] AS first_message, ks[-1] AS last_message, count(*) AS paragraphs, sum(length(p))::BIGINT AS chars
  FROM t GROUP BY messages, ks""",
    (),
)
def repeated_paragraphs(f: Frames) -> DataFrame:
    return messages.repeated_guidance(f.table("documents"), "doc_id", "text")


@query("paragraph_signatures")
def paragraph_signatures(f: Frames) -> DataFrame:
    """Estimated similarity of each paragraph's words to those of the paragraph before it in its document."""
    signed = f.table("documents").select("doc_id", messages.signed_paragraphs(F.col("text")).alias("p"))
    # outer, as a filter of lists that hold anything would be put before the signatures and work them out once more
    each = signed.select("doc_id", F.explode_outer(messages.consecutive_similarity(F.col("p"))).alias("p"))
    return each.filter("p IS NOT NULL").select("doc_id", "p.pos", "p.similarity")
