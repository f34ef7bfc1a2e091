"""Messages between agents: pairing of sends and receives, delivery, reactions, chains, repeated guidance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair(sends: DataFrame, receives: DataFrame, slack_ns: int = 5_000_000_000) -> DataFrame:
    """Sends with the receive of the same rank among those of equal text in the conversation, if it is not more than
    slack_ns before the send. Columns: conv, author, recipient, turn, fp, ns (and chars of sends)."""
    key = ["conv", "fp"]
    w = Window.partitionBy(*key).orderBy("ns", "turn")
    left = sends.withColumn("_n", F.row_number().over(w))
    right = receives.select(*key, "ns", "turn").withColumn("_n", F.row_number().over(w)).select(
        *key, "_n", F.col("ns").alias("received_ns"), F.lit(True).alias("_r")
    )
    ok = F.coalesce(F.col("ns") <= F.col("received_ns") + slack_ns, F.lit(False))
    joined = left.join(right, [*key, "_n"], "left")
    return joined.withColumn("received_ns", F.when(ok, F.col("received_ns"))).drop("_n", "_r")


def crossed(pairs: DataFrame) -> DataFrame:
    """Messages sent while one from their recipient was under way."""
    # messages under way are counted along the time of a conversation and author, so none is joined with all others: at
    # one instant arrivals come first, then the question, then departures
    under_way = pairs.filter("received_ns > ns")
    none = {x: F.lit(None).cast(pairs.schema[x].dataType) for x in ("turn", "author", "recipient")}
    edge = lambda at, place, n: under_way.select(
        "conv", F.col("author").alias("who"), F.col(at).alias("at"), F.lit(place).alias("place"), F.lit(n).alias("n")
    ).withColumns(none)
    asks = pairs.select(
        "conv",
        F.col("recipient").alias("who"),
        F.col("ns").alias("at"),
        F.lit(1).alias("place"),
        F.lit(0).alias("n"),
        "turn",
        "author",
        "recipient",
    )
    every = edge("received_ns", 0, -1).unionByName(edge("ns", 2, 1)).unionByName(asks)
    w = Window.partitionBy("conv", "who").orderBy("at", "place").rangeBetween(Window.unboundedPreceding, 0)
    return every.withColumn("_open", F.sum("n").over(w)).filter("place = 1 AND _open > 0").select(
        "conv", "turn", "author", "recipient"
    )


def routes(pairs: DataFrame) -> DataFrame:
    delay = (F.col("received_ns") - F.col("ns")) / 1_000_000
    return pairs.groupBy("author", "recipient").agg(
        F.count(F.lit(1)).alias("sent"),
        F.count("received_ns").alias("paired"),
        F.sum("chars").alias("chars"),
        F.percentile(delay, 0.5).alias("median_ms"),
        F.max(delay).cast("long").alias("max_ms"),
    )


def reactions(messages: DataFrame, of: str = "assistant") -> DataFrame:
    """The first message of `of` after each message of someone else: a forward as-of search by one window."""
    w = Window.partitionBy("conv").orderBy("ns", "turn").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.min(F.when(F.col("author") == of, F.struct("ns", "turn"))).over(w)
    rows = messages.withColumn("_x", nxt).filter(F.col("author") != of)
    return rows.select(
        "conv", "turn", F.col("_x.turn").alias("reaction_turn"), (F.col("_x.ns") - F.col("ns")).alias("wait_ns")
    )


def chains(messages: DataFrame, least: int = 2) -> DataFrame:
    """Stretches in which the author changes with every message."""
    w = Window.partitionBy("conv").orderBy("ns", "turn")
    cut = F.coalesce((F.lag("author").over(w) == F.col("author")).cast("long"), F.lit(0))
    numbered = messages.withColumn("_b", cut).withColumn(
        "chain", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy("conv", "chain").agg(
        F.count(F.lit(1)).alias("length"), F.min("turn").alias("first_turn"), F.sum("chars").alias("chars")
    ).filter(F.col("length") >= least)


def paragraphs(text: Column, least: int = 40) -> Column:
    """Paragraphs of a text: lower case, white space collapsed, short ones left out, each once."""
    parts = F.transform(F.split(text, r"\n"), lambda p: F.lower(F.trim(F.regexp_replace(p, r"\s+", " "))))
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) >= least))


def repeated_guidance(
    texts: DataFrame, key: str, text: str, least_messages: int = 2, least_chars: int = 80
) -> DataFrame:
    """Paragraphs that come in several messages; those with the same set of messages are one group. Sets are compared by
    count, sum and extremes of hashed keys, so none is gathered. A paragraph goes by its digest and length, so that no text
    is shuffled."""
    each = texts.select(F.col(key).alias("_k"), F.explode(paragraphs(F.col(text), least_chars)).alias("_p"))
    each = each.select("_k", F.unhex(F.sha2("_p", 256)).alias("_digest"), F.length("_p").alias("_chars")).distinct()
    h = F.xxhash64("_k")
    by_text = each.groupBy("_digest", "_chars").agg(
        F.count("_k").alias("messages"),
        F.sum(F.pmod(h, F.lit(2**40))).alias("_s"),
        F.min("_k").alias("first_message"),
        F.max("_k").alias("last_message"),
    ).filter(F.col("messages") >= least_messages)
    return by_text.groupBy("messages", "_s", "first_message", "last_message").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.sum("_chars").alias("chars")
    ).drop("_s")


def minhash_signature(words: Column, seeds: int = 32) -> Column:
    """The least hash of the words under each of `seeds` hash functions."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(seeds)), lambda i: F.array_min(F.transform(words, lambda w: F.xxhash64(w, i)))
    )


# Words that say nothing about a paragraph, in two languages.
STOP_WORDS = (
    "les", "des", "une", "pour", "dans", "avec", "que", "qui", "pas", "par", "sur", "est", "sont", "aux", "ces", "cet",
    "cette",
    "mais", "tout", "tous", "toutes", "plus", "moins", "son", "ses", "leur", "leurs", "nous", "vous", "ils", "elles",
    "elle",
    "lui", "eux", "the", "and", "for", "with", "that", "this", "are", "you", "not", "but", "from", "have", "has", "was",
    "were",
    "will", "can", "your", "our", "its", "all", "any", "into", "then", "than", "there", "their", "them", "they", "what",
    "when",
    "which", "who", "etre", "avoir", "fait", "faire", "comme", "aussi", "donc", "alors", "ainsi", "tres", "bien",
)


def useful_words(paragraph: Column) -> Column:
    """The words of a paragraph that its signature is made of: three characters at least, without accents, cut to six, no
    stop words, each once; null where fewer than four remain."""
    plain = F.translate(F.lower(paragraph), "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    found = F.filter(F.regexp_extract_all(plain, F.lit("[a-z0-9_]{3,}"), 0), lambda w: ~w.isin(*STOP_WORDS))
    words = F.array_distinct(F.transform(found, lambda w: F.substring(w, 1, 6)))
    return F.when(F.size(words) >= 4, words)


def payload_facts(text: Column) -> dict[str, Column]:
    """Of a text handed from one agent to another: a fingerprint and the length without differences of white space, and
    whether it is encrypted; the same for sender and recipient."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    told = F.nullif(plain, F.lit(""))
    return {
        "payload_fp": F.substring(F.sha2(told, 256), 1, 16),
        "payload_chars": F.length(told),
        "encrypted": F.coalesce(told.rlike(r"^gAAAA[A-Za-z0-9_\-]{40,}={0,2}$"), F.lit(False)),
    }


def received_payload(text: Column) -> tuple[Column, Column]:
    """The kind of a received message, and what was handed over, behind its head."""
    kind = F.nullif(F.regexp_extract(text, r"(?m)^Message Type:[ \t]*([A-Z_]{3,24})[ \t]*$", 1), F.lit(""))
    return kind, F.when(text.contains("Payload:\n"), F.substring_index(text, "Payload:\n", -1))


def signature_similarity(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.size(a)


def signed_paragraphs(text: Column) -> Column:
    """Of a text, its paragraphs of four words at least, in order: pos (place among all paragraphs) and s, the signature of
    the words, cut to six characters, of three at least. A paragraph's words are worked out once for all hash functions: as
    columns of a frame, they would be put into the function of each seed."""
    cut = lambda p: F.array_distinct(
        F.filter(F.transform(F.split(p, " "), lambda x: F.substring(x, 1, 6)), lambda x: F.length(x) >= 3)
    )
    worded = F.transform(paragraphs(text), lambda p, i: F.struct(i.alias("pos"), cut(p).alias("w")))
    worded = F.filter(worded, lambda p: F.size(p["w"]) >= 4)
    return F.transform(worded, lambda p: F.struct(p["pos"].alias("pos"), minhash_signature(p["w"]).alias("s")))


def consecutive_similarity(signed: Column) -> Column:
    """pos and similarity of each signed paragraph (all but the first) to the one before it."""
    later, before = F.slice(signed, 2, F.greatest(F.size(signed), F.lit(0))), lambda i: F.element_at(signed, i + 1)
    return F.transform(
        later,
        lambda p, i: F.struct(
            p["pos"].alias("pos"), signature_similarity(p["s"], before(i)["s"]).alias("similarity")
        ),
    )
