"""The corpus operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables,
and extra columns with clashing names."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import chat, embedding_dedup, language, minhash, mixing, packing, quality, substring_dedup, token_counts, vector_search
from loomtrace.llm.common import written
from loomtrace.llm.tokens import Resync, encoder, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n: int, seed: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[tuple]:
    base = words(120, 1)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base.replace("w1 ", "x1 ", 1), "en", "b"),
        (4, words(300, 2), "fr", None),
        (5, None, None, "a"),
        (6, "", "en", "b"),
        (7, " \n\t", None, "b"),
    ]
    rows += [
        (8, words(20, 3), "en", "c"),
        (9, words(50, 4) + " " + words(60, 2)[: 8 * 60], "fr", "c"),
        (9, words(50, 4), "fr", "c"),
        (10, "one two", "en", "a"),
        (11, "one two", "en", "a"),
        (12, words(4_000, 5, 9_000), "en", "a"),
        (None, words(40, 6), "en", "a"),
    ]
    rows += [(20 + k, words(80, 100 + k) + " " + words(45, 77), "en", "hot") for k in range(12)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names the operators use themselves."""
    rows = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    return rows.withColumns(
        {
            "n_chars": F.length("text").cast("long"),
            "uid": F.lit("x"),
            "node": F.lit(1),
            "codes": F.lit(2),
            "copy": F.lit(0),
            "n_words": F.lit(-1),
            "quality_score": F.lit(-1.0),
            "rate": F.lit(9),
        }
    ).repartition(3)


def test_mixing_equals_an_inverted_poisson(spark, docs, texts):
    clashing = docs.withColumns(
        {
            x: F.lit(5)
            for x in (
                "_source", "_u", "_n", "n_parts", "cdf", "key", "spread", "rate_source", "times", "drawn", "mix_key"
            )
        }
    )
    mixed = mixing.mix(clashing, {"a": 5.0, "hot": 0.5}, seed=3)
    assert mixed.columns == [*[c for c in clashing.columns if c not in ("copy", "mix_key")], "copy", "mix_key"]
    out = mixed.collect()
    assert all(r._source == r.cdf == r.spread == 5 and r.rate == 9 for r in out)
    chars, weight = collections.Counter(), {"a": 5.0, "hot": 0.5}
    for _, t, _, s in texts:
        chars[s] += len(t or "")
    total_w, total_c = sum(weight.get(s, 1.0) for s in chars), sum(chars.values())
    want = collections.Counter()
    for d, t, _, s in texts:
        mean = weight.get(s, 1.0) / total_w * total_c / chars[s] if chars[s] else 0.0
        key = f"{'' if d is None else d}|{hashlib.md5((t or '').encode()).hexdigest()}"
        u = int(hashlib.md5(f"3|{key}|1".encode()).hexdigest()[:13], 16) / 2**52
        n, p, c = 0, np.exp(-mean), np.exp(-mean)
        while mean and c <= u:
            n += 1
            p *= mean / n
            c += p
        want[d] += n
    assert mixing.STEP > 5
    got = collections.Counter(r.doc_id for r in out)
    assert got == collections.Counter({k: v for k, v in want.items() if v})
    assert len({r.mix_key for r in out}) == len({(r.doc_id, r.text or "", r.copy) for r in out})
    assert mixing.mix(docs.limit(0), {}).count() == 0


def test_mixing_spreads_rows_without_ids(spark):
    some = spark.range(2_000).select(
        F.lit(None).cast("long").alias("doc_id"),
        F.concat(F.lit("text "), "id").alias("text"),
        F.lit("s").alias("source"),
    )
    same = spark.range(2_000).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit("all equal").alias("text"), F.lit("s").alias("source")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = [
        mixing.mix(rows, {}, budget=3.0).select(F.spark_partition_id().alias("part")).collect() for rows in (some, same)
    ]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for rows in spread:
        parts = collections.Counter(r.part for r in rows)
        assert len(parts) >= 3 and max(parts.values()) < 0.6 * sum(parts.values())
    n = collections.Counter(r.text for r in mixing.mix(some, {}, budget=3.0).collect())
    assert len(set(n.values())) > 5 and abs(sum(n.values()) - 6_000) < 5 * 6_000**0.5


def test_mixing_draws_large_means_in_parts(spark):
    rows = spark.range(200).select(
        F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.lit("s").alias("source")
    )
    n = mixing.mix(rows, {}, budget=100.0).count()
    assert abs(n - 200 * 100) < 5 * (200 * 100) ** 0.5


def brute_repeats(rows: list[tuple], window: int) -> dict[int, tuple]:
    split = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = collections.Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize(("window", "prefix"), [(35, 8), (5, 2), (3, 1), (6, 6)])
def test_substring_dedup_equals_brute_force(docs, texts, window, prefix):
    got = substring_dedup.remove_repeats(docs, window, prefix)
    assert got.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c not in ("n_words", "n_removed")]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    want = [(d, *x) for (d, *_), x in zip(texts, brute_repeats(texts, window), strict=True)]
    norm = [(r.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.text))) for r in got.collect()]
    assert sorted(norm, key=key) == sorted(want, key=key)


def test_substring_dedup_of_periodic_and_empty_input(spark):
    rows = [
        (1, "a b " * 60, "s"),
        (2, "a " * 36, "s"),
        (3, " ".join(map(str, range(100))), "s"),
        (3, " ".join(map(str, range(100))), "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == sorted((d, x[1]) for (d, *_), x in zip(rows, brute_repeats(rows, 35), strict=True))
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_chat_round_trip_and_mask(spark):
    tricky = [r"\### Assistant: </turn> ok", "<|endoftext|>", r"\<|\\", "é日本<", "", None, "a|>b", "\\", "<\\|x"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(tricky)] + [
        (2, 0, None, "x"), (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (None, None, "assistant", "n")
    ]
    rows += [(3, k, "assistant", words(200, k)) for k in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "segment", F.lit(7)
    )
    for most in (1_000_000, 500):  # in one segment, and in many
        got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df, segment_chars=most)).collect()}
        assert set(got) == {1, 2, 3, None}
        for conv, r in got.items():
            turns = sorted(((t is not None, t or 0, ro or "", tx or "") for c, t, ro, tx in rows if c == conv))
            assert r.n_turns == len(turns)
            assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
            loss = "".join(x[3] for x in turns if x[2] == "assistant")
            assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
    # stored output, in any order
    once = chat.format_conversations(df, segment_chars=500)
    direct = sorted(map(str, chat.digests(once, in_order=True).collect()))
    assert direct == sorted(map(str, chat.digests(written(once.repartition(4, F.rand(3)), "test")).collect()))
    # offsets are those of the library, in bytes
    tok = tokenizer()
    for r in chat.format_conversations(df).collect():
        e = tok.encode(r.formatted, add_special_tokens=False)
        at = np.cumsum([0, *[len(c.encode()) for c in r.formatted]])
        assert r.ids == e.ids and r.starts[0] == 0 and r.starts[1:] == r.ends[:-1] and r.ends[-1] == at[-1]
        assert all(at[a] <= lo and hi <= at[b] for (a, b), lo, hi in zip(e.offsets, r.starts, r.ends, strict=True))


def test_token_counts_equal_the_library(docs, texts):
    tok = tokenizer()
    want = sorted(
        ((d is None, d or 0), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False)))
        for d, t, *_ in texts
    )
    for chunk, overlap in ((65_536, 1_024), (200, 20)):
        got = token_counts.count_tokens(docs, chunk=chunk, overlap=overlap).collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_resync_and_memo_are_exact_on_hostile_text():
    r, tok = random.Random(1), tokenizer()
    alphabet = [
        " ",
        "  ",
        "\n",
        "\t",
        "\xa0",
        "\x85",
        "\x1c",
        "\x1f",
        "a",
        "bé",
        "don't",
        "<|endoftext|>",
        "12",
        "!!",
        ".",
        ",",
        "日本",
        "\r\n",
        "\x0b",
    ]
    for _ in range(400):
        s = "".join(r.choice(alphabet) for _ in range(r.randint(0, 120)))
        ids = tok.encode(s, add_special_tokens=False).ids
        assert Resync(chunk=r.randint(5, 60), overlap=r.randint(1, 10)).count(s) == len(ids)
        assert encoder().encode([s])[0] == np.array(ids, dtype="<u4").tobytes()


def test_packing_holds_every_token_once(docs, texts):
    tok, window = tokenizer(), 256
    rows = packing.pack(docs, window=window, with_ids=True).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length > 0
    want = collections.Counter()
    for d, t, *_ in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want[d, len(ids)] += 1
        assert (d, len(ids)) in by_doc
    for key, n in want.items():
        spans = sorted((r.start, r.length) for r in by_doc[key])
        assert sum(x[1] for x in spans) == n * key[1]
        if n == 1:
            assert [x[0] for x in spans] == list(np.cumsum([0, *[x[1] for x in spans[:-1]]]))
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0, *[r.length for r in parts[:-1]]]))
        assert sum(r.length for r in parts) == parts[0].used <= window
    assert packing.pack(docs.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_window():
    assert sorted(sorted(p[0] for p in w) for w in packing.best_fit([6, 5, 4, 5], 10)) == [[0, 2], [1, 3]]
    r = random.Random(2)
    lengths = [r.randint(1, 700) for _ in range(500)]
    got = packing.best_fit(lengths, 256)
    assert sum(p[2] for w in got for p in w) == sum(lengths) and len(got) == -(-sum(lengths) // 256)


SMALL = "/root/testdata/sf0.01"


def plain_trigrams(text: str, bits: int, lower: bool) -> np.ndarray:
    """Counts of hashed trigrams, one by one."""
    raw, out = (text or "").encode() + b"  ", np.zeros(1 << bits)
    if lower:
        raw = bytes(x + 32 if 65 <= x <= 90 else x for x in raw)
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        out[((a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) * 0x27D4EB2F % 2**32) >> (32 - bits)] += 1
    return out


def plain_style(text: str) -> list[float]:
    split, raw = WORD.findall(text or ""), (text or "").encode()
    if not split:
        return [0.0, 0.0, 0.0]
    again = sum(a == b for a, b in zip(split, split[1:]))
    return [again / len(split), 1 - len(set(split)) / len(split), sum(65 <= b <= 90 for b in raw) / len(raw)]


def fold(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def test_quality_votes_equal_brute_force_and_held_out_rows_are_right(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit(docs, labels)
    learned = {r.doc_id: r.quality for r in labels.collect()}
    assert len(model.labels) == sum(fold(d, 5) != 0 for d, v in learned.items() if v is not None) > 100
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == docs.count()
    axes, vectors = model.axes.astype(np.float64), model.vectors.astype(np.float64)
    for r in docs.filter("doc_id % 29 = 0").collect():
        x = np.log1p(plain_trigrams(r.text, quality.BITS, False)) * model.idf
        x = np.concatenate([x / np.linalg.norm(x), plain_style(r.text)])
        x = x / np.linalg.norm(x) @ axes
        x /= max(np.linalg.norm(x), 1e-9)
        cosines = [sum(p * q for p, q in zip(x, v, strict=True)) for v in vectors]
        near = sorted(range(len(cosines)), key=lambda k: -cosines[k])[: model.k]
        votes = [max(cosines[k], 0) ** 4 for k in near]
        want = sum(v * model.labels[k] for v, k in zip(votes, near, strict=True)) / sum(votes) if sum(
            votes
        ) else model.labels.mean()
        assert abs(got[r.doc_id].quality_score - want) < 1e-3
    held = [d for d, v in learned.items() if fold(d, 5) == 0 and d in got and v is not None]
    assert len(held) > 30 and np.mean([got[d].quality_label == learned[d] for d in held]) >= 0.95


@pytest.mark.parametrize("n_ids", [1, 20])
def test_languages_whose_rows_repeat_ids_are_learned(spark, n_ids):
    ids = [k for k in range(4_000) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows = [(ids[k], f"the words of english number {k}", "en") for k in range(400)]
    rows += [(ids[1_000 + k % n_ids], f"zz zazz zozz zuzz {k}", "zz") for k in range(40_000)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8), 50, 100)
    assert list(model.languages) == ["en", "zz"]


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 3)
    rows = spark.createDataFrame([(k, "text", f"l{k % 4}") for k in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="distinct values"):
        language.fit(rows)


def test_language_losses_equal_brute_force_and_held_out_rows_are_right(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    for r in rows[::37]:
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        x = np.log1p(plain_trigrams(r.text, language.BITS, True))
        margins = x / np.linalg.norm(x) @ model.weights.astype(np.float64) + model.bias
        losses = [
            sum(t * np.log1p(np.exp(-c * m)) for t, c, m in zip(model.trust, code, margins, strict=True))
            for code in model.code
        ]
        chances = np.exp(min(losses) - np.array(losses))
        assert got[r.doc_id].lang_pred == model.languages[int(np.argmin(losses))]
        assert abs(got[r.doc_id].score - chances.max() / chances.sum()) < 1e-3
    held = [r for r in rows if r.lang and fold(r.doc_id, 4) == 2 and got[r.doc_id].lang_pred != "und"]
    assert len(held) > 100 and np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) >= 0.98


def test_classifiers_of_odd_rows(spark):
    good, bad = [words(60, k, 80) for k in range(150)], [
        words(30, k, 80).upper().replace(" ", "!! ") + " x" * 40 for k in range(150)
    ]
    rows = [(k, t, "en" if k % 2 else "xx") for k, t in enumerate([y for x in zip(good, bad, strict=True) for y in x])]
    odd = [
        (900, None, None),
        (901, "", "en"),
        (902, "123 !!", None),
        (None, good[0], "en"),
        (903, words(150_000, 1), None),
        (0, good[1], "xx"),
        (0, good[2], "xx"),
    ]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string").withColumns(
        {"_label": F.lit(3), "hash": F.lit(1), "share": F.lit(2), "cells": F.lit("c")}
    )
    labels = df.filter("doc_id < 900 AND lang IS NOT NULL").select(
        "doc_id", (1 - F.col("doc_id") % 2).alias("quality")
    ).union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality long"))
    model = quality.fit(df, labels, per_class=50, rank=8, k=5)
    assert len(model.labels) == 100
    again = quality.fit(df.repartition(5), labels.repartition(2), per_class=50, rank=8, k=5)
    assert np.array_equal(model.labels, again.labels) and np.allclose(model.idf, again.idf)
    scored = quality.score(df, model)
    assert scored.columns == [*df.columns, "quality_score", "quality_label"]
    got = scored.collect()
    assert len(got) == 307 and all(0 <= r.quality_score <= 1 for r in got)
    assert np.mean(
        [r.quality_label == 1 - r.doc_id % 2 for r in got if r.doc_id is not None and 0 < r.doc_id < 900]
    ) > 0.95
    assert all(r.quality_label == 1 for r in quality.score(df, quality.fit(df, labels.limit(0))).collect())
    assert quality.score(df.limit(0), model).count() == 0
    found = language.identify(df, language.fit(df)).collect()
    assert len(found) == 307 and {r.lang_pred for r in found if r.doc_id in (900, 901, 902)} == {"und"}
    assert {r.lang_pred for r in language.identify(df, language.fit(df.limit(0))).collect()} == {"und"}


def test_all_languages_are_learned(spark):
    rows = [
        (7 * k + j, f"{chr(97 + k % 26)}{chr(97 + k // 26)}q " * 20, f"l{k:03d}") for k in range(210) for j in range(6)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, per_language=3)
    assert len(model.languages) == 210


def test_codewords_are_apart():
    for n in (1, 2, 3, 6, 12):
        code = language.codewords(n)
        assert code.shape[0] == n and len({tuple(x) for x in code.tolist()}) == n


def vectors(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((300, 16)).astype(np.float32)
    near = base[:40] + 0.05 * r.standard_normal((40, 16)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate([*base, *near, *base[:5], *base[:1]])]
    odd = [
        (1_000, None),
        (1_001, [0.0] * 16),
        (1_002, [float("nan")] * 16),
        (1_003, [1.0, None] * 8),
        (1_004, [1.0, 2.0]),
        (1_005, [2.0, 4.0]),
        (1_006, []),
        (1_007, [float("inf")] * 16),
    ]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns(
        {"label": F.lit(1), "tile": F.lit("t"), "rep": F.lit(0)}
    ), rows


def test_embedding_dedup_equals_brute_force(spark):
    df, rows = vectors(spark)
    x = np.array([v for _, v in rows], dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    least = np.arange(len(x))
    while (new := np.array([min([least[k], *least[near[k]]]) for k in range(len(x))])).tolist() != least.tolist():
        least = new
    for tile in (None, 32):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, tile_rows=tile).collect()}
        assert [got[k].n_links for k in range(len(x))] == near.sum(axis=1).tolist()
        assert [got[k].component_id for k in range(len(x))] == least.tolist()
        assert got[1_005].component_id == 1_004 and got[1_004].n_links == 1
        assert all(got[k].n_links == 0 and got[k].kept for k in (1_000, 1_001, 1_002, 1_003, 1_006, 1_007))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_that_share_an_id_have_the_links_of_their_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 2.0]), (4, [0.01, 1.0]), (None, [1.0, 0.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [
        (0, 0, 0), (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)
    ]


def test_vector_search_is_exact_at_factor_one(spark):
    df, rows = vectors(spark)
    x, ids = np.array([v for _, v in rows], dtype=np.float64), np.arange(len(rows))
    for shard, relax, least in ((8_192, 1.0, 1.0), (64, 1.0, 1.0), (64, 1.5, 0.9)):
        got = collections.defaultdict(list)
        for r in vector_search.search(df, F.col("vec_id") % 20 == 0, 10, relax, shard, 7).orderBy(
            "query_id", "rank"
        ).collect():
            got[r.query_id].append((r.vec_id, r.score))
        hit = total = 0
        for q in ids[ids % 20 == 0].tolist():
            s = (x * x[q]).sum(axis=1)
            want = [k for k in np.lexsort((ids, -s)).tolist() if k != q][:10]
            hit, total = hit + len({k for k, _ in got[q]} & set(want)), total + 10
            if relax == 1:
                assert [k for k, _ in got[q]] == want
                assert np.allclose([v for _, v in got[q]], s[want], rtol=1e-12)
        assert hit / total >= least
    assert vector_search.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    # repeated queries: once with their vector, each with another
    odd = spark.createDataFrame(
        [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0]), (None, [9.0, 9.0])],
        "vec_id long, embedding array<double>",
    )
    got = sorted(
        (r.query_id, r.rank, r.vec_id, r.score)
        for r in vector_search.search(odd, F.col("vec_id") % 20 == 0, 3).collect()
    )
    assert got == [(0, 1, 1, 2.0), (0, 1, 2, 3.0), (0, 2, 1, 1.0), (0, 2, 2, 1.0)]


def test_vector_search_recall_over_many_shards(spark):
    """The registered relaxation and depth on a whole table, dealt into shards small enough that there are many."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    x, ids = np.array([v for _, v in rows], dtype=np.float64), np.array([k for k, _ in rows])
    got = collections.defaultdict(set)
    for r in vector_search.search(table, F.col("vec_id") % 20 == 0, shard_rows=max(64, len(rows) // 20)).collect():
        got[r.query_id].add(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0).tolist():
        s = x @ x[q]
        want = [int(ids[k]) for k in np.lexsort((ids, -s)) if k != q][:20]
        hit, total = hit + len(got[ids[q]] & set(want)), total + len(want)
    assert hit / total >= 0.95


def test_minhash_classes_equal_brute_force(docs, texts):
    weights = minhash.tfidf_weights(docs)
    raw = [(t or "").encode() for _, t, *_ in texts]
    flat, starts = minhash.shingles(raw)
    sets = [(flat[a:b] >> np.uint64(32)).astype("<u4") for a, b in zip(starts[:-1], starts[1:], strict=True)]
    n = len(texts)
    linked = [
        [i != j and len(sets[i]) > 0 and minhash.similarity(sets[i], sets[j], weights) >= 0.8 for j in range(n)]
        for i in range(n)
    ]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *[label[j] for j in range(n) if linked[i][j]]]) for i in range(n)]
    want = sorted(
        (d, min([texts[j][0] for j in range(n) if label[j] == label[i] and texts[j][0] is not None], default=None))
        for i, (d, *_) in enumerate(texts) if d is not None
    )
    # many bands of one row: every similar pair is a candidate
    got = minhash.near_duplicates(docs, bands=24, rows=2).collect()
    assert len(got) == n and sorted((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == want
    i, j = minhash.links_within(sets, weights, 0.8)
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if len(sets[a])} == {
        (a, b) for a in range(n) for b in range(a + 1, n) if linked[a][b]
    }
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    kept = [r.doc_id for r in kept.collect()]
    assert 1 in kept and 2 not in kept and kept.count(9) == 2 and {5, 6, 7, None} <= set(kept)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.keep_one(docs.limit(0)).count() == 0


def test_minhash_keeps_one_row_of_each_class_whatever_the_ids(spark):
    a, b, c, d = (words(60, 900 + k, 10_000) for k in range(4))
    rows = [
        (3, a),
        (9, a),
        (9, b),
        (None, c),
        (None, c),
        (7, d),
        (7, d),
        (7, d + " x"),
        (None, None),
        (None, None),
        (8, ""),
        (8, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"_n": F.lit(1), "_id": F.lit(2), "uid": F.lit("u"), "times": F.lit(3), "kept": F.lit(False)}
    ).repartition(3)
    got = minhash.keep_one(df)
    assert got.columns == df.columns
    text = {a: "a", b: "b", c: "c", d: "d", d + " x": "d"}
    assert sorted((r.doc_id or -1, text.get(r.text, "-")) for r in got.collect()) == [
        (-1, "-"), (-1, "-"), (-1, "c"), (3, "a"), (7, "d"), (8, "-"), (8, "-"), (9, "b")
    ]
    classes = minhash.near_duplicates(df).collect()
    assert len(classes) == len(rows)
    assert len({r.group_id for r in classes if r.group_id is not None}) == 4


def test_document_frequencies_are_those_of_a_plain_count(spark, docs, texts):
    shingled = [minhash.shingles([(t or "").encode()])[0] >> np.uint64(32) for _, t, *_ in texts]
    want = collections.Counter(k for x in shingled for k in set(x.tolist()))
    for rare, most in ((10, 1 << 20), (1_000, 1 << 20), (1_000, 300)):
        n, floor, keys, counts = minhash.frequencies(docs, rare, most)
        assert n == len(texts) and len(keys) <= most
        assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {k: v for k, v in want.items() if v >= floor}
        assert floor == max(1, -(-n // rare), -(-sum(want.values()) // most))
    assert minhash.frequencies(docs.limit(0))[0] == 0


def test_minhash_of_crowded_buckets_equals_brute_force(spark, monkeypatch):
    """Buckets of several components, in tiles of a few members; two rows a band make all meet."""
    r = random.Random(8)
    base = words(100, 70, 100_000).split()
    rows = [
        (
            k,
            " ".join(
                [*base[: r.choice((70, 80, 88, 96))], *words(30, 7_000 + k, 100_000).split()[: r.choice((0, 1, 2, 3))]]
            ),
        )
        for k in range(120)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    weights = minhash.tfidf_weights(df)
    flat, starts = minhash.shingles([t.encode() for _, t in rows])
    sets = [(flat[a:b] >> np.uint64(32)).astype("<u4") for a, b in zip(starts[:-1], starts[1:], strict=True)]
    label = list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if minhash.similarity(sets[i], sets[j], weights) >= 0.8]
    assert near
    for _ in rows:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    whole = minhash.verified_buckets
    monkeypatch.setattr(minhash, "verified_buckets", lambda *how: whole(*how, tile=7))
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(df, bands=40, rows=1).collect()}
    assert [got[k] for k in range(len(rows))] == label


def test_minhash_finds_pairs_just_above_the_threshold(spark):
    """Groups of two, with the registered bands and rows: no third text could link what the bands miss."""
    rows = []
    for k in range(3_000):
        base, cut = words(100, 1_000 + k, 1_000_000), 92 - k % 3
        rows += [
            (2 * k, base),
            (2 * k + 1, " ".join([*base.split()[:cut], *words(100 - cut, 10_000 + k, 1_000_000).split()])),
        ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    weights = minhash.tfidf_weights(df)
    flat, starts = minhash.shingles([t.encode() for _, t in rows])
    sets = [(flat[a:b] >> np.uint64(32)).astype("<u4") for a, b in zip(starts[:-1], starts[1:], strict=True)]
    near = [minhash.similarity(sets[2 * k], sets[2 * k + 1], weights) for k in range(3_000)]
    assert 0.8 <= min(near) and max(near) < 0.85
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert [k for k in range(3_000) if not got[2 * k] == got[2 * k + 1] == 2 * k] == []


@pytest.mark.parametrize(("window", "prefix", "most"), [(5, 2, 1), (35, 8, 1), (35, 8, 6)])
def test_large_subtrees_are_split_to_the_same_result(docs, texts, monkeypatch, window, prefix, most):
    monkeypatch.setattr(substring_dedup, "SUBTREE", most)
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, window, prefix).collect()]
    want = [(d, *x[:2]) for (d, *_), x in zip(texts, brute_repeats(texts, window), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_suffix_order_shares_what_a_plain_sort_shares():
    r = random.Random(9)
    runs = [[r.randrange(2) for _ in range(r.randrange(1, 14))] for _ in range(40)]
    suffixes = [(x[k:], n) for n, x in enumerate(runs) for k in range(len(x))]
    left = np.array([len(x) for x, _ in suffixes])
    order, shared = substring_dedup.suffix_order(np.array([y for x in runs for y in x], dtype=np.uint64), left, 8)
    heads = [suffixes[k][0][:8] for k in order]
    assert heads == sorted(heads)
    for a, b, n in zip(heads[:-1], heads[1:], shared.tolist(), strict=True):
        assert min(n, 8) == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_deep_nodes_are_repeated_windows():
    r = random.Random(4)
    runs = [[r.randrange(3) for _ in range(r.randrange(3, 12))] for _ in range(60)]
    for window in (1, 2, 3, 5, 7):
        seen = collections.Counter(tuple(x[k : k + window]) for x in runs for k in range(len(x) - window + 1))
        want = [k + window <= len(x) and seen[tuple(x[k : k + window])] > 1 for x in runs for k in range(len(x))]
        got = substring_dedup.deep_nodes(
            np.array([y for x in runs for y in x], dtype=np.uint64), np.cumsum([len(x) for x in runs]), window
        )
        assert got.tolist() == want


def test_substring_dedup_of_many_rows_that_repeat(spark):
    base, other = words(90, 50, 10_000), words(30, 51, 10_000)
    rows = [(1, base)] * 40 + [(2, other + " " + " ".join(base.split()[10:60])), (3, words(60, 52, 10_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == collections.Counter({(1, 90, 90): 40, (2, 80, 50): 1, (3, 60, 0): 1})


def test_very_long_texts(spark, tmp_path):
    """A text of over a million characters beside short ones, through every text operator with its own parameters."""
    long = words(260_000, 99, 60_000)
    passage = words(60, 98, 100_000)
    rows = [
        (1, f"{long} {passage}", "en", "a"),
        (2, f"{words(50, 97, 100_000)} {passage}", "en", "a"),
        (3, f"{long} {passage}", "xx", "b"),
        (4, "z" * 700_000, "xx", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    tok = tokenizer()
    want = [len(tok.encode(t, add_special_tokens=False)) for _, t, *_ in rows]
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(df).collect()) == [
        (k + 1, n) for k, n in enumerate(want)
    ]
    cut = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df).collect()}
    assert cut == {1: 260_060, 2: 60, 3: 260_060, 4: 0}
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    assert sorted(r.doc_id for r in minhash.keep_one(df).collect()) == [1, 2, 4]
    packed = packing.pack(df, block_tokens=100_000).collect()
    by_doc, by_seq = collections.Counter(), collections.Counter()
    for r in packed:
        by_doc[r.doc_id] += r.length
        by_seq[r.sequence_id] += r.length
    assert by_doc == {k + 1: n + 1 for k, n in enumerate(want)} and max(by_seq.values()) <= 2_048
    assert sum(1 for n in by_seq.values() if n < 2_048) <= 4
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 4)], "doc_id long, quality long")
    assert all(0 <= r.quality_score <= 1 for r in quality.score(df, quality.fit(df, labels)).collect())
    assert len(language.identify(df, language.fit(df)).collect()) == 4
    assert {(r.doc_id, len(r.text)) for r in mixing.mix(df, {}, budget=4.0).collect()} <= {
        (d, len(t)) for d, t, *_ in rows
    }


def test_a_conversation_beyond_a_segment(spark):
    """With the operator's own limit: one conversation in several rows, whose turns are never cut."""
    turns = [(1, k, "assistant" if k % 2 else "user", words(30_000, k)) for k in range(12)] + [(2, 0, "user", "short")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat.format_conversations(df).select("conv_id", "segment", "n_turns").collect()
    assert len([r for r in rows if r.conv_id == 1]) > 1 and sum(r.n_turns for r in rows) == 13
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    loss = "".join(t for c, k, role, t in turns if c == 1 and role == "assistant")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (
        12, len(loss), hashlib.sha256(loss.encode()).hexdigest()
    )
