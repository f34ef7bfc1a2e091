"""Entropy-coded token files against the tokenizer's own ids: round trips, checkpoints, damage, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import ans, token_files
from loomtrace.llm.tokens import WORD_BPE, WordEncoder


def library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    return [x.ids for x in tok.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = [
    None, "", " \n\t", "Don't STOP we'll 've'd 'tis '''s", "éÉ é Å ñandú ÜBER straße ẞ", "ΑΣ ΣΑΣ, ΟΔΟΣ", "a\x1cb\x00c\x7f",
    "<|endoftext|> and <|startoftext|>x<|endoftext|>", "1234 5a6 ½ ² Ⅷ", " a b\u0085c　d", "×÷·¿¡", "日本語 テキスト", "́a",
    "x" * 5_000, "a'S b'T 'RE'LL", "<| <|endof text|>", "퟿\U0001f600", "tab\tand\x0bvt\x0cff", "İstanbul ı", "ﬁ ﬂ",
]


def test_word_encoder_equals_the_library():
    r = random.Random(3)
    pieces = [x for x in ODD if x] + ["the", "The", ",", ".", "'s", "'", "42", "é", "\n", " ", "ab's"]
    texts = [x or "" for x in ODD] + ["".join(r.choice(pieces) + r.choice(["", " "]) for _ in range(12)) for _ in range(400)]
    small = WordEncoder(limit=50)
    for encoder in (WordEncoder(), small):
        for k in range(0, len(texts), 100):
            flat, sizes = encoder.encode(texts[k : k + 100])
            ends = np.cumsum(sizes)
            got = [x.tolist() for x in np.split(flat, ends[:-1])]
            assert ends[-1] == len(flat)
            assert got == library(texts[k : k + 100])


@pytest.mark.parametrize("n", [1, 7, 8, 9, 63, 64, 65, 1_000])
def test_stretches_decode_on_their_own(n):
    ids = np.random.default_rng(n).integers(0, 300, size=n).astype(np.uint32)
    counts = {int(i): int(c) for i, c in zip(*np.unique(ids, return_counts=True), strict=True)}
    table = ans.Table.of_counts(counts, 300)
    blocks = ans.split(table, ids, lanes=4, every=2, size=64)
    assert [c for c, _ in blocks] == [min(64, n - k) for k in range(0, n, 64)]
    for k, (count, payload) in enumerate(blocks):
        parts = ans.stretches(payload)
        assert np.concatenate(ans.decode(table, parts)).tolist() == ids[64 * k : 64 * k + count].tolist()
        some = ans.stretches(payload, count // 2, count // 2 + 1)
        assert len(some) == 1
        (one,) = ans.decode(table, some)
        assert one.tolist() == ids[64 * k + some[0].first : 64 * k + some[0].first + some[0].n].tolist()


def test_damage_is_told():
    table = ans.Table.of_counts({3: 5, 7: 9}, 20)
    ((_, payload),) = ans.split(table, np.array([3, 7, 7, 3] * 30, dtype=np.uint32), 4, 2, 128)
    for k in (0, 20, len(payload) // 2, len(payload) - 1):
        with pytest.raises(ValueError, match="checksum"):
            ans.stretches(payload[:k] + bytes([payload[k] ^ 1]) + payload[k + 1 :])
    other = ans.Table.of_counts({3: 50, 7: 1}, 20)
    with pytest.raises(ValueError, match="checksum"):
        ans.decode(other, ans.stretches(payload))


def test_shifted_checksums_add_up():
    parts = [b"some", b"", b"bytes" * 1_000, b"\0" * 77]
    whole, behind, got = b"".join(parts), 0, 0
    for p in reversed(parts):
        got ^= ans.shifted(zlib.crc32(p), behind)
        behind += len(p)
    assert got == zlib.crc32(whole)


def test_shares_hold_every_id():
    table = ans.Table.of_counts({0: 10**25, 5: 1}, 50_000)
    assert table.freq.min() == 1
    assert int(table.freq.sum()) == 1 << ans.SCALE
    assert ans.Table.of_counts({}, 3).freq.sum() == 1 << ans.SCALE


def rows_of():
    r = random.Random(5)
    rows = [(k, x) for k, x in enumerate(ODD)]
    rows += [(100 + k, " ".join(r.choice(["one", "Two", "thr33", "vier,"]) for _ in range(r.randrange(60)))) for k in range(80)]
    rows += [(7, "a repeated id"), (7, "a repeated id"), (None, "no id"), (None, None), (500, "long word list " * 3_000)]
    return rows + [(50, f"hot {k % 3}") for k in range(90)]


@pytest.fixture
def files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 512)
    monkeypatch.setattr(token_files, "LANES", 8)
    monkeypatch.setattr(token_files, "EVERY", 16)
    rows = spark.createDataFrame(rows_of(), "doc_id long, text string").withColumns(
        {x: F.lit(1) for x in ("tie", "ids", "part", "at", "first", "start")}
    )
    folder = token_files.new_folder(spark, "test-files")
    token_files.write_tokens(rows.repartition(5), folder)
    return folder


def test_documents_come_back(spark, files):
    got = token_files.read_documents(spark, files).collect()
    rows = rows_of()
    want = []
    for (doc, _), ids in zip(rows, library([x for _, x in rows]), strict=True):
        raw = np.array([*ids, 1], "<u4").tobytes()
        want.append((doc, len(ids) + 1, zlib.crc32(raw)))
    key = repr
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert spark.read.parquet(f"{files}/blocks").count() > 10


def test_any_range_is_read(spark, files):
    docs = token_files.read_documents(spark, files).orderBy("start").collect()
    total = docs[-1].start + docs[-1].n_tokens
    for start, length in ((0, 1), (500, 30), (511, 2), (total - 3, 50), (0, total), (total, 5)):
        ids = []
        for r in sorted(token_files.read_ids(spark, files, start, length).collect(), key=lambda r: r.start):
            assert r.start == start + len(ids)
            ids += r.ids
        assert len(ids) == max(0, min(length, total - start))
    doc = max(docs, key=lambda r: r.n_tokens)
    (r,) = [r for r in docs if r.start == doc.start]
    ids = [i for x in sorted(token_files.read_ids(spark, files, r.start, r.n_tokens).collect(), key=lambda x: x.start) for i in x.ids]
    assert zlib.crc32(np.array(ids, "<u4").tobytes()) == doc.ids_crc32


def test_empty_table(spark):
    folder = token_files.new_folder(spark, "test-none")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert token_files.read_documents(spark, folder).count() == 0
    assert token_files.read_ids(spark, folder, 0, 5).count() == 0
