"""Token alignment against brute force over bytes and whole texts."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import alignment


def by_hand(rows):
    """The contract, token by token, with both libraries on whole texts."""
    a, b, a_bytes, b_bytes = alignment._tokenizers(None, None)
    docs, holders = [], collections.defaultdict(set)
    for row, (doc, text) in enumerate(rows):
        if not text:
            docs.append((doc, [], [], [], [], ""))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = (" " + text).encode()
        if b"".join(a_bytes[i] for i in ids_a) != raw or b"".join(b_bytes[i] for i in ids_b) != raw:
            docs.append((doc, [], [], [], [], ""))
            continue
        spans = []
        for ids, size in ((ids_a, a_bytes), (ids_b, b_bytes)):
            ends = np.cumsum([len(size[i]) for i in ids]).tolist()
            spans.append(list(zip([0, *ends], ends, ids, strict=False)))
        links = []
        j = 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= cut) for side in spans))
            low = cut
        docs.append((doc, ids_a, ids_b, groups, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        for pair in set(links):
            holders[pair].add(row)
    most = collections.defaultdict(int)
    for (i, _), found in holders.items():
        most[i] = max(most[i], len(found))
    return [
        (
            doc,
            len(ids_a),
            len(ids_b),
            len(groups),
            len(links),
            sum(len(holders[x]) == most[x[0]] for x in links),
            sum(len(holders[x]) for x in links),
            said,
        )
        for doc, ids_a, ids_b, groups, links, said in docs
    ]


ODD = [
    None, "", " ", "  ", " a", "a ", "a  ", "\n", "\n\n a\n b \n", "a \nb", "a\n b", "x▁y", "▁", "tail ▁ in one", "<s> </s> <unk> <0x0A>",
    "<|endoftext|> is text", "don't  you'll", "naïve café Straße", "\U0001f600 \U0001f600‍ x", "日本語 テキスト です", "12 345 6,789.",
    "tab\tand\x0b\x0c\r\nends \x1c \x1c x\x1fy", "\x00 \x01a", "a b   c", "　wide　space ", "(){}[];  \"'..", "y" * 3_000,
    "word " * 2_000,
]


def rows_of():
    r = random.Random(11)
    pool = ["the", "The", " ", "of.", "Thtionnd", "\n", "étreaueux", "x1", "▁", ",,", "'s", "  ", "日", "ing", "\t"]
    rows = list(enumerate(ODD))
    rows += [(100 + k, "".join(r.choice(pool) + r.choice(["", " "]) for _ in range(r.randrange(25)))) for k in range(300)]
    return rows + [(7, "the same id"), (7, "the same id"), (None, "no id"), (None, None)] + [(60, "hot text here")] * 40


@pytest.mark.parametrize("size", [200, 10**9])
def test_equals_brute_force(spark, size):
    rows = rows_of()
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {x: F.lit(1) for x in ("chunk", "docs", "place", "key", "a", "b", "n", "best", "groups")}
    )
    got = alignment.align(table.repartition(3), size=size)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(by_hand(rows), key=repr)


def test_forgotten_units_are_learned_again():
    texts = [x or "" for _, x in rows_of()]
    small, large = alignment.Units(limit=30), alignment.Units()
    for k in range(0, len(texts), 40):
        one, two = (alignment.chunk_of(u, texts[k : k + 40]) for u in (small, large))
        assert one["said"] == two["said"]
        assert (one["sums"] == two["sums"]).all()
        assert dict(zip(one["pairs"], one["pair_docs"].tolist(), strict=True)) == dict(
            zip(two["pairs"], two["pair_docs"].tolist(), strict=True)
        )


def test_empty_table(spark):
    out = alignment.align(spark.createDataFrame([], "doc_id string, text string"))
    assert out.count() == 0
    assert out.columns[0] == "doc_id"


def test_only_texts_without_tokens(spark):
    out = alignment.align(spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]
