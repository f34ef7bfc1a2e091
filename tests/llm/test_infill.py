"""Fill-in-middle against brute force: rank and select, cuts, forms, and texts rebuilt."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import infill

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def plain_form(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    draw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(draw[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = LINE.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in infill.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 513, 9_000])
def test_rank_and_select(n):
    flags = np.random.default_rng(n).random(n) < 0.3
    bits = infill.Bits(flags)
    assert (bits.rank(np.arange(n + 1)) == np.concatenate([[0], np.cumsum(flags)])).all()
    ones = np.flatnonzero(flags)
    assert (bits.select(np.arange(len(ones))) == ones).all()


TEXTS = [
    (1, "one\ntwo\nthree"), (2, "one\ntwo\n"), (3, "\n\n\n"), (4, ""), (5, None), (6, "no line"), (7, "with <S> in it\nx"),
    (8, "é\n\U0001f600\r\nü\x85z \n"), (9, "<\nS>\n<P\n><\n"), (None, "a\nb\nc\n"), (None, None), (11, "x\ny\n" * 50_000),
    (12, "long" * 100_000), (12, "a\nb"), (12, "a\nb"), (13, "\0\n\0"),
] + [(100 + k, "".join(f"line {j} <\n" for j in range(k % 7))) for k in range(60)]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 100), (0, 0)])
def test_equals_brute_force_and_restores(spark, rate, spm):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns(
        {x: F.lit(1) for x in ("n", "form", "cut", "draw", "output")}
    )
    out = infill.fill_in_middle(rows.repartition(3), rate, spm)
    got = out.withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    key = repr
    want = [(i, *plain_form(i, x, rate, spm), x or "") for i, x in TEXTS]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    out = infill.fill_in_middle(none)
    assert out.count() == 0
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
