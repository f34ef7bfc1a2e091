"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one linear classifier per bit, over hashed byte trigrams of the lower-cased text,
learns to predict it by logistic regression. Decoding is loss-weighted: a language's loss is the sum over bits of
log(1 + exp(-bit x margin)), weighted by how well the bit was learned; the nearest codeword wins, and a text whose two
nearest are close is flagged ambiguous.

Fitting takes at most `per_language` rows of each language of the learning folds (smallest hashed ids; of rows that share
doc_id and language, the one whose text hashes least), `max_rows` in all but one of each language at least; features
travel to the driver as their cells that are not zero. All languages found there are learned, whatever share of their rows repeats ids; over MAX_LANGUAGES values
are an error.

Null text, and text without any letter, is `und` with score 0. Languages equally near: the first by name, flagged
ambiguous. Repeated rows are each predicted; rows without doc_id are predicted but not learned from. With nothing to learn
from, everything is `und`; an empty table gives none; very long texts are taken whole. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_of, small_arrow, small_batches
from .textfeatures import log_counts, log_counts_of, packed, to_unit, trigram_counts
from .tokens import in_blocks

BITS = 12
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: A table of more distinct values of lang is refused: codewords are chosen on the driver, all against all.
MAX_LANGUAGES = 2_000


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1. Up to six languages: the exhaustive code; beyond, the best of 200 random dense codes."""
    if n <= 6:
        width = max(1, 2 ** (n - 1) - 1)
        return np.array(
            [
                [1 if row == 0 or not (column >> (row - 1)) & 1 else -1 for column in range(1, width + 1)]
                for row in range(n)
            ]
        )
    random, best, apart = np.random.default_rng(11), None, -1
    for _ in range(200):
        code = random.choice([-1, 1], size=(n, int(np.ceil(10 * np.log2(n)))))
        agree = code @ code.T
        np.fill_diagonal(agree, -code.shape[1])
        if (d := code.shape[1] - agree.max()) > apart and (abs(code.sum(axis=0)) < n).all():
            best, apart = code, d
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    @classmethod
    def fit(
        cls, x: np.ndarray, languages: list[str], epochs: int = 12, batch: int = 256, rate: float = 1.0, ridge: float = 1e-5
    ) -> Model:
        """Logistic regression of each bit, by gradient steps over small batches whose sizes adapt to each weight."""
        names = sorted(set(languages))
        code = codewords(len(names))
        y = code[[names.index(v) for v in languages]].astype(np.float32)
        share = {v: languages.count(v) for v in names}
        row_weight = np.array([len(languages) / (len(names) * share[v]) for v in languages], dtype=np.float32)[:, None]
        w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        seen_w, seen_b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
        random = np.random.default_rng(13)
        for _ in range(epochs):
            order = random.permutation(len(x))
            for k in range(0, len(x), batch):
                at = order[k : k + batch]
                rows, want = x[at], y[at]
                pull = -want * row_weight[at] / (1 + np.exp(np.clip(want * (rows @ w + b), -30, 30))) / len(at)
                step_w, step_b = rows.T @ pull + ridge * w, pull.sum(axis=0)
                seen_w += step_w**2
                seen_b += step_b**2
                w -= rate * step_w / np.sqrt(seen_w)
                b -= rate * step_b / np.sqrt(seen_b)
        right = ((x @ w + b) * y > 0).mean(axis=0)
        return cls(names, code, w, b, np.maximum(2 * right - 1, 0.01).astype(np.float32))

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous, of each text."""
        margins = np.clip(to_unit(log_counts(texts, BITS, lower=True)) @ self.weights + self.bias, -30, 30).astype(
            np.float64
        )
        losses = np.log1p(np.exp(-margins[:, None, :] * self.code[None])) @ self.trust.astype(np.float64)
        chance = np.exp(losses.min(axis=1, keepdims=True) - losses)
        chance /= chance.sum(axis=1, keepdims=True)
        order = np.sort(chance, axis=1)
        second = order[:, -2] if chance.shape[1] > 1 else np.zeros(len(chance))
        return [self.languages[k] for k in losses.argmin(axis=1)], np.clip(order[:, -1], 0, 1), order[
            :, -1
        ] < 2 * second


def fit(docs: DataFrame, per_language: int = 1_000, max_rows: int = 6_000) -> Model | None:
    """A model from at most per_language documents of each language, and max_rows in all (or one of each language, where
    that is more), outside the held-out fold."""
    learn = small_arrow(docs).select("doc_id", "text", "lang").filter(
        "doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL"
    )
    learn = learn.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    ids = F.approx_count_distinct("doc_id", 0.05)
    sizes = learn.groupBy("lang").agg(ids.alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if not sizes:
        return None
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"lang has over {MAX_LANGUAGES} distinct values: these are no languages")
    per_language = max(1, min(per_language, max_rows // len(sizes)))
    # only hashes low enough to be among the least of their language go into the ranking: of distinct ids, three times as
    # many as are taken, so that neither repeated ids nor the count's error of some hundredths leaves out any of these
    shares = [(r.lang, min(1.0, (3 * per_language + 100) / r.n)) for r in sizes]
    # at most MAX_LANGUAGES rows
    shares = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share double"))
    keys = learn.select("lang", F.xxhash64("doc_id").alias("hash"), "doc_id").join(shares, "lang")
    keys = keys.filter(F.col("hash") / 2.0**64 + 0.5 <= F.col("share")).select("lang", "hash", "doc_id").distinct()
    order = Window.partitionBy("lang").orderBy("hash", "doc_id")
    chosen = keys.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language).select(
        "doc_id", "lang"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]
            cells = [packed(trigram_counts(x, BITS, lower=True)) for x in texts]
            columns = [batch.column("doc_id").cast(pa.string()), *batch.columns[1:3], pa.array(cells, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "hash", "cells"])

    # at most max(max_rows, number of languages) ids
    rows = learn.join(F.broadcast(chosen), ["doc_id", "lang"]).select(
        "doc_id", "lang", F.xxhash64("text").alias("hash"), "text"
    )
    found = rows.mapInArrow(run, "doc_id string, lang string, hash long, cells binary")
    one = found.groupBy("doc_id", "lang").agg(F.min(F.struct("hash", "cells")).alias("row"))
    sample = sorted((r.lang, r.doc_id, bytes(r.row.cells)) for r in one.toLocalIterator())
    if not sample:
        return None
    return Model.fit(to_unit(log_counts_of([c for *_, c in sample], BITS)), [v for v, *_ in sample])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every document, in one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 4_000_000):
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            lettered = batch.column(2).to_pylist()
            names, scores, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            rows = [k for k, x in enumerate(lettered) if x] if shared.value else []
            for a, b in in_blocks([texts[k] for k in rows], 2_000_000):
                for c in range(a, b, 512):
                    part = rows[c : min(c + 512, b)]
                    for k, name, s, u in zip(part, *shared.value.predict([texts[k] for k in part]), strict=True):
                        names[k], scores[k], unsure[k] = name, float(s), bool(u)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(unsure, pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    rows = small_arrow(docs).select(
        "doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    )
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
