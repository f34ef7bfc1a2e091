"""Quality by nearest-neighbour voting over latent-semantic vectors.

Fitting: from the labelled rows of the learning folds, at most `per_class` of each label are taken (those whose hashed id
is smallest; of rows that share a doc_id, the one whose text hashes least). Their hashed byte-trigram counts, log-scaled
and weighted by inverse document frequency, and three shares of style (repeated words, words seen before, capitals: without
them a quarter of the held-out junk passes, see the README) are reduced to `rank` dimensions by a truncated SVD. The bound
makes the broadcast at most 2 x per_class vectors; features travel to the driver as their cells that are not zero.

Scoring: every document is mapped to the same space, exact cosine products with all labelled vectors are taken in blocks,
and the `k` nearest vote with weight max(cosine, 0)^4; of neighbours equally near, any may be among the k. The score is
the share of the weight on label 1; where no neighbour has a positive cosine (an empty text, say) it is the mean of the
fitted labels.

Null text is empty. A document with several label rows has the mean of its labels; null labels and labels of a null doc_id
are ignored, and rows without doc_id are scored but not learned from. Without any labelled row every score is 1 (nothing
is known against a document). Repeated rows are scored each; an empty table gives none; very long texts are taken whole.
Columns of docs are kept, but for those that bear the new names, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, small_arrow, small_batches
from .textfeatures import N_STYLE, log_counts, log_counts_of, packed, style, to_unit, trigram_counts
from .tokens import in_blocks

BITS = 12
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


def _weigh(rows: np.ndarray, styles: list[tuple] | np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log-scaled counts with their style behind, weighted, each row of length 1; rows is overwritten."""
    cells = rows[:, :-N_STYLE]
    np.multiply(cells, idf, out=cells)
    to_unit(cells)
    rows[:, -N_STYLE:] = styles
    return to_unit(rows)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int

    @classmethod
    def fit(cls, rows: np.ndarray, styles: np.ndarray, labels: np.ndarray, rank: int, k: int) -> Model:
        """From log-scaled counts, which are overwritten."""
        idf = np.log((len(rows) + 1) / ((rows[:, :-N_STYLE] > 0).sum(axis=0) + 1)).astype(np.float32) + 0.1
        weighed = _weigh(rows, styles, idf)
        random = np.random.default_rng(7)
        width = min(rank + 16, len(weighed))
        span = weighed @ random.standard_normal((weighed.shape[1], width)).astype(np.float32)
        for _ in range(3):  # subspace iteration
            span, _ = np.linalg.qr(weighed @ (weighed.T @ span))
        axes = np.linalg.svd(span.T @ weighed, full_matrices=False)[2][:rank].T.astype(np.float32)
        return cls(idf, axes, to_unit(weighed @ axes), labels.astype(np.float32), min(k, len(labels)))

    def vectors_of(self, texts: list[bytes]) -> np.ndarray:
        rows = log_counts(texts, BITS, more=N_STYLE)
        return to_unit(_weigh(rows, [style(x) for x in texts], self.idf) @ self.axes)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.ones(len(texts))
        cosines = self.vectors_of(texts) @ self.vectors.T
        nearest = np.argpartition(-cosines, self.k - 1, axis=1)[:, : self.k]
        votes = np.maximum(np.take_along_axis(cosines, nearest, 1), 0).astype(np.float64) ** 4
        total = votes.sum(axis=1)
        share = (votes * self.labels[nearest]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, share, self.labels.mean()), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2_000, rank: int = 64, k: int = 25) -> Model:
    """A model from at most 2 x per_class labelled documents outside the held-out fold."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("_label"))
    known = known.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    # by class, a limited sort each: nothing is gathered but the rows taken
    of = lambda keep: known.filter(keep).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = of(F.col("_label") < 0.5).union(of(F.col("_label") >= 0.5))
    # at most 2 x per_class rows of 16 bytes
    texts = small_arrow(docs).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "_label", F.xxhash64("text").alias("hash"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = pa.array([packed(trigram_counts(x, BITS)) for x in texts], pa.binary())
            styles = pa.array([list(style(x)) for x in texts], pa.list_(pa.float64()))
            columns = [batch.column("doc_id").cast(pa.string()), *batch.columns[1:3], found, styles]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "hash", "cells", "style"])

    found = rows.mapInArrow(run, "doc_id string, label double, hash long, cells binary, style array<double>")
    # repeated ids: one row of each, so there are no more rows than ids
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct("hash", "cells", "style")).alias("row"))
    sample = sorted((r.doc_id, r.label, bytes(r.row.cells), tuple(r.row.style)) for r in one.toLocalIterator())
    if not sample:
        none, width = np.zeros((0, 1), np.float32), 1 << BITS
        return Model(np.zeros(width, np.float32), np.zeros((width + N_STYLE, 1), np.float32), none, none[:, 0], 0)
    counts = log_counts_of([x for _, _, x, _ in sample], BITS, N_STYLE)
    styles = np.array([x for *_, x in sample], dtype=np.float32)
    return Model.fit(counts, styles, np.array([v for _, v, _, _ in sample]), rank, k)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with quality_score and quality_label (1 where the score reaches the threshold), in one narrow pass."""
    docs = small_arrow(docs).drop("quality_score", "quality_label")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"_{k}" for k in range(len(docs.columns))]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at, 4_000_000):
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(at).to_pylist()]
            scores = np.zeros(len(texts))
            for a, b in in_blocks(texts, 2_000_000):
                for c in range(a, b, 256):
                    scores[c : min(c + 256, b)] = shared.value.scores(texts[c : min(c + 256, b)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*names, "quality_score"]
            )

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    scored = docs.toDF(*names).mapInArrow(run, f"{schema}, quality_score double")
    back = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    label = (F.col("quality_score") >= threshold).cast("int").alias("quality_label")
    return scored.select(*back, "quality_score", label)
