"""Nearest neighbours by vantage-point trees, one per shard.

Nearness is the inner product. With M the greatest length of all vectors, a candidate x gets one more component,
sqrt(M^2 - |x|^2), and a query a zero: then the distance falls as the inner product rises, and the triangle inequality
holds. A tree's node keeps a vantage point and the median distance to it; a side is left out for a query whose distance
to the median sphere, times `relax`, exceeds the distance of its k-th best so far. relax = 1 is exact, more is faster.

Every vector is dealt into a shard of bounded size, whose tree is built once and stored: one shuffle of the vectors. The
queries are stored in blocks of bounded size; each block is sent to all tasks, which stream through the stored trees and
carry the k best of each query from one tree to the next, so that later trees are pruned by what earlier ones found. The
best of all tasks meet in a last ranking. Scores are inner products in doubles of the original vectors, computed row by
row, so equal vectors have equal scores; ties go to the smaller id.

Null and zero vectors and such with null or non-finite components take no part, nor does a null vec_id; candidates of
another length than the query's are skipped. Repeated rows are candidates each, but a query's own id never is one. A query
that is repeated with its vector is asked once; rows that share a vec_id with different vectors are asked and ranked each.
Other columns are ignored, whatever their names; an empty table, or one without queries, gives none.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, small_arrow, written
from .vectors import matrix, n_parts, usable

LEAF = 128
#: Slack for rounding, in distances and scores.
SLACK = 1e-7
#: The id where no neighbour is known yet; it sorts behind all others.
NONE = np.iinfo(np.int64).max


class Tree:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, longest: float):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids = rows[order], ids[order]
        self.longest = longest
        more = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", self.rows, self.rows), 0))
        self.root = self._build(np.arange(len(ids)), more, np.random.default_rng(5))

    def _build(self, where: np.ndarray, more: np.ndarray, random):
        if len(where) <= LEAF:
            return np.sort(where)
        point = where[random.integers(len(where))]
        gaps = self.rows[where] - self.rows[point]
        far = np.sqrt(np.einsum("ij,ij->i", gaps, gaps) + (more[where] - more[point]) ** 2)
        middle = float(np.median(far))
        inside = far <= middle
        if inside.all():  # equal or equally far
            return [np.sort(part) for part in np.array_split(where, -(-len(where) // LEAF))]
        return point, middle, self._build(where[inside], more, random), self._build(where[~inside], more, random)

    def search(self, asked: Asked, relax: float) -> None:
        """Betters the k best of each query by what this tree holds."""
        self._visit(self.root, np.arange(len(asked.own)), asked, relax)

    def _visit(self, node, who: np.ndarray, asked: Asked, relax: float) -> None:
        if not len(who):
            return
        if not isinstance(node, tuple):
            for part in [node] if isinstance(node, np.ndarray) else node:
                self._leaf(part, who, asked)
            return
        point, middle, inner, outer = node
        square = asked.square[who] + self.longest**2
        far = np.sqrt(np.maximum(square - 2 * (asked.rows[who] @ self.rows[point]), 0)) - middle
        near = far <= 0
        self._visit(inner, who[near], asked, relax)
        self._visit(outer, who[~near], asked, relax)
        reach = np.sqrt(np.maximum(square - 2 * asked.score[who, -1], 0))
        left = np.abs(far) * relax <= reach + SLACK
        self._visit(outer, who[near & left], asked, relax)
        self._visit(inner, who[~near & left], asked, relax)

    def _leaf(self, where: np.ndarray, who: np.ndarray, asked: Asked) -> None:
        rough = asked.rows[who] @ self.rows[where].T
        promising = rough >= (asked.score[who, -1] - SLACK * self.longest**2)[:, None]
        r, c = np.nonzero(promising & (self.ids[where][None, :] != asked.own[who][:, None]))
        if len(r):
            exact = (asked.rows[who[r]] * self.rows[where[c]]).sum(axis=1)
            asked.better(who, r, self.ids[where[c]], exact)


class Asked:
    """A block of queries and the best k of each so far."""

    def __init__(self, rows: np.ndarray, own: np.ndarray, k: int):
        self.rows, self.own, self.square = rows, own, np.einsum("ij,ij->i", rows, rows)
        self.best, self.score = np.full((len(rows), k), NONE), np.full((len(rows), k), -np.inf)

    def better(self, who: np.ndarray, r: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes candidates in: of query who[r], each with its id and score."""
        touched, k = np.unique(r), self.best.shape[1]
        old = who[touched]
        row = np.r_[np.repeat(touched, k), r]
        ids, scores = np.r_[self.best[old].ravel(), ids], np.r_[self.score[old].ravel(), scores]
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        pick = np.searchsorted(row, touched)[:, None] + np.arange(k)
        self.best[old], self.score[old] = ids[pick], scores[pick]


def shard_trees(good: DataFrame, shard_rows: int, longest: float) -> DataFrame:
    """shard, dims, tree: one row per shard, with its vectors and their tree, stored."""
    shards = n_parts(good, shard_rows)

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        tree = Tree(matrix(group["embedding"]), group["vec_id"].to_numpy(), longest)
        return pa.table({"dims": group["dims"][:1], "tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary())})

    dealt = F.pmod(F.xxhash64("vec_id", "embedding", F.lit(1)), F.lit(shards)).alias("shard")
    dealt = good.select(dealt, F.size("embedding").alias("dims"), "vec_id", "embedding")
    return written(dealt.groupBy("shard", "dims").applyInArrow(build, "dims int, tree binary"), "search-trees")


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, relax: float = 1.5, shard_rows: int = 8_192,
    block_rows: int = 65_536
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found of every row for which is_query holds. A block of
    queries (block_rows vectors) is held by the driver and by each task, one block at a time."""
    spark = vectors.sparkSession
    rows = small_arrow(vectors).filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    good = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    good = written(good, "search-vectors")
    asking = good.filter("asks").select("vec_id", "embedding").distinct()
    blocks = n_parts(asking, block_rows)
    longest = good.agg(F.sqrt(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)))).first()[0] or 1.0
    trees = shard_trees(good, shard_rows, float(longest) * (1 + 1e-12))
    block = F.pmod(F.xxhash64("vec_id", "embedding", F.lit(2)), F.lit(blocks)).cast("int").alias("block")
    folder = f"{shared_folder(spark)}/loomtrace/search-queries-{uuid.uuid4().hex}"
    asking.select("vec_id", "embedding", block).write.partitionBy("block").parquet(folder)
    asking = spark.read.schema("vec_id long, embedding array<double>, block int").parquet(folder)

    found = []
    for b in range(blocks):
        asked = small_arrow(asking).filter(F.col("block") == b).select(
            "vec_id", F.size("embedding").alias("dims"), "embedding"
        ).toArrow()
        by_dims = {}
        for dims in set(asked["dims"].to_pylist()):
            same = asked.filter(pa.compute.equal(asked["dims"], dims)).combine_chunks()
            by_dims[dims] = matrix(same["embedding"]), same["vec_id"].to_numpy()
        found.append(written(_of_block(trees, by_dims, k, relax), "search-found"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select("query_id", "rank", "vec_id", "score")


def _of_block(trees: DataFrame, by_dims: dict[int, tuple], k: int, relax: float) -> DataFrame:
    """The k best of the queries of one block (of each vector length, the vectors and their ids)."""
    shared = trees.sparkSession.sparkContext.broadcast(by_dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, Asked] = {}
        for batch in batches:
            for dims, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if dims in shared.value:
                    if dims not in asked:
                        asked[dims] = Asked(*shared.value[dims], k)
                    pickle.loads(stored.as_buffer()).search(asked[dims], relax)
        for dims, a in asked.items():
            q, place = np.nonzero(a.best != NONE)
            columns = [
                pa.array(a.own[q]), pa.array(q + (dims << 32)), pa.array(a.best[q, place]), pa.array(a.score[q, place])
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "row", "vec_id", "score"])

    found = trees.select("dims", "tree").mapInArrow(run, "query_id long, row long, vec_id long, score double")
    # a query's number in its block: rows that share an id are ranked each
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
