"""Near-duplicate embeddings by int8 tile products with error bounds.

Equal vectors are folded into one class first, so copies are never paired. Classes are dealt into tiles of bounded size;
every pair of tiles is one group. There each vector is scaled to length 1 and quantised to 8 bits; with e the length of
its quantisation error, the cosine of two vectors differs from the product of their quantised forms by at most
e1 + e2 + e1 e2, so only pairs whose product comes that near the threshold are computed anew in double precision. (The
products of small integers are exact in single-precision floats.) A group returns each vector's number of links and, of
the links themselves, only the star to the least member of each local component: no more rows than vectors.

Null vectors, zero vectors and vectors with null or non-finite components link with nothing; neither do vectors of
different lengths. Repeated rows are vectors of their own, and so are rows that share a vec_id: each has the links of its
vector. A null vec_id is kept, with no links and a null component. An empty table gives none. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components, least_members
from .vectors import matrix, n_parts, usable


#: Numbers in a tile.
TILE_NUMBERS = 1 << 19


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float, block: int = 512):
    """Index pairs (of x and y, or of x and x with the first smaller) whose cosine in doubles reaches the threshold."""

    def quantised(rows: np.ndarray):
        lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        unit = rows / lengths[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        q = np.rint(unit / scale[:, None])
        return lengths, scale, q.astype(np.int8), np.linalg.norm(unit - q * scale[:, None], axis=1) + 1e-9

    exact_in = np.float32 if x.shape[1] * 127 * 127 < 2**24 else np.float64
    len_x, scale_x, q_x, err_x = quantised(x)
    len_y, scale_y, q_y, err_y = (len_x, scale_x, q_x, err_x) if y is None else quantised(y)
    other, wide_y = x if y is None else y, np.ascontiguousarray(q_y.T).astype(exact_in)
    # the least product that a row needs, whatever the column
    gap = threshold - err_x - err_y.max() - err_x * err_y.max()
    need = np.where(gap > 0, gap / (scale_x * scale_y.max()), gap / (scale_x * scale_y.min())).astype(np.float64)
    for at in range(0, len(x), block):
        skip = at if y is None else 0
        products = q_x[at : at + block].astype(exact_in) @ wide_y[:, skip:]
        flat = np.flatnonzero(products >= np.floor(need[at : at + block]).astype(exact_in)[:, None])
        for part in np.array_split(flat, max(1, -(-len(flat) // 200_000))):
            r, c = np.divmod(part, products.shape[1])
            i, j = r + at, c + skip
            maybe = products[r, c] * scale_x[i] * scale_y[j] + err_x[i] + err_y[j] + err_x[i] * err_y[j] >= threshold
            if y is None:
                maybe &= i < j
            i, j = i[maybe], j[maybe]
            near = np.einsum("ij,ij->i", x[i], other[j]) / (len_x[i] * len_y[j]) >= threshold
            yield i[near], j[near]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tile_rows: int | None = None) -> DataFrame:
    """vec_id, n_links (other vectors at or above the threshold), component_id, kept (vec_id = component_id)."""
    rows = vectors.select(
        "vec_id", "embedding", (usable(F.col("embedding")) & F.col("vec_id").isNotNull()).alias("_ok")
    )
    good = rows.filter("_ok").select("vec_id", "embedding")
    # classes are numbered as they are stored, so a class is its vector, whatever ids bear it
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    if tile_rows is None:
        # a tile's vectors take 4 MB as doubles, whatever their length: the larger, the fewer times a vector is sent
        longest = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
        tile_rows = max(256, TILE_NUMBERS // longest)
    tiles = n_parts(classes, tile_rows)
    # rows of different lengths never meet: the length is part of the group's key
    tile = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(tiles)).cast("int").alias("tile")
    dealt = classes.select("rep", "n", "embedding", F.size("embedding").alias("dims"), tile)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    ends = F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2")
    met = met.select("dims", *ends, "tile", "rep", "n", "embedding")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        tile, first = group["tile"].to_numpy(), group["t1"][0].as_py()
        alone = first == group["t2"][0].as_py()
        rep, n, rows = group["rep"].to_numpy(), group["n"].to_numpy(), matrix(group["embedding"])
        a, b = np.flatnonzero(tile == first), np.flatnonzero(tile != first)
        links = np.zeros(len(rep), dtype=np.int64)
        least = np.arange(len(rep))
        if len(a) and (alone or len(b)):
            order = np.argsort(rep, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            for i, j in tile_links(rows[a], None if alone else rows[b], threshold):
                i, j = a[i], (a if alone else b)[j]
                links += np.bincount(i, weights=n[j], minlength=len(rep)).astype(np.int64)
                links += np.bincount(j, weights=n[i], minlength=len(rep)).astype(np.int64)
                now = least_members(len(rep), np.r_[rank[i], np.arange(len(rep))], np.r_[rank[j], least])
                least = now
            least = order[least[rank]]
        some = np.flatnonzero(links)
        columns = {"rep": pa.array(rep[some], pa.int64()), "links": pa.array(links[some], pa.int64())}
        return pa.table(columns | {"least": pa.array(rep[least[some]], pa.int64())})

    found = met.groupBy("dims", "t1", "t2").applyInArrow(run, "rep long, links long, least long")
    found = written(found, "vector-links")
    joined = components(found.select(F.col("rep").alias("u"), F.col("least").alias("v")), "vector-components")
    degrees = found.groupBy("rep").agg(F.sum("links").alias("links"))
    state = classes.join(degrees, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    state = written(
        state.select("embedding", "least_id", n_links, F.coalesce("component", "rep").alias("group")), "vector-state"
    )
    least = written(state.groupBy("group").agg(F.min("least_id").alias("component_id")), "vector-least")
    # written, so that both sides of the last join are plain shuffles, which a hot class can be split over
    known = state.join(least, "group").select(F.col("embedding").alias("vector"), "n_links", "component_id")
    known = written(known, "vector-known")
    out = good.join(known, good["embedding"] == known["vector"]).select("vec_id", "n_links", "component_id")
    none = F.lit(0).cast("long").alias("n_links")
    rest = rows.filter("NOT _ok").select("vec_id", none, F.col("vec_id").alias("component_id"))
    every = out.unionByName(rest)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
