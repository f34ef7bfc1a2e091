"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

Weights: a document is its multiset of shingles of five words (fewer than five words: one shingle of all). A shingle
weighs its count times 1 + ln((N + 1) / (n + 1)), where N is the number of documents and n that of documents with the
shingle, but at least N / RARE: rarer ones weigh alike (see `frequencies`).

Signatures: improved consistent weighted sampling, `bands` x `rows` samples; equal samples have the weighted Jaccard
similarity as their chance. Documents that share all samples of a band are candidates.

Verification: exactly equal texts (as words) are folded first. In every band bucket all are compared with the least, and
links form components; pairs whose total weights alone rule out the threshold are not fetched. Where a bucket still holds
several components, the members outside its largest one are compared with all members, in tiles that return no more links
than members; so every candidate pair is either verified or already joined. The class of a document is its component; its
id is the least doc_id in it.

Rows are known by (doc_id, 64-bit hash of doc_id and text): rows that share a doc_id are documents of their own, rows equal
in both are one document. Null and empty texts belong to no group: each row is its own class. Texts whose words are equal
are equal, whatever the white space. A null doc_id takes part like any other but never names a class: a class of rows
without doc_id has a null class_id, and its group_id tells it from others. An empty table gives none. Columns beside
doc_id and text are ignored by near_duplicates and kept, whatever their names, by keep_one. Texts of any length are taken
whole. Words' identity is kept by 64-bit hashes, shingles' in weights and verification by 32 bits.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from .common import small_arrow, small_batches, written
from .graph import components, least_members
from .tokens import in_blocks
from .words import grams, hashed_words, mixed

CELL_BITS, SLICES = 20, 64
#: A shingle in fewer than one of RARE documents counts as one in RARE.
RARE = 1_000
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 3
#: Nodes up to which their list is broadcast to find their texts; beyond, texts are shuffled.
MAX_BROADCAST = 200_000
#: Pairs of one leader that a task compares.
MANY = 512


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingle hashes of each text, with repeats, one text after the other; where each text starts."""
    flat, starts = hashed_words(texts)
    all_grams, parts, sizes = grams(flat, SHINGLE), [], np.zeros(len(texts) + 1, dtype=np.int64)
    for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        if b - a >= SHINGLE:
            own = np.sort(all_grams[a : b - SHINGLE + 1])
        else:
            own = grams(flat[a:b], b - a, seed=2) if b > a else np.zeros(0, dtype=np.uint64)
        parts.append(own)
        sizes[k + 1] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64), np.cumsum(sizes)


def distinct(sorted_hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text, their counts, and where each text starts among them."""
    if not len(sorted_hashes):
        return sorted_hashes, np.zeros(0, dtype=np.int64), np.zeros_like(starts)
    first = np.r_[True, sorted_hashes[1:] != sorted_hashes[:-1]]
    first[starts[:-1][starts[:-1] < len(sorted_hashes)]] = True
    where = np.flatnonzero(first)
    return sorted_hashes[where], np.diff(np.r_[where, len(sorted_hashes)]), np.searchsorted(where, starts)


@dataclass
class Weights:
    """The weight of each shingle (of the first 32 bits of its hash): of the frequent ones in a table, else that of a rare."""

    keys: np.ndarray
    values: np.ndarray
    rare: float

    def __post_init__(self) -> None:
        self.cells = np.zeros(1 << CELL_BITS, dtype=bool)
        self.cells[self.keys >> np.uint32(32 - CELL_BITS)] = True

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of shingle hashes of 32 or 64 bits."""
        short = hashes if hashes.dtype == np.uint32 else (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(short), self.rare)
        maybe = np.flatnonzero(self.cells[short >> np.uint32(32 - CELL_BITS)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, short[maybe]), len(self.keys) - 1)
            known = self.keys[at] == short[maybe]
            out[maybe[known]] = self.values[at[known]]
        return out * counts


def _distinct_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of texts: how many, and the 32-bit keys of the distinct shingles of each, one after the other."""
    for batch in small_batches(batches, 0, 8_000_000):
        texts = [x or b"" for x in batch.column(0).to_pylist()]
        for a, b in in_blocks(texts, 2_000_000):
            yield b - a, (distinct(*shingles(texts[a:b]))[0] >> np.uint64(32)).astype(np.uint32)


def frequencies(docs: DataFrame, rare: int = RARE, most: int = 1 << CELL_BITS) -> tuple[
    int, int, np.ndarray, np.ndarray
]:
    """N, the floor, and the frequent shingles with their numbers of documents, counted over all documents.

    Frequent are shingles in at least N / rare documents. With S shingles in a document on average there are at most
    rare x S of them, however many documents there are; where that may exceed `most`, rare is most / S. The first pass
    counts in 2^20 hashed cells, so that the second counts one by one only the shingles of cells that are full enough;
    tasks send sums, never shingle by shingle.
    """
    per_slice = (1 << CELL_BITS) // SLICES
    texts = docs.select(F.col("text").cast("binary").alias("text"))

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(1 << CELL_BITS, dtype=np.int64), 0
        for size, keys in _distinct_keys(batches):
            n += size
            cells += np.bincount(keys >> np.uint32(32 - CELL_BITS), minlength=1 << CELL_BITS)
        if n:
            parts = cells.reshape(SLICES, per_slice).astype("<i8")
            packed = [zlib.compress(part.tobytes(), 1) for part in parts]
            columns = [
                pa.array(range(SLICES), pa.int32()), pa.array([n] * SLICES, pa.int64()), pa.array(packed, pa.binary())
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "n", "cells"])

    def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(per_slice, dtype=np.int64), 0
        for part in tables:
            for more, packed in zip(part.column("n").to_pylist(), part.column("cells").to_pylist(), strict=True):
                total += np.frombuffer(zlib.decompress(packed), "<i8")
                n += more
        columns = [
            pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["slice", "n", "cells"])

    schema = "slice int, n long, cells binary"
    # 2^20 counts in all, whatever the input
    rows = sorted(texts.mapInArrow(in_cells, schema).groupBy("slice").applyInArrow(add, schema).collect())
    if not rows:
        return 0, 1, np.zeros(0, np.uint32), np.zeros(0, np.int64)
    n = rows[0].n
    cells = np.concatenate([np.frombuffer(r.cells, "<i8") for r in rows])
    floor = max(1, math.ceil(n / rare), math.ceil(int(cells.sum()) / most))
    full = docs.sparkSession.sparkContext.broadcast(np.packbits(cells >= floor))

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(full.value).astype(bool)
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int64)), pa.array(counts, pa.int64())], names=["key", "n"]
            )

        for _, keys in _distinct_keys(batches):
            held.append(keys[wanted[keys >> np.uint32(32 - CELL_BITS)]])
            size += len(held[-1])
            if size > 8_000_000:
                yield summed()
                held, size = [], 0
        if size:
            yield summed()

    counted = texts.mapInArrow(one_by_one, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # at most `most` rows of 16 bytes, by the floor
    found = counted.filter(F.col("n") >= floor).toArrow().sort_by("key")
    return n, floor, found["key"].to_numpy().astype(np.uint32), found["n"].to_numpy().astype(np.int64)


def tfidf_weights(docs: DataFrame, rare: int = RARE) -> Weights:
    n, floor, keys, counts = frequencies(docs, rare)
    idf = lambda of: 1 + np.log((n + 1) / (np.minimum(of, n) + 1))
    return Weights(keys, idf(counts), float(idf(floor)))


class Sampler:
    """Consistent weighted samples. The gamma variates come from tables of 2^16 quantiles, the shift from 16 bits more."""

    def __init__(self, n: int):
        u = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = np.full(len(u), 1.5)
        for _ in range(60):  # P(gamma(2) <= x) = 1 - (1 + x) e^-x, inverted by damped Newton steps
            x = np.maximum(x - np.clip((1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), -1, 1), x / 4)
        self.n, self.gamma, self.log_gamma = n, x.astype(np.float32), np.log(x).astype(np.float32)

    def __call__(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of n samples for each text; all texts have shingles."""
        out = np.empty((len(starts) - 1, self.n), dtype=np.uint64)
        lengths, log_w = np.diff(starts), np.log(weights).astype(np.float32)
        other = mixed(hashes + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        low, step = np.uint64(0xFFFF), hashes.copy()
        for k in range(self.n):
            step += other
            h = step ^ (step >> np.uint64(29))
            h *= np.uint64(0xBF58476D1CE4E5B9)
            r = self.gamma[(h >> np.uint64(48)).astype(np.int64)]
            shift = ((h >> np.uint64(16)) & low).astype(np.float32) * np.float32(2**-16)
            level = np.floor(log_w / r + shift)
            value = self.log_gamma[((h >> np.uint64(32)) & low).astype(np.int64)] - r * (level - shift + 1)
            least = np.minimum.reduceat(value, starts[:-1])
            at = np.flatnonzero(value == np.repeat(least, lengths))
            at = at[np.searchsorted(at, starts[:-1])]
            out[:, k] = mixed(
                hashes[at] + level[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            )
        return out


def row_keys(docs: DataFrame) -> DataFrame:
    """doc_id, uid (64-bit hash of doc_id and text), text as binary: what the steps below read of each row."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), F.col("text").cast("binary").alias("text"))


def signatures(docs: DataFrame, weights: Weights, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, uid, node (hash of the words; null without any), weight (in all), band_keys."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sampler(bands * rows)
        for batch in small_batches(batches, 2, 8_000_000):
            texts = [x or b"" for x in batch.column(2).to_pylist()]
            nodes, totals, keys = [], [], []
            for a, b in in_blocks(texts, 400_000):
                hashes, counts, starts = distinct(*shingles(texts[a:b]))
                own = shared.value(hashes, counts)
                full = np.flatnonzero(np.diff(starts))
                sums, band = np.zeros(b - a), [None] * (b - a)
                if len(full):
                    sums[full] = np.add.reduceat(own, starts[full])
                    drawn = sample(hashes, own, np.r_[starts[full], len(hashes)]).reshape(len(full), bands, rows)
                    key = np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1)
                    for r in range(rows):
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + drawn[:, :, r])
                    for k, row in zip(full.tolist(), key.astype(np.int64).tolist(), strict=True):
                        band[k] = row
                nodes += [node_of(x) for x in texts[a:b]]
                totals += sums.tolist()
                keys += band
            made = [pa.array(nodes, pa.int64()), pa.array(totals, pa.float64()), pa.array(keys, pa.list_(pa.int64()))]
            names = ["doc_id", "uid", "node", "weight", "band_keys"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    schema = f"doc_id {kind}, uid long, node long, weight double, band_keys array<long>"
    return row_keys(docs).mapInArrow(run, schema)


def node_of(text: bytes) -> int | None:
    words = text.split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63 if words else None


def similarity(a: np.ndarray, b: np.ndarray, weights: Weights) -> float:
    """Weighted Jaccard similarity of two sorted arrays of shingle hashes with repeats."""
    both = np.concatenate([a, b])
    hashes, where = np.unique(both, return_inverse=True)
    in_a, in_b = np.bincount(where[: len(a)], minlength=len(hashes)), np.bincount(
        where[len(a) :], minlength=len(hashes)
    )
    most = weights(hashes, np.maximum(in_a, in_b)).sum()
    return float(weights(hashes, np.minimum(in_a, in_b)).sum() / most) if most else 0.0


def gram_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """node, grams (32 bits of each shingle, sorted, with repeats) of the wanted nodes (node, uid of a row that has it)."""
    wanted = written(wanted.select(F.col("node"), F.col("uid").alias("holder")), "minhash-wanted")
    if wanted.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = row_keys(docs).select("uid", "text").join(wanted, F.col("uid") == F.col("holder"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()  # rows may repeat: a task sends each node once
        for batch in small_batches(batches, 1, 2_000_000):
            texts, nodes = [x or b"" for x in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            keep = [k for k, x in enumerate(texts) if nodes[k] not in done and node_of(x) == nodes[k]]
            keep = list({nodes[k]: k for k in keep}.values())
            done.update(nodes[k] for k in keep)
            flat, starts = shingles([texts[k] for k in keep])
            short = (flat >> np.uint64(32)).astype("<u4")
            packed = [short[i:j].tobytes() for i, j in zip(starts[:-1], starts[1:], strict=True)]
            columns = [pa.array([nodes[k] for k in keep], pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "grams"])

    found = texts.select("node", "text").mapInArrow(fetch, "node long, grams binary")
    return written(found.dropDuplicates(["node"]), "minhash-sets")


def verified_pairs(pairs: DataFrame, sets: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The pairs (u, v of nodes) whose similarity reaches the threshold."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2, 4_000_000):
            u, v, a, b = (c.to_pylist() for c in batch.columns)
            near = [
                k
                for k in range(len(u)) if similarity(
                    np.frombuffer(a[k], "<u4"), np.frombuffer(b[k], "<u4"), shared.value
                ) >= threshold
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([u[k] for k in near], pa.int64()), pa.array([v[k] for k in near], pa.int64())],
                names=["u", "v"],
            )

    # a leader of many pairs is dealt over several tasks: its set once for each MANY pairs
    hot = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / MANY).cast("int").alias("deals")).filter("deals > 1")
    hot = written(hot, "minhash-hot")
    if hot.count() <= MAX_BROADCAST:
        hot = F.broadcast(hot)
    deals = F.coalesce("deals", F.lit(1))
    dealt = pairs.join(hot, "v", "left").select(
        "u", "v", F.pmod(F.xxhash64("u", F.lit(7)), deals).cast("int").alias("deal")
    )
    members = sets.select(F.col("node").alias("u"), F.col("grams").alias("a"))
    leaders = sets.select(F.col("node").alias("v"), F.col("grams").alias("b")).join(hot, "v", "left")
    leaders = leaders.select("v", "b", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
    both = dealt.join(members, "u").join(leaders, ["v", "deal"]).select("u", "v", "a", "b")
    return written(both.mapInArrow(compare, "u long, v long"), "minhash-links")


def links_within(sets: list[np.ndarray], weights: Weights, threshold: float, split: int | None = None) -> tuple[
    np.ndarray, np.ndarray
]:
    """Index pairs of similar sets, all against all, or those before `split` against the rest. The weight two sets share is
    a matrix product over the shingles that several sets have; a repeated shingle counts as one for each time."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    hashes = np.concatenate(sets) if n else np.zeros(0, "<u4")
    first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(
        hashes
    ) else np.zeros(0, np.int64)
    times = np.arange(len(hashes)) - np.repeat(first, np.diff(np.r_[first, len(hashes)]))
    # a shingle and which time it is, 32 bits each
    numbered = hashes.astype(np.uint64) << np.uint64(32) | times.astype(np.uint64)
    keys, column, uses = np.unique(numbered, return_inverse=True, return_counts=True)
    weight = weights((keys >> np.uint64(32)).astype(np.uint32), np.ones(len(keys), np.int64))
    total = np.bincount(owner, weights=weight[column], minlength=n)
    common = np.cumsum(uses > 1) - 1
    use = uses[column] > 1
    owner, column, width = owner[use], common[column[use]], int(common[-1] + 1) if len(common) else 0
    weight = weight[uses > 1]
    cut = n if split is None else split
    rows, cols = np.arange(cut), np.arange(n) if split is None else np.arange(split, n)
    shared = np.zeros((len(rows), len(cols)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, width, 2_048):
        lo, hi = np.searchsorted(column, [at, at + 2_048])
        has = np.zeros((n, min(2_048, width - at)))
        has[owner[lo:hi], column[lo:hi] - at] = 1
        shared += (has[rows] * weight[at : at + 2_048]) @ has[cols].T
    near = shared >= threshold * (total[rows][:, None] + total[cols][None, :] - shared) - 1e-9
    i, j = np.nonzero(near)
    i, j = rows[i], cols[j]
    keep = i < j
    return i[keep], j[keep]


def verified_buckets(
    members: DataFrame, sets: DataFrame, weights: Weights, threshold: float, tile: int = 512
) -> DataFrame:
    """Links within buckets (bucket, node, main: of the bucket's largest component). Members outside the largest component
    are compared with all; pairs inside it are joined already. A bucket is dealt into tiles of bounded size, those of main
    members and of the rest apart, and each pair of tiles that is not of two main ones is one group, which returns, of the
    links it finds, a star per component."""
    shared = members.sparkSession.sparkContext.broadcast(weights)
    n_tiles = lambda of: F.greatest(F.ceil(F.count_if(of) / tile), F.lit(1)).cast("int")
    size = members.groupBy("bucket").agg(n_tiles(F.col("main")).alias("mains"), n_tiles(~F.col("main")).alias("rests"))
    # buckets of several tiles are few and hold many members each; all others have one tile of each kind
    size = written(size.filter("mains > 1 OR rests > 1"), "minhash-tiles")
    if size.count() <= MAX_BROADCAST:
        size = F.broadcast(size)
    dealt = members.join(size, "bucket", "left").fillna(1, ["mains", "rests"])
    # tiles of main members have numbers below zero
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast(
        "int"
    )
    dealt = dealt.withColumn("tile", F.when(F.col("main"), -1 - own).otherwise(own))
    first = F.when(F.col("main"), F.lit(0)).otherwise(-F.col("mains"))
    met = dealt.withColumn("other", F.explode(F.sequence(first, F.col("rests") - 1)))
    ends = F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2")
    met = met.select("node", "bucket", *ends, "tile").join(sets, "node")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        first, last = group["t1"][0].as_py(), group["t2"][0].as_py()
        order = np.lexsort((group["node"].to_numpy(), group["tile"].to_numpy()))
        nodes, tiles = group["node"].to_numpy()[order], group["tile"].to_numpy()[order]
        grams = group["grams"].to_pylist()
        split = None if first == last else int((tiles == first).sum())
        i, j = links_within([np.frombuffer(grams[k], "<u4") for k in order], shared.value, threshold, split)
        least = least_members(len(nodes), i, j)
        moved = np.flatnonzero(least != np.arange(len(nodes)))
        return pa.table({"u": pa.array(nodes[moved], pa.int64()), "v": pa.array(nodes[least[moved]], pa.int64())})

    return written(met.groupBy("bucket", "t1", "t2").applyInArrow(run, "u long, v long"), "minhash-links")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, rare: int = RARE
) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), kept (the row stands for its class), group_id (a number of the
    class that is never null but for texts without words) of every row of docs. Rows equal in doc_id and text are one
    document, so all of them are marked as kept if one is."""
    return _classes(docs, threshold, bands, rows, rare).select("doc_id", "class_id", "kept", "group_id")


def _classes(docs: DataFrame, threshold: float, bands: int, rows: int, rare: int) -> DataFrame:
    """doc_id, uid, class_id, kept, group_id of every row."""
    weights = tfidf_weights(small_arrow(docs), rare)
    signed = written(signatures(docs, weights, bands, rows), "minhash-signatures")
    some = signed.filter("node IS NOT NULL")
    # whose row stands first: the least doc_id, then the least hash
    who = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "uid"))
    nodes = some.groupBy("node").agg(
        who.alias("lead"), F.max("weight").alias("weight"), F.min("band_keys").alias("band_keys")
    )
    nodes = written(nodes, "minhash-nodes")
    holders = nodes.select("node", F.col("lead.uid").alias("uid"))
    members = nodes.select("node", "weight", F.explode("band_keys").alias("band"))
    leaders = members.groupBy("band").agg(F.min(F.struct("node", "weight")).alias("lead"), F.count(F.lit(1)).alias("n"))
    # written, as are the least below: a join whose both inputs are plain shuffles is split where a key is hot
    leaders = written(leaders.filter("n > 1").select("band", "lead"), "minhash-leaders")
    # total weights already rule out pairs: the similarity is at most the lesser over the greater
    ends = [
        F.col("node").alias("u"),
        F.col("weight").alias("wu"),
        F.col("lead.node").alias("v"),
        F.col("lead.weight").alias("wv"),
    ]
    first = members.join(leaders, "band").select(*ends).filter("u <> v")
    first = first.filter(F.least("wu", "wv") >= F.greatest("wu", "wv") * (threshold - 1e-9))
    first = written(first.select("u", "v").distinct(), "minhash-pairs")
    wanted = first.select(F.col("u").alias("node")).union(first.select(F.col("v").alias("node"))).distinct()
    links = verified_pairs(first, gram_sets(wanted.join(holders, "node"), docs), weights, threshold)
    joined = written(components(links, "minhash-components"), "minhash-joined")

    # buckets that still hold several components; of buckets with the same members one is enough
    coloured = members.join(leaders.select("band"), "band").join(joined, "node", "left")
    coloured = coloured.select("band", "node", F.coalesce("component", "node").alias("colour"))
    token = lambda seed: F.sum(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(2**40)))
    shades = coloured.groupBy("band", "colour").agg(
        F.count(F.lit(1)).alias("n"), token(5).alias("s1"), token(6).alias("s2")
    )
    several = shades.groupBy("band").agg(
        F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"),
        F.count(F.lit(1)).alias("colours"), F.max(F.struct("n", "colour")).alias("most"),
    ).filter("colours > 1")
    several = several.groupBy("n", "s1", "s2").agg(F.min(F.struct("band", "most")).alias("one"))
    several = several.select("one.band", F.col("one.most.colour").alias("main"))
    crowd = coloured.join(several, "band").select(
        F.col("band").alias("bucket"), "node", (F.col("colour") == F.col("main")).alias("main")
    )
    crowd = written(crowd, "minhash-buckets")
    if not crowd.isEmpty():
        sets = gram_sets(crowd.select("node").distinct().join(holders, "node"), docs)
        joined = components(links.union(verified_buckets(crowd, sets, weights, threshold)), "minhash-components")

    named = nodes.join(joined, "node", "left").select("node", "lead", F.coalesce("component", "node").alias("group_id"))
    least = written(named.groupBy("group_id").agg(F.min("lead").alias("first")), "minhash-least")
    classes = written(named.join(least, "group_id").select("node", "group_id", "first"), "minhash-classes")
    is_first = (F.col("uid") == F.col("first.uid")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    grouped = some.select("doc_id", "uid", "node").join(classes, "node")
    grouped = grouped.select(
        "doc_id", "uid", F.col("first.doc_id").alias("class_id"), is_first.alias("kept"), "group_id"
    )
    alone = signed.filter("node IS NULL")
    alone = alone.select(
        "doc_id",
        "uid",
        F.col("doc_id").alias("class_id"),
        F.lit(True).alias("kept"),
        F.lit(None).cast("long").alias("group_id"),
    )
    return grouped.unionByName(alone)


def keep_one(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, rare: int = RARE
) -> DataFrame:
    """The rows of docs that stand for their class, one each: that with the least doc_id, nulls last, then the least hash
    of doc_id and text, then of all columns of plain types. Texts without words all stay."""
    found = _classes(docs, threshold, bands, rows, rare).filter("kept")
    stand = found.groupBy("doc_id", "uid").agg(
        F.count(F.lit(1)).alias("times"), F.max(F.col("group_id").isNotNull()).alias("once")
    )
    stand = written(stand, "minhash-kept").select(
        F.col("doc_id").alias("kept_id"), F.col("uid").alias("kept_uid"), "times", "once"
    )
    inner = [f"_{k}" for k in range(len(docs.columns))]
    rows_of = docs.toDF(*inner)
    doc, text = (inner[docs.columns.index(x)] for x in ("doc_id", "text"))
    met = rows_of.withColumn("uid", F.xxhash64(doc, text)).join(
        stand, (F.col("uid") == F.col("kept_uid")) & F.col(doc).eqNullSafe(F.col("kept_id"))
    )
    many = F.col("once") & (F.col("times") > 1)
    # rows equal in doc_id and text: each task sends its first only
    plain = [
        f.name for f in rows_of.schema if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)
    ]
    order = Window.partitionBy("uid", doc).orderBy(F.xxhash64(*plain), *plain)
    again = met.filter(many).withColumn("place", F.row_number().over(order)).filter("place = 1")
    out = met.filter(~many).select(*inner).unionByName(again.select(*inner))
    return out.toDF(*docs.columns)
