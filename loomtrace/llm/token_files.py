"""Files of token ids, entropy-coded, and their readers.

A data set is a folder of three tables, all written by Spark's own committer, so lost tasks leave nothing behind:
`table` (id, freq: the shares of the numeral system, from the counts of all ids), `blocks` (part, block, first, n_tokens,
payload, docs: about 131 072 ids each, coded as in ans.py, with the pieces of documents in them) and `parts` (part, base,
n_tokens: how many ids lie before each part). Ids stand in ascending order of doc_id, nulls first; equal doc_ids in the order
of their ids' checksums. A document's ids may run over several blocks of one part.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ans
from .common import shared_folder, small_arrow, small_batches, written
from .tokens import in_blocks, word_encoder

#: id that ends every document
END_ID = 1
#: Ids of a block, states that take turns, steps between checkpoints, and blocks coded side by side by one task.
BLOCK, LANES, EVERY, TOGETHER = 131_072, 128, 256, 16
PIECES = "doc_id {}, at long, doc_first long, before long, length long, doc_tokens long"


def token_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, tie, ids (little-endian, 16 bits where the vocabulary allows, else 32) of every document, end_id last."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        width = _width(max(encoder.size, end_id + 1))
        end = end_id.to_bytes(int(width[-1]), "little")
        for batch in small_batches(batches, 1, 4_000_000):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in in_blocks(texts, 2_000_000):
                flat, sizes = encoder.encode(texts[a:b])
                ids, ends = memoryview(flat.astype(width, copy=False).tobytes()), (np.cumsum(sizes) * int(width[-1])).tolist()
                raw = [bytes(ids[p:q]) + end for p, q in zip([0, *ends], ends, strict=False)]
                columns = [batch.column(0).slice(a, b - a), pa.array(map(zlib.crc32, raw), pa.int64()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "ids"])

    return small_arrow(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, tie long, ids binary")


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def id_counts(stored: DataFrame, width: str) -> dict[int, int]:
    """How often each id occurs, over all rows; one entry at most for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            found = np.bincount(_flat(batch.column(0), width)[0])
            if len(found) > len(counts):
                counts = np.pad(counts, (0, len(found) - len(counts)))
            counts[: len(found)] += found
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["id", "n"])

    counted = stored.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r.id: r.n for r in counted.toLocalIterator()}


def _flat(column: pa.Array, width: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of binaries, and where each row's begin (one entry more than rows)."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return raw.view(width), (ends - ends[0]) // int(width[-1])


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of all documents to a new data set.

    Documents are the rows of docs: null texts count as empty, which is end_id alone; rows that repeat stay as many; null
    doc_ids stand first. Columns beside doc_id and text are ignored. An empty table gives a data set without blocks. Ids
    are kept once in the shared folder, counted, dealt by ranges of doc_id and, where these are equal, of checksums and
    rows, so that no doc_id makes a task large, and coded block by block.
    """
    spark = docs.sparkSession
    size = max(word_encoder(path).size, end_id + 1)
    width = _width(size)
    stored = written(token_ids(docs, path, end_id), "token-ids")
    table = ans.Table.of_counts(id_counts(stored, width), size)
    # one row for each id of the vocabulary
    spark.createDataFrame(list(enumerate(table.freq.astype(int).tolist())), "id int, freq long").coalesce(1).write.parquet(
        f"{folder}/table"
    )
    kind = stored.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(table.freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = ans.Table(shared.value), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        pieces: list[tuple] = []  # what stands in held: doc_id, row, where the row begins in the part, place, length, size
        number = done = size = row = 0

        def close(n: int) -> Iterator[pa.RecordBatch]:
            """Codes the first n of the ids held; keeps the rest."""
            nonlocal held, pieces, number, done, size
            flat = np.concatenate(held)
            rest = []
            for count, payload in ans.split(table, flat[:n].astype(np.uint32), LANES, EVERY, BLOCK):
                inside, rest = [], []
                room = count
                for doc, at, first, before, length, whole in pieces:
                    here = min(length, room)
                    room -= here
                    if here:
                        inside.append((doc, at, first, before, here, whole))
                    if length > here:
                        rest.append((doc, at, first, before + here, length - here, whole))
                pieces = rest
                yield _block(part, number, done, count, payload, inside, doc_type)
                number, done = number + 1, done + count
            held, size = [flat[n:]], size - n

        for batch in batches:
            doc_type = batch.schema.field(0).type
            flat, starts = _flat(batch.column(1), width)
            held.append(flat)
            for doc, a, b in zip(batch.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                pieces.append((doc, row, done + size + a, 0, b - a, b - a))
                row += 1
            size += len(flat)
            if size >= TOGETHER * BLOCK:
                yield from close(size // BLOCK * BLOCK)
        if size:
            yield from close(size)

    ordered = stored.orderBy("doc_id", "tie", F.monotonically_increasing_id()).select("doc_id", "ids")
    docs_type = f"array<struct<{', '.join(f'{x.split()[0]}:{x.split()[1]}' for x in PIECES.format(kind).split(', '))}>>"
    blocks = ordered.mapInArrow(run, f"part int, block int, first long, n_tokens long, payload binary, docs {docs_type}")
    blocks.write.option("compression", "zstd").parquet(f"{folder}/blocks")
    # one row for each task that wrote
    ended = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("n"))
    sizes = sorted((r.part, r.n) for r in ended.toLocalIterator())
    bases = itertools.accumulate((n for _, n in sizes), initial=0)
    rows = [(part, base, n) for (part, n), base in zip(sizes, bases, strict=False)]
    spark.createDataFrame(rows, "part int, base long, n_tokens long").coalesce(1).write.parquet(f"{folder}/parts")


def _block(part, number, first, count, payload, inside, doc_type) -> pa.RecordBatch:
    columns = list(zip(*inside, strict=True))
    names = [x.split()[0] for x in PIECES.split(", ")]
    arrays = [pa.array(columns[0], doc_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
    docs = pa.ListArray.from_arrays(pa.array([0, len(inside)], pa.int32()), pa.StructArray.from_arrays(arrays, names=names))
    one = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64())]
    one += [pa.array([count], pa.int64()), pa.array([payload], pa.binary()), docs]
    return pa.RecordBatch.from_arrays(one, names=["part", "block", "first", "n_tokens", "payload", "docs"])


def _table(spark: SparkSession, folder: str):
    """The shares of a data set, one row for each id of its vocabulary, as a broadcast."""
    rows = spark.read.parquet(f"{folder}/table").orderBy("id").select("freq").toLocalIterator()
    return spark.sparkContext.broadcast(np.array([r.freq for r in rows], dtype=np.uint64))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document of a data set, from its files.

    Blocks are proven and decoded where they lie; what they hold of a document is a checksum, shifted by what follows, and
    the document's is the exclusive or of these."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    shared = _table(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ans.Table(shared.value)
        for batch in batches:
            counts = batch.column(1).to_numpy()
            start, held = 0, 0
            for k, n in enumerate([*counts.tolist(), 0]):
                if k == len(counts) or held + n > TOGETHER * BLOCK and held:
                    yield from pieces_of(batch.slice(start, k - start), table)
                    start, held = k, 0
                held += n

    def pieces_of(batch: pa.RecordBatch, table: ans.Table) -> Iterator[pa.RecordBatch]:
        if not len(batch):
            return
        parts = [x for payload in batch.column(2) for x in ans.stretches(payload.as_py())]
        raw = memoryview(np.concatenate(ans.decode(table, parts)).tobytes())
        docs = batch.column(3).flatten()
        lengths, before, whole = (docs.field(k).to_numpy() for k in (4, 3, 5))
        ends = np.cumsum(lengths) * 4
        if ends[-1] != len(raw):
            raise ValueError("documents do not match their block")
        behind = (whole - before - lengths).tolist()
        sums = [zlib.crc32(raw[a:b]) for a, b in zip((ends - 4 * lengths).tolist(), ends.tolist(), strict=True)]
        sums = [ans.shifted(c, 4 * n) if n else c for c, n in zip(sums, behind, strict=True)]
        part = pa.array(np.repeat(batch.column(0).to_numpy(), pa.compute.list_value_length(batch.column(3)).to_numpy()))
        columns = [part, docs.field(1), docs.field(0), docs.field(2), docs.field(5), docs.field(4), pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "at", "doc_id", "doc_first", "doc_tokens", "length", "crc"])

    schema = f"part int, at long, doc_id {kind}, doc_first long, doc_tokens long, length long, crc long"
    rows = small_arrow(blocks).select("part", "n_tokens", "payload", "docs").mapInArrow(run, schema)
    one = rows.groupBy("part", "at").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("doc_first").alias("doc_first"),
        F.first("doc_tokens").alias("n_tokens"),
        F.sum("length").alias("found"),
        F.bit_xor("crc").alias("ids_crc32"),
    )
    # one row for each task that wrote
    bases = spark.read.parquet(f"{folder}/parts").select("part", "base")
    missing = F.raise_error(F.lit("a document's ids are not all there")).cast("long")
    return one.join(F.broadcast(bases), "part").select(
        "doc_id",
        (F.col("base") + F.col("doc_first")).alias("start"),
        F.when(F.col("found") == F.col("n_tokens"), F.col("n_tokens")).otherwise(missing).alias("n_tokens"),
        "ids_crc32",
    )


def read_ids(spark: SparkSession, folder: str, start: int, length: int) -> DataFrame:
    """start, ids (array) of the stretches that hold the ids from `start` on, `length` of them, cut to these: blocks outside
    are not read, and inside a block decoding begins at the checkpoint before."""
    # one row for each task that wrote
    bases = spark.read.parquet(f"{folder}/parts").filter((F.col("base") < start + length) & (F.col("base") + F.col("n_tokens") > start))
    place = F.col("base") + F.col("first")
    blocks = spark.read.parquet(f"{folder}/blocks").join(F.broadcast(bases.select("part", "base")), "part")
    blocks = blocks.filter((place < start + length) & (place + F.col("n_tokens") > start))
    shared = _table(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ans.Table(shared.value)
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = ans.stretches(payload, max(0, start - base), start + length - base)
                for p, ids in zip(parts, ans.decode(table, parts), strict=True):
                    low, high = max(0, start - base - p.first), min(p.n, start + length - base - p.first)
                    columns = [pa.array([base + p.first + low]), pa.array([ids[low:high].tolist()], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["start", "ids"])

    return blocks.select(place.alias("place"), "payload").mapInArrow(run, "start long, ids array<int>")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/loomtrace/{label}-{uuid.uuid4().hex}"
