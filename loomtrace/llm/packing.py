"""Packing documents into windows of a fixed number of tokens.

Best-fit decreasing: a document longer than a window is first cut into full windows and a rest; rests are placed from the
longest down, each into the open window with the least room that still holds it, found in a segment tree over the room
left. What remains half empty is then levelled: the emptiest windows are taken apart and their tokens poured into the
gaps of the others, so at most one window of a block is left short.

Every task packs its own rows in blocks of bounded size, so nothing is gathered anywhere; more rows are more blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_arrow, small_batches
from .tokens import encoder, in_blocks

#: id that ends every document
END_ID = 1


class RoomTree:
    """How many open windows have each amount of room, with the least amount of at least n found in log time."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, which: int) -> None:
        self.open[room].append(which)
        k = room + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest open window with room for `need`, removed from the tree, and its room."""
        k = need + self.leaves
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k <<= 1
                if not self.count[k]:
                    k += 1
        room = k - self.leaves
        which = self.open[room].pop()
        while k:
            self.count[k] -= 1
            k >>= 1
        return which, room


def best_fit(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start in the item, length); every part of every item lies in exactly one window."""
    windows: list[list[tuple[int, int, int]]] = []
    rests = []
    for item, n in enumerate(lengths):
        full = n // window
        windows += [[(item, k * window, window)] for k in range(full)]
        if n % window:
            rests.append((n % window, item, full * window))
    tree, n_full = RoomTree(window), len(windows)
    rests.sort(key=lambda x: (-x[0], x[1]))
    for n, item, start in rests:
        if found := tree.take(n):
            which, room = found
            windows[which].append((item, start, n))
        else:
            which, room = len(windows), window
            windows.append([(item, start, n)])
        if room > n:
            tree.add(room - n, which)
    return windows[:n_full] + levelled(windows[n_full:], window)


def levelled(windows: list[list[tuple[int, int, int]]], window: int) -> list[list[tuple[int, int, int]]]:
    """The same parts, cut where needed, in as few windows as they can fill."""
    by_use = sorted(windows, key=lambda w: -sum(p[2] for p in w))
    keep = -(-sum(p[2] for w in windows for p in w) // window)
    kept, loose = by_use[:keep], [p for w in by_use[keep:] for p in w]
    for w in kept:
        room = window - sum(p[2] for p in w)
        while room and loose:
            item, start, n = loose.pop()
            w.append((item, start, min(n, room)))
            if n > room:
                loose.append((item, start + room, n - room))
            room -= min(n, room)
    return kept


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, used long, padded_to long"


def pack(
    docs: DataFrame,
    window: int = 2_048,
    end_id: int = END_ID,
    path: str | None = None,
    with_ids: bool = False,
    block_tokens: int = 4_000_000,
) -> DataFrame:
    """One row per piece: doc_id, start (tokens of its document before it), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset in the sequence, used (tokens of the sequence), padded_to (`window`,
    or `used` where that is a power of two); with_ids adds the piece's ids as array<int>.

    A document is its ids and end_id, so null and empty texts are one token. Repeated rows are packed each on their own; a
    null doc_id is kept. An empty table gives none. Columns beside doc_id and text are ignored, whatever their names. A text
    of any length is taken whole: one beyond a block's tokens is a block of its own. A block closes at block_tokens tokens,
    so memory is bounded; sequence_id holds the partition and a running number.
    """
    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, end_id.to_bytes(4, "little")
        base, number = TaskContext.get().partitionId() << 36, 0
        held, tokens = [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, held, tokens
            rows = []
            for parts in best_fit([len(raw) // 4 for _, raw in held], window):
                used, at = sum(p[2] for p in parts), 0
                for item, start, n in parts:
                    doc, raw = held[item]
                    ids = raw[4 * start : 4 * (start + n)]
                    rows.append(
                        (
                            doc,
                            start,
                            n,
                            zlib.crc32(ids),
                            len(raw) // 4,
                            base + number,
                            at,
                            used,
                            used if used & (used - 1) == 0 else window,
                            ids,
                        )
                    )
                    at += n
                number += 1
            held, tokens = [], 0
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], doc_type), *(pa.array(c, pa.int64()) for c in columns[1:9])]
            if with_ids:
                arrays.append(
                    pa.ListArray.from_arrays(
                        pa.array([0, *_running(columns[2])], pa.int32()),
                        pa.Array.from_buffers(pa.int32(), sum(columns[2]), [None, pa.py_buffer(b"".join(columns[9]))]),
                    )
                )
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in small_batches(batches, 1, 4_000_000):
            doc_type = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in in_blocks(texts, 2_000_000):
                for doc, raw in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    held.append((doc, raw + end))
                    tokens += len(raw) // 4 + 1
                if tokens >= block_tokens:
                    yield close()
        if held:
            yield close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_arrow(docs).select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, {SCHEMA}" + ", ids array<int>" * with_ids
    )


def _running(lengths) -> list[int]:
    total, out = 0, []
    for n in lengths:
        total += n
        out.append(total)
    return out
