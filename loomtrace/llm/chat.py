"""Chat formatting with a loss mask that is exact to the byte.

A turn is rendered as MARK role MARK text MARK, a conversation as its turns one after the other. MARK is the
vocabulary's control string; the tokenizer splits a text at control strings before anything else, so token boundaries
coincide with the ends of every text. Inside roles and texts a backslash becomes two and "<|" becomes "<\\|", so MARK
cannot occur there and the way back is unique.

A conversation is rendered whole and encoded once, with offsets: those of a byte-level vocabulary are the running sum of
its tokens' bytes. The sorted spans of assistant texts are intersected with the token spans by binary search. A stated
limit: a conversation longer than `segment_chars` comes out as several rows that end between turns, since a row must fit
into memory whatever a conversation's length; the encoding of the whole is that of its segments one after the other, since
MARK ends a turn, and a single turn is never cut.

Rows of a conversation are sorted by turn (nulls first), then role, then text. Null role or text is empty; the rows whose
conv_id is null are one conversation; repeated turns are kept; an empty table gives none. Other columns are ignored. The
turns of a conversation have an order, so one task reads them, a segment at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_arrow
from .tokens import encoder

MARK = "<|endoftext|>"
LOSS_ROLE = "assistant"
SCHEMA = (
    "segment int, n_turns int, formatted string, ids array<int>, loss_mask array<boolean>, starts array<int>, ends "
    "array<int>"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, k = [], 0
    while (at := text.find("\\", k)) >= 0:
        out += text[k:at], text[at + 1 : at + 2]
        k = at + 2
    return "".join([*out, text[k:]])


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of what the loss counts, in its UTF-8 bytes."""
    parts, spans, at = [], [], 0
    size = lambda x: len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass"))
    for role, text in turns:
        head, body = MARK + escape(role) + MARK, escape(text)
        parts += head, body, MARK
        start = at + size(head)
        end = start + size(body)
        if role == LOSS_ROLE and body:
            spans.append((start, end))
        at = end + len(MARK)
    return "".join(parts), spans


def loss_mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens lie wholly inside a span; spans and tokens are sorted, spans do not meet."""
    if not spans:
        return np.zeros(len(starts), dtype=bool)
    lo, hi = np.array(spans, dtype=np.int64).T
    k = np.searchsorted(lo, starts, side="right") - 1
    return (k >= 0) & (ends <= hi[np.maximum(k, 0)]) & (ends > starts)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    fields = formatted.split(MARK)
    return [(unescape(fields[k]), unescape(fields[k + 1])) for k in range(1, len(fields) - 1, 3)]


def masked_texts(raw: bytes, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> Iterator[str]:
    """The unescaped text under the mask, a run of touching tokens at a time."""
    a, b = starts[mask], ends[mask]
    if len(a):
        first = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
        last = np.r_[first[1:], len(a)] - 1
        for lo, hi in zip(a[first].tolist(), b[last].tolist(), strict=True):
            yield unescape(raw[lo:hi].decode("utf-8", "surrogatepass"))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def format_conversations(turns: DataFrame, path: str | None = None, segment_chars: int = 1_000_000) -> DataFrame:
    """conv_id, segment, n_turns, formatted, ids, loss_mask, starts, ends (offsets of tokens in the bytes of formatted).

    One shuffle brings the turns of a conversation to one task in order, which it streams through, holding one segment;
    the segments of a conversation follow each other in the same task.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        waiting: list[tuple] = []
        conv, held, size, segment, waits, none_yet = None, [], 0, 0, 0, True

        def encoded() -> pa.RecordBatch:
            ids, masks, starts, ends = [], [], [], []
            for raw, (*_, spans) in zip(encode.encode([x[3] for x in waiting]), waiting, strict=True):
                ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                ends.append(np.cumsum(encode.n_bytes[ids[-1]]))
                starts.append(np.r_[0, ends[-1][:-1]] if len(raw) else ends[-1])
                masks.append(loss_mask(spans, starts[-1], ends[-1]))
            convs, segments, counts, texts, _ = zip(*waiting, strict=True)
            waiting.clear()
            columns = [
                pa.array(convs, id_type),
                pa.array(segments, pa.int32()),
                pa.array(counts, pa.int32()),
                pa.array(texts, pa.string()),
            ]
            columns += [_lists(ids, pa.int32()), _lists(masks, pa.bool_())]
            columns += [_lists([x.astype(np.int32) for x in of], pa.int32()) for of in (starts, ends)]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", *(x.split()[0] for x in SCHEMA.split(", "))])

        def close() -> None:
            nonlocal waits
            formatted, spans = render(held)
            waiting.append((conv, segment, len(held), formatted, spans))
            waits += len(formatted)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if none_yet or c != conv:
                    if held:
                        close()
                    conv, held, size, segment, none_yet = c, [], 0, 0, False
                elif size > segment_chars:
                    close()
                    held, size, segment = [], 0, segment + 1
                held.append((role, text))
                size += len(role) + len(text)
                if waits > min(segment_chars, 1_000_000):
                    waits = 0
                    yield encoded()
        if held:
            close()
        if waiting:
            yield encoded()

    no_null = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = small_arrow(turns).select("conv_id", no_null("role"), no_null("text"), "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, {SCHEMA}")


def digests(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """What the output of format_conversations says when read back: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Stored output is first brought into order, by one shuffle; in_order is for the frame
    that format_conversations has just returned, whose tasks hold each conversation's segments one after the other."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    id_type = to_arrow_type(formatted.schema["conv_id"].dataType)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def flush() -> pa.RecordBatch:
            rows = [(s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]) for s in done]
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
            )

        for batch in batches:
            ids, segments, texts = (batch.column(k).to_pylist() for k in range(3))
            lists = [batch.column(k) for k in (3, 4, 5)]
            flat = [x.values.to_numpy(zero_copy_only=False) for x in lists]
            edges = [x.offsets.to_numpy() for x in lists]
            for k, (conv, segment, text) in enumerate(zip(ids, segments, texts, strict=True)):
                if segment == 0:
                    if state:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                said = parse(text)
                state[1] += len(said)
                state[2].update("".join([f"{role}\n{body}\n" for role, body in said]).encode("utf-8", "surrogatepass"))
                mask, starts, ends = (v[e[k] : e[k + 1]] for v, e in zip(flat, edges, strict=True))
                counted = "".join(masked_texts(text.encode("utf-8", "surrogatepass"), starts, ends, mask))
                state[3] += len(counted)
                state[4].update(counted.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if len(done) > 1_000:
                yield flush()
        if state:
            done.append(state)
        if done:
            yield flush()

    rows = formatted.select("conv_id", "segment", "formatted", "loss_mask", "starts", "ends")
    if not in_order:
        rows = small_arrow(rows).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(run, schema)
