"""Fill-in-middle: a document's lines, or other units, are cut in three, and the middle is moved to the end.

The units of a batch of texts are the ones of one packed bitvector over its bytes (a bit at each byte that ends a unit), with
a directory of the ones before each block of 512 bits. All texts are answered together: the ones between a text's ends give n
(rank), the bytes at which the drawn units end give the cuts (select), and a second bitvector, of the bytes that begin a code
point, turns cuts into characters (rank). Texts stay with Spark: Python sees a text's bytes and returns five numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_arrow

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
CUTS = "n long, low long, high long, prefix_chars long, middle_chars long"
_BLOCK = 8  # words of 64 bits in a block of the directory


class Bits:
    """A packed bitvector with a directory of popcounts, for many questions at once."""

    def __init__(self, flags: np.ndarray):
        raw = np.packbits(flags, bitorder="little")
        padded = np.zeros((len(raw) // (8 * _BLOCK) + 1) * 8 * _BLOCK, dtype=np.uint8)
        padded[: len(raw)] = raw
        self.blocks = padded.view("<u8").reshape(-1, _BLOCK)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones lie before each bit `at`."""
        block, bit = at // (64 * _BLOCK), at % (64 * _BLOCK)
        below = np.clip(bit[:, None] - 64 * np.arange(_BLOCK), 0, 64).astype(np.uint64)
        mask = np.where(below == 64, np.uint64(2**64 - 1), (np.uint64(1) << (below & np.uint64(63))) - np.uint64(1))
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask).sum(axis=1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The bit of the k-th one, counted from 0; k must be below the number of ones."""
        block = np.searchsorted(self.before, k, side="right") - 1
        rest = k - self.before[block]
        upto = np.cumsum(np.bitwise_count(self.blocks[block]), axis=1, dtype=np.int64)
        word = (upto <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(word > 0, np.take_along_axis(upto, np.maximum(word - 1, 0)[:, None], axis=1)[:, 0], 0)
        one = np.unpackbits(self.blocks[block, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = (np.cumsum(one, axis=1, dtype=np.int64) <= rest[:, None]).sum(axis=1)
        return block * 64 * _BLOCK + word * 64 + inside


def cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """n, bytes to the first and to the second cut, and code points in the prefix and in the middle, of each text.
    A cut lies behind hash % (n + 1) units."""
    texts = texts.cast(pa.large_binary())
    n_rows = len(texts)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n_rows + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    closes = raw == 10
    closes[ends[1:][ends[1:] > ends[:-1]] - 1] = True  # what follows the last newline is a unit too
    units, points = Bits(closes), Bits((raw & 0xC0) != 0x80)
    rank = units.rank(ends)
    n = np.diff(rank)
    a, b = first % (n + 1), second % (n + 1)
    found = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        at = ends[:-1].copy()
        some = np.flatnonzero(k)
        if len(some):
            at[some] = units.select(rank[:-1][some] + k[some] - 1) + 1
        found.append(at)
    low, high = found
    chars = [points.rank(x) for x in (ends[:-1], low, high)]
    return [n, low - ends[:-1], high - ends[:-1], chars[1] - chars[0], chars[2] - chars[1]]


def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, first, second in batches:
        columns = cuts(texts, *(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (first, second)))
        names = ["n", "low", "high", "prefix_chars", "middle_chars"]
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """doc_id, n (lines), form ('plain', 'psm' or 'spm'), prefix_chars, middle_chars (null where plain), output of every
    document: `rate` per cent are transformed, `spm` per cent of these with the suffix first, all drawn from the sha256
    of seed and doc_id. restored() gives the text back.

    A document stays plain where its text is null (taken as empty), empty or holds a mark. A text of one line may have
    empty parts. Null doc_ids draw as the empty string does, rows that repeat a doc_id draw alike. An empty table gives
    none; other columns are ignored. One narrow pass without shuffle; a text is a value of one row, whatever its length.
    """
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = small_arrow(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), draw.alias("draw"))
    h = [F.conv(F.substring("draw", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    held = F.lit(False)
    for mark in MARKS:
        held |= F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | held | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    cut = rows.select("doc_id", "text", form.alias("form"), F.arrow_udf(_cuts, CUTS)("text", h[0], h[1]).alias("cut"))
    raw = F.col("text").cast("binary")
    low, high = F.col("cut.low").cast("int"), F.col("cut.high").cast("int")
    prefix = F.substring(raw, F.lit(1), low).cast("string")
    middle = F.substring(raw, low + 1, high - low).cast("string")
    suffix = F.substring(raw, high + 1, F.octet_length("text")).cast("string")
    p, s, m = map(F.lit, MARKS)
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    moved = F.col("form") != "plain"
    return cut.select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(moved, F.col("cut.prefix_chars")).alias("prefix_chars"),
        F.when(moved, F.col("cut.middle_chars")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(form: Column, output: Column) -> Column:
    """The text of a document from its form and output alone. No mark can arise across a part's end, since each begins with
    '<' and ends with '>', so the three found are those that were written."""
    parts = F.split(output, "|".join(MARKS))
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
