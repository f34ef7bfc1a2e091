"""Hashed byte-trigram counts of whole texts, as NumPy rows."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Fixed odd multipliers of the hash.
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def trigram_counts(text: bytes, bits: int, lower: bool = False) -> np.ndarray:
    """How often each of 2^bits hashed byte trigrams occurs; two spaces are put behind the text."""
    raw = np.frombuffer(text + b"  ", dtype=np.uint8)
    b = (_LOWER[raw] if lower else raw).astype(np.uint32)
    a1, a2, a3, a4 = map(np.uint32, _MULTIPLIERS)
    codes = ((b[:-2] * a1 + b[1:-1] * a2 + b[2:] * a3) * a4) >> np.uint32(32 - bits)
    return np.bincount(codes, minlength=1 << bits)


#: Parts of a text's style, each between 0 and 1.
N_STYLE = 3


def style(text: bytes) -> tuple[float, float, float]:
    """Shares of words that repeat the word before, of words seen before in the text, and of upper-case letters."""
    words = text.split()
    if not words:
        return 0.0, 0.0, 0.0
    again = sum(map(bytes.__eq__, words[1:], words))
    b = np.frombuffer(text, dtype=np.uint8)
    return again / len(words), 1 - len(set(words)) / len(words), float(((b >= 65) & (b <= 90)).mean())


def log_counts(texts: list[bytes], bits: int, lower: bool = False, more: int = 0) -> np.ndarray:
    """log(1 + count), a row of floats for each text, with room for `more` features behind."""
    out = np.zeros((len(texts), (1 << bits) + more), dtype=np.float32)
    for k, text in enumerate(texts):
        out[k, : 1 << bits] = trigram_counts(text, bits, lower)
    return np.log1p(out, out=out)


def packed(counts: np.ndarray) -> bytes:
    """The cells that are not zero and their counts, as they travel to where a model is fitted (at most 2^16 cells)."""
    cells = np.flatnonzero(counts)
    return cells.astype("<u2").tobytes() + counts[cells].astype("<u4").tobytes()


def log_counts_of(rows: list[bytes], bits: int, more: int = 0) -> np.ndarray:
    """What log_counts gives for the texts that were packed."""
    out = np.zeros((len(rows), (1 << bits) + more), dtype=np.float32)
    for k, row in enumerate(rows):
        n = len(row) // 6
        out[k, np.frombuffer(row, "<u2", n)] = np.frombuffer(row, "<u4", n, 2 * n)
    return np.log1p(out, out=out)


def to_unit(rows: np.ndarray) -> np.ndarray:
    """The rows, scaled to length 1 in place (zero rows stay)."""
    lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    rows /= np.maximum(lengths, 1e-9)[:, None]
    return rows
