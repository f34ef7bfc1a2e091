"""Words of whole texts as 64-bit hashes, in NumPy arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes that end a word: space and \x09-\x0d.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte, and the base of the words' polynomials.
_CODES = np.random.default_rng(21).integers(0, 2**63, size=256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
#: Bytes looked at together; a longer word is not cut.
_CHUNK = 1 << 18


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    inverse = np.full(n, np.uint64(pow(_BASE, -1, 2**64)))
    base = np.full(n, np.uint64(_BASE))
    base[:1] = inverse[:1] = 1
    return np.cumprod(base), np.cumprod(inverse)


def _hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the bytes, and where it starts. A word's hash is the polynomial of its bytes' codes, as a
    difference of running sums, stirred with its length."""
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    first, end = edge[::2], edge[1::2]
    power, inverse = _powers(1 << max(18, (len(raw) - 1).bit_length()))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(np.multiply(_CODES[raw], power[: len(raw)]), out=sums[1:])
    return mixed((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64)), first


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts one after the other, and where each text's words start (one more entry than
    texts). Words are runs of bytes other than space and \x09-\x0d."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    hashes, places, start = [], [], 0
    while start < len(raw):
        end = start + _CHUNK
        while end < len(raw) and not _BLANK[raw[end - 1]]:  # on to the end of a word
            step = np.flatnonzero(_BLANK[raw[end : end + _CHUNK]])
            end += int(step[0]) + 1 if len(step) else _CHUNK
        h, first = _hashes(raw[start:end])
        hashes.append(h)
        places.append(first + start)
        start = end
    flat = np.concatenate(hashes)
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
    return flat, np.searchsorted(np.concatenate(places), begins).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """The hashes, stirred so that every bit depends on every bit (multipliers of a common 64-bit finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def grams(flat: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """The hash of the n words from each place on (len(flat) - n + 1 entries; they run over the ends of texts)."""
    count = len(flat) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    # prefix hashes of doubling length: n words in log n steps
    odd = np.random.default_rng(seed).integers(1, 2**63, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    power, size, out, done = flat, 1, None, 0
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            piece = power[done : done + count]
            out = piece.copy() if out is None else mixed(out * odd[bit] + piece)
            done += size
        if size * 2 <= n:
            power = mixed(power[: len(power) - size] * odd[bit + 8] + power[size:])
            size *= 2
    return out
