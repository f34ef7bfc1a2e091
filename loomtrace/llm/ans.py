"""A static range asymmetric numeral system over token ids, in NumPy.

Every id of the alphabet has a share of 2^20 slots, at least one. A block is coded in `lanes` interleaved states of 64 bits
that take turns: token t belongs to lane t % lanes, and all lanes write to one list of 32-bit words, in the order in which
decoding wants them. Every `every` steps a block keeps a checkpoint: the lanes' states, how many words lie before, and the
crc32 of the ids up to the next one. So any stretch is decoded, and proven, on its own; many stretches go side by side.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

SCALE = 20
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)
_MAGIC, _HEAD = b"lans\x01\x00\x00\x00", struct.Struct("<8sIIIII")


class Table:
    """Shares of the ids: freq adds up to 2^SCALE."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, dtype=np.uint64)
        if int(self.freq.sum()) != 1 << SCALE or not self.freq.all():
            raise ValueError("shares must be positive and add up to all slots")
        self.first = np.cumsum(self.freq) - self.freq
        self.pad = int(self.freq.argmax())
        self.id_of = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    @classmethod
    def of_counts(cls, counts: dict[int, int], size: int) -> Table:
        """One slot for each of `size` ids, the others by count, what rounding leaves to the most frequent id."""
        if size > 1 << (SCALE - 1):
            raise ValueError(f"at most {1 << (SCALE - 1)} ids fit into the table")
        free, total = (1 << SCALE) - size, sum(counts.values())
        freq = np.ones(size, dtype=np.int64)
        for i, n in counts.items():
            freq[i] += n * free // total  # whole numbers of any size
        freq[max(counts, key=lambda i: (counts[i], -i)) if counts else 0] += (1 << SCALE) - int(freq.sum())
        return cls(freq)


def encode(table: Table, blocks: np.ndarray, every: int) -> list[bytes]:
    """The payloads of blocks of equal size, an array (blocks, steps, lanes) of ids; see split() for what may be padding."""
    n_blocks, steps, lanes = blocks.shape
    state = np.full((n_blocks, lanes), _LOW)
    out, spilled = np.zeros(blocks.shape, dtype=np.uint32), np.zeros(blocks.shape, dtype=bool)
    marks = np.zeros((-(-steps // every), n_blocks, lanes), dtype="<u8")
    for s in range(steps - 1, -1, -1):
        ids = blocks[:, s].astype(np.int64)
        share = table.freq.take(ids)
        full = state >= share << np.uint64(63 - SCALE)
        out[:, s], spilled[:, s] = state.astype(np.uint32), full
        state = np.where(full, state >> _WORD, state)
        turn = state // share
        state = (turn << np.uint64(SCALE)) + (state - turn * share) + table.first.take(ids)
        if s % every == 0:
            marks[s // every] = state
    return [_packed(out[b][spilled[b]], spilled[b], marks[:, b], every) for b in range(n_blocks)]


def _packed(words: np.ndarray, spilled: np.ndarray, states: np.ndarray, every: int) -> tuple:
    upto = np.concatenate([[0], np.cumsum(spilled.sum(axis=1))])[: len(spilled) : every]
    return words.astype("<u4"), states, upto.astype("<u4")


def split(table: Table, ids: np.ndarray, lanes: int, every: int, size: int) -> list[tuple[int, bytes]]:
    """(number of ids, payload) of each block of `size` ids, the last one shorter. size is a multiple of lanes; a last step
    that is not full is padded with the most frequent id, which readers cut off."""
    whole = len(ids) // size
    out = []
    for part in (ids[: whole * size].reshape(whole, size), ids[whole * size :][None]):
        n = part.shape[1]
        if not part.size:
            continue
        steps = -(-n // lanes)
        filled = np.full((len(part), steps * lanes), table.pad, dtype=np.uint32)
        filled[:, :n] = part
        for row, (words, states, upto) in zip(part, encode(table, filled.reshape(len(part), steps, lanes), every), strict=True):
            raw = np.ascontiguousarray(row, dtype="<u4").tobytes()
            sums = [zlib.crc32(raw[k : k + 4 * every * lanes]) for k in range(0, len(raw), 4 * every * lanes)]
            body = b"".join(
                [
                    _HEAD.pack(_MAGIC, lanes, every, n, len(words), len(states)),
                    upto.tobytes(),
                    np.array(sums, dtype="<u4").tobytes(),
                    states.tobytes(),
                    words.tobytes(),
                ]
            )
            out.append((n, body + struct.pack("<I", zlib.crc32(body))))
    return out


@dataclass
class Stretch:
    """What lies between two checkpoints: its place among the block's ids, how many, and what decoding needs."""

    first: int
    n: int
    lanes: int
    states: np.ndarray
    words: np.ndarray
    crc: int


def stretches(payload: bytes, first: int = 0, end: int | None = None) -> list[Stretch]:
    """The stretches of a block that hold any of the ids first to end; raises ValueError where the payload is damaged."""
    if len(payload) < _HEAD.size + 4 or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("block does not match its checksum")
    magic, lanes, every, n, n_words, n_marks = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a block of this format")
    at = _HEAD.size
    upto = np.frombuffer(payload, "<u4", n_marks, at).tolist()
    sums = np.frombuffer(payload, "<u4", n_marks, at + 4 * n_marks).tolist()
    states = np.frombuffer(payload, "<u8", n_marks * lanes, at + 8 * n_marks).reshape(n_marks, lanes)
    words = np.frombuffer(payload, "<u4", n_words, at + 8 * n_marks + 8 * n_marks * lanes)
    size = every * lanes
    low, high = first // size, -(-min(n if end is None else end, n) // size)
    cut = [*upto, n_words]
    return [
        Stretch(k * size, min(size, n - k * size), lanes, states[k], words[cut[k] : cut[k + 1]], sums[k])
        for k in range(low, high)
    ]


def decode(table: Table, parts: list[Stretch]) -> list[np.ndarray]:
    """The ids of each stretch; raises ValueError where they do not match their checksum."""
    out: list[np.ndarray] = [None] * len(parts)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, p in enumerate(parts):
        groups.setdefault((-(-p.n // p.lanes), p.lanes), []).append(k)
    for (steps, lanes), members in groups.items():
        for k, ids in zip(members, _side_by_side(table, [parts[k] for k in members], steps, lanes), strict=True):
            out[k] = ids[: parts[k].n]
            if zlib.crc32(out[k].tobytes()) != parts[k].crc:
                raise ValueError("ids do not match their checksum")
    return out


def _side_by_side(table: Table, parts: list[Stretch], steps: int, lanes: int) -> np.ndarray:
    n = len(parts)
    state = np.concatenate([p.states for p in parts]).astype(np.uint64)
    sizes = [len(p.words) for p in parts]
    words = np.concatenate([p.words for p in parts]).astype(np.uint64)
    at = (np.cumsum(sizes) - sizes).astype(np.int64)
    row_of = np.repeat(np.arange(n), lanes)
    ids = np.zeros((steps, n * lanes), dtype="<u4")
    mask, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for s in range(steps):
        slot = (state & mask).astype(np.int64)
        one = table.id_of.take(slot).astype(np.int64)
        ids[s] = one
        state >>= shift
        state *= table.freq.take(one)
        state += slot.view(np.uint64)
        state -= table.first.take(one)
        low = np.flatnonzero(state < _LOW)
        if len(low):
            row = row_of.take(low)
            taken = np.bincount(row, minlength=n)
            step = at - (np.cumsum(taken) - taken)
            state[low] = state.take(low) << _WORD | words.take(step.take(row) + np.arange(len(low)))
            at += taken
    return ids.reshape(steps, n, lanes).transpose(1, 0, 2).reshape(n, -1)


def shifted(crc: int, n_bytes: int) -> int:
    """What crc32 gives for a text's part that n_bytes follow: the crc32 of a text is the exclusive or of its parts' shifted
    ones, in any order."""
    power, square = 1 << 31, 1 << 23  # 1 and x^8 as reflected polynomials
    while n_bytes:
        if n_bytes & 1:
            power = _product(power, square)
        square, n_bytes = _product(square, square), n_bytes >> 1
    return _product(power, crc)


def _product(a: int, b: int) -> int:
    """a times b modulo the polynomial of crc32; the highest bit is the constant term."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out
