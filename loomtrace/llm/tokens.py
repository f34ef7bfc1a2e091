"""Encoding with the public byte-level BPE.

Where a text may be cut: the tokenizer first splits a text, left to right, by a pattern whose alternatives are a
contraction, one optional space and letters, the same with digits, the same with anything else that is not white space,
and white space only. Its next piece depends on nothing before it. So there is a boundary, whatever surrounds it,
(a) where white space follows something else, (b) where a full stop or comma follows a letter or digit, and (c) behind a
newline that stands alone between two characters that are not white space. A special token holds none of these places.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BYTE_BPE = "byte_bpe_50k.json"
#: Chunks between such places: a lone newline; a word of letters and digits before (a), (b) or the end; else all up to (a).
#: \x1c-\x1f are white space to Python only, so no chunk but a plain word ends before them.
_CHUNK = re.compile(r"\n(?!\s)|\s*+[^\W_]++(?=[.,\s]|\Z)|\s*+\S++(?:[\x1c-\x1f]\s*+\S*+)*+|\s+")
#: A proven boundary: not white space before it, white space of the tokenizer's own pattern behind it.
SAFE_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")


@lru_cache(maxsize=4)
def tokenizer(path: str | None = None):
    """The tokenizer of this Python worker."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(BYTE_BPE))


class Encoder:
    """Token ids of whole texts, encoding each distinct chunk (see _CHUNK) once while it is remembered.

    The memory is bounded: beyond `limit` chunks it starts anew with those of the texts at hand. New chunks of a batch are
    joined and encoded as one text, which the proof above allows, and told apart by the bytes that their tokens stand for.
    """

    def __init__(self, path: str | None = None, limit: int = 600_000):
        self.tok, self.limit, self.memo = tokenizer(path), limit, {}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        for token, i in vocab.items():
            self.n_bytes[i] = len(token.encode()) if token in special else len(token)

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks put one after the other; those that begin with no white space have a lone newline before them."""
        spaced = [x for x in chunks if x[0] in " \t\n\r"]
        bare = [x for x in chunks if x[0] not in " \t\n\r"]
        for mark, group in (("", spaced), ("\n", bare)):
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                text = mark + mark.join(part)
                ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
                sizes = np.fromiter(map(len, map(str.encode, part)), dtype=np.int64, count=len(part)) + len(mark)
                ends = (np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(sizes)) + 1) * 4
                starts = np.r_[0, ends[:-1]] + 4 * len(mark)
                raw = ids.tobytes()
                self.memo.update(zip(part, [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split, known, new = [_CHUNK.findall(x) for x in texts], self.memo.__contains__, set()
        for words in split:
            new.update(filterfalse(known, words))
        if len(self.memo) + len(new) > self.limit:
            self.memo = {x: self.memo[x] for x in set().union(*split) - new}
        joined = [x for x in new if not x[-1].isspace() and (x[0] in " \t\n\r" or not x[0].isspace())]
        self._learn(joined)
        for x in new.difference(joined):
            self.memo[x] = np.array(self.tok.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()
        get = self.memo.__getitem__
        return [b"".join(map(get, words)) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """The encoder of this Python worker: what one task has learned serves the next."""
    return Encoder(path)


WORD_BPE = "word_bpe_49k.json"
#: What the lower-case BPE with word ends makes one piece of, in texts of its plain characters: a contraction, letters, one
#: digit, or other printable characters; white space is dropped.
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
#: Texts with any other character, or with what may begin a special token, are cut at white space only.
_ODD = re.compile(r"[^\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ]|<\|")
_WORD = re.compile(r"[^ \t\n\r]+")


class _Numbers(dict):
    """Numbers for keys in the order in which they are first asked for; `new` holds those not yet looked at."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        number = self[key] = len(self)
        return number


class WordEncoder:
    """Token ids of whole texts by the lower-case BPE with word ends, each distinct piece encoded once while remembered.

    The tokenizer composes, folds white space, lowers, and splits by a pattern no match of which holds white space; no
    composition reaches over white space either. So texts may be cut at white space. Where all characters are plain (their
    composed and lower form is one character each), the pattern itself is applied here, to the lowered text. Other
    tokenizers than this one encode whole texts. Beyond `limit` pieces the memory starts anew.
    """

    def __init__(self, path: str | None = None, limit: int = 700_000):
        import json

        import public_tokenizers

        self.tok, self.limit = tokenizer(path or public_tokenizers.path(WORD_BPE)), limit
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.width = "<u2" if self.size <= 1 << 16 else "<u4"
        self.last = np.zeros(self.size, dtype=bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        said = json.loads(self.tok.to_str())
        steps = [x.get("type") for x in (said["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (said["pre_tokenizer"] or {}).get("pretokenizers", [])]
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.known = steps == ["NFC", "Replace", "Lowercase"] and splits == [known, None]
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.flat, self.ends = _Numbers(), np.zeros(0, dtype=self.width), np.zeros(1, dtype=np.int64)

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, ids.astype(self.width)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def _learn_new(self) -> None:
        """Encodes the new pieces, each a word of the tokenizer, side by side."""
        pieces, self.numbers.new = self.numbers.new, []
        for k in range(0, len(pieces), 20_000):
            part = pieces[k : k + 20_000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                raise RuntimeError("a piece is not one word of the tokenizer")
            self._add(ids, np.diff(ends, prepend=0))

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), dtype=self.width), np.array([len(x) for x in found], dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        if not self.known:
            return self._each(texts)
        if len(self.numbers) > self.limit:
            self._forget()
        odd = {k: _WORD.findall(x) for k, x in enumerate(texts) if _ODD.search(x)}
        unknown = [x for x in set().union(*odd.values()) if x not in self.numbers]
        if unknown:
            self.numbers.update(zip(unknown, range(len(self.numbers), len(self.numbers) + len(unknown)), strict=True))
            self._add(*self._each(unknown))
        number, split, counts = self.numbers.__getitem__, [], []
        for k, x in enumerate(texts):
            words = odd[k] if k in odd else _PIECE.findall(x.lower())
            counts.append(len(words))
            split.append(np.fromiter(map(number, words), dtype=np.int32, count=len(words)))
        self._learn_new()
        numbers = np.concatenate([*split, np.zeros(0, dtype=np.int32)])
        first, sizes = self.ends[numbers], np.diff(self.ends)[numbers]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.cumsum(counts)] if counts else np.zeros(0, dtype=np.int64)
        return flat, np.diff(upto, prepend=0)


@lru_cache(maxsize=2)
def word_encoder(path: str | None = None) -> WordEncoder:
    """The word encoder of this Python worker."""
    return WordEncoder(path)


def in_blocks(texts: list[str], most_chars: int = 4_000_000):
    """Consecutive slices (start, end) of texts with about so many characters each, one text at least."""
    start, size = 0, 0
    for k, x in enumerate(texts):
        if size and size + len(x) > most_chars:
            yield start, k
            start, size = k, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


class Resync:
    """Token counts of long texts from overlapping chunks."""

    def __init__(self, path: str | None = None, chunk: int = 65_536, overlap: int = 1_024):
        self.tok, self.chunk, self.overlap = tokenizer(path), chunk, overlap

    def _encode(self, text: str):
        return self.tok.encode(text, add_special_tokens=False)

    @staticmethod
    def _index(encoding, at: int) -> int | None:
        """The token that starts at character `at`, if one does."""
        k = encoding.char_to_token(at)
        return k if k is not None and encoding.token_to_chars(k)[0] == at else None

    def count(self, text: str) -> int:
        n, base, first, low, total, overlap = len(text), 0, 0, 0, 0, self.overlap
        left = self._encode(text[: self.chunk + overlap])
        while base + self.chunk + overlap < n:
            ahead, end = base + self.chunk, base + self.chunk + overlap
            right = self._encode(text[ahead : ahead + self.chunk + overlap])
            for cut in SAFE_CUT.finditer(text, max(ahead, low + 1), end):
                p = cut.start()
                a, b = self._index(left, p - base), self._index(right, p - ahead)
                if a is not None and b is not None:
                    total, first, low = total + a - first, b, p
                    base, left, overlap = ahead, right, self.overlap
                    break
            else:  # no proven boundary that both have: widen, and encode this chunk again
                overlap *= 2
                left = self._encode(text[base : base + self.chunk + overlap])
                continue
        return total + len(left) - first
