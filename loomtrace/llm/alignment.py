"""Which tokens of two tokenizers share text, counted over a corpus.

Tokenizer A is the byte-level BPE, B the piece BPE with byte fallback, both over a space and the text. Byte offsets where
tokens of both end cut a text into groups; a link is a token of A and one of B in one group whose bytes overlap.

Equal groups have equal links. So groups are interned: every chunk of documents (what one task takes at a time, about
`CHUNK` characters) has a dictionary of its distinct groups, documents hold places in it with counts, and the chunk says of
each linked id pair how many of its documents hold it. Spark adds these up by pair, expands the links of every distinct
group of the corpus once, sums their pairs' counts, joins the sums back to the dictionaries by group, and hands each chunk
its own to add up by document. What is shuffled is a row for each distinct group of a chunk, never one for each token.

Texts are aligned in units that begin at a space behind what is not white space (see Units), each distinct one once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_arrow, small_batches, written
from .tokens import BYTE_BPE

PIECE_BPE = "piece_bpe_32k.model"
#: Characters of a chunk.
CHUNK = 2_000_000
#: " word", up to the next space that something follows; see Units.
_UNIT = re.compile(r" \s*+\S*+(?:(?! .)\s\S*+)*+", re.S)
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


@lru_cache(maxsize=2)
def _tokenizers(a_path: str | None, b_path: str | None):
    """Both tokenizers, and the bytes that each of their ids stands for."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path or public_tokenizers.path(BYTE_BPE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path(PIECE_BPE))
    # the byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in set(shown)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}
    vocab = a.get_vocab(with_added_tokens=False)
    a_bytes = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    b_bytes = [
        bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces
    ]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("tokenizer B has pieces that go on behind a space: texts may not be cut there")
    return a, b, a_bytes, b_bytes


def _links(a_sizes: list[int], b_sizes: list[int]) -> list[tuple[int, int]]:
    """Places of the tokens of one group whose bytes overlap."""
    if len(a_sizes) == 1 or len(b_sizes) == 1:
        return [(i, j) for i in range(len(a_sizes)) for j in range(len(b_sizes))]
    out, i, j, a_end, b_end = [], 0, 0, a_sizes[0], b_sizes[0]
    while True:
        out.append((i, j))
        low = min(a_end, b_end)
        i, j = i + (a_end == low), j + (b_end == low)
        if i == len(a_sizes):
            return out
        a_end, b_end = a_end + (a_end == low and a_sizes[i]), b_end + (b_end == low and b_sizes[j])


def links_of(key: str, a_bytes: list[bytes], b_bytes: list[bytes]) -> list[tuple[int, int]]:
    """The linked id pairs of a group `a1,a2|b1`, as often as they are linked."""
    a, b = (list(map(int, side.split(","))) for side in key.split("|"))
    return [(a[i], b[j]) for i, j in _links([len(a_bytes[x]) for x in a], [len(b_bytes[x]) for x in b])]


class Units:
    """Groups of units of text, remembered up to `limit` units.

    A unit begins at a space behind what is not white space and reaches to the next such space that is not the last
    character. A's pattern has a boundary there; no piece of B goes on behind a space (checked when loaded), and B puts
    the space before a text that a unit begins with. So the tokens of a text are those of its units.
    """

    def __init__(self, a_path: str | None = None, b_path: str | None = None, limit: int = 500_000):
        self.a, self.b, self.a_bytes, self.b_bytes = _tokenizers(a_path, b_path)
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.memo, self.said = {}, []  # unit -> number; the groups of each as text
        self.sizes = np.zeros((0, 4), dtype=np.int64)  # tokens of A, of B, groups, links; -1 where bytes differ
        self.first = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int64)  # the groups of all units
        self.codes, self.keys = {}, []  # group -> number
        self.group_first, self.group_pairs = [0], []
        self.pairs, self.pair_list = {}, []  # id pair -> number

    def _code(self, key: tuple[bytes, bytes]) -> int:
        """Interns a group, and its linked pairs."""
        a, b = (np.frombuffer(x, "<u4").tolist() for x in key)
        code = self.codes[key] = len(self.keys)
        self.keys.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
        places = _links([len(self.a_bytes[x]) for x in a], [len(self.b_bytes[x]) for x in b])
        for pair in dict.fromkeys((a[i], b[j]) for i, j in places):
            if pair not in self.pairs:
                self.pairs[pair] = len(self.pair_list)
                self.pair_list.append(pair)
            self.group_pairs.append(self.pairs[pair])
        self.group_first.append(len(self.group_pairs))
        return code

    def _a_ids(self, units: list[str], plain: int) -> np.ndarray:
        """Ids of A for all units; the first `plain` of them end with what is not white space and go one behind the other."""
        texts = ["".join(units[k : min(k + 20_000, plain)]) for k in range(0, plain, 20_000)] + units[plain:]
        found = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), dtype=np.int64)

    def learn(self, units: list[str]) -> None:
        """Adds units that are not known yet."""
        plain = [x for x in units if not x[-1].isspace()]
        units = plain + [x for x in units if x[-1].isspace()]
        if not units:
            return
        raws = [x.encode() for x in units]
        a = self._a_ids(units, len(plain))
        b_lists = self.b.encode([x[1:] for x in units], num_threads=1)
        b = np.fromiter(chain.from_iterable(b_lists), dtype=np.int64)
        whole = b"".join(raws)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            if len(units) > 1:
                same = [b"".join(map(self.b_bytes.__getitem__, x)) == raw for x, raw in zip(b_lists, raws, strict=True)]
                bad = [x for x, ok in zip(units, same, strict=True) if not ok]
                if bad:
                    self.learn([x for x, ok in zip(units, same, strict=True) if ok])
                    for x in bad:
                        self._add([x], [""], np.full((1, 4), -1), np.zeros(0, dtype=np.int64))
                else:
                    for x in units:
                        self.learn([x])
            else:
                self._add(units, [""], np.full((1, 4), -1), np.zeros(0, dtype=np.int64))
            return
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_upto, b_upto = np.searchsorted(a_ends, cuts) + 1, np.searchsorted(b_ends, cuts) + 1
        a_raw, b_raw = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        i, j = (4 * a_upto).tolist(), (4 * b_upto).tolist()
        groups = [(a_raw[p:q], b_raw[r:t]) for p, q, r, t in zip([0, *i], i, [0, *j], j, strict=False)]
        for g in groups:
            if g not in self.codes:
                self._code(g)
        codes = list(map(self.codes.__getitem__, groups))
        texts = list(map(self.keys.__getitem__, codes))
        ends = np.searchsorted(cuts, np.cumsum([len(x) for x in raws])) + 1
        upto = np.stack([a_upto[ends - 1], b_upto[ends - 1], ends, a_upto[ends - 1] + b_upto[ends - 1] - ends], axis=1)
        said = [";".join(texts[p:q]) for p, q in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        self._add(units, said, np.diff(upto, axis=0, prepend=0), np.array(codes, dtype=np.int64))

    def _add(self, units: list[str], said: list[str], sizes: np.ndarray, codes: np.ndarray) -> None:
        self.memo.update(zip(units, range(len(self.said), len(self.said) + len(units)), strict=True))
        self.said += said
        self.sizes = np.concatenate([self.sizes, sizes])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.maximum(sizes[:, 2], 0))])
        self.flat = np.concatenate([self.flat, codes])

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the units of each text that is not empty. Starts anew where too many are remembered."""
        split, known, new = [_UNIT.findall(" " + x) if x else [] for x in texts], self.memo.__contains__, set()
        for units in split:
            new.update(filterfalse(known, units))
        if len(self.memo) + len(new) > self.limit and self.memo:
            self._forget()
            new = set().union(*split)
        self.learn(list(new))
        get = self.memo.__getitem__
        return [np.fromiter(map(get, units), dtype=np.int64, count=len(units)) for units in split]


@lru_cache(maxsize=2)
def _units(a_path: str | None, b_path: str | None) -> Units:
    """The units of this Python worker."""
    return Units(a_path, b_path)


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places first[k], first[k] + 1, ... (sizes[k] of them) of all k, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def chunk_of(units: Units, texts: list[str]) -> dict:
    """What a chunk keeps of its documents, see align()."""
    numbers = units.numbers(texts)
    # a unit whose bytes differ cannot be made up for by another: B only ever puts other bytes in a character's place
    numbers = [x if len(x) == 0 or units.sizes[x, 0].min() >= 0 else x[:0] for x in numbers]
    n_docs, flat = len(texts), np.concatenate([*numbers, np.zeros(0, dtype=np.int64)])
    doc = np.repeat(np.arange(n_docs), [len(x) for x in numbers])
    sums = np.stack([np.bincount(doc, units.sizes[flat, k], minlength=n_docs) for k in range(4)]).astype(np.int64)
    said = ["" if not len(x) else hashlib.sha256(";".join(map(units.said.__getitem__, x.tolist())).encode()).hexdigest() for x in numbers]
    n_groups = units.sizes[flat, 2]
    codes = units.flat[_spread(units.first[flat], n_groups)]
    n_codes = len(units.keys)
    held, times = np.unique(np.repeat(doc, n_groups) * n_codes + codes, return_counts=True)
    held_doc, held_code = held // n_codes if n_codes else held, held % n_codes if n_codes else held
    own, place = np.unique(held_code, return_inverse=True)
    group_first, group_pairs = np.array(units.group_first), np.array(units.group_pairs, dtype=np.int64)
    n_pairs = np.diff(group_first)[held_code]
    pairs = group_pairs[_spread(group_first[held_code], n_pairs)]
    linked = np.unique(np.repeat(held_doc, n_pairs) * max(1, len(units.pair_list)) + pairs) % max(1, len(units.pair_list))
    pair, pair_docs = np.unique(linked, return_counts=True)
    return {
        "sums": sums,
        "said": said,
        "n_held": np.bincount(held_doc, minlength=n_docs),
        "place": place,
        "times": times,
        "groups": [units.keys[k] for k in own.tolist()],
        "pairs": [units.pair_list[k] for k in pair.tolist()],
        "pair_docs": pair_docs,
    }


_DOCS = ("n_a", "n_b", "n_groups", "n_links", "n_held", "groups_sha256")


def chunks(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, size: int = CHUNK) -> DataFrame:
    """One row per chunk of documents: chunk, docs (array of doc_id, n_a, n_b, n_groups, n_links, n_held, groups_sha256),
    place and times (for each document in turn, n_held places in the chunk's dictionary and how often), groups (the
    dictionary), a, b, pair_docs (linked id pairs and how many of the chunk's documents hold them)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, task, number = _units(a_path, b_path), TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal ids, texts, held, number
            c = chunk_of(units, texts)
            columns = [pa.array(ids, doc_type), *map(pa.array, c["sums"]), pa.array(c["n_held"]), pa.array(c["said"], pa.string())]
            one = pa.StructArray.from_arrays(columns, names=["doc_id", *_DOCS])
            out = [pa.array([task << 32 | number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), one)]
            out += [pa.array([c[k].astype("<i4").tobytes()], pa.binary()) for k in ("place", "times")]
            out.append(pa.array([c["groups"]], pa.list_(pa.string())))
            out += [pa.array([[p[k] for p in c["pairs"]]], pa.list_(pa.int32())) for k in (0, 1)]
            out.append(pa.array([c["pair_docs"].tolist()], pa.list_(pa.int64())))
            ids, texts, held, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays(out, names=["chunk", "docs", "place", "times", "groups", "a", "b", "pair_docs"])

        for batch in small_batches(batches, 1, 1_000_000):
            doc_type = batch.schema.field(0).type
            ids += batch.column(0).to_pylist()
            texts += [x or "" for x in batch.column(1).to_pylist()]
            held += sum(len(x) for x in texts[len(texts) - len(batch) :])
            if held >= size:
                yield close()
        if ids:
            yield close()

    counts = ", ".join(f"{x}: {'string' if x == 'groups_sha256' else 'long'}" for x in _DOCS)
    return small_arrow(docs).select("doc_id", "text").mapInArrow(
        run,
        f"chunk long, docs array<struct<doc_id: {kind}, {counts}>>, place binary, times binary, groups array<string>, "
        "a array<int>, b array<int>, pair_docs array<long>",
    )


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, size: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose id pair is in as many documents as any pair of its A id),
    count_sum (over links: documents that hold the pair linked), groups_sha256 (of `a1,a2|b1;a3|b2,b3`) of every document.

    Strings of special tokens are plain text. Texts that are null, empty, or of which B's tokens give other bytes (it takes
    U+2581 for a space) have no tokens: zeros, and an empty groups_sha256. Rows that repeat are documents each on their
    own; null doc_ids stay. An empty table gives none. Columns beside doc_id and text are ignored. A text is taken whole
    and never split over chunks; a chunk is as large as `size` characters and one text, and what it holds in memory
    follows that.
    """
    stored = written(chunks(docs, a_path, b_path, size), "aligned")
    counted = written(pair_counts(stored), "pair-counts")
    # one row for each id of A at most
    best = F.broadcast(counted.groupBy("a").agg(F.max("n_docs").alias("most")))
    scored = counted.join(best, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).cast("long").alias("best"))
    dictionary = stored.select("chunk", F.posexplode("groups").alias("place", "key"))
    linked = expanded(dictionary.select("key").distinct(), a_path, b_path)
    valued = linked.join(scored, ["a", "b"]).groupBy("key").agg(
        F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"), F.sum(F.col("n") * F.col("best")).alias("n_best")
    )
    back = dictionary.join(valued, "key").select(F.col("chunk").alias("of_chunk"), "place", "count_sum", "n_best")
    kind = stored.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def add_up(chunk: pa.Table, values: pa.Table) -> pa.Table:
        if not len(chunk):
            raise RuntimeError("a dictionary without its chunk")
        docs = chunk.column("docs").combine_chunks().flatten()
        n_held = docs.field("n_held").to_numpy()
        place, times = (np.frombuffer(chunk.column(x)[0].as_py(), "<i4") for x in ("place", "times"))
        order = values.column("place").to_numpy()
        owner = np.repeat(np.arange(len(docs)), n_held)
        sums = []
        for name in ("n_best", "count_sum"):
            value = np.zeros(len(order), dtype=np.int64)
            value[order] = values.column(name).to_numpy()
            total = np.zeros(len(docs), dtype=np.int64)
            np.add.at(total, owner, value[place] * times)
            sums.append(pa.array(total))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        columns = [docs.field(x) for x in names] + sums + [docs.field("groups_sha256")]
        return pa.Table.from_arrays(columns, names=[*names, "n_best", "count_sum", "groups_sha256"])

    return (
        stored.select("chunk", "docs", "place", "times")
        .groupBy("chunk")
        .cogroup(back.groupBy("of_chunk"))
        .applyInArrow(
            add_up,
            f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
        )
    )


def pair_counts(stored: DataFrame) -> DataFrame:
    """a, b, n_docs: how many documents of all chunks hold the id pair linked."""
    pairs = stored.select(F.explode(F.arrays_zip("a", "b", "pair_docs")).alias("x")).select("x.*")
    return pairs.groupBy("a", "b").agg(F.sum("pair_docs").alias("n_docs"))


def expanded(keys: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """key, a, b, n: the linked id pairs of each group, and how often it links them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *_, a_bytes, b_bytes = _tokenizers(a_path, b_path)
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                rows += [(key, a, b, n) for (a, b), n in Counter(links_of(key, a_bytes, b_bytes)).items()]
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "a", "b", "n"]
            )

    return keys.mapInArrow(run, "key string, a int, b int, n long")
