"""Removing passages that repeat, through a suffix tree that is partitioned by prefixes of varying length.

A window is `window` consecutive words of one document; a word goes if any window that covers it starts anywhere else
too. Equal windows are suffixes with a common prefix of that length: an internal node of the suffix tree, that deep.

Suffixes: of each window only the suffix at its anchor is put into the tree, the leftmost place whose `prefix` words hash
least. Equal windows have equal anchors at equal places, so no repeat is lost, and anchors are few (2 in 29 words for 35
and 8). Windows in a row with one anchor are a run, the tree's edge down from the anchor's prefix.

Partitioning: suffixes are counted by the prefix at the anchor. Alone, it is a leaf and nothing repeats there. Equal
suffixes are folded into one with a multiplicity: if there is more than one, every window on it repeats (an edge that does
not branch), and one of them stands for all below a prefix that does branch. What is left below a branching prefix is a
subtree. While a subtree has more than SUBTREE runs, its prefix is lengthened: its windows are counted by their first 12,
18, 26 words (of PREFIXES), until each group fits; one that still does not fit at the whole window is a node by itself.

Subtrees are built in memory, many to a task: all suffixes of their runs are sorted, with the length of the prefix that
each shares with the next (LCP), and an interval of neighbours that share `window` words or more is an internal node as
deep as a window: all its suffixes repeat. Counts are pre-aggregated, and a subtree has at most SUBTREE runs, so a prefix
that a third of all documents share is no group in any task's memory.

Null and empty texts have no words and stay as they are (null becomes empty). Repeated rows repeat each other's windows.
What is kept is joined by single spaces. Very long texts are read whole, one at a time; an empty table gives none. Words
are compared by 64-bit hashes, runs by 128 with prefix; a document is known between steps by a 64-bit hash of its doc_id
and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_arrow, small_batches, tidy, written
from .words import grams, hashed_words, mixed

WINDOW, PREFIX = 35, 8
#: The longer prefixes that a large subtree is split by, one after the other.
PREFIXES = (12, 18, 26)
#: What is to be done with a run: it repeats whole; its windows are to be looked at; both.
WHOLE, SPLIT, BOTH = 1, 2, 3
#: Runs up to which the subtree below a prefix is built in memory, and runs that a task builds at once.
SUBTREE, AT_ONCE = 1_024, 4_096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def runs(texts: list[bytes], window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Of all runs: text, hash of the anchor's prefix, hash of the run, first window, number of further windows."""
    flat, starts = hashed_words(texts)
    n = len(flat) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    of_gram = grams(flat, prefix)
    width = window - prefix + 1
    seen = np.lib.stride_tricks.sliding_window_view(of_gram, width)
    # in slices: argmin copies what it looks at
    anchor = np.arange(n) + np.concatenate([seen[k : k + 20_000].argmin(axis=1) for k in range(0, n, 20_000)])
    text = np.repeat(np.arange(len(texts)), np.diff(starts))[:n]
    start = np.flatnonzero(np.arange(n) + window <= starts[text + 1])
    if not len(start):
        return (np.zeros(0, np.int64),) * 5
    new = np.r_[True, (anchor[start[1:]] != anchor[start[:-1]]) | (start[1:] != start[:-1] + 1)]
    first = start[new]
    last = start[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]
    power = np.cumprod(np.full(len(flat), _BASE))
    back = np.cumprod(np.full(len(flat), _INVERSE))
    sums = np.r_[np.uint64(0), np.cumsum(flat * power)]
    run = mixed((sums[last + window] - sums[first]) * back[first])
    run = mixed(
        run + (anchor[first] - first).astype(np.uint64) * np.uint64(1_000_003) + (last - first).astype(np.uint64)
    )
    which = text[first]
    return which, of_gram[anchor[first]].view(np.int64), run.view(np.int64), first - starts[which], last - first


def packed(first, more, kind):
    """A run and what to do with it in one number (arrays or columns); 4 is added to the kind of a run in a large subtree."""
    return first * 2048 + more * 8 + kind


def unpacked(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return code // 2048, code // 8 % 256, code % 4, code // 4 % 2


def suffix_order(words: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their first words (as many as `window` at least), and how many words each shares with
    the next (up to that many). `left` says how many words a suffix has before its run ends.

    Suffixes are ranked by prefixes of 1, 2, 4 ... words, each rank from two of the one before; the shared length is found
    from the ranks, the longest first.
    """
    ranks, depth = [np.unique(words, return_inverse=True)[1].astype(np.int64)], 1
    while depth < window:
        rank = ranks[-1]
        pair = rank * (len(rank) + 1)
        more = np.flatnonzero(left > depth)
        pair[more] += rank[more + depth] + 1
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        depth *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    room, shared = np.minimum(left[a], left[b]), np.zeros(len(a), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        fits = np.flatnonzero(shared + (1 << k) <= room)
        same = fits[ranks[k][a[fits] + shared[fits]] == ranks[k][b[fits] + shared[fits]]]
        shared[same] += 1 << k
    return order, shared


def deep_nodes(words: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Where a suffix of the runs (their words one after the other, ends behind each) shares `window` words with another:
    it lies in an interval of the order whose neighbours all do."""
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(len(words))  # words to the end of the run
    order, shared = suffix_order(words, left, window)
    deep = shared >= window
    found = np.zeros(len(words), dtype=bool)
    found[order[:-1][deep]] = True
    found[order[1:][deep]] = True
    return found


def covered(n_words: int, first: np.ndarray, more: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in windows first .. first + more."""
    edges = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + more + window, -1)
    return np.cumsum(edges[:-1]) > 0


def _steps(heads: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices (start, length) of sorted heads, of about `most` rows, none of which cuts a head in two."""
    start = 0
    while start < len(heads):
        end = len(heads) if start + most >= len(heads) else int(np.searchsorted(heads, heads[start + most]))
        if end <= start:
            end = int(np.searchsorted(heads, heads[start], side="right"))
        yield start, end - start
        start = end


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """The columns of docs, its text without the repeats, then n_words (before) and n_removed.

    docs needs doc_id and text; columns that bear the new names are replaced.
    """
    if not 1 <= prefix <= window <= 200:
        raise ValueError("1 <= prefix <= window <= 200")
    docs = small_arrow(docs).drop("n_words", "n_removed")
    names = [f"_{k}" for k in range(len(docs.columns))]
    at = docs.columns.index("text")
    source = docs.withColumn("text", F.coalesce("text", F.lit("")).cast("binary")).toDF(*names)
    source = source.withColumn("uid", F.xxhash64(names[docs.columns.index("doc_id")], names[at]))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 1_000_000):
            uid, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            text, head, run, first, more = runs(texts, window, prefix)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid[text]),
                    pa.array(head),
                    pa.array(run),
                    pa.array(first.astype(np.int32)),
                    pa.array(more.astype(np.int32)),
                ],
                names=["uid", "head", "run", "first", "more"],
            )

    every = written(
        source.select("uid", names[at]).mapInArrow(anchors, "uid long, head long, run long, first int, more int"),
        "suffix-anchors",
    )
    # the short prefixes that several suffixes have, and whether the tree branches below them
    heads = every.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("lo"), F.max("run").alias("hi"))
    heads = written(
        heads.filter("n > 1").select("head", (F.col("lo") != F.col("hi")).alias("branches")), "suffix-prefixes"
    )
    shared = written(
        every.join(heads, "head").select(
            "uid", "head", "run", F.col("first").cast("long").alias("first"), "more", "branches"
        ),
        "suffix-shared",
    )
    branching = shared.filter("branches")
    edges = written(
        branching.groupBy("head", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "first")).alias("one")),
        "suffix-edges",
    )
    large = written(
        edges.groupBy("head").agg(F.count(F.lit(1)).alias("_runs")).filter(F.col("_runs") > SUBTREE).select(
            "head", F.lit(4).alias("_large")
        ),
        "suffix-large",
    )
    is_one = (F.col("one.uid") == F.col("uid")) & (F.col("one.first") == F.col("first"))
    kind = F.when(F.col("n") == 1, SPLIT).when(is_one, BOTH).otherwise(WHOLE) + F.coalesce("_large", F.lit(0))
    code = lambda k: packed(F.col("first"), F.col("more"), k).alias("code")
    todo = shared.filter("NOT branches").select("uid", code(F.lit(WHOLE))).union(
        branching.join(edges, ["head", "run"]).join(large, "head", "left").select("uid", code(kind))
    )
    # a set: rows that repeat a document have its codes too; written, so that the join below has two plain shuffles
    todo = written(todo.groupBy("uid").agg(F.collect_set("code").alias("codes")), "suffix-codes")

    def codes_of(column: pa.Array) -> list[np.ndarray]:
        return [np.zeros(0, np.int64) if x is None else np.asarray(x, dtype=np.int64) for x in column.to_pylist()]

    def cut(words: list[bytes], gone: np.ndarray) -> bytes:
        return b" ".join([words[k] for k in np.flatnonzero(~gone)] if gone.any() else words)

    branch = pa.struct(
        [
            ("head", pa.int64()),
            ("first", pa.int64()),
            ("more", pa.int64()),
            ("one", pa.bool_()),
            ("large", pa.bool_()),
            ("words", pa.binary()),
        ]
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Finishes documents whose runs are all decided; of the others, the runs for subtrees."""
        for batch in small_batches(batches, at, 4_000_000):
            texts, codes = batch.column(at).to_pylist(), codes_of(batch.column(len(names) + 1))
            kept, n_words, n_removed, open_codes, branches = [], [], [], [], []
            for text, code in zip(texts, codes, strict=True):
                words = text.split()
                first, more, what, large = unpacked(code)
                n_words.append(len(words))
                undecided = what >= SPLIT
                if undecided.any():
                    flat, _ = hashed_words([text])
                    of_gram = grams(flat, prefix)
                    rows = zip(*(x[undecided].tolist() for x in (first, more, what, large)), strict=True)
                    anchor = lambda i: int(of_gram[i : i + window - prefix + 1].min().view(np.int64))
                    branches.append(
                        [
                            (anchor(i), i, m, w == BOTH, lg == 1, flat[i : i + m + window].tobytes())
                            for i, m, w, lg in rows
                        ]
                    )
                    kept.append(text)
                    n_removed.append(0)
                    open_codes.append(code[what != SPLIT].tolist())
                else:
                    gone = covered(len(words), first, more, window)
                    kept.append(cut(words, gone))
                    n_removed.append(int(gone.sum()))
                    for x in (open_codes, branches):
                        x.append(None)
            extra = [
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(open_codes, pa.list_(pa.int64())),
                pa.array(branches, pa.list_(branch)),
            ]
            columns = [
                *batch.columns[:at], pa.array(kept, pa.binary()), *batch.columns[at + 1 : len(names) + 1], *extra
            ]
            yield pa.RecordBatch.from_arrays(
                columns, names=[*names, "uid", "n_words", "n_removed", "codes", "branches"]
            )

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (head, uid, first, words) sorted by head; a subtree is never cut."""
        held, n = [], 0

        def build(table: pa.Table) -> pa.RecordBatch:
            runs_words = [np.frombuffer(x, dtype=np.uint64) for x in table["words"].to_pylist()]
            ends = np.cumsum([len(x) for x in runs_words])
            deep = np.flatnonzero(deep_nodes(np.concatenate(runs_words), ends, window))
            which = np.searchsorted(ends, deep, side="right")
            place = table["first"].to_numpy()[which] + deep - np.r_[0, ends][which]
            return pa.RecordBatch.from_arrays(
                [pa.array(table["uid"].to_numpy()[which]), pa.array(packed(place, 0, WHOLE))], names=["uid", "code"]
            )

        for batch in batches:
            held, n = [*held, batch], n + len(batch)
            if n >= AT_ONCE:
                table = pa.Table.from_batches(held)
                heads = table["head"].to_numpy()
                full = int(np.searchsorted(heads, heads[-1]))  # the last head may go on
                for a in _steps(heads[:full], AT_ONCE):
                    yield build(table.slice(*a))
                held = table.slice(full).to_batches()
                n = len(table) - full
        if n:
            table = pa.Table.from_batches(held)
            for a in _steps(table["head"].to_numpy(), AT_ONCE):
                yield build(table.slice(*a))
        tidy()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at, 4_000_000):
            kept, n_removed = [], []
            for text, code, more_code in zip(
                batch.column(at).to_pylist(),
                codes_of(batch.column(len(names) + 1)),
                codes_of(batch.column(len(names) + 2)),
                strict=True,
            ):
                words = text.split()
                first, more, _, _ = unpacked(np.concatenate([code, more_code]))
                gone = covered(len(words), first, more, window)
                kept.append(cut(words, gone))
                n_removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:at],
                    pa.array(kept, pa.binary()),
                    *batch.columns[at + 1 : len(names)],
                    batch.column(len(names)),
                    pa.array(n_removed, pa.int64()),
                ],
                names=[*names, "n_words", "n_removed"],
            )

    base = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, source.schema, strict=False))
    met = source.join(todo, "uid", "left").select(*names, "uid", "codes")
    more_columns = (
        "codes array<long>, branches "
        "array<struct<head:long,first:long,more:long,one:boolean,large:boolean,words:binary>>"
    )
    state = written(
        met.mapInArrow(split, f"{base}, uid long, n_words long, n_removed long, {more_columns}"), "suffix-documents"
    )
    waiting = state.filter("codes IS NOT NULL")
    branches = waiting.select("uid", F.explode("branches").alias("b")).select("uid", "b.*")
    # what stands for several runs comes once for each row that repeats its document: one is enough
    branches = branches.filter("NOT one").union(branches.filter("one").dropDuplicates(["head", "uid", "first"]))
    groups = branches.filter("NOT large").select("head", "uid", "first", "words")
    # large subtrees: windows by longer and longer prefixes, as bytes of their words
    windows = branches.filter("large").select(
        "uid", "first", "words", F.explode(F.sequence(F.lit(0), F.col("more").cast("int"))).alias("k")
    )
    start = F.col("k") * 8 + 1
    windows = windows.select(
        "uid",
        (F.col("first") + F.col("k")).alias("first"),
        F.col("words").substr(start, F.lit(8 * window)).alias("words"),
    )
    windows = written(windows, "suffix-windows")
    for length in [x for x in PREFIXES if prefix < x < window]:
        if windows.isEmpty():
            break
        key = windows.withColumn("prefix", F.substring("words", 1, 8 * length))
        sizes = written(key.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix-prefixes")
        key = key.join(sizes, "prefix")
        groups = groups.unionByName(
            key.filter(F.col("n") <= SUBTREE).select(F.xxhash64("prefix").alias("head"), "uid", "first", "words")
        )
        windows = written(key.filter(F.col("n") > SUBTREE).select("uid", "first", "words"), "suffix-windows")
    in_trees = groups.repartition("head").sortWithinPartitions("head").mapInArrow(subtrees, "uid long, code long")
    nodes = written(
        windows.groupBy("words").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("words"), "suffix-nodes"
    )
    in_large = windows.join(nodes, "words").select("uid", packed(F.col("first"), F.lit(0), F.lit(WHOLE)).alias("code"))
    found = in_trees.union(in_large).groupBy("uid").agg(F.collect_set("code").alias("found"))
    late = waiting.select(*names, "uid", "n_words", "codes").join(found, "uid", "left").select(
        *names, "codes", "found", "n_words"
    )
    late = late.select(*names, "n_words", "codes", "found").mapInArrow(finish, f"{base}, n_words long, n_removed long")
    early = state.filter("codes IS NULL").select(*names, "n_words", "n_removed")
    out = early.unionByName(late)
    return out.select(
        *[
            F.col(n).cast("string" if c == "text" else docs.schema[c].dataType).alias(c)
            for n, c in zip(names, docs.columns, strict=True)
        ],
        "n_words",
        "n_removed",
    )
