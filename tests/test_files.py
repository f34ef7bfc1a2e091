"""Growing files: states, cursors, truncation, byte offsets over many splits, references, discovery."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from loomtrace.sources import files


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def put(path, raw, at=None):
    path.write_bytes(raw)
    if at is not None:
        os.utime(path, (at, at))


def offsets(raw: bytes):
    out, start = [], 0
    for line in raw.split(b"\n"):
        out.append((start, line))
        start += len(line) + 1
    return out if out[-1][1] else out[:-1]


def test_offsets_over_many_splits(spark, tmp_path, small_splits):
    raw = {}
    for name, body in {
        "a": b"".join(f"line {k} \xc3\xa9".encode("latin-1") * (k % 5) + b"\r\n" for k in range(200)) + b"open end",
        "b": b"\n\n" + "é\U0001f600\n".encode() * 80,
        "c": b"x" * 2_000 + b"\n" + b"y\n",
        "d": b"",
    }.items():
        raw[name] = body
        put(tmp_path / name, body)
    got = files.lines_at(spark, str(tmp_path)).select(
        F.regexp_extract("file", r"/(\w)$", 1).alias("n"), "offset", "size", F.col("value").cast("binary").alias("v")
    ).collect()
    want = sorted((n, at, len(line), line) for n, body in raw.items() if body for at, line in offsets(body))
    assert sorted((r.n, r.offset, r.size, bytes(r.v)) for r in got) == want


def taken(spark, path, cursors):
    changes = files.changed(files.states(spark, path), cursors)
    new = files.tail(spark, changes)
    kinds = {r.file.rsplit("/", 1)[1]: r.change for r in changes.collect()}
    rows = sorted((r.file.rsplit("/", 1)[1], r.offset, r.value) for r in new.collect())
    after = files.advanced(cursors, changes, new).collect()
    return kinds, rows, spark.createDataFrame(after, files.CURSOR)


def test_tails_of_files_that_grow(spark, tmp_path):
    path, none = str(tmp_path), spark.createDataFrame([], files.CURSOR)
    put(tmp_path / "a", b"one\ntwo\nthr", 1_000), put(tmp_path / "b", b"x\n", 1_000), put(tmp_path / "c", b"", 1_000)
    kinds, rows, cursors = taken(spark, path, none)
    assert kinds == {"a": "new", "b": "new"}
    assert rows == [("a", 0, "one"), ("a", 4, "two"), ("b", 0, "x")]
    kinds, rows, cursors = taken(spark, path, cursors)
    assert set(kinds.values()) == {"same"}
    assert rows == []
    # an open line is closed, one file is written anew at the same size, one comes, an empty one goes
    put(tmp_path / "a", b"one\ntwo\nthree\n", 2_000), put(tmp_path / "b", b"y\n", 2_000)
    put(tmp_path / "d", b"new\n", 2_000)
    (tmp_path / "c").unlink()
    kinds, rows, cursors = taken(spark, path, cursors)
    assert kinds == {"a": "grown", "b": "rewritten", "d": "new"}
    assert rows == [("a", 8, "three"), ("b", 0, "y"), ("d", 0, "new")]
    put(tmp_path / "a", b"again\n", 3_000)
    kinds, rows, cursors = taken(spark, path, cursors)
    assert (kinds["a"], rows) == ("rewritten", [("a", 0, "again")])
    assert {r.file.rsplit("/", 1)[1]: r.offset for r in cursors.collect()} == {"a": 6, "b": 2, "d": 4}


def test_too_many_files_are_refused(spark, tmp_path):
    for k in range(3):
        put(tmp_path / f"f{k}", b"x\n")
    changes = files.changed(files.states(spark, str(tmp_path)), spark.createDataFrame([], files.CURSOR))
    with pytest.raises(ValueError, match="by folders"):
        files.tail(spark, changes, most_files=2)


def test_references(spark, tmp_path):
    rows = [{"type": "response_item", "payload": {"call_id": "c1"}}, {"type": "event_msg", "payload": {"item": {"id": "i2"}}}, {"type": "novelty"}]
    raw = b"".join(json.dumps(x).encode() + b"\n" for x in rows) + b"{broken\n" + b'{"type":"long","x":"' + b"z" * 900 + b'"}\n'
    put(tmp_path / "log", raw)
    lines = files.lines_at(spark, str(tmp_path / "log"))
    at = [k for k, _ in offsets(raw)]
    file = lines.first().file
    refs = [
        (at[0], "response_item", "c1", "yes"), (at[0], "event_msg", "c1", "changed"), (at[0], "response_item", "c9", "changed"),
        (at[1], "event_msg", "i2", "yes"), (at[1] + 3, "event_msg", "i2", "missing"), (at[2], "novelty", None, "yes"),
        (at[3], "novelty", None, "changed"), (at[4], "long", None, "too_long"), (10**9, "long", None, "missing"),
    ]
    table = spark.createDataFrame([(file, *r) for r in refs], "file string, offset long, kind string, ident string, want string")
    got = files.found_again(table, lines, most_bytes=500).collect()
    assert all(r.found == r.want for r in got)
    assert all((r.value is not None) == (r.found == "yes") for r in got)
    assert len(got) == len(refs)


def test_discovery_takes_whole_sessions(spark):
    changes = spark.createDataFrame(
        [("main", 10, 5, 10, "same"), ("child", 20, 90, 20, "same"), ("old", 10, 5, 10, "same"), ("grown", 30, 5, 10, "grown"), ("loose", 1, 95, 1, "same")],
        "file string, size long, modified_us long, offset long, change string",
    )
    roots = spark.createDataFrame([("main", "r1"), ("child", "r1"), ("old", "r2"), ("grown", "r3")], "file string, root string")
    got = files.discovered(changes, roots, 80).collect()
    assert sorted((r.root, r.file) for r in got) == [("loose", "loose"), ("r1", "child"), ("r1", "main"), ("r3", "grown")]
