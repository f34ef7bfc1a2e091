"""Log files as they grow: their states, what of them is new, lines with their byte offsets, and lines found again.

File sizes and times come from Spark's own listing, so any store that Spark reads will do; no content is read for them. A
cursor is the byte behind the last complete line taken of a file. Lines end with a line feed; what stands behind the last
one is not a line yet. A carriage return before a line feed belongs to the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .logs import MAX_SPLITS, at
from .stored import stored

#: Bytes of a line beyond which it is not handed out again.
MAX_LINE = 4 << 20
STATE = "file string, size long, modified_us long"
CURSOR = "file string, offset long, size long, modified_us long"


def states(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, size, modified_us of the files under a path (a glob, a folder, or several). Spark lists no empty file: one that
    was emptied keeps its cursor, and is rewritten once it has lines again."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(
        F.col("path").alias("file"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified_us")
    )


def changed(now: DataFrame, cursors: DataFrame) -> DataFrame:
    """file, size, modified_us, offset (where to go on) and change: `new`, `grown`, `rewritten` (shorter than what was taken,
    or of the same size but written since: from the start again), or `same`."""
    old = cursors.select("file", F.col("offset").alias("_at"), F.col("size").alias("_size"), F.col("modified_us").alias("_us"))
    met = now.join(old, "file", "left")
    kind = (
        F.when(F.col("_at").isNull(), "new")
        .when((F.col("size") < F.col("_at")) | (F.col("size") < F.col("_size")), "rewritten")
        .when(F.col("size") > F.col("_size"), "grown")
        .when(F.col("modified_us") > F.col("_us"), "rewritten")
        .otherwise("same")
    )
    met = met.withColumn("change", kind)
    offset = F.when(F.col("change").isin("new", "rewritten"), F.lit(0)).otherwise(F.col("_at")).cast("long")
    return met.select("file", "size", "modified_us", offset.alias("offset"), "change")


def discovered(changes: DataFrame, roots: DataFrame, since_us: int) -> DataFrame:
    """The files of all sessions (roots: file, root) of which one file is active: written since an instant, or longer than
    what was taken of it. A file of no known root stands for itself. Nothing of their content is read."""
    named = changes.join(roots.select("file", "root").distinct(), "file", "left").withColumn("root", F.coalesce("root", "file"))
    active = (F.col("modified_us") >= since_us) | (F.col("size") > F.col("offset"))
    alive = named.groupBy("root").agg(F.max(active).alias("alive")).filter("alive")
    return named.join(alive.select("root"), "root", "left_semi")


def lines_at(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, offset, size (bytes without the line feed), value of each line, however files are split over tasks."""
    meta = [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_at"),
    ]
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(*meta, F.monotonically_increasing_id().alias("_id"), "value")
    rows = rows.withColumn("size", F.octet_length("value").cast("long"))
    # a split's lines lie in one task, in order: one row per split says how many bytes are before it
    splits = rows.groupBy("file", "_at").agg(F.sum(F.col("size") + 1).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    splits = stored(splits.select("file", "_at", F.coalesce(before, F.lit(0)).alias("_before")), "split-bytes")
    if splits.count() <= MAX_SPLITS:
        splits = F.broadcast(splits)
    so_far = Window.partitionBy("file", "_at").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("size") + 1).over(so_far), F.lit(0))
    met = rows.withColumn("_inside", inside).join(splits, ["file", "_at"])
    return met.select("file", (F.col("_before") + F.col("_inside")).alias("offset"), "size", "value")


def plain(file: Column) -> Column:
    """A file's name as states and lines both give it: one spelling of the scheme."""
    return F.regexp_replace(file, "^([a-z]+):/+", "$1:/")


def tail(spark: SparkSession, changes: DataFrame, most_files: int = 100_000) -> DataFrame:
    """file, offset, size, value of the complete lines behind the cursor of each changed file (as changed() gives them). Only
    files that changed are opened; their names, most_files at most, come to the driver, which must name them to Spark."""
    todo = stored(changes.filter("change <> 'same'").select("file", "offset", F.col("size").alias("upto")), "file-changes")
    names = [r.file for r in todo.select("file").limit(most_files + 1).toLocalIterator()]
    if len(names) > most_files:
        raise ValueError(f"over {most_files} files changed: take them by folders")
    if not names:
        return spark.createDataFrame([], "file string, offset long, size long, value string")
    found = lines_at(spark, names).withColumn("_key", plain(F.col("file")))
    known = todo.select(plain(F.col("file")).alias("_key"), F.col("file").alias("_file"), F.col("offset").alias("_from"), "upto")
    met = found.join(known, "_key")
    # a line that was not closed with a line feed when the file was listed may still grow
    whole = (F.col("offset") >= F.col("_from")) & (F.col("offset") + F.col("size") < F.col("upto"))
    return met.filter(whole).select(F.col("_file").alias("file"), "offset", "size", "value")


def advanced(cursors: DataFrame, changes: DataFrame, taken: DataFrame) -> DataFrame:
    """Cursors after the lines of a tail were taken: file, offset, size, modified_us. Files that are gone keep theirs."""
    end = taken.groupBy("file").agg(F.max(F.col("offset") + F.col("size") + 1).alias("_end"))
    now = changes.join(end, "file", "left").select(
        "file", F.coalesce("_end", "offset").alias("offset"), "size", "modified_us"
    )
    return now.unionByName(cursors.join(now, "file", "left_anti").select("file", "offset", "size", "modified_us"))


def found_again(refs: DataFrame, lines: DataFrame, most_bytes: int = MAX_LINE) -> DataFrame:
    """Each reference (file, offset, kind, ident, and any more columns) with the line that stands there now: value and found:
    `yes`, `missing` (no line begins there), `changed` (another record: its type, or an id of its payload or item, differs),
    or `too_long` (not handed out)."""
    here = lines.select("file", "offset", F.col("size").alias("_size"), F.col("value").alias("_value"))
    kind = at("type", "_value")
    ids = F.array_compact(
        F.array(*[at(x, "_value") for x in ("payload.call_id", "payload.id", "payload.item.id", "payload.response_id", "id")])
    )
    met = refs.join(here, ["file", "offset"], "left")
    same = F.col("kind").eqNullSafe(kind) & (F.col("ident").isNull() | F.array_contains(ids, F.col("ident")))
    told = F.when(F.col("_value").isNull(), "missing").when(F.col("_size") > most_bytes, "too_long").when(
        F.coalesce(same, F.lit(False)), "yes"
    ).otherwise("changed")
    out = met.withColumn("found", told).withColumn("value", F.when(F.col("found") == "yes", F.col("_value")))
    return out.drop("_size", "_value")
