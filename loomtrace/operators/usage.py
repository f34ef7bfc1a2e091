"""Token accounting: strict totals, consensus, exact allocation, growth and residence of context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_usage(responses: DataFrame) -> DataFrame:
    """The record of each thread with the highest index."""
    last = F.max_by(F.struct("input_tokens", "output_tokens"), F.struct("idx", "response_id"))
    return responses.groupBy("thread").agg(F.count(F.lit(1)).alias("responses"), last.alias("_l")).select(
        "thread",
        "responses",
        F.col("_l.input_tokens").alias("input_tokens"),
        F.col("_l.output_tokens").alias("output_tokens"),
    )


def strict_totals(responses: DataFrame, *by: str) -> DataFrame:
    """Totals that are null if one value is missing, beside partial sums, coverage and a status."""
    known, n = F.count("output_tokens"), F.count(F.lit(1))
    return responses.groupBy(*by).agg(
        n.alias("responses"),
        known.alias("known"),
        F.when(known == n, F.sum("output_tokens")).alias("strict_output"),
        F.sum("output_tokens").alias("partial_output"),
        F.when(known == n, "complete").when(known > 0, "partial").otherwise("missing").alias("status"),
    )


def consensus(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The one value that all rows agree on; null with a conflict where they do not."""
    n = F.count_distinct(column)
    return df.groupBy(*by).agg(
        F.when(n == 1, F.max(column)).alias(column), (n > 1).alias("conflict"), n.alias("n_values")
    )


def split_floor(lines: DataFrame, group: str, total: str, weight: str) -> DataFrame:
    """Shares of a total by weight, rounded down; what is left over is lost. Weights are whole numbers."""
    w = Window.partitionBy(group)
    return lines.withColumn(
        "share", F.expr(f"{total} * {weight} div nullif(sum({weight}) OVER (PARTITION BY {group}), 0)")
    ).withColumn("lost", F.max(total).over(w) - F.sum("share").over(w))


def split_exact(lines: DataFrame, group: str, total: str, weight: str, order: str) -> DataFrame:
    """Shares of a total by weight that add up to it: rounded down, then one more for the largest remainders (ties by
    order). Weights that are all zero count alike."""
    w = Window.partitionBy(group)
    all_weight = F.sum(weight).over(w)
    even = lines.withColumn("_w", F.when(all_weight == 0, F.lit(1)).otherwise(F.col(weight)).cast("long"))
    even = even.withColumn("_t", F.sum("_w").over(w)).withColumn("_base", F.expr(f"{total} * _w div _t")).withColumn(
        "_rest", F.expr(f"{total} * _w % _t")
    )
    left = F.col(total) - F.sum("_base").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("_rest"), order))
    return even.withColumn("_left", left).withColumn("_rank", rank).withColumn(
        "share", F.col("_base") + (F.col("_rank") <= F.col("_left")).cast("long")
    ).drop("_w", "_t", "_base", "_rest", "_left", "_rank")


def growth(responses: DataFrame) -> DataFrame:
    """Tokens added to the context by what came between two responses of one context window: input less the previous
    input and output, where known and positive."""
    w = Window.partitionBy("thread").orderBy("idx")
    prev = F.lag(F.struct("input_tokens", "output_tokens", "ctx", "idx")).over(w)
    added = F.col("input_tokens") - prev["input_tokens"] - prev["output_tokens"]
    valid = (prev["ctx"] == F.col("ctx")) & (prev["idx"] + 1 == F.col("idx")) & (added > 0)
    return responses.withColumn("added", F.when(valid, added))


def residence(responses: DataFrame) -> DataFrame:
    """Growth, how many later responses of its window read it again, and the tokens so reread."""
    w = Window.partitionBy("thread", "ctx")
    later = F.max("idx").over(w) - F.col("idx")
    return growth(responses).withColumn("residence", later).withColumn("reread", F.col("added") * later)


def families(responses: DataFrame, by: str) -> DataFrame:
    """Added and reread tokens per family, and each family's share of all that was added."""
    sums = residence(responses).filter("added IS NOT NULL").groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("added").alias("added"), F.sum("reread").alias("reread")
    )
    total = sums.agg(F.sum("added").alias("_all"))
    return sums.join(F.broadcast(total)).select(
        by, "n", "added", "reread", F.round(100 * F.col("added") / F.col("_all"), 6).alias("share_pct")
    )


def window_starts(responses: DataFrame) -> DataFrame:
    """The first input of each context window beside the output gathered before it; the partial first window is left out."""
    w = Window.partitionBy("thread").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = responses.withColumn("before", F.coalesce(F.sum("output_tokens").over(w), F.lit(0)))
    return rows.groupBy("thread", "ctx").agg(
        F.min_by("input_tokens", "idx").alias("first_input"), F.min_by("before", "idx").alias("before")
    ).filter("ctx > 0")


def window_slope(responses: DataFrame, least: int = 3) -> DataFrame:
    """Per thread with enough windows: slope and correlation of first input over gathered output."""
    s = window_starts(responses).groupBy("thread").agg(
        F.count(F.lit(1)).alias("windows"),
        F.regr_slope("first_input", "before").alias("slope"),
        F.covar_pop("first_input", "before").alias("_cov"),
        (F.stddev_pop("first_input") * F.stddev_pop("before")).alias("_dev"),
        F.min("first_input").alias("least_input"),
    )
    # null where one side does not vary
    s = s.withColumn("r", F.try_divide("_cov", "_dev"))
    return s.filter(F.col("windows") >= least).select(
        "thread", "windows", F.round("slope", 6).alias("slope"), F.round("r", 6).alias("r"), "least_input"
    )


def retained(responses: DataFrame, least_r: float = 0.5, least_windows: int = 5) -> DataFrame:
    """Retained context where the correlation is a sufficient basis: surplus of the first inputs over the least one."""
    base = window_slope(responses).filter((F.col("r") >= least_r) & (F.col("windows") >= least_windows)).select(
        "thread", "r", "least_input"
    )
    return window_starts(responses).join(base, "thread").groupBy("thread", "r").agg(
        F.sum(F.col("first_input") - F.col("least_input")).alias("surplus"), F.count(F.lit(1)).alias("windows")
    )


def asof_before(
    left: DataFrame, right: DataFrame, by: str, time: str, value: str, within: int | None = None
) -> DataFrame:
    """left with value and time of the last row of right at or before it (same `by`), no older than `within`. One shuffle:
    both sides are put together and the last non-null value is carried forward."""
    cols = [c for c in left.columns if c not in (by, time)]
    one = left.select(
        by,
        time,
        F.struct(*cols).alias("_row"),
        F.lit(None).cast(right.schema[value].dataType).alias("_v"),
        F.lit(1).alias("_side"),
    )
    two = right.select(
        by,
        time,
        F.lit(None).cast(one.schema["_row"].dataType).alias("_row"),
        F.col(value).alias("_v"),
        F.lit(0).alias("_side"),
    )
    w = Window.partitionBy(by).orderBy(time, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("_side") == 0, F.struct(F.col("_v").alias("v"), F.col(time).alias("t")))
    both = one.unionByName(two).withColumn("_m", F.last(mark, ignorenulls=True).over(w)).filter("_side = 1")
    near = F.lit(True) if within is None else F.col(time) - F.col("_m.t") <= within
    return both.select(by, time, "_row.*", F.when(near, F.col("_m.v")).alias(f"asof_{value}"))


def tier_changes(responses: DataFrame) -> DataFrame:
    """How often the tier changes from one response of a thread to the next."""
    w = Window.partitionBy("thread").orderBy("idx")
    changed = F.coalesce((F.lag("tier").over(w) != F.col("tier")).cast("long"), F.lit(0))
    return responses.withColumn("_c", changed).groupBy("thread").agg(
        F.sum("_c").alias("changes"), F.count_distinct("tier").alias("tiers")
    )


def coverage_reasons(calls: DataFrame, responses: DataFrame) -> DataFrame:
    """Why calls have, or have not, a response to take tokens from; each call gets the first reason that holds."""
    r = responses.select(
        F.col("thread").alias("_t"),
        F.col("idx").alias("_i"),
        "input_tokens",
        "output_tokens",
        F.lit(True).alias("_found"),
    )
    j = calls.join(r, (F.col("agent") == F.col("_t")) & (F.col("emitter") + 1 == F.col("_i")), "left")
    shared = F.count(F.lit(1)).over(Window.partitionBy("session", "agent", "emitter"))
    reason = F.when(F.col("status") == "open", "open").when(F.col("_found").isNull(), "no_response").when(
        F.col("output_tokens").isNull(), "no_usage"
    ).when(F.col("_n") > 1, "shared").otherwise("own")
    return j.withColumn("_n", shared).withColumn("reason", reason).groupBy("tool", "reason").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("output_tokens").alias("output_tokens")
    )
