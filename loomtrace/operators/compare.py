"""Across sessions: patterns and their trends, additive measures, rate ratios and differences with confidence intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patterns(findings: DataFrame) -> DataFrame:
    """Recurring patterns at three granularities in one pass: all, per project, per client.

    findings: pattern, session, project, client, n (calls), confidence (3 high, 2 medium, 1 low).
    """
    sets = findings.groupingSets(
        [["pattern"], ["pattern", "project"], ["pattern", "client"]], "pattern", "project", "client"
    )
    return sets.agg(
        F.count_distinct("session").alias("sessions"),
        F.count(F.lit(1)).alias("occurrences"),
        F.sum("n").alias("calls"),
        F.max("confidence").alias("confidence"),
        F.grouping_id("pattern", "project", "client").cast("int").alias("grain"),
    )


def ranked(found: DataFrame, n: int = 5) -> DataFrame:
    return found.filter("sessions >= 2").orderBy(
        F.desc("sessions"), F.desc("confidence"), F.desc("occurrences"), F.desc("calls"), "pattern"
    ).limit(n)


def measure(calls: DataFrame, *by: str) -> DataFrame:
    """The additive measure of call sets: measures of parts add up to that of the whole."""
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status") == "error").alias("failures"),
        F.count_if(F.col("category") == "read").alias("reads"),
        F.sum("duration_ms").alias("known_ms"),
        F.count("duration_ms").alias("timed"),
        F.count_distinct("agent").alias("agents"),
    )


def merge(measures: DataFrame, *by: str) -> DataFrame:
    names = [c for c in measures.columns if c not in by and c != "part"]
    return measures.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])


def rate_ratio(k1: Column, n1: Column, k2: Column, n2: Column, c1: Column, c2: Column) -> dict[str, Column]:
    """(k2/n2)/(k1/n1) with a 95 % interval by the logarithm; half a count is added to both where one is zero; the standard
    error is over clusters c1, c2."""
    half = F.when((k1 == 0) | (k2 == 0), 0.5).otherwise(0.0)
    half_c = F.when((c1 == 0) | (c2 == 0), 0.5).otherwise(0.0)
    ratio = F.try_divide((k2 + half) / n2, (k1 + half) / n1)
    se = F.sqrt(1 / (c1 + half_c) + 1 / (c2 + half_c))
    return {"ratio": ratio, "low": ratio * F.exp(-1.96 * se), "high": ratio * F.exp(1.96 * se)}


def conclusion(
    low: Column, high: Column, events: Column, activity: Column, clusters: Column, least=(10, 200, 5)
) -> Column:
    """What may be said of a ratio, behind gates on events, activity and clusters."""
    return F.when((events < least[0]) | (activity < least[1]) | (clusters < least[2]), "too_few").when(
        high < 1, "decrease"
    ).when(low > 1, "increase").otherwise("no_difference")


def compare_rates(calls: DataFrame, split_ns: int, by: str = "tool") -> DataFrame:
    """Failures per call before and after an instant, by tool: ratio, interval, conclusion. One pass over the calls."""
    late = F.col("start_ns") >= split_ns
    k = lambda side: F.count_if(side & (F.col("params") == 1))
    sides = calls.groupBy(by).agg(
        k(~late).alias("k1"),
        F.count_if(~late).alias("n1"),
        k(late).alias("k2"),
        F.count_if(late).alias("n2"),
        F.count_distinct(F.when(~late & (F.col("params") == 1), F.col("agent"))).alias("c1"),
        F.count_distinct(F.when(late & (F.col("params") == 1), F.col("agent"))).alias("c2"),
    )
    r = rate_ratio(*[F.col(c).cast("double") for c in ("k1", "n1", "k2", "n2", "c1", "c2")])
    out = sides.withColumns(r)
    said = conclusion(F.col("low"), F.col("high"), F.col("k1") + F.col("k2"), F.least("n1", "n2"), F.least("c1", "c2"))
    return out.withColumn("conclusion", said).select(
        by,
        "k1",
        "n1",
        "k2",
        "n2",
        "c1",
        "c2",
        *[F.round(c, 6).alias(c) for c in ("ratio", "low", "high")],
        "conclusion",
    )


def proportion_difference(calls: DataFrame, split_ns: int, by: str, least: int = 20) -> DataFrame:
    """Difference of the shares of successes after and before, with a 95 % interval; null where a side has too few."""
    late, won = F.col("start_ns") >= split_ns, F.col("status") == "success"
    known = F.col("status").isin("success", "error")
    s = calls.filter(known).groupBy(by).agg(
        F.count_if(~late & won).alias("x1"),
        F.count_if(~late).alias("m1"),
        F.count_if(late & won).alias("x2"),
        F.count_if(late).alias("m2"),
    )
    p1, p2 = F.try_divide(F.col("x1"), F.col("m1")), F.try_divide(F.col("x2"), F.col("m2"))
    se = F.sqrt(F.try_divide(p1 * (1 - p1), F.col("m1")) + F.try_divide(p2 * (1 - p2), F.col("m2")))
    enough = (F.col("m1") >= least) & (F.col("m2") >= least)
    pick = lambda c: F.when(enough, F.round(c, 6))
    return s.select(
        by,
        "x1",
        "m1",
        "x2",
        "m2",
        pick(p2 - p1).alias("difference"),
        pick(p2 - p1 - 1.96 * se).alias("low"),
        pick(p2 - p1 + 1.96 * se).alias("high"),
    )


def rank_agreement(scores: DataFrame, by: list[str], item: str, left: str, right: str, k: int = 3) -> DataFrame:
    """How two scores rank the items of each group: Spearman's correlation (of mean ranks; null where one is flat) and the
    Jaccard similarity of their k best, ties at the cut included (null where one has none above zero)."""
    flat = 1e-8

    def ranked(c: str) -> dict[str, Column]:
        w = Window.partitionBy(*by)
        same = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
        cut = F.min(F.when(F.col(f"_n{c}") <= k, F.col(c))).over(w)
        above = F.max(c).over(w) > flat
        return {
            f"_r{c}": F.rank().over(w.orderBy(c)) + (same - 1) / 2,
            f"_t{c}": above & (F.col(c) >= cut - flat),
            f"_s{c}": F.max(c).over(w) - F.min(c).over(w),
        }

    place = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(c), item))
    rows = scores.withColumns({f"_n{c}": place(c) for c in (left, right)}).withColumns(ranked(left) | ranked(right))
    both, either = F.count_if(F.col(f"_t{left}") & F.col(f"_t{right}")), F.count_if(
        F.col(f"_t{left}") | F.col(f"_t{right}")
    )
    some = (F.count_if(F.col(f"_t{left}")) > 0) & (F.count_if(F.col(f"_t{right}")) > 0)
    # corr() fails where one side is flat
    correlation = F.try_divide(
        F.covar_pop(f"_r{left}", f"_r{right}"), F.stddev_pop(f"_r{left}") * F.stddev_pop(f"_r{right}")
    )
    told = (F.max(f"_s{left}") > flat) & (F.max(f"_s{right}") > flat)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.when(told, correlation).alias("spearman"),
        F.when(some, both / either).alias("top_jaccard")
    )
