"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool, label: str) -> DataFrame:
    """Every node's larger (large) or not larger (small) neighbours are linked to the least of its neighbourhood. The least
    are written, so that the join with them has plain inputs, which Spark may broadcast or split where a hub is hot."""
    near = _both_ways(edges) if large else edges
    least = written(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{label}-least")
    if large:
        moved = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _counted(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The edges, written, and their number and checksum, which the write itself observes."""
    seen = Observation()
    checksum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("checksum")
    stored = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), checksum), label)
    return stored, (seen.get["n"], seen.get["checksum"])


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """node, component (the least node it is linked to, through any number of links) of every node that has a link.

    links: columns u, v; loops and repeats do no harm. The links left after each round are written to the shared folder,
    until a round changes nothing; rounds grow with the logarithm of the longest path. Only counts come to the driver.
    """
    plain = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = _counted(plain, label)
    while before[0]:
        edges, after = _counted(_star(_star(edges, True, label), False, label), label)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def least_members(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index in the component of each of n nodes, under links a-b."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            return least
        least = new
