"""Connected components of an edge table by alternating large and small stars, a logarithmic number of rounds of joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least.select(F.col("hi").alias("c"), "m"), F.col("hi") == F.col("c")).filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame], a: str = "a", b: str = "b", drop: Callable[[DataFrame], None] = lambda df: None) -> DataFrame:
    """node and component (its smallest node) for every node of an undirected edge table. keep materializes a round's result, drop forgets one."""
    now = keep(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    mark = None
    while not (mark is None and now.isEmpty()):
        before, now = now, keep(_small(_large(now)))
        drop(before)
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
