"""Synthetic mixtures. Every point depends on its id and the seed only, so any number of executors gives the same data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _normal(i: int | F.Column, seed: int) -> F.Column:
    """A standard normal number from hashes of the row id (Box-Muller)."""
    unit = lambda salt: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt), i if not isinstance(i, int) else F.lit(i)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    return F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * np.pi * unit(2))


def mixture(spark: SparkSession, centers: np.ndarray, sizes: list[int], sigma: float, seed: int = 42) -> DataFrame:
    """<id, features, label>: sizes[c] points around centers[c], with independent normal noise in each component."""
    centers = np.asarray(centers, dtype=np.float64)
    ends = np.cumsum(sizes)
    frame = spark.range(int(ends[-1]))
    label = F.lit(0)
    for c, end in enumerate(ends[:-1]):
        label = F.when(F.col("id") >= int(end), c + 1).otherwise(label)
    if len(ends) > 64:  # even sizes by division, so that the expression stays small
        label = F.least(F.floor(F.col("id") / int(sizes[0])), F.lit(len(sizes) - 1))
    table = spark.createDataFrame([(c, row.tolist()) for c, row in enumerate(centers)], "c long, center array<double>")
    placed = frame.withColumn("label", label.cast("long")).join(F.broadcast(table), F.col("label") == F.col("c"))
    return placed.select("id", F.transform("center", lambda x, i: x + sigma * _normal(i, seed)).alias("features"), "label")


def gaussian(spark: SparkSession, clusters: int, average: int, dim: int = 2, seed: int = 42) -> DataFrame:
    """Means uniform in [0, 100), deviation 2, sizes uniform between average / 1.5 and twice average."""
    rng = np.random.default_rng(seed)
    sizes = [int(rng.integers(int(average / 1.5), 2 * average)) for _ in range(clusters)]
    return mixture(spark, rng.uniform(0, 100, (clusters, dim)), sizes, 2.0, seed)


def scaling(spark: SparkSession, n: int, clusters: int, dim: int = 128, variance: float = 0.05, seed: int = 42) -> DataFrame:
    """Centers uniform in the unit cube, isotropic noise, n / clusters points for each."""
    rng = np.random.default_rng(seed)
    return mixture(spark, rng.uniform(0, 1, (clusters, dim)), [n // clusters] * clusters, float(np.sqrt(variance)), seed)
