"""Baselines: k-means with restarts, and its grid."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.operators.knn import nearest_centroid


def kmeans(pts: DataFrame, k: int, niter: int = 10, nredo: int = 1, seed: int = 1) -> DataFrame:
    """<id, cluster> of the best of nredo runs by training cost."""
    rows = pts.select("id", array_to_vector("features").alias("features")).cache()
    fits = [KMeans(k=k, maxIter=niter, seed=seed + r, featuresCol="features").fit(rows) for r in range(nredo)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    out = best.transform(rows).select("id", F.col("prediction").cast("long").alias("cluster"))
    return out


def centroids(spark: SparkSession, rows: list[tuple[int, list[float]]]) -> DataFrame:
    return spark.createDataFrame(rows, "id long, features array<double>")


def assign_to_centroids(pts: DataFrame, given: DataFrame) -> DataFrame:
    """<id, cluster>: the nearest centroid, ties by id."""
    return nearest_centroid(pts, given).select("id", F.col("nbr").alias("cluster"))


def grid() -> list[tuple[int, int]]:
    """(nredo, niter) with a product of at most 100."""
    niter = [*range(1, 10), *range(10, 46, 5)]
    return [(r, i) for r in range(1, 5) for i in niter if r * i <= 100]


