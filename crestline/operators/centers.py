"""Cluster centers from a decision graph <id, rho[, rho_rw], dep, delta>: each gives <id>."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_FLOAT = 3.4028234663852886e38


def by_threshold(graph: DataFrame, delta_min: float = MAX_FLOAT, rho_min: float = 0.0, noise: DataFrame | None = None) -> DataFrame:
    """Points without a dependent point (noise too), and those at or above both thresholds that are no noise."""
    marked = graph.withColumn("noisy", F.lit(False)) if noise is None else graph.join(noise.select("id").withColumn("n", F.lit(True)), "id", "left").withColumn("noisy", F.coalesce("n", F.lit(False)))
    far = ~F.col("noisy") & (F.col("delta") >= delta_min) & (F.col("rho") >= rho_min)
    return marked.filter(F.col("dep").isNull() | F.coalesce(far, F.lit(False))).select("id")


def scores(graph: DataFrame, reweighted: bool = False) -> DataFrame:
    """<id, score>: density times distance; infinite without a dependent point, lowest for the undefined product of 0 and infinity."""
    rho = F.col("rho_rw" if reweighted else "rho")
    product = rho * F.col("delta")
    return graph.select("id", F.when(F.col("dep").isNull(), F.lit(float("inf"))).when(F.isnan(product), F.lit(float("-inf"))).otherwise(product).alias("score"))


def by_product(graph: DataFrame, num_clusters: int, reweighted: bool = False) -> DataFrame:
    """The num_clusters points with the largest product of density and distance, ties by id. Noise is not excluded."""
    if num_clusters < 1:
        raise ValueError("num_clusters must be positive")
    return scores(graph, reweighted).orderBy(F.desc("score"), "id").limit(num_clusters).select("id")
