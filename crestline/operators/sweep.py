"""Clusterings for many numbers of clusters from one decision graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.operators.assign import roots

SMALLEST = 2.2250738585072014e-308  # smallest normal double


def sweep(graph: DataFrame, ks: list[int], a: float = 1.0, b: float = 1.0) -> DataFrame:
    """<k, id, cluster> for each k: points rank by a ln(rho) + b ln(delta), the first k are centers, others follow their dependent points.
    Points without a dependent point (dep null or delta -1) rank first; delta 0 counts as the smallest normal double. A cluster is named by its center."""
    n = graph.count()
    if not ks or min(ks) < 1 or max(ks) > n:
        raise ValueError(f"numbers of clusters lie between 1 and {n}")
    first = F.col("dep").isNull() | (F.col("delta") < 0)
    score = F.when(first, F.lit(float("inf"))).otherwise(a * F.log("rho") + b * F.log(F.greatest("delta", F.lit(SMALLEST))))
    ranked = graph.select("id", "dep", score.alias("score"))
    top = ranked.orderBy(F.desc("score"), "id").limit(max(ks)).select("id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("place"))  # max(ks) rows
    placed = graph.select("id", "dep").join(top, "id", "left").withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
    parents = placed.select("k", "id", F.when(F.col("place").isNotNull() & (F.col("place") <= F.col("k")) | F.col("dep").isNull(), F.col("id")).otherwise(F.col("dep")).alias("parent"))
    return roots(parents, ("k",)).withColumnRenamed("root", "cluster")
