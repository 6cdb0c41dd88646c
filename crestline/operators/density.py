"""Densities over a kNN table whose lists hold k = K + 1 entries, the point itself included. Each gives <id, rho, rho_rw>; rho_rw is null unless reweighted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.vector import inverse_root
from crestline.session import keep


def _none(name: str) -> Column:
    return F.lit(None).cast("double").alias(name)


def _folded(knn: DataFrame, term: Callable[[Column], Column]) -> DataFrame:
    """<id, total, n>: terms of the squared distances added in rank order (a plain sum depends on the shuffle's order). Lists are k long."""
    lists = knn.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rk", "d2"))).alias("l"))
    return lists.select("id", F.aggregate("l", F.lit(0.0), lambda s, x: s + term(x["d2"])).alias("total"), F.size("l").alias("n"))


def kth(knn: DataFrame) -> DataFrame:
    """1 / distance of the last neighbour."""
    return knn.groupBy("id").agg(F.max("d2").alias("d2")).select("id", inverse_root(F.col("d2")).alias("rho"), _none("rho_rw"))


def normalized(knn: DataFrame) -> DataFrame:
    """kth, reweighted by the mean density of the neighbours."""
    return reweighted(knn, kth(knn))


def reweighted(knn: DataFrame, rho: DataFrame) -> DataFrame:
    """rho_rw = rho / mean of rho over the neighbours, the point itself included."""
    rho = keep(rho.select("id", "rho"))
    near = knn.join(rho.select(F.col("id").alias("nbr"), F.col("rho").alias("r")), "nbr")
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rk", "r"))).alias("l"))
    mean = F.aggregate("l", F.lit(0.0), lambda s, x: s + x["r"]) / F.size("l")
    ratio = F.when(mean != 0, F.col("rho") / mean).otherwise(F.lit(float("inf")))
    return rho.join(lists.select("id", mean.alias("mean"), "l"), "id").select("id", "rho", ratio.alias("rho_rw"))


def exp_squared(knn: DataFrame) -> DataFrame:
    """exp(-(mean of squared distances))."""
    return _folded(knn, lambda d2: d2).select("id", F.exp(-F.col("total") / F.col("n")).alias("rho"), _none("rho_rw"))


def sum_exp(knn: DataFrame) -> DataFrame:
    """Mean of exp(-squared distance)."""
    return _folded(knn, lambda d2: F.exp(-d2)).select("id", (F.col("total") / F.col("n")).alias("rho"), _none("rho_rw"))


def top_k_sum(knn: DataFrame) -> DataFrame:
    """Minus the sum of distances: densities are negative."""
    return _folded(knn, F.sqrt).select("id", (-F.col("total")).alias("rho"), _none("rho_rw"))


def mutual(knn: DataFrame) -> DataFrame:
    """Over neighbours that have the point among theirs: (sum of 1 / (both ranks from 0 + 2)) * count / (sum of distances)."""
    back = knn.select(F.col("id").alias("nbr"), F.col("nbr").alias("id"), F.col("rk").alias("back"))
    both = knn.join(back, ["id", "nbr"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rk", "back", "d2"))).alias("l"))
    score = F.aggregate("l", F.lit(0.0), lambda s, x: s + 1 / (x["rk"] + x["back"]).cast("double"))
    length = F.aggregate("l", F.lit(0.0), lambda s, x: s + F.sqrt(x["d2"]))
    rho = F.when(length == 0, F.lit(float("inf"))).otherwise(score * F.size("l") / length)
    everyone = knn.select("id").distinct()
    # A point that its own list lost to more than k twins has no mutual neighbour: length 0, so infinite like the others at distance 0.
    return everyone.join(both.select("id", rho.alias("rho")), "id", "left").select("id", F.coalesce("rho", F.lit(float("inf"))).alias("rho"), _none("rho_rw"))


def wrapped(given: DataFrame) -> DataFrame:
    """Densities supplied by the caller as <id, rho[, rho_rw]>."""
    rw = F.col("rho_rw").cast("double") if "rho_rw" in given.columns else F.lit(None).cast("double")
    return given.select(F.col("id").cast("long").alias("id"), F.col("rho").cast("double").alias("rho"), rw.alias("rho_rw"))


def kth_capped(knn: DataFrame, most: float = 3.4028234663852886e38) -> DataFrame:
    """The legacy form of kth: the largest 32-bit float instead of infinity at distance 0."""
    d2 = F.col("d2")
    return knn.groupBy("id").agg(F.max("d2").alias("d2")).select("id", F.when(d2 <= 0, F.lit(most)).otherwise(1 / F.sqrt(d2)).alias("rho"), _none("rho_rw"))


#: Density methods by the names that configurations use.
METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "kth": kth, "normalized": normalized, "exp-sum": exp_squared, "sum-exp": sum_exp, "sum": top_k_sum, "mutual": mutual,
}
