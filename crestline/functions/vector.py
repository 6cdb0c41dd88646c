"""Column expressions over array<double> vectors; folds run left to right, so results have the same bits wherever they are computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, t: s + t)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)


def inverse_root(d2: Column) -> Column:
    """1 / sqrt(d2), infinity at 0."""
    return F.when(d2 == 0, F.lit(float("inf"))).otherwise(1 / F.sqrt(d2))


def denser(rho_j: Column, j: Column, rho_i: Column, i: Column) -> Column:
    """Whether j is denser than i: higher density, or equal density and higher id."""
    return (rho_j > rho_i) | ((rho_j == rho_i) & (j > i))
