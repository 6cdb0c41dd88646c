"""Points: a DataFrame <id bigint, features array<double>>."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points(df: DataFrame, id_col: str, features: str | list[str]) -> DataFrame:
    """Points from an array column or from numeric columns. Rows with a null id, vector or component are left out."""
    vector = F.col(features) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    out = df.select(F.col(id_col).cast("long").alias("id"), vector.cast("array<double>").alias("features"))
    return out.filter(F.col("id").isNotNull() & F.col("features").isNotNull() & ~F.exists("features", lambda x: x.isNull()))


def from_matrix(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """Points from rows of an in-memory matrix; the id is the row number."""
    matrix = np.asarray(matrix, dtype=np.float64)
    if matrix.ndim != 2:
        raise ValueError("a matrix has two dimensions")
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], "id long, features array<double>")


def dimension(pts: DataFrame) -> int:
    """The common number of components; ragged vectors are rejected."""
    low, high = pts.agg(F.min(F.size("features")), F.max(F.size("features"))).first()
    if low != high:
        raise ValueError(f"vectors have between {low} and {high} components")
    return low or 0
