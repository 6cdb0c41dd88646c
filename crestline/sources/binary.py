"""Binary sources: matrices as .npy, and fvecs/ivecs files with an int32 header of row count and width."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from crestline.operators.vectors import from_matrix


def npy(spark: SparkSession, path: str) -> DataFrame:
    """Points from the rows of a .npy matrix, read as 32-bit floats. The matrix has to fit the driver; convert larger ones to Parquet."""
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    return from_matrix(spark, np.load(io.BytesIO(content)).astype(np.float32))


def header_matrix(spark: SparkSession, path: str, kind: str = "float32") -> DataFrame:
    """Points (float32) or integer vectors (int32) of files that hold two int32, rows and columns, and then the values. A file is parsed by one task."""
    if kind not in ("float32", "int32"):
        raise ValueError(f"unknown kind {kind}")

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                n, dim = np.frombuffer(content, "<i4", 2)
                values = np.frombuffer(content, np.dtype(kind).newbyteorder("<"), int(n) * int(dim), offset=8).reshape(n, dim)
                for at in range(0, int(n), 10_000):
                    yield pd.DataFrame({"id": np.arange(at, min(at + 10_000, int(n))), "features": list(values[at : at + 10_000].astype(np.float64))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "id long, features array<double>")
