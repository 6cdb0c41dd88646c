"""All-pairs work in numpy blocks: whether one side can be broadcast, and else a join of blocks. Per-row results are merged by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline import session
from crestline.operators.nearest import EMIT, vectors

_HELD: WeakKeyDictionary[DataFrame, tuple[np.ndarray, np.ndarray]] = WeakKeyDictionary()  # goes with its table of points


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, components added in order (the same bits as the fold over columns)."""
    out = np.zeros((len(a), len(b)))
    for t in range(a.shape[1]):
        diff = a[:, t, None] - b[None, :, t]
        diff *= diff
        out += diff
    return out


def _triangle(pts: DataFrame, blocks: int, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """All pairs of one table's rows: a pair of blocks meets once, for both directions, so rows move half as often."""
    names = [part.split()[0] for part in schema.split(",")]
    dealt = pts.withColumn("__block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    dealt = dealt.withColumn("__low", F.least("__block", "__other")).withColumn("__high", F.greatest("__block", "__other")).drop("__other")

    def cell(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        low, high = (group[group["__block"] == at].sort_values("id").reset_index(drop=True) for at in key)
        sides = [(low, high)] if key[0] == key[1] else [(low, high), (high, low)]
        parts = [work(a, b) for a, b in sides if len(a) and len(b)]
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in names})

    return dealt.groupBy("__low", "__high").applyInPandas(cell, schema)


def _extent(df: DataFrame) -> tuple[int, int]:
    n, width = df.agg(F.count("*"), F.max(F.size("features"))).first()
    return n, (width or 0) + 4


def fits(df: DataFrame) -> bool:
    """Whether points are few enough to be broadcast."""
    n, width = _extent(df)
    return n * 8 * width <= session.BROADCAST_BYTES


def held(pts: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of points that are few enough to be broadcast, None of others. A table of points is read once, however many steps search it."""
    known = _HELD.get(pts)
    if known is None:
        if not fits(pts):
            return None
        table = pts.select("id", "features").toArrow()
        known = _HELD[pts] = table["id"].to_numpy(), vectors(table["features"])
    return known if known[1].size * 8 + len(known[0]) * 32 <= session.BROADCAST_BYTES else None


def frame(spark: SparkSession, names: tuple[str, ...], *columns: np.ndarray) -> DataFrame:
    """A table of whole numbers that the driver holds, sent to tasks once."""
    shared = spark.sparkContext.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(column[number * EMIT : (number + 1) * EMIT]) for column in shared.value], list(names))

    return numbers(spark, -(-len(columns[0]) // EMIT)).mapInArrow(run, ", ".join(f"{name} long" for name in names))


def numbers(spark: SparkSession, n: int) -> DataFrame:
    """Numbers of n pieces of work, in more tasks than cores, as pieces differ, and as many for each core, as most are alike."""
    cores = spark.sparkContext.defaultParallelism
    return spark.range(0, n, 1, max(1, min(n, cores * max(4, -(-32 // cores)))))


def against_all(left: DataFrame, right: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(rows of left, rows of right by id) for blocks that cover all pairs. left and right have an id and features; the results of one left row
    over several right blocks have to be merged by the caller."""
    n, width = _extent(right)
    per_block = max(1_024, session.BROADCAST_BYTES // (8 * width) // 4)
    blocks = max(1, -(-n // per_block))
    if left is right:
        return _triangle(left, blocks, work, schema)
    each = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own, also if both come from one table
    here = left.withColumn("__l", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("__r", F.explode(each))
    there = right.withColumn("__r", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("__l", F.explode(each))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id").reset_index(drop=True)
        return work(a, b) if len(a) and len(b) else pd.DataFrame({c: [] for c in names})

    names = [part.split()[0] for part in schema.split(",")]
    return here.groupBy("__l", "__r").cogroup(there.groupBy("__l", "__r")).applyInPandas(cell, schema)
