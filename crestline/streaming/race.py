"""The sketch of a stream of points: counts only grow, so a running aggregate by estimator and bucket is the whole state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from crestline.operators.sketch import HashFamily, add, buckets


def sketch_stream(pts: DataFrame, estimators: int, hashes: int, family: HashFamily, dim: int) -> DataFrame:
    """A streaming <estimator, bucket, cnt>; the state has at most estimators * range ** hashes rows."""
    return add(buckets(pts, estimators, hashes, family, dim))


def start(pts: DataFrame, estimators: int, hashes: int, family: HashFamily, dim: int, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the sketch of the stream in the in-memory table ``name``."""
    counts = sketch_stream(pts, estimators, hashes, family, dim)
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
