"""Cluster labels: every point follows its dependent point until a center, by pointer jumping (a logarithmic number of joins)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline import session
from crestline.operators.blocks import frame
from crestline.session import Scratch, keep

HELD = 64  # bytes for each point that the driver holds while it follows a forest by itself


def roots(parents: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """<keys, id, root> from a forest <keys, id, parent> where roots are their own parents. A round jumps twice, so paths shrink to a third; points that have
    reached a root rest, so that each joins a large cluster's root once."""
    with Scratch() as run:
        now = run.put(parents.select(*keys, "id", "parent", (F.col("id") == F.col("parent")).alias("done")))
        while not now.filter("NOT done").isEmpty():
            up = now.select(*keys, F.col("id").alias("parent"), F.col("parent").alias("next"))
            once = now.filter("NOT done").join(up, [*keys, "parent"]).select(*keys, "id", F.col("next").alias("parent"))
            twice = once.join(up.toDF(*up.columns), [*keys, "parent"])
            moved = twice.select(*keys, "id", F.col("next").alias("parent"), (F.col("next") == F.col("parent")).alias("done"))
            after = run.put(now.filter("done").unionByName(moved))
            run.drop(now)
            now = after
        return run.leave(now.select(*keys, "id", F.col("parent").alias("root")), now)


def _forest(graph: DataFrame, centers: DataFrame, noise: DataFrame | None) -> DataFrame:
    stop = centers.select("id") if noise is None else centers.select("id").unionByName(noise.select("id")).distinct()
    marked = graph.select("id", "dep").join(stop.withColumn("stop", F.lit(True)), "id", "left")
    return marked.select("id", F.when(F.col("stop").isNotNull() | F.col("dep").isNull(), F.col("id")).otherwise(F.col("dep")).alias("parent"))


def _at_once(graph: DataFrame, centers: DataFrame, noise: DataFrame | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids in order and the place of each one's root, found on the driver; None of points that are too many or share an id, and of links that lead out of the graph."""
    if graph.count() * HELD > session.BROADCAST_BYTES:
        return None
    table = _forest(graph, centers, noise).toArrow()
    ids, to = table["id"].combine_chunks(), table["parent"].combine_chunks()
    if not len(ids) or ids.null_count or to.null_count:
        return None
    ids, to = ids.to_numpy(), to.to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, to = ids[order], to[order]
    first = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
    if (ids[1:] == ids[:-1]).any() or (ids[first] != to).any():
        return None
    up = first
    for _ in range(len(ids).bit_length()):
        up = up[up]
    if (first[up] != up).any():
        raise ValueError("dependent points form a circle")
    return ids, up


def densest_labels(graph: DataFrame, centers: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """<id, cluster> where a cluster is named by its center."""
    if (known := _at_once(graph, centers, noise)) is not None:
        ids, up = known
        return frame(graph.sparkSession, ("id", "cluster"), ids, ids[up])
    return roots(_forest(graph, centers, noise)).withColumnRenamed("root", "cluster")


def labels(graph: DataFrame, centers: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """<id, cluster> where a cluster is named by its largest id."""
    if (known := _at_once(graph, centers, noise)) is not None:
        ids, up = known
        last = up.copy()
        np.maximum.at(last, up, np.arange(len(ids)))
        return frame(graph.sparkSession, ("id", "cluster"), ids, ids[last[up]])
    with Scratch() as run:
        found = keep(roots(_forest(graph, centers, noise)))
        names = found.groupBy("root").agg(F.max("id").alias("cluster"))  # partial aggregates first, so a cluster of any size is fine
        return run.leave(found.join(names, "root").select("id", "cluster"), found)


def legacy_labels(graph: DataFrame, rho_cutoff: float, delta_cutoff: float, center_rho_cutoff: float) -> DataFrame:
    """Link to the dependent point if rho > rho_cutoff and (delta <= delta_cutoff or rho < center_rho_cutoff); the rest are roots."""
    link = F.col("dep").isNotNull() & (F.col("rho") > rho_cutoff) & ((F.col("delta") <= delta_cutoff) | (F.col("rho") < center_rho_cutoff))
    return labels(graph, graph.filter(~link).select("id"))


def count_clusters(found: DataFrame) -> DataFrame:
    """One row: num_clusters."""
    return found.agg(F.countDistinct("cluster").alias("num_clusters"))
