"""Embedding near-dedup by randomised-rotation binary codes with correction factors (operator 4).

1. Equal vectors of one label (by 128 bits of hash) collapse into a class (its smallest id, its size): thousands of copies are one row from here on. Vectors
   whose hash occurs once, told by a sieve, are classes of their own without a shuffle.
2. Every class vector is normalised and rotated by a random orthogonal matrix; the signs are its binary code, and the code's inner product with its own
   vector is the correction factor f. For a vector q at cosine c, <code, q> = f c + noise whose deviation is sqrt(1 - f^2) sqrt(1 - c^2) / sqrt(d - 1), so
   <code, q> / f estimates c without bias. Code, factor and a query form of the rotated vector (four bits a component, rounded at random and so without
   bias; the deviation is at most half a step) are stored once. A pair is recomputed exactly (double precision) only if the estimate's
   confidence bound reaches the threshold.
3. Candidates share the bits of one of several disjoint slices of the code. Bits per slice grow with the logarithm of the largest label, and
   slices are added until a pair at the threshold is missed with a chance below ``MISS`` (both by formula, at every size).
4. A slice's bucket of more than ``BLOCK`` rows is cut into blocks and every pair of blocks is a key of its own. The first pass moves stored codes only and
   returns the ids that have an undecided pair there; the second fetches the vectors of these and returns a count of links and a tree parent for
   each, never pairs. A pair counts in the first slice that it shares only.

Defined results: a null vector or label, a zero vector, and null or non-finite components link with nothing (component_id is the own id);
vectors of different lengths never link; rows that repeat a vec_id count as links of each other if their vectors are near; a null vec_id is kept
as null, and counts as a copy only; rows of one vec_id with different vectors are one node of their component; an empty table gives no rows; columns besides vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import Sieve
from crestline.operators.components import connected_components
from crestline.session import Scratch

BLOCK = 1_024
MISS = 1e-4
DEVIATIONS = 5.0
SEED = 20
LEVELS = 7  # of a component of a query form, on each side of 0
#: Columns of a row of a cell; those from the third on name the cell.
CELL = ("class", "block", "label", "dim", "slice", "key", "low", "high")


def plan(largest: int, threshold: float) -> tuple[int, int]:
    """Bits per slice and number of slices for labels of up to this many vectors."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, largest) / 128))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def _rotations(d: int, bits: int, seed: int) -> np.ndarray:
    """Orthogonal matrices of size d side by side, at least ``bits`` rows."""
    rng = np.random.default_rng([seed, d])
    made = [np.linalg.qr(rng.standard_normal((d, d)))[0].T for _ in range(-(-max(bits, d) // d))]
    return np.concatenate(made)


def _coded(x: np.ndarray, rotations: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code bits, packed code, correction factor, query form and its step of each vector."""
    d = x.shape[1]
    turned = (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32) @ rotations.T.astype(np.float32)
    bits, own = turned > 0, turned[:, :d]
    step = np.maximum(np.abs(own).max(axis=1), np.float32(1e-30)) / np.float32(LEVELS)
    dither = np.random.default_rng(SEED).random(own.shape, dtype=np.float32)
    query = np.clip(np.floor(own / step[:, None] + dither), -LEVELS, LEVELS).astype(np.int8) + np.int8(LEVELS + 1)
    query = np.pad(query, ((0, 0), (0, d % 2))).astype(np.uint8)
    return bits, np.packbits(bits, axis=1), np.abs(own).sum(axis=1) / np.float32(math.sqrt(d)), query[:, ::2] << 4 | query[:, 1::2], step


def _queries(packed: np.ndarray, d: int, step: np.ndarray) -> np.ndarray:
    """The query forms as numbers."""
    halves = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, :d]
    return (halves.astype(np.float32) - np.float32(LEVELS + 1)) * step[:, None]


def _keys(code_bits: np.ndarray, bits: int) -> np.ndarray:
    """The key of each slice: its bits as a number."""
    n = code_bits.shape[1] // bits
    return (code_bits[:, : n * bits].reshape(len(code_bits), n, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _undecided(table: pa.Table, bits: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one block, or of two, whose confidence bound reaches the threshold and that share no earlier slice."""
    d, slice_ = table["dim"][0].as_py(), table["slice"][0].as_py()
    code, query = np.unpackbits(_matrix(table["code"], np.uint8), axis=1), _matrix(table["query"], np.uint8)
    signs = code[:, :d].astype(np.float32) * 2 - 1
    f, step = table["factor"].to_numpy().astype(np.float32), table["step"].to_numpy().astype(np.float32)
    query = _queries(query, d, step)
    spread = DEVIATIONS * math.sqrt(1 - threshold * threshold) / math.sqrt(max(d - 1, 1))
    least = f * threshold - spread * np.sqrt(np.maximum(1 - f * f, 0)) - 1e-5
    keys = _keys(code, bits)[:, :slice_]
    block, low, high = table["block"].to_numpy(), table["low"][0].as_py(), table["high"][0].as_py()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    for r in range(0, len(left), BLOCK):
        for c in range(r if low == high else 0, len(right), BLOCK):
            some, others = left[r : r + BLOCK], right[c : c + BLOCK]
            estimate = signs[some] @ query[others].T / np.float32(math.sqrt(d))
            i, j = np.nonzero(estimate >= least[some][:, None] - (step[others] * np.float32(DEVIATIONS / 2))[None, :])
            i, j = some[i], others[j]
            fresh = i < j if low == high and r == c else i != j
            for earlier in range(slice_):
                fresh &= keys[i, earlier] != keys[j, earlier]
            yield i[fresh], j[fresh]


def _needed(table: pa.Table, bits: int, threshold: float) -> pa.Table:
    """The rows of a cell that have an undecided pair."""
    found = np.zeros(len(table), bool)
    for i, j in _undecided(table, bits, threshold):
        found[i] = found[j] = True
    return table.filter(pa.array(found)).select(CELL)


def _linked(table: pa.Table, bits: int, threshold: float) -> pa.Table:
    """Links and tree parents of the undecided pairs of a cell, recomputed exactly."""
    table = table.sort_by("rep")
    x = np.array(table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(table), -1)
    copies, rep = table["copies"].to_numpy(), table["rep"].to_numpy()
    norms = np.sqrt((x * x).sum(axis=1))
    links, trees = np.zeros(len(x), np.int64), np.arange(len(x))
    for i, j in _undecided(table, bits, threshold):
        for at in range(0, len(i), 200_000):
            a, b = i[at : at + 200_000], j[at : at + 200_000]
            near = (x[a] * x[b]).sum(axis=1) / (norms[a] * norms[b]) >= threshold
            np.add.at(links, a[near], copies[b[near]])
            np.add.at(links, b[near], copies[a[near]])
            trees = _merged(trees, a[near], b[near])
    some = np.flatnonzero(links)
    return pa.table({"class": table["class"].to_numpy()[some], "links": links[some], "rep": rep[some], "root": rep[trees[some]]})


def _merged(trees: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The tree of each row after rows i and j are joined pairwise; a tree is named by its smallest row."""
    while (apart := trees[i] != trees[j]).any():
        i, j = i[apart], j[apart]
        onto = np.arange(len(trees))
        np.minimum.at(onto, np.maximum(trees[i], trees[j]), np.minimum(trees[i], trees[j]))
        while (further := onto[onto]).tobytes() != onto.tobytes():
            onto = further
        trees = onto[trees]
    return trees


def _classes(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    ok = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    base = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].alias("label"), vectors["embedding"].cast(kind).alias("embedding"))
    return base.select("*", F.coalesce(ok, F.lit(False)).alias("ok"), F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(SEED), "embedding", "label").alias("h2"))


def _collapsed(rows: DataFrame, run: Scratch) -> DataFrame:
    """<label, h1, h2, rep, copies, embedding>: a row for each class."""
    twice = rows.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("h1").alias("mark"))
    met = Sieve.of(run.put(twice, "twice"), F.col("mark")).marked(rows, F.col("h1"))
    alone = met.filter("NOT __maybe").select("label", "h1", "h2", F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies"), "embedding")
    return alone.unionByName(met.filter("__maybe").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))


def coded(classes: DataFrame, bits: int, slices: int, seed: int) -> DataFrame:
    """Classes with codes, factors and query forms instead of vectors, and the keys of their slices."""
    need = bits * slices
    own = [c for c in classes.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = pc.list_value_length(b.column("embedding")).to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                x = np.array(part.column("embedding").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
                code_bits, code, factor, query, step = _coded(x, _rotations(int(d), need, seed))
                keys = _keys(code_bits, bits)[:, :slices]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, slices), pa.int32()), pa.array(keys.ravel()))
                raw = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (code, query)]
                made = [pa.array([int(d)] * len(part), pa.int32()), raw[0], pa.array(factor, pa.float32()), raw[1], pa.array(step, pa.float32()), lists]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *made], names=[*own, "dim", "code", "factor", "query", "step", "keys"])

    kinds = dict(classes.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in own) + ", dim int, code binary, factor float, query binary, step float, keys array<long>"
    return classes.mapInArrow(run, schema)


def near_vectors(vectors: DataFrame, threshold: float = 0.98, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors."""
    every = _classes(vectors)
    rows = every.filter("ok")
    with Scratch() as run:
        top = rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        bits, slices = plan(top, threshold)
        codes = run.put(coded(_collapsed(rows, run).withColumn("class", F.monotonically_increasing_id()), bits, slices, seed), "codes")
        live = codes.filter("rep IS NOT NULL")
        entries = live.select("label", "dim", F.posexplode("keys").alias("slice", "key"))
        buckets = entries.groupBy("label", "dim", "slice", "key").agg(F.count("*").alias("n")).filter("n > 1")
        buckets = buckets.select(*[F.col(c).alias(f"b_{c}") for c in ("label", "dim", "slice", "key")], F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        full = live.select("class", "label", "dim", "code", "factor", "query", "step", F.posexplode("keys").alias("slice", "key"))
        same = (F.col("label") == F.col("b_label")) & (F.col("dim") == F.col("b_dim")) & (F.col("slice") == F.col("b_slice")) & (F.col("key") == F.col("b_key"))
        dealt = full.join(buckets, same).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        # Dealt by cell, so that the blocks of a large bucket don't meet in one task.
        cells = cells.select(*CELL, "code", "factor", "query", "step").repartition(*CELL[2:])
        kinds = dict(cells.dtypes)
        needed = cells.groupBy(*CELL[2:]).applyInArrow(lambda t: _needed(t, bits, threshold), ", ".join(f"{c} {kinds[c]}" for c in CELL))
        needed = run.put(needed, "needed")
        # The vectors of these classes: a sieve spares all others the way, and of a class only rows with its smallest id go.
        own = Sieve.of(needed, F.xxhash64("class")).marked(live, F.xxhash64("class")).filter("__maybe").join(needed.select(F.col("class").alias("n_class")), F.col("class") == F.col("n_class"), "left_semi")
        own = run.put(own.select(F.col("class").alias("o_class"), F.col("label").alias("o_label"), F.col("h1").alias("o1"), F.col("h2").alias("o2"), "rep", "copies", "code", "factor", "query", "step"), "own")
        fetched = Sieve.of(own, F.col("o1")).marked(rows, F.col("h1")).filter("__maybe").select("vec_id", "label", "h1", "h2", "embedding")
        own = own.join(fetched, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")) & (F.col("label") == F.col("o_label")) & (F.col("vec_id") == F.col("rep")))
        own = own.select("o_class", "rep", "copies", "code", "factor", "query", "step", "embedding").dropDuplicates(["o_class"])
        whole = needed.join(own, F.col("class") == F.col("o_class")).drop("o_class").repartition(*CELL[2:])
        found = whole.groupBy(*CELL[2:]).applyInArrow(lambda t: _linked(t, bits, threshold), "class long, links long, rep long, root long")
        found = run.put(found, "cells")
        links = found.groupBy(F.col("class").alias("k_class")).agg(F.sum("links").alias("links"))
        parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), lambda df: run.put(df, "rounds"), drop=run.drop)
        placed = codes.select("class", "label", "h1", "h2", "rep", "copies").join(links, F.col("class") == F.col("k_class"), "left").join(parts, F.col("rep") == F.col("node"), "left")
        placed = placed.filter("copies > 1 OR links IS NOT NULL OR component IS NOT NULL").select(
            F.col("label").alias("c_label"), F.col("h1").alias("c1"), F.col("h2").alias("c2"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"),
        )
        placed = run.put(placed, "placed")
        # All other vectors have neither copies nor links.
        marked = Sieve.of(placed, F.col("c1")).marked(every.select("vec_id", "ok", "label", "h1", "h2"), F.col("h1"))
        met = marked.filter("ok AND __maybe").join(placed, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("label") == F.col("c_label")), "left")
        found = F.col("c1").isNotNull()
        met = met.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.when(found, F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
        alone = marked.filter("NOT (ok AND __maybe)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return run.leave(met.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), placed)


def op4_query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id WHERE r.c < l.b
), c AS (
  SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a
)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
