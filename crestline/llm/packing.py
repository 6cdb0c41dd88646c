"""Packing by shortest-pack-first over the length histogram (operator 1).

1. One pass tokenizes each text and cuts it, by itself, into pieces of ``max_length`` tokens and a rest; only piece
   lengths and checksums leave the Python workers.
2. The driver gets the histogram of piece lengths (at most ``max_length`` rows) and places lengths longest first: each
   length goes into the emptiest open pack that it fits (the shortest pack), updating counts of packing patterns rather than single packs.
3. Pieces are ranked within their length by a distributed prefix sum over hash shards (a length that a third of
   all rows share is spread over all shards) and joined back to the pattern slots by rank.

Defined results: a null or empty text is the single closing id; repeated rows are packed as rows of their own; an empty table gives
no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crestline.llm.common import bounded_batches, ids_and_texts, running
from crestline.llm.tokens import encoder
from crestline.session import Scratch

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SHARD_ROWS = 400


def pieces(docs: DataFrame, tokenizer_path: str, max_length: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4")
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                rows += [(doc, at, len(p := ids[at : at + max_length]), zlib.crc32(p.tobytes()), len(ids)) for at in range(0, len(ids), max_length)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return ids_and_texts(docs).mapInArrow(run, PIECES)


def patterns(histogram: dict[int, int], max_length: int) -> list[tuple[int, tuple[int, ...]]]:
    """(packs, lengths in a pack), by shortest pack first over the histogram."""
    free: list[list[list]] = [[] for _ in range(max_length + 1)]  # by space left: [packs, lengths]
    done: list[tuple[int, tuple[int, ...]]] = []
    most = 0  # largest space left in any open pack
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while most and not free[most]:
                most -= 1
            if most < length:
                if length == max_length:
                    done.append((left, (length,)))
                else:
                    free[max_length - length].append([left, (length,)])
                    most = max(most, max_length - length)
                break
            top = free[most][-1]
            n = min(left, top[0])
            if n == top[0]:
                free[most].pop()
            else:
                top[0] -= n
            left -= n
            if space := most - length:
                free[space].append([n, (*top[1], length)])
            else:
                done.append((n, (*top[1], length)))
    return done + [(n, lengths) for space in free for n, lengths in space]


def slots(found: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of each place in each pattern."""
    out, used, sequence = [], {}, 0
    for n, lengths in found:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            out.append((length, rank, rank + n, sequence, offset))
            used[length] = rank + n
            offset += length
        sequence += n
    return out


def located(places: list[tuple[int, int, int, int, int]], histogram: dict[int, int]) -> tuple[dict[int, int], list[tuple]]:
    """For each length a width of rank buckets, as wide as its slots are on average, and the slots with each bucket that they reach into: a rank
    then meets the few slots of its bucket only, and there are at most twice as many rows as slots."""
    count: dict[int, int] = {}
    for length, *_ in places:
        count[length] = count.get(length, 0) + 1
    width = {length: -(-n // count[length]) for length, n in histogram.items()}
    return width, [(length, at, lo, hi, first, offset) for length, lo, hi, first, offset in places for at in range(lo // width[length], (hi - 1) // width[length] + 1)]


def pack(docs: DataFrame, tokenizer_path: str, max_length: int = 2048, end_id: int = 1) -> DataFrame:
    """Each piece with its sequence_id and offset."""
    spark = docs.sparkSession
    with Scratch() as run:
        cut = run.put(pieces(docs, tokenizer_path, max_length, end_id), "pieces")
        histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_length rows
        width, places = located(slots(patterns(histogram, max_length)), histogram)
        # As many shards as a length needs; a row for each length, so at most max_length rows are broadcast.
        shards = spark.createDataFrame([(length, -(-n // SHARD_ROWS), width[length]) for length, n in histogram.items()], "h_length long, shards long, width long")
        sharded = cut.join(F.broadcast(shards), F.col("length") == F.col("h_length")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.col("shards")))
        before = sharded.groupBy("length", "shard").agg(F.count("*").alias("n"))
        before = running(before, "length", "shard", "n", "before").drop("n")
        within = W.partitionBy("length", "shard").orderBy("doc_id", "start", "ids_crc32")
        ranked = sharded.withColumn("r", F.row_number().over(within).cast("long") - 1).join(before, ["length", "shard"]).withColumn("rank", F.col("before") + F.col("r"))
        table = spark.createDataFrame(places, "s_length long, at long, lo long, hi long, first long, offset long")  # bounded by lengths and patterns, not by rows
        bucket = F.floor(F.col("rank") / F.col("width")) == F.col("at")
        out = ranked.join(F.broadcast(table), (F.col("length") == F.col("s_length")) & bucket & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"
        )
        return run.leave(out, cut)


def op1_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
