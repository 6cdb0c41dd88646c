"""Shared helpers of the training-data operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space and words as every contract here means them, in Java, RE2 and Python syntax alike.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the largest sieve: 2^18 words of 64 bits, some 10 MB where it is broadcast.
SIEVE_BITS = 1 << 24


def bounded_batches(spark: SparkSession, size: str = "16m") -> None:
    """Bound what one Arrow batch holds, so a run of very long texts can't fill a Python worker. It stays set: plans read it when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """<doc_id bigint, text>, whatever kind of integer the id is and whatever else docs has."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def text_or_empty(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value written as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n).cast("long"))


def running(sums: DataFrame, key: str, place: str, value: str, out: str, block: int = 1_024) -> DataFrame:
    """sums with out: the sum of value over rows of the same key at smaller places (whole numbers from 0, each once). Blocks of places are added
    up first, so that a key with very many places isn't one task."""
    cut = sums.withColumn("__block", F.floor(F.col(place) / block))
    ends = cut.groupBy(F.col(key).alias("__key"), F.col("__block").alias("__of")).agg(F.sum(value).alias("__sum"))
    ends = ends.withColumn("__before", F.sum("__sum").over(W.partitionBy("__key").orderBy("__of")) - F.col("__sum")).drop("__sum")
    within = F.sum(value).over(W.partitionBy(key, "__block").orderBy(place)) - F.col(value)
    met = cut.withColumn("__within", within).join(ends, (F.col(key) == F.col("__key")) & (F.col("__block") == F.col("__of")))
    return met.select(*sums.columns, (F.col("__before") + F.col("__within")).alias(out))


def _bit(place: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(place).bitwiseAND(F.lit(63)).cast("int"))


@dataclass
class Sieve:
    """A set of hashes as a bitmap of bounded size, for broadcast: rows that surely aren't in a table needn't be shuffled to meet it. What it lets
    through by chance is left to the exact step that follows; a full sieve lets everything through."""

    words: DataFrame
    bits: int

    @classmethod
    def of(cls, table: DataFrame, key: Column) -> Sieve:
        """Of the keys (long hashes) of a written table."""
        n = table.count()
        bits = min(SIEVE_BITS, max(64, 1 << (16 * n).bit_length()))
        place = F.pmod(key, F.lit(bits).cast("long")).alias("__place")
        words = table.select(place).select(F.shiftright("__place", 6).alias("__word"), _bit("__place").alias("__one"))
        return cls(words.groupBy("__word").agg(F.bit_or("__one").alias("__bits")), bits)

    def marked(self, df: DataFrame, key: Column) -> DataFrame:
        """df with __maybe: whether the key may be in the set."""
        there = df.withColumn("__at", F.pmod(key, F.lit(self.bits).cast("long")))
        met = there.join(F.broadcast(self.words), F.shiftright("__at", 6) == F.col("__word"), "left")
        hit = F.col("__bits").bitwiseAND(_bit("__at")) != 0
        return met.withColumn("__maybe", F.coalesce(hit, F.lit(False))).drop("__at", "__word", "__bits")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_order(docs: DataFrame) -> Column:
    """What decides between rows that are equal in doc_id and text: the other columns by name, those that have an order."""
    ordered = [c for c in sorted(docs.columns) if c != "text" and not any(kind in docs.schema[c].dataType.simpleString() for kind in ("map<", "variant", "void"))]
    return F.struct(*[docs[_quoted(c)] for c in ordered])


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs under a name that can't clash."""
    return F.struct(*[docs[_quoted(c)] for c in docs.columns]).alias("__row")
