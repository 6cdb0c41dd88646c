"""The corpus pipeline: five operators in a row, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crestline.llm import stages
from crestline.llm.common import documents
from crestline.session import Scratch

STAGES = [
    ("quality_classifier", stages.quality),
    ("exact_dedup", stages.exact),
    ("ngram_jaccard", stages.near),
    ("mixing", stages.mix),
    ("packing", stages.packing),
]

#: The classifier is fitted and the tokenizer has no SQL form, so tests hold this against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written before the next one reads it, and deleted once that one is written."""
    docs = documents(spark, sf_dir)
    with Scratch() as tables:
        for name, stage in STAGES:
            with Scratch() as own:  # what a stage leaves isn't read any more once its result is written
                made = own.put(stage(spark, docs, sf_dir), name)
                own.leave(made, made)
            tables.drop(docs)
            docs = made
        return tables.leave(docs, docs)
