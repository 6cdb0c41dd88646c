"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 10).

Training rows (``crc32(doc_id as text) mod 4 <> 2``, non-null lang) are counted per language; at most about ``per_language``
of each, chosen by a hash of doc_id, give n-gram counts (the bound is a parameter; the priors count all of them). The
log-probability matrix has one row of 3 * ``buckets`` float32 per language and is broadcast after a check of its size.
Every whole text is scored in numpy over slices of bounded length.

Defined results: a null text, or one without letters, is ``und`` with score 0; so is every text if there is nothing to learn
from; ties go to the language first by code point; repeated rows repeat; an empty table gives no rows; columns besides
doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import bounded_batches, crc_mod, ids_and_texts

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
MODEL_BYTES = 400_000_000
SLICE = 400_000  # characters handled at a time
_MIX = np.uint32(0x9E3779B1)


def _slices(texts: list[str]) -> Iterator[tuple[list[int], list[str], int]]:
    """Numbers and lower-cased parts of texts, together of bounded length, and how far the first part reaches back over the one before."""
    ids, parts, held, back = [], [], 0, 0
    for i, text in enumerate(texts):
        text = text.lower()
        for at in range(0, len(text), SLICE):
            if at:
                if ids:
                    yield ids, parts, back
                ids, parts, held, back = [], [], 0, max(ORDERS) - 1
            part = text[max(0, at - max(ORDERS) + 1) : at + SLICE]
            ids.append(i)
            parts.append(part)
            held += len(part)
            if held >= SLICE:
                yield ids, parts, back
                ids, parts, held, back = [], [], 0, 0
    if ids:
        yield ids, parts, back


def _grams(lower: list[str], buckets: int, back: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the part, bucket) of each n-gram, for each order; none crosses parts, none lies in the first ``back`` characters."""
    parts = lower
    sizes = np.array([len(p) for p in lower])
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    h = np.zeros(len(codes), np.uint32)
    for k, order in enumerate(ORDERS):
        n = len(codes) - order + 1
        if n <= 0:
            return
        h = (h[:n] + codes[order - 1 :] + np.uint32(1)) * _MIX
        h ^= h >> np.uint32(15)
        ok = owner[:n] == owner[order - 1 :]
        ok[: max(0, back - order + 1)] = False
        yield owner[:n][ok], ((h[ok] * np.uint32(0x85EBCA6B)) >> shift).astype(np.int64) + k * buckets


def _count(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            own = counts.setdefault(lang, np.zeros(len(ORDERS) * buckets, np.int64))
            for _, parts, back in _slices(texts):
                for _, cells in _grams(parts, buckets, back):
                    own += np.bincount(cells, minlength=len(own))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], names=["lang", "counts"])


def fit(docs: DataFrame, per_language: int = 5_000, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages by code point, their log priors, and log probabilities by cell and language."""
    bounded_batches(docs.sparkSession)
    train = docs.filter(docs["lang"].isNotNull() & (crc_mod(docs["doc_id"], 4) != 2)).select("doc_id", "text", "lang")
    most = MODEL_BYTES // (len(ORDERS) * buckets * 4)
    rows = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if len(rows) > most:
        raise ValueError(f"more than {most} languages: the model would exceed {MODEL_BYTES} bytes; lower buckets")
    langs = sorted(rows, key=lambda s: s.encode())
    if not langs:
        return [], np.zeros(0), np.zeros((0, 0), np.float32)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_language / rows[lang]))])
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(10)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = train.filter(unit < F.element_at(share, F.col("lang"))).select("text", "lang").repartition(16)
    blobs = some.mapInArrow(lambda it: _count(it, buckets), "lang string, counts binary")

    def total(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(ORDERS) * buckets, np.int64)
        for blob in group["counts"]:
            out += np.frombuffer(blob, np.int64)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "counts": [out.tobytes()]})

    got = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in blobs.groupBy("lang").applyInPandas(total, "lang string, counts binary").toLocalIterator()}
    matrix = np.zeros((len(ORDERS) * buckets, len(langs)), np.float32)
    for j, lang in enumerate(langs):
        for k in range(len(ORDERS)):
            own = got[lang][k * buckets : (k + 1) * buckets] if lang in got else np.zeros(buckets)
            matrix[k * buckets : (k + 1) * buckets, j] = np.log((own + SMOOTHING) / (own.sum() + SMOOTHING * buckets))
    priors = np.log(np.array([rows[lang] for lang in langs]) / sum(rows.values()))
    return langs, priors, matrix


def score_texts(texts: list[str | None], langs: list[str], priors: np.ndarray, matrix: np.ndarray) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its posterior probability."""
    if not langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    logs = np.tile(priors, (len(texts), 1)).astype(np.float64)
    judged = [bool(t) and any(map(str.isalpha, t)) for t in texts]
    for ids, parts, back in _slices([t if ok else "" for t, ok in zip(texts, judged, strict=True)]):
        at = np.array(ids)
        for owner, cells in _grams(parts, len(matrix) // len(ORDERS), back):
            if not len(owner):
                continue
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            np.add.at(logs, at[owner[first]], np.add.reduceat(matrix[cells], first, axis=0, dtype=np.float64))
    best = logs.argmax(axis=1)
    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
    top = 1.0 / odds.sum(axis=1)
    return [langs[b] if ok else "und" for b, ok in zip(best, judged, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(top, judged, strict=True)]


def identify(docs: DataFrame, per_language: int = 5_000, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, per_language, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = score_texts(b.column(1).to_pylist(), *model.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    scored = ids_and_texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
