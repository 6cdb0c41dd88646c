"""Token counts by overlap resynchronisation (operator 6).

Texts of up to ``chunk_chars`` are encoded whole, in batches of bounded size, by the faster of two libraries where both give the same ids. A longer text is encoded in
overlapping chunks with offsets. Two neighbouring chunks are spliced at a position where both begin a word of the
pre-tokenizer: its matches look ahead only, so from a common match boundary on both chunks see the same words. A boundary counts as stable if
it lies at least ``MARGIN`` characters before the end of the left chunk (nothing that decides it is cut off there) and behind
the first word of the right chunk. Without a stable common boundary the overlap doubles; once it would reach
back over the left chunk's own splice, the left chunk grows instead, in the worst case to the whole text.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated rows; an empty table gives
an empty table; columns besides doc_id and text are ignored; a null doc_id is kept as null.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import bounded_batches, ids_and_texts

MARGIN = 64  # longer than any special string or contraction the pre-tokenizer looks at
BATCH_CHARS = 400_000
_LOADED: dict[str, object] = {}
_RANKED: dict[str, object] = {}


def load(path: str):
    """The tokenizer at path, once per Python worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def _visible_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(path: str):
    """text -> ids by the rank-merging library from the vocabulary in a tokenizers file, if it is byte-level with merges in id order: then both
    libraries give the same ids (tests compare them over all code points). None for any other file."""
    if not path.endswith(".json"):
        return None
    spec = json.load(open(path, encoding="utf-8"))
    pre, vocab, merges = spec.get("pre_tokenizer") or {}, spec["model"]["vocab"], spec["model"].get("merges") or []
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    made = [vocab["".join(p)] for p in pairs if "".join(p) in vocab]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and not spec.get("normalizer")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if not plain or len(made) < len(pairs) or any(a >= b for a, b in zip(made, made[1:])) or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    import public_tokenizers
    import tiktoken

    table = _visible_bytes()
    ranks = {bytes(table[c] for c in token): i for token, i in vocab.items() if token not in special}
    fast = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: np.asarray(fast.encode_to_numpy(text, allowed_special="all"), dtype="<u4")


def ranked(path: str):
    """_ranked(path), made once per Python worker."""
    if path not in _RANKED:
        _RANKED[path] = _ranked(path)
    return _RANKED[path]


def encoder(path: str):
    """text -> ids as the tokenizers library gives them, by the faster library where both agree. The faster one refuses some texts, such as
    those with a million white spaces in a row; the tokenizers library encodes these."""
    fast = ranked(path)

    def whole(text: str) -> np.ndarray:
        return np.asarray(load(path).encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(text: str) -> np.ndarray:
        try:
            return fast(text)
        except ValueError:
            return whole(text)

    return encode if fast else whole


def _word_starts(encoding, text: str, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Global positions where a word starts with a visible character, and the index of its first token."""
    words = np.array([-1 if w is None else w for w in encoding.word_ids], dtype=np.int64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (words[1:] < 0)])
    offsets = encoding.offsets  # a property that builds its list anew at each use
    at = np.array([offsets[i][0] for i in first], dtype=np.int64)
    ok = np.array([a < len(text) and not text[a].isspace() for a in at], dtype=bool)
    return at[ok] + base, first[ok]


def spliced_count(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """Tokens of text, from overlapping chunks; equal to encoding it at once."""

    def encode(begin: int, end: int):
        part = text[begin:end]
        got = tokenizer.encode(part, add_special_tokens=False)
        at, index = _word_starts(got, part, begin)
        return len(got.ids), at, index

    total, begin, end = 0, 0, min(chunk, len(text))
    left = encode(begin, end)
    used, splice = 0, 0  # tokens of the left chunk already counted by its predecessor, and where its own part begins
    while end < len(text):
        width = overlap
        found = None
        while found is None and end - width > splice:
            right_begin, right_end = end - width, min(end - width + chunk + width, len(text))
            right = encode(right_begin, right_end)
            common = np.intersect1d(left[1], right[1])
            first_word = right[1][0] if len(right[1]) else right_end
            stable = common[(common > max(splice, first_word, right_begin + 1)) & (common <= end - MARGIN)]
            if len(stable):
                found = int(stable[0])
            else:
                width *= 2
        if found is None:  # no common boundary: the left chunk grows
            end = min(end + max(chunk, end - begin), len(text))
            grown = encode(begin, end)
            used = int(grown[2][np.searchsorted(grown[1], splice)]) if splice else 0
            left = grown
            continue
        total += int(left[2][np.searchsorted(left[1], found)]) - used
        used, splice = int(right[2][np.searchsorted(right[1], found)]), found
        left, begin, end = right, right_begin, right_end
    return total + left[0] - used


def _counts(texts: list[str], path: str, chunk: int, overlap: int) -> list[int]:
    tokenizer, fast = load(path), ranked(path)
    out = [0] * len(texts)
    if path.endswith(".model"):  # no offsets to splice by: whole texts
        for i, text in enumerate(texts):
            out[i] = len(tokenizer.encode(text, num_threads=1)) if text else 0
        return out
    batch, held = [], 0

    def flush() -> None:
        for i, got in zip(batch, tokenizer.encode_batch_fast([texts[i] for i in batch], add_special_tokens=False), strict=True):
            out[i] = len(got.ids)
        batch.clear()

    for i, text in enumerate(texts):
        if len(text) > chunk and fast:  # splicing is proven for the byte-level pre-tokenizer; with others whole texts are encoded
            out[i] = spliced_count(tokenizer, text, chunk, overlap)
        elif text and fast:
            out[i] = len(fast(text))
        elif text:
            batch.append(i)
            held += len(text)
            if held >= BATCH_CHARS:
                flush()
                held = 0
    flush()
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, chunk_chars: int = 32_768, overlap_chars: int = 1_024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs."""
    if overlap_chars <= 2 * MARGIN or chunk_chars <= 2 * overlap_chars:
        raise ValueError("chunk_chars must exceed twice overlap_chars, and that twice the margin")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            n = pa.array(_counts(text.to_pylist(), tokenizer_path, chunk_chars, overlap_chars), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.cast(pc.binary_length(text), pa.int64()), n], names=["doc_id", "n_bytes", "n_tokens"])

    counted = ids_and_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
