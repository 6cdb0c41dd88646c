"""Sets of word shingles as sorted 64-bit hashes, for whole Arrow batches at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 500_000  # temporary arrays take some 60 times as much, in every Python worker
_U = np.uint64
_BASE = 0x9D39247E33776D41 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, SLICE_BYTES), base, dtype=_U)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lowered) and the number of its text. data: the texts' bytes; offsets: where each begins, and the end."""
    upper = (data >= 65) & (data <= 90)
    lower = data + (upper * np.uint8(32))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~blank
    before = np.r_[True, blank[:-1]] | edge[:-1]
    after = np.r_[blank[1:], True] | edge[1:]
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((lower.astype(_U) + _U(1)) * _powers(_BASE, len(data)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts], 1)
    return hashes, np.searchsorted(offsets[1:], starts, side="right")


def _shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct shingle, by number and then hash."""
    words, owner = _word_hashes(data, offsets)
    texts = len(offsets) - 1
    odd = [_U((2 * i + 1) * 0xA24BAED4963EE407 % (1 << 64) | 1) for i in range(k)]
    n = len(words) - k + 1
    full = np.zeros(0, _U)
    whose = np.zeros(0, np.int64)
    if n > 0:
        full = words[:n] * odd[0]
        for i in range(1, k):
            full = mix(full, 2) + words[i : i + n] * odd[i]
        ok = owner[:n] == owner[k - 1 :]
        full, whose = mix(full, 3)[ok], owner[:n][ok]
    counts = np.bincount(owner, minlength=texts)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(owner, short)
        few = np.full(len(short), 0x5851F42D4C957F2D, _U)
        for i in range(k - 1):
            has = counts[short] > i
            few[has] = mix(few[has], 4) + words[first[has] + i] * odd[i]
        full, whose = np.r_[full, mix(few, 5)], np.r_[whose, short]
    order = np.lexsort((full, whose))
    full, whose = full[order], whose[order]
    fresh = np.r_[True, (full[1:] != full[:-1]) | (whose[1:] != whose[:-1])][: len(full)]
    return whose[fresh], full[fresh]


def sets(text: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of the column: first and end row, sizes of the sets, and their hashes one after another (each set ascending)."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(text):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        part = data[offsets[row] : offsets[end]]
        if len(part):
            whose, values = _shingles(part, offsets[row : end + 1] - offsets[row], k)
            yield row, end, np.bincount(whose, minlength=end - row), values
        else:
            yield row, end, np.zeros(end - row, np.int64), np.zeros(0, _U)
        row = end
