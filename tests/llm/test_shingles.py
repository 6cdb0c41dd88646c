"""What a Python worker holds while it makes sets of shingles."""

import tracemalloc

import numpy as np
import pyarrow as pa

from crestline.llm import shingles


def test_sets_of_many_texts_take_little_memory():
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = pa.array([" ".join(rng.choice(words, 700)) for _ in range(1000)])
    shingles._POWERS.clear()
    tracemalloc.start()
    sizes = [sizes for _, _, sizes, _ in shingles.sets(texts, 4)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, sizes)) == 1000 and peak < 40e6
