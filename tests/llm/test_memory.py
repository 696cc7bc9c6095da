"""What Python workers hold beside their input: an executor has several of them."""

import tracemalloc

import numpy as np

from runnel.llm import language_id
from runnel.llm.core import WHITE, WordHasher, groups


def peak_mb(f) -> float:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_words_of_a_batch():
    texts = [f"word{k} and some others of a text " * 100 for k in range(1500)]

    def words():
        hasher = WordHasher(WHITE)
        for at, to in groups(texts):
            hasher.words(texts[at:to])

    assert peak_mb(words) < 30


def test_machine_of_many_rows():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 512), np.float32)
    y = np.where(x[:, 0] + 0.1 * rng.random(4000) > 0.55, 1.0, -1.0)
    found = []
    assert peak_mb(lambda: found.append(language_id.support_vectors(x, y, 1e-4, 25))) < 2 * x.nbytes / 1e6 + 6
    assert ((x @ found[0][:-1] + found[0][-1] > 0) == (y > 0)).mean() > 0.97
