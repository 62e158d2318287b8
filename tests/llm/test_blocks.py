"""Texts are looked at in small blocks: the same results, and memory that does not follow the batch."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from clickloom.llm import ngram_join, quality, textblocks


def make_texts(n, words):
    rnd = random.Random(n)
    vocab = ["".join(rnd.choice("abcé#D") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    return ["".join(rnd.choice(vocab) + rnd.choice([" ", " ", "\n"]) for _ in range(words)) for _ in range(n)]


def peak_mb(run):
    run()  # the powers of the hash are made once
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_memory_follows_small_blocks():
    texts = make_texts(800, 400)
    assert sum(map(len, texts)) > 1_500_000
    column = pa.array(texts)
    assert peak_mb(lambda: quality.statistics(column)) < 25
    million = next(textblocks.blocks(texts))[1]
    assert peak_mb(lambda: ngram_join.shingle_sets(million, 4)) < 25


@pytest.mark.parametrize("chars", [1, 60, 250_000])
def test_blocks_do_not_change_results(monkeypatch, chars):
    texts = ["", *make_texts(9, 12), None, "two words", "", " \n", None]
    for module in (quality, ngram_join):
        monkeypatch.setattr(module, "SMALL_BLOCK_CHARS", chars)
    got = quality.statistics(pa.array(texts))
    t, h, sizes = ngram_join.shingle_sets([x or "" for x in texts], 4)
    for i, x in enumerate(texts):
        alone = quality.statistics([x])
        assert all(got[c][i] == alone[c][0] for c in alone)
        _, own, size = ngram_join.shingle_sets([x or ""], 4)
        assert sizes[i] == size[0] and np.array_equal(h[t == i], own)
