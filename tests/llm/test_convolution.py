"""The byte network against plain convolution, and equal scores of equal texts."""

import random

import numpy as np
import pytest
from recallframe.llm import bytecnn as B


def network(seed):
    rng = np.random.default_rng(seed)
    net = B.ByteNet(rng.normal(0, 0.5, (257, B.DEPTH)).astype(np.float32), rng.normal(0, 0.3, (B.WIDTH * B.DEPTH, B.FILTERS)).astype(np.float32), rng.normal(0, 0.1, B.FILTERS).astype(np.float32), rng.normal(0, 0.5, B.FILTERS).astype(np.float32), np.zeros(1, np.float32))
    net.emb[256] = 0
    return net.exact()


def plain(net, text):
    """Maxima of all windows at even places, bytes behind the end being nothing."""
    data = list((text or "").encode())
    top = np.zeros(B.FILTERS)
    for at in range(0, len(data), B.STRIDE):
        window = data[at : at + B.WIDTH]
        x = np.concatenate([net.emb[window].astype(np.float64).reshape(-1), np.zeros((B.WIDTH - len(window)) * B.DEPTH)])
        top = np.maximum(top, x @ net.filters.astype(np.float64) + net.bias)
    return top


@pytest.mark.parametrize("chunk", [32, 100, 1 << 16])
def test_against_plain_convolution(spark, monkeypatch, chunk):
    monkeypatch.setattr(B, "CHUNK", chunk)
    rng = random.Random(chunk)
    net = network(chunk)
    texts = ["", "a", "é日本", "".join(rng.choice("abc é😀.") for _ in range(33)), *("".join(rng.choice("abcdefg ") for _ in range(rng.randint(1, 700))) for _ in range(20))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = net.pooled(data, off, net.stacked())
    assert np.abs(got - np.array([plain(net, t) for t in texts])).max() < 1e-6


def test_equal_texts_have_equal_scores(spark):
    rng = random.Random(5)
    net = network(7)
    texts = ["".join(rng.choice("abcdefg hijk") for _ in range(rng.randint(1, 900))) for _ in range(40)] + [None, ""]
    rows = [(i, texts[rng.randrange(len(texts))]) for i in range(3000)]
    got = B.score_quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), net).collect()
    seen = {}
    for r in got:
        seen.setdefault(dict(rows)[r.doc_id], set()).add((r.score, tuple(r.maxima)))
    assert len(got) == 3000 and all(len(v) == 1 for v in seen.values())


def test_sums_are_exact():
    net = network(1)
    rng = np.random.default_rng(2)
    x = net.emb[rng.integers(0, 257, (500, B.WIDTH))].reshape(500, -1)
    want = x.astype(np.float64) @ net.filters.astype(np.float64)
    for order in (slice(None), slice(None, None, -1), rng.permutation(x.shape[1])):
        assert np.array_equal((x[:, order] @ net.filters[order]).astype(np.float64), want)
