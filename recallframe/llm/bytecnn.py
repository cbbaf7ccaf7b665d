"""Quality classifier: a byte-level convolutional network in numpy. Learned byte vectors pass through learned
filters over overlapping chunks that cover the whole text; each filter's maximum over all chunks enters one
logistic output.

A null or empty text gets the score of no evidence at all (all maxima zero). Without labels of both kinds every score is
0.5. Texts of any length are read whole, when the network learns too; equal texts get equal scores, as
the learned numbers are rounded until sums of their products are exact in single precision, in whatever order; ties with the
threshold count as reaching it. Of rows that repeat an id the network learns from one. An empty table has no scores. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fresh, id_text, labelled_sample, released, text_bytes, text_slices

#: Labelled documents that a fit reads at most, and bytes of their whole texts (one document at least).
MAX_TRAIN, MAX_TRAIN_BYTES = 2500, 6 << 20
HOLD_OUT = 5
THRESHOLD = 0.3
DEPTH, WIDTH, STRIDE, FILTERS = 8, 16, 2, 16
#: Bytes in a chunk; chunks overlap by a filter's width, so that no window is lost at a cut.
CHUNK = 1 << 16
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.01, 1e-4
_PIECES = WIDTH // STRIDE
#: Stands behind a text's end; its vector is zero.
_PAD = 256


@dataclass
class ByteNet:
    emb: np.ndarray  # 257 x DEPTH
    filters: np.ndarray  # WIDTH * DEPTH x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.emb, self.filters, self.bias, self.out, self.out_bias]

    def exact(self) -> ByteNet:
        """The network with byte vectors and filters rounded to multiples of powers of two, so that every sum of their products in a
        window is a whole number of quanta below 2**24: single precision then adds without error, on any machine."""
        bound = float((np.abs(self.emb).max(0)[None, :, None] * np.abs(self.filters).reshape(WIDTH, DEPTH, FILTERS)).sum((0, 1)).max())
        bits = 23 - max(0, int(np.ceil(np.log2(max(bound, 1e-9)))))
        low, high = 2.0 ** (bits // 2), 2.0 ** (bits - bits // 2)
        return replace(self, emb=(np.rint(self.emb * low) / low).astype(np.float32), filters=(np.rint(self.filters * high) / high).astype(np.float32))

    def stacked(self) -> np.ndarray:
        """Filters cut into stride-long pieces side by side: one product serves all pieces."""
        return np.ascontiguousarray(self.filters.reshape(_PIECES, STRIDE * DEPTH, FILTERS).transpose(1, 0, 2).reshape(STRIDE * DEPTH, _PIECES * FILTERS))

    def respond(self, ids: np.ndarray, stacked: np.ndarray) -> np.ndarray:
        """Each filter's response at every position of the stride."""
        y = self.emb[ids].reshape(-1, STRIDE * DEPTH) @ stacked
        n = len(y) - _PIECES + 1
        r = y[:n, :FILTERS].copy()
        for j in range(1, _PIECES):
            r += y[j : j + n, j * FILTERS : (j + 1) * FILTERS]
        return r

    def pooled(self, data: np.ndarray, off: np.ndarray, stacked: np.ndarray) -> np.ndarray:
        """Maxima over all chunks of each text (zero at least)."""
        out = np.zeros((len(off) - 1, FILTERS), np.float32)
        for owner, _, ids, first, n in groups(data, off):
            r = self.respond(ids, stacked)
            edges = np.stack([first, first + n], 1).reshape(-1)[:-1]  # what lies between two chunks is not looked at
            np.maximum.at(out, owner, np.maximum.reduceat(r[: first[-1] + n[-1]], edges)[::2] + self.bias)
        return out

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        logit = np.add.reduce(pooled.astype(np.float64) * self.out, axis=1) + float(self.out_bias[0])
        return np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 9)


def groups(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of all texts side by side, about CHUNK bytes at a time: the text and its place that each chunk comes from, the
    padded bytes of all, and each chunk's first window and number of windows."""
    held: list[tuple[int, int, int]] = []  # text, from, to
    size = 0

    def close() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        # a chunk with more of its text behind it has windows up to the next one's first
        n = np.array([-(-(b - a) // STRIDE) if b == off[t + 1] else CHUNK // STRIDE for t, a, b in held])
        length = np.array([-(-(b - a) // STRIDE) for _, a, b in held])
        first = np.concatenate([[0], np.cumsum(length + _PIECES - 1)])
        ids = np.full(int(first[-1]) * STRIDE, _PAD, np.int16)
        for (_, a, b), at in zip(held, first.tolist(), strict=False):
            ids[at * STRIDE : at * STRIDE + b - a] = data[a:b]
        return np.array([t for t, _, _ in held]), np.array([a for _, a, _ in held]), ids, first[:-1], n

    for t in range(len(off) - 1):
        for a in range(int(off[t]), int(off[t + 1]), CHUNK):
            b = min(int(off[t + 1]), a + CHUNK + WIDTH - STRIDE)
            if held and size + b - a > CHUNK:
                yield close()
                held, size = [], 0
            held.append((t, a, b))
            size += b - a
    if held:
        yield close()


def train(texts: list[bytes], target: np.ndarray, seed: int = 3) -> ByteNet | None:
    """Adam on the logistic loss; the gradient of a maximum flows to the one window that attained it."""
    if len(set(target.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    net = ByteNet(rng.normal(0, 0.3, (257, DEPTH)).astype(np.float32), rng.normal(0, 0.2, (WIDTH * DEPTH, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(1, np.float32))
    net.emb[_PAD] = 0
    mean, var = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    step = 0
    columns = np.arange(FILTERS)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            stacked, kernel = net.stacked(), net.filters.reshape(WIDTH, DEPTH, FILTERS)
            data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])
            top = np.full((len(rows), FILTERS), -np.inf, np.float32)
            window = np.full((len(rows), FILTERS, WIDTH), _PAD, np.int16)
            for owner, _, ids, first, n in groups(data, off):
                r = net.respond(ids, stacked)
                for t, a, m in zip(owner.tolist(), first.tolist(), n.tolist(), strict=True):
                    at = a + r[a : a + m].argmax(0)
                    value = r[at, columns]
                    for f in np.flatnonzero(value > top[t]):
                        top[t, f] = value[f]
                        window[t, f] = ids[at[f] * STRIDE : at[f] * STRIDE + WIDTH]
            top = np.where(np.isfinite(top), top + net.bias, 0)
            h = np.maximum(top, 0)
            d = ((net.scores(h) - target[rows]) / len(rows)).astype(np.float32)
            g = d[:, None] * net.out * (top > 0)
            x = net.emb[window].reshape(len(rows), FILTERS, WIDTH * DEPTH)
            flow = np.einsum("nf,wdf->nfwd", g, kernel)
            emb = np.stack([np.bincount(window.reshape(-1), flow[..., c].reshape(-1), minlength=257) for c in range(DEPTH)], 1)
            emb[_PAD] = 0
            grads = [emb.astype(np.float32), np.einsum("nf,nfk->kf", g, x), g.sum(0), h.T @ d, np.array([d.sum()], np.float32)]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for v, dv, m, s in zip(net.params(), grads, mean, var, strict=True):
                dv = dv + DECAY * v
                m += 0.1 * (dv - m)
                s += 0.001 * (dv * dv - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, value: str = "quality", bound: int = MAX_TRAIN, bytes_bound: int = MAX_TRAIN_BYTES) -> ByteNet | None:
    """Train on at most ``bound`` labelled documents (``bytes_bound`` bytes of whole texts) whose crc32(doc_id) mod 5 is
    not 0. Neither ids nor labels are inputs; the order of training follows the texts."""
    sample = labelled_sample(docs, labels, value, f"{id_text('doc_id')} % {HOLD_OUT} <> 0", bound, bytes_bound)
    got = sample.select(F.md5(F.coalesce("text", F.lit(""))).alias("at"), "text", "value").toArrow().sort_by([("at", "ascending"), ("value", "ascending")])
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in got["text"].to_pylist()]
    net = train(texts, np.asarray(got["value"].to_pylist(), dtype=np.float32))
    return net and net.exact()


def score_quality(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: probability of good quality and each filter's maximum. One pass, no shuffle."""
    bound_batches(docs.sparkSession)
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([T.StructField(fresh(["score", "maxima"], id_col), docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("maxima", T.ArrayType(T.FloatType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacked = None if net is None else net.stacked()
        for batch in batches:
            texts = batch.column(1)
            pooled = np.zeros((len(texts), FILTERS), np.float32)
            for first, last in text_slices(texts) if net is not None else ():
                data, off = text_bytes(texts.slice(first, last - first))
                pooled[first:last] = net.pooled(data, off, stacked)
            values = np.full(len(texts), 0.5) if net is None else net.scores(pooled).astype(np.float64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, pooled.size + 1, FILTERS), pa.int32()), pa.array(pooled.reshape(-1), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), flat], names=[f.name for f in schema])

    return own.mapInArrow(released(score), schema)
