"""Toxicity as cumulative-link ordinal regression: severity grades from sparse word and word-beginning features,
one weight vector shared across ordered thresholds, and the expected severity as output.

Labels say only whether a text is toxic. The grade of a toxic training text is the number of distinct markers that it
holds of those that stand out in the other half of the training texts, so that no text is graded by what was learned from
itself. A text without a word (null, empty, blank) has severity 0. Without labelled rows of both kinds no text is toxic.
Texts of any length are read whole; rows that repeat get equal values, and of rows that repeat an id one is learned from. An
empty table has no values. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_WORDS, WordHasher, bound_batches, fresh, id_text, labelled_sample, release_memory, released, text_bytes, text_slices

#: Labelled documents that a fit reads at most.
MAX_TRAIN = 6000
SPACE_BITS = 22
#: Whole words, and the first so many bytes of longer words.
PREFIXES: tuple[int | None, ...] = (None, 4, 5, 6)
MIN_SUPPORT = 3
MIN_LIFT = 8.0
#: Distinct markers from which a toxic text has the next grade.
GRADE_STEPS = (1, 3, 6)
STEPS, RATE, RIDGE = 600, 0.1, 1e-4
#: Rejected if at least grade 1 is this likely.
REJECT = 0.3
HOLD_OUT = 5
_HASHER: WordHasher | None = None


def hasher() -> WordHasher:
    global _HASHER
    if _HASHER is None:
        _HASHER = WordHasher(ALNUM_WORDS, seed=8)
    return _HASHER


def feature_ids(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every word and of every proper word beginning."""
    h = hasher()
    starts, ends, rows = h.spans(data, off)
    size = ends - starts
    ids, at = [], []
    for k, (length, values) in enumerate(zip(PREFIXES, h.prefix_hashes(data, starts, ends, list(PREFIXES)), strict=True)):
        keep = slice(None) if length is None else size > length
        ids.append(((values[keep] + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - SPACE_BITS)).astype(np.int64))
        at.append(rows[keep])
    return np.concatenate(at), np.concatenate(ids)


@dataclass(frozen=True)
class SeverityModel:
    features: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, line: np.ndarray) -> np.ndarray:
        """Probability of a grade above each cut."""
        return 1 / (1 + np.exp(-np.clip(line[:, None] - self.cuts, -50, 50)))


def sparse_features(sample: DataFrame) -> DataFrame:
    """doc_id, value and the distinct feature ids of each text."""
    bound_batches(sample.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(2), []
            for first, last in text_slices(texts):
                data, off = text_bytes(texts.slice(first, last - first))
                rows, ids = feature_ids(data, off)
                lists += split_unique(rows, ids, last - first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "value", "ids"])

    return sample.mapInArrow(released(extract), T.StructType([sample.schema["doc_id"], sample.schema["value"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def split_unique(rows: np.ndarray, ids: np.ndarray, n: int) -> list[np.ndarray]:
    key = np.unique(rows << SPACE_BITS | ids)
    return np.split(key & ((1 << SPACE_BITS) - 1), np.searchsorted(key >> SPACE_BITS, np.arange(1, n)))


def fit_severity(docs: DataFrame, labels: DataFrame, value: str = "toxic", bound: int = MAX_TRAIN) -> SeverityModel | None:
    """Fit on at most ``bound`` labelled documents whose crc32(doc_id) mod 5 is not 0."""
    sample = labelled_sample(docs, labels, value, f"{id_text('doc_id')} % {HOLD_OUT} <> 0", bound)
    got = sparse_features(sample).toArrow().sort_by("doc_id").combine_chunks()
    if not len(got):
        return None
    ids = got["ids"].chunk(0)
    model = fit_grades(np.split(ids.values.to_numpy(), ids.offsets.to_numpy()[1:-1]), got["value"].to_numpy())
    del got, ids
    release_memory()
    return model


def _lifts(rows: np.ndarray, at: np.ndarray, toxic: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many toxic texts hold each of n features, and how much more often they do than the others."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    mark = toxic[rows]
    ones, zeros = np.bincount(at[mark], minlength=n), np.bincount(at[~mark], minlength=n)
    return ones, ((ones + 0.1) / (n1 + 0.2)) / ((zeros + 0.1) / (n0 + 0.2))


def fit_grades(lists: list[np.ndarray], toxic: np.ndarray) -> SeverityModel | None:
    toxic = np.asarray(toxic) == 1
    if not toxic.any() or toxic.all():
        return None
    # what too few toxic texts hold can be neither feature nor marker; the rest is few, and known by a place from here on
    often = np.bincount(np.concatenate([x for x, t in zip(lists, toxic, strict=True) if t]), minlength=1 << SPACE_BITS) >= MIN_SUPPORT
    known = np.flatnonzero(often)
    lists = [np.searchsorted(known, x[often[x]]) for x in lists]
    del often
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    ids = np.concatenate(lists)
    ones, lift = _lifts(rows, ids, toxic, len(known))
    features = np.flatnonzero((ones >= MIN_SUPPORT) & (lift >= MIN_LIFT))
    if not len(features):
        return None
    # each half of the texts is graded by the markers of the other half
    half = np.zeros(len(lists), bool)
    half[np.flatnonzero(toxic)[::2]] = half[np.flatnonzero(~toxic)[::2]] = True
    marks = np.zeros(len(lists), np.int64)
    for own in (half, ~half):
        theirs = ~own[rows]
        n, far = _lifts(rows[theirs], ids[theirs], toxic, len(known))
        marker = (n >= MIN_SUPPORT) & (far >= 4 * MIN_LIFT)
        marks += np.bincount(rows[~theirs], marker[ids[~theirs]], minlength=len(lists)).astype(np.int64)
    grade = np.where(toxic, np.maximum(1, np.searchsorted(GRADE_STEPS, marks, side="right")), 0)
    levels = int(grade.max())
    y = (grade[:, None] > np.arange(levels)).astype(np.float64)
    place = np.full(len(known), -1)
    place[features] = np.arange(len(features))
    held = place[ids] >= 0
    r, c = rows[held], place[ids[held]]  # the sparse table of features, rows in order
    w, cuts = np.zeros(len(features)), np.arange(1, levels + 1, dtype=np.float64)
    params = [w, cuts]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        line = np.bincount(r, w[c], minlength=len(lists))
        p = 1 / (1 + np.exp(-np.clip(line[:, None] - cuts, -30, 30)))
        d = (p - y) / len(y)
        grads = [np.bincount(c, d.sum(1)[r], minlength=len(w)) + RIDGE * w, -d.sum(0)]
        for v, g, m, s in zip(params, grads, mean, var, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        np.maximum.accumulate(cuts, out=cuts)  # thresholds stay ordered
    return SeverityModel(known[features], w.astype(np.float32), cuts)


def score_severity(docs: DataFrame, model: SeverityModel | None, id_col: str = "doc_id", text_col: str = "text", keep: str = "") -> DataFrame:
    """One row per document: expected severity, most likely grade, probability of any grade and the verdict.

    With ``keep`` the columns of ``docs`` stay and the four are added under names that begin with it.
    """
    bound_batches(docs.sparkSession)
    names = ["severity", "grade", "score", "toxic"]
    fields = [T.StructField(f"{keep}{n}", k) for n, k in zip(names, (T.DoubleType(), T.IntegerType(), T.DoubleType(), T.BooleanType()), strict=True)]
    own = docs if keep else docs.select(docs[id_col].alias(fresh(names, id_col)), docs[text_col].cast("string").alias("_text"))
    schema = T.StructType([*(own.schema.fields if keep else own.schema.fields[:1]), *fields])
    text_at = own.columns.index(text_col) if keep else 1
    packed = None if model is None else (model.features, model.weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = None
        if packed is not None:
            weights = np.zeros(1 << SPACE_BITS, np.float32)
            weights[packed[0]] = packed[1]
        for batch in batches:
            texts = batch.column(text_at)
            line = np.zeros(len(texts))
            worded = np.zeros(len(texts), bool)
            for first, last in text_slices(texts) if weights is not None else ():
                data, off = text_bytes(texts.slice(first, last - first))
                rows, ids = feature_ids(data, off)
                at = np.flatnonzero(weights[ids])
                key = np.unique(rows[at] << SPACE_BITS | ids[at])
                r = key >> SPACE_BITS
                line[first:last] = np.bincount(r, weights[key & ((1 << SPACE_BITS) - 1)], minlength=last - first)
                worded[first + np.unique(rows)] = True
            if model is None:
                above = np.zeros((len(texts), 1))
            else:
                above = np.where(worded[:, None], model.above(line), 0.0)
            grade = (above >= 0.5).sum(1)
            values = [pa.array(above.sum(1), pa.float64()), pa.array(grade, pa.int32()), pa.array(above[:, 0], pa.float64()), pa.array(above[:, 0] >= REJECT, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.columns if keep else batch.columns[:1]), *values], names=[f.name for f in schema])

    return own.mapInArrow(released(score), schema)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the fitted model rejects; every other row stays as it is."""
    model = fit_severity(docs, labels)
    mark = "_"
    while f"{mark}toxic" in docs.columns:
        mark += "_"
    scored = score_severity(docs, model, keep=mark)
    return scored.where(~F.col(f"{mark}toxic")).select(*[F.col(f"`{c}`") for c in docs.columns])
