"""Language identification as mixture inference: expectation-maximisation estimates each document's language
proportions from byte n-gram likelihoods, and a penalised likelihood selects the set of languages.

A null text, or one without a letter, is ``und`` with score 0, as is every text while no language is known. A text with a
letter but no known n-gram gets the language with the most documents. Ties go to the language that sorts first. Texts of any
length are read whole; rows that repeat count as often as they come when languages are learned and get equal results. An
empty table teaches nothing and has no results. Columns other than id, text and lang are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_WORDS, bound_batches, fresh, lower_ascii_table, released, text_bytes, text_slices

BUCKETS = 1 << 15
SMOOTHING = 0.5
EM_STEPS = 12
#: Times log(n) that a further language must gain in log-likelihood.
PENALTY = 3.0
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.where(ALNUM_WORDS | ((np.arange(256) >= 65) & (np.arange(256) <= 90)), lower_ascii_table(), 0x20)
_FOLD[ord("0") : ord("9") + 1] = 0x20
_FOLD = _FOLD.astype(np.uint32)


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram over letters and gaps; BUCKETS where two of the three bytes are gaps."""
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    x = _FOLD[data]
    a, b, c = x[:-2], x[1:-1], x[2:]
    h = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    h = h >> np.uint32(17)
    gaps = (a == 0x20).view(np.uint8) + (b == 0x20).view(np.uint8) + (c == 0x20).view(np.uint8)
    h[gaps >= 2] = BUCKETS
    return h


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    like: np.ndarray  # language x bucket
    prior: np.ndarray | None = None  # share of each language among the documents

    def usual(self) -> int:
        return 0 if self.prior is None else int(np.argmax(self.prior))

    def gain(self, p: np.ndarray, counts: np.ndarray, chosen: list[int]) -> tuple[float, np.ndarray]:
        """Penalised log-likelihood of a set of languages, and their proportions."""
        n = counts.sum()
        pi = mixture(p[chosen], counts, n)
        return float(np.log(pi @ p[chosen]) @ counts) - PENALTY * np.log(max(n, 2)) * (len(chosen) - 1), pi

    def infer(self, counts: np.ndarray, buckets: np.ndarray) -> tuple[list[str], np.ndarray, str, float]:
        """Selected languages, their proportions, the main one and its share."""
        p = self.like[:, buckets]
        full = mixture(p, counts, counts.sum())
        best = int(np.argmax(np.log(p) @ counts))
        chosen, (level, share) = [best], self.gain(p, counts, [best])
        rest = [int(i) for i in np.argsort(-full, kind="stable") if i != best]
        while rest:  # the languages that the whole mixture weighs most come first; the penalty alone ends it
            trial = [*chosen, rest[0]]
            value, pi = self.gain(p, counts, trial)
            if value <= level:
                break
            chosen, level, share = trial, value, pi
            rest.pop(0)
            while len(chosen) > 2:  # one that was taken before may have become needless
                fewer = [[x for x in chosen if x != c] for c in chosen]
                values = [self.gain(p, counts, f) for f in fewer]
                k = int(np.argmax([v[0] for v in values]))
                if values[k][0] <= level:
                    break
                chosen, (level, share) = fewer[k], values[k]
        k = int(np.argmax(share))
        return [self.langs[i] for i in chosen], share, self.langs[chosen[k]], float(min(1.0, full[chosen[k]]))


def mixture(p: np.ndarray, counts: np.ndarray, n: float) -> np.ndarray:
    """Proportions of the rows of ``p`` by expectation-maximisation from equal shares."""
    pi = np.full(len(p), 1 / len(p))
    for _ in range(EM_STEPS if len(p) > 1 else 0):
        pi = pi * (p @ (counts / (pi @ p))) / n
        pi /= pi.sum()
    return pi


def language_counts(docs: DataFrame) -> DataFrame:
    """Counts of each language's buckets over all documents of ``docs`` (lang, text), and of its documents under the bucket
    BUCKETS: lang, bucket, n."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts_of: Counter[str] = Counter()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts_of.update(langs)
            texts = batch.column(1)
            for first, last in text_slices(texts):
                data, off = text_bytes(texts.slice(first, last - first))
                h = gram_buckets(data)
                for i in range(last - first):
                    own = h[off[i] : max(off[i], off[i + 1] - 2)]
                    s = sums.setdefault(langs[first + i], np.zeros(BUCKETS + 1, np.int64))
                    s += np.bincount(own, minlength=BUCKETS + 1)
        for lang, s in sums.items():
            s[BUCKETS] = texts_of[lang]
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(s[at], pa.int64())], names=["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(released(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel | None:
    """Learn every non-null language of ``docs`` from all its texts. What reaches the driver is at most BUCKETS
    counts for each language, however many documents there are."""
    own = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text")).where("lang is not null and text is not null")
    got = language_counts(own).toArrow()
    if not len(got):
        return None
    names, which = np.unique(np.array(got["lang"].to_pylist(), dtype=object).astype(str), return_inverse=True)
    table = np.full((len(names), BUCKETS + 1), SMOOTHING)
    table[which, got["bucket"].to_numpy()] += got["n"].to_numpy()
    prior, table = table[:, BUCKETS], table[:, :BUCKETS]
    return LanguageModel(tuple(str(x) for x in names), table / table.sum(1, keepdims=True), prior / prior.sum())


def identify_languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: predicted language, its share, and all selected languages with their proportions."""
    bound_batches(docs.sparkSession)
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    fields = T._parse_datatype_string("lang_pred string, score double, langs array<string>, shares array<double>").fields
    schema = T.StructType([T.StructField(fresh([f.name for f in fields], id_col), docs.schema[id_col].dataType), *fields])

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            rows: list[tuple[str, float, list[str], list[float]]] = []
            for first, last in text_slices(texts):
                part = texts.slice(first, last - first)
                data, off = text_bytes(part)
                h = gram_buckets(data)
                for i in range(last - first):
                    text = part[i].as_py()
                    if model is None or not text or not _LETTER.search(text):
                        rows.append(("und", 0.0, [], []))
                        continue
                    c = np.bincount(h[off[i] : max(off[i], off[i + 1] - 2)], minlength=BUCKETS + 1)[:BUCKETS]
                    at = np.flatnonzero(c)
                    if not len(at):  # a letter or two: what is most usual decides
                        k = model.usual()
                        rows.append((model.langs[k], 1 / len(model.langs) if model.prior is None else float(model.prior[k]), [model.langs[k]], [1.0]))
                        continue
                    langs, shares, pred, score = model.infer(c[at].astype(np.float64), at)
                    rows.append((pred, score, langs, shares.tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))))], names=[f.name for f in schema])

    return own.mapInArrow(released(infer), schema)
