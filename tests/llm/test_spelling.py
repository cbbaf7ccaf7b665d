"""Spelling variants against plain comparison of all words, with cells of every size."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import LOWER, awkward, documents

from recallframe.llm import spelling as S


def plain_words(docs):
    out = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n):
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    nears = {w: [v for k in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(k, ()) if near(w, v)] for w in n}
    form = {}
    for w, others in nears.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(nears[w]), n[form[w]] if form[w] else None))
    return out


def planted(seed, count=400):
    """Texts of few long words with variants, chains of variants, equal letters in a row."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(6, 9))) for _ in range(12)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Baaaaaaa"]
    docs = []
    for i in range(count):
        words = []
        for _ in range(30):
            w = rng.choice(base[: 1 + rng.randint(0, len(base) - 1)])
            for _ in range(rng.choice([0, 0, 0, 0, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w[:k] + rng.choice("abÉ") + w[k + 1 :]])
            words.append(w)
        docs.append((i, rng.choice([" ", "-", "\n", "1"]).join(words)))
    return docs


def rows(frame):
    return {tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("cell", [1, 20, 4096])
def test_against_plain_comparison(spark, cell):
    docs = planted(cell)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = S.spelling_variants(frame, cell=cell)
    n = plain_words(docs)
    assert len(n) > 300
    assert rows(got) == plain(n) and got.count() == len(n)


def test_trie_and_paths_find_each_pair_once():
    rng = random.Random(3)
    for _ in range(200):
        letters = rng.choice(["ab", "abc", "aàéÿ"])
        depth = rng.randint(0, 2)
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(depth, 7))) for _ in range(rng.randint(1, 60))})
        heads = sorted({w[:depth] for w in words})
        data, off = S.latin_bytes(pa.array(words))
        a, b = S.trie_pairs(data, off[:-1] + depth, np.diff(off) - depth, np.array([heads.index(w[:depth]) for w in words]))
        got = Counter(tuple(sorted((words[i], words[j]))) for i, j in zip(a, b, strict=True))
        assert got == Counter((x, y) for i, x in enumerate(words) for y in words[i + 1 :] if x[:depth] == y[:depth] and near(x[depth:], y[depth:]))


def test_awkward_rows(spark):
    docs = awkward(spark)
    n = plain_words([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(S.spelling_variants(docs)) == plain(n)
    assert S.spelling_variants(documents(spark, [])).count() == 0
    assert S.spelling_variants(documents(spark, [(1, None, None, None, None)])).count() == 0


def test_long_words_null_ids_repeats_and_clashing_names(spark):
    long = "q" * 3000 + "é"
    docs = [(None, f"{long} {long}x abcdefgh"), (None, f"{long} {long}x abcdefgh"), (5, "ABCDEFGH abcdefgi×÷ÿ " * 30), (5, "ABCDEFGH abcdefgi×÷ÿ " * 30)]
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, word string, n long")
    assert rows(S.spelling_variants(frame, cell=2)) == plain(plain_words(docs))


def test_hashes_of_runs():
    texts = ["abc Éé" + "z" * 200, "", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts, ends, _ = S.letter_runs(data, off)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["abc", "Éé" + "z" * 200, "x"]
    before = np.array([zlib.crc32(b"12:")] * 3, np.uint32)
    assert S.run_hashes(data, starts, ends, before).tolist() == [zlib.crc32(b"12:" + bytes(data[a:b])) for a, b in zip(starts, ends, strict=True)]
