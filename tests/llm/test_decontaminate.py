"""Decontamination against plain search for windows."""

import hashlib
import random
import re

import pytest
from helpers import LOWER, awkward, documents

from recallframe.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def tokens(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def windows(items):
    out = {}
    for item, text in items:
        w = tokens(text)
        m = min(len(w), 10)
        for i in range(len(w) - m + 1 if m else 0):
            out.setdefault(tuple(w[i : i + m]), set()).add("" if item is None else str(item))
    return out


def plain(text, known):
    w = tokens(text)
    hit, items = set(), set()
    for m in {len(k) for k in known}:
        for i in range(len(w) - m + 1):
            own = known.get(tuple(w[i : i + m]))
            if own:
                hit |= set(range(i, i + m))
                items |= own
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def planted(seed):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "été", "42", "日本", "x"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 25]) if seed % 2 else rng.randint(10, 30)))) for i in range(12)]
    items = [(i, t + (f" only{i}" if len(t.split()) < 4 else "")) for i, t in items] + [(3, "an item that repeats its id " * 3), (None, "no id for this item but ten words and more"), (90, None), (91, "?!"), (92, "")]
    docs = []
    for d in range(120):
        words = [rng.choice([*vocabulary, "noise", f"n{d}"]) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            if w:
                a = rng.randrange(len(w))
                at = rng.randint(0, len(words))
                words[at:at] = w[a:] if rng.random() < 0.3 else w
        docs.append((d, rng.choice([" ", ", ", "\n", "--"]).join(x.upper() if rng.random() < 0.2 else x for x in words)))
    return docs, items


def columns(frame):
    return sorted(tuple(r) for r in frame.select("n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_plain_search(spark, seed):
    docs, items = planted(seed)
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    known = windows(items)
    want = {d: plain(t, known) for d, t in docs}
    assert sum(v[-1] for v in want.values()) > 20
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_a_benchmark_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_GRAMS", 40)
    docs, items = planted(4)
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    known = windows(items)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {d: plain(t, known) for d, t in docs}


def test_awkward_rows_repeats_and_clashing_names(spark):
    docs = awkward(spark).selectExpr("*", "1 as h", "2 as doc", "'x' as n_words", "3 as w").union(awkward(spark).selectExpr("doc_id", "concat(text, ' again')", "lang", "source", "n_chars", "1", "2", "'x'", "3"))
    docs = docs.union(docs.where("doc_id in (6, 8)"))
    items = [(1, "alpha beta gamma delta alpha beta gamma delta alpha beta gamma"), (2, "word"), (3, None), (4, "no id here at all")]
    bench = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, gram string")
    got = D.contamination(docs, bench)
    known = windows(items)
    assert columns(got) == sorted(plain(r.text, known) for r in docs.collect())
    assert D.contamination(documents(spark, []), bench).count() == 0
    none = D.contamination(docs, bench.limit(0))
    assert columns(none) == sorted(plain(r.text, {}) for r in docs.collect())


def test_an_id_named_like_an_output(spark):
    docs = spark.createDataFrame([(1, "a b c")], "n_hit long, text string")
    assert D.contamination(docs, spark.createDataFrame([(1, "b c")], "item_id long, text string"), "n_hit").columns[:2] == ["n_hit", "n_words"]


def test_removal_of_spans_and_documents(spark):
    ten = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, ten), (2, "eight nine ten eleven twelve a b c d e f"), (3, "lone item")], "item_id long, text string")
    rows = [
        (1, f"Before. {ten.upper()}, after!"), (2, "clean text. stays   as it is"), (3, "x one, two; three four five six seven eight nine ten (eleven) twelve a b c d e f y"),
        (4, None), (5, ""), (6, "lone  item"), (7, f"a {ten} b {ten}"), (None, f"{ten}!"),
    ]
    docs = spark.createDataFrame([(a, b, "k") for a, b in rows], "doc_id long, text string, runs string")
    got = D.decontaminate(docs, bench)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "Before. , after!", 2: rows[1][1], 3: "x  y", 4: None, 5: "", 6: "", 7: "a  b ", None: "!"}
    assert sorted(r.doc_id for r in D.decontaminate(docs, bench, "documents").collect()) == [2, 4, 5]
    with pytest.raises(ValueError, match="how"):
        D.decontaminate(docs, bench, "rows")


def test_cleaned_texts_hold_no_window(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    before = D.contamination(docs, bench).where("contaminated").count()
    assert before and D.contamination(D.decontaminate(docs, bench), bench).where("contaminated").count() == 0


def test_native_plan(spark, small):
    own, hits = D.window_hits(*(spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark")))
    import inspect

    assert not any(x in inspect.getsource(D) for x in ("mapIn", "applyIn", "udf", "toPandas", "toArrow", ".rdd"))
    assert own.count() and hits.columns == ["doc", "h", "s", "m", "item"]
