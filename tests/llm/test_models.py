"""Language mixture, byte network and ordinal severity: held-out accuracy and defined results of odd inputs."""

import itertools
import zlib

import numpy as np
from helpers import awkward
from recallframe.llm import bytecnn as B
from recallframe.llm import langmix as M
from recallframe.llm import queries as Q
from recallframe.llm import severity as S
from recallframe.llm.common import labelled_sample

SF = "/root/testdata/sf0.01"


def held(doc_id, m, r):
    return zlib.crc32(str(doc_id).encode()) % m == r


def test_language_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = Q.language_mixture(spark, SF).collect()
    assert len(rows) == len(lang) and all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in own]) > 0.97


def test_mixture_shares_and_set():
    rng = np.random.default_rng(0)
    like = rng.dirichlet(np.full(50, 0.2), size=3) + 1e-4
    like /= like.sum(1, keepdims=True)
    model = M.LanguageModel(("a", "b", "c"), like)
    counts = rng.multinomial(6000, 0.7 * like[0] + 0.3 * like[2]).astype(float)
    langs, shares, best, score = model.infer(counts, np.arange(50))
    assert set(langs) == {"a", "c"} and best == "a" and abs(dict(zip(langs, shares, strict=True))["a"] - 0.7) < 0.05 and 0.6 < score < 0.8
    assert model.infer(rng.multinomial(3000, like[1]).astype(float), np.arange(50))[0] == ["b"]


def test_language_awkward(spark):
    docs = awkward(spark)
    model = M.fit_languages(docs)
    got = {r.doc_id: r for r in M.identify_languages(docs, model).collect()}
    assert len(got) == 11 and got[0].lang_pred == got[1].lang_pred == got[7].lang_pred == got[10].lang_pred == "und" and got[0].score == 0
    assert got[3].lang_pred in model.langs and got[3].lang_pred == got[4].lang_pred
    assert M.fit_languages(docs.where("false")) is None
    assert {r.lang_pred for r in M.identify_languages(docs, None).collect()} == {"und"}


def test_quality_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = Q.byte_cnn(spark, SF).collect()
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in own]) > 0.9


def test_quality_chunks_and_awkward(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 110, 300, dtype=np.uint8)) for _ in range(30)] + [bytes(rng.integers(40, 60, 300, dtype=np.uint8)) for _ in range(30)]
    net = B.train(texts, np.array([1.0] * 30 + [0.0] * 30, np.float32))
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.array([0, len(data)])
    whole = net.pooled(data, off, net.stacked())
    monkeypatch.setattr(B, "CHUNK", 64)
    assert np.allclose(whole, net.pooled(data, off, net.stacked()), atol=1e-4)
    docs = awkward(spark)
    got = {r.doc_id: r.score for r in B.score_quality(docs, net).collect()}
    assert len(got) == 11 and got[0] == got[1] and got[3] == got[4]
    assert {r.score for r in B.score_quality(docs, None).collect()} == {0.5}
    assert B.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = Q.ordinal_toxicity(spark, SF).collect()
    own = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.toxic == bool(labels[r.doc_id]) for r in own]) > 0.93
    assert all(r.severity >= 0 and r.grade >= 0 for r in rows)


def test_ordered_thresholds_and_awkward(spark):
    rng = np.random.default_rng(2)
    marks = np.arange(100, 120)
    lists, toxic = [], []
    for i in range(400):
        t = i % 4 == 0
        ids = rng.integers(1000, 1400, 30)
        lists.append(np.unique(np.concatenate([ids, rng.choice(marks, rng.integers(1, 9), replace=False) if t else ids])))
        toxic.append(int(t))
    model = S.fit_grades(lists, np.array(toxic))
    assert (np.diff(model.cuts) >= 0).all() and set(marks) <= set(model.features.tolist())
    docs = awkward(spark)
    got = S.score_severity(docs, model).collect()
    assert len(got) == 11 and not any(r.toxic for r in got if r.doc_id in (0, 1, 2))
    assert S.fit_severity(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    kept = S.reject_toxic(docs.withColumnRenamed("lang", "_toxic"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert kept.count() == 11 and kept.columns == ["doc_id", "text", "_toxic", "source", "n_chars"]


def test_mixture_set_against_all_subsets():
    """The selected set reaches the best penalised likelihood of all sets of languages."""
    rng = np.random.default_rng(3)
    like = rng.dirichlet(np.full(60, 0.3), size=5) + 1e-4
    like /= like.sum(1, keepdims=True)
    model = M.LanguageModel(tuple("abcde"), like, np.array([0.1, 0.1, 0.5, 0.2, 0.1]))
    best = 0
    for trial in range(120):
        k = trial % 5 + 1
        share = rng.dirichlet(np.full(k, 3.0))
        counts = rng.multinomial(int(rng.integers(20, 9000)), share @ like[rng.choice(5, k, replace=False)]).astype(float)
        sets = [c for n in range(1, 6) for c in itertools.combinations(range(5), n)]
        top = max(model.gain(like, counts, list(c))[0] for c in sets)
        got = [model.langs.index(x) for x in model.infer(counts, np.arange(60))[0]]
        best += model.gain(like, counts, got)[0] >= top - 1e-6 * abs(top)
    assert best >= 114


def test_five_languages_in_one_text():
    rng = np.random.default_rng(4)
    like = rng.dirichlet(np.full(80, 0.2), size=6) + 1e-4
    like /= like.sum(1, keepdims=True)
    model = M.LanguageModel(tuple("abcdef"), like)
    counts = rng.multinomial(60_000, np.full(5, 0.2) @ like[:5]).astype(float)
    langs, shares, _, _ = model.infer(counts, np.arange(80))
    assert set(langs) == set("abcde") and np.abs(shares - 0.2).max() < 0.05
    small = rng.multinomial(60_000, np.array([0.985, 0.015]) @ like[:2]).astype(float)
    assert set(model.infer(small, np.arange(80))[0]) == {"a", "b"}  # a small share counts if the penalty allows it


def test_usual_language_repeats_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "ab cd ef gh " * 50, "aa"), (2, "zz yy xx ww " * 50, "zz"), (3, "zz yy xx ww " * 20, "zz"), (4, "Q", None), (5, "zz yy xx ww " * 60_000, None), (5, "zz yy xx ww " * 60_000, None)], "doc_id long, text string, lang string")
    model = M.fit_languages(docs)
    got = [(r.doc_id, r.lang_pred, r.score) for r in M.identify_languages(docs, model).orderBy("doc_id").collect()]
    assert got[3][:2] == (4, "zz") and got[4] == got[5] and got[4][1] == "zz" and got[0][1] == "aa"


def test_quality_ranks_and_finds_both_kinds(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    own = [(labels[r.doc_id], r.score) for r in Q.byte_cnn(spark, "/root/testdata/sf0.1").where("held_out").collect() if labels.get(r.doc_id) is not None]
    good, bad = np.array([s for q, s in own if q == 1]), np.array([s for q, s in own if q == 0])
    assert (good[:, None] > bad[None]).mean() > 0.97 and (bad < B.THRESHOLD).mean() > 0.75 and (good >= B.THRESHOLD).mean() > 0.97


def test_quality_learns_from_whole_texts_and_not_from_ids(spark):
    """What decides stands at the end of long texts; ids in another order change nothing."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(500):
        end = "!!##!!##" if i % 2 else "and so on"
        rows.append((i, "".join(rng.choice(list("abcdefgh "), int(rng.integers(8500, 9500)))) + end * 3, i % 2))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    net = B.fit_quality(docs, labels)
    got = {r.doc_id: r.score for r in B.score_quality(docs, net).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows]) > 0.9
    repeated = docs.unionByName(docs.where("doc_id < 5"))
    again = B.fit_quality(repeated, labels.unionByName(labels))
    assert np.allclose([a for a in net.params()[3]], again.params()[3])
    scores = [(r.doc_id, r.score) for r in B.score_quality(repeated, net).collect()]
    assert len(scores) == 505 and len({(d, round(x, 5)) for d, x in scores}) == 500


def test_training_samples_are_bounded_in_rows_and_bytes(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "repeat('x', 100) as text")
    docs = docs.unionByName(docs).unionByName(docs.selectExpr("doc_id", "repeat('y', 90) as text"))
    labels = spark.range(200).selectExpr("id as doc_id", "cast(id % 2 as int) as v").unionByName(spark.range(50).selectExpr("id as doc_id", "1 as v"))
    sample = labelled_sample(docs, labels, "v", "doc_id >= 0", 60).collect()
    assert len(sample) == len({r.doc_id for r in sample}) == 60 and all(r.text == "x" * 100 and r.value == r.doc_id % 2 for r in sample if r.doc_id >= 50)
    assert len(labelled_sample(docs, labels, "v", "doc_id >= 0", 60, 1050).collect()) == 10
    assert len(labelled_sample(docs, labels, "v", "doc_id >= 0", 60, 5).collect()) == 1
    assert labelled_sample(docs.where("false"), labels, "v", "doc_id >= 0", 60, 5).count() == 0


def test_severity_rises_with_markers(spark):
    rng = np.random.default_rng(6)
    clean, foul = [f"word{i}" for i in range(300)], [f"vile{i}" for i in range(12)]
    rows = []
    for i in range(1500):
        own = list(rng.choice(clean, 40))
        if i % 5 == 0:
            own += list(rng.choice(foul, int(rng.integers(1, 12)), replace=False))
        rows.append((i, " ".join(own), int(i % 5 == 0)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = S.fit_severity(docs, labels)
    planted = spark.createDataFrame([(n, " ".join(clean[:40] + foul[:n])) for n in (0, 1, 4, 9)] + [(90, " ".join(foul[:9]) + " plain" * 400_000), (91, " ,.! "), (1, " ".join(clean[:40] + foul[:1]))], "doc_id long, text string")
    got = sorted({(r.doc_id, r.severity, r.toxic) for r in S.score_severity(planted, model).collect()})
    assert len(got) == 6  # rows that repeat agree
    level = {d: s for d, s, _ in got}
    assert level[0] < level[1] < level[4] < level[9] and abs(level[90] - level[9]) < 0.5 and level[91] == 0
    assert [t for _, _, t in got[:4]] == [False, True, True, True]
    odd = planted.withColumnRenamed("doc_id", "toxic")
    assert S.score_severity(odd, model, id_col="toxic").columns[0] == "toxic_"
