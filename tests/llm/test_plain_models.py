"""Language likelihoods and shares, and severity grades, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from recallframe.llm import langmix as L
from recallframe.llm import severity as S

WORDS = {"aa": "alpha beta gamma delta of the", "bb": "être mañana über çava los", "cc": "kolme neljä viisi kuusi ja"}


def plain_buckets(text):
    folded = []
    for b in text.encode():
        c = chr(b)
        folded.append(ord(c.lower()) if c.isascii() and c.isalpha() else b if b >= 128 else 32)
    out = Counter()
    for x in zip(folded, folded[1:], folded[2:], strict=False):
        if x.count(32) < 2:
            h = ((x[0] * 0x9E3779B1 % 2**32) ^ (x[1] * 0x85EBCA6B % 2**32) ^ (x[2] * 0xC2B2AE35 % 2**32)) * 0x27D4EB2F % 2**32
            out[h >> 17] += 1
    return out


def plain_likelihood(counts):
    total = sum(counts.values()) + L.SMOOTHING * L.BUCKETS
    return lambda bucket: (counts[bucket] + L.SMOOTHING) / total


def sentences(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(3, 60))) + rng.choice([".", " 12!", ""]), lang) for i in range(n) for lang in (rng.choice(list(WORDS)),)]


def test_languages_against_plain_likelihoods(spark):
    rows = sentences(1, 60)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_languages(frame)
    sums = {k: Counter() for k in WORDS}
    for _, text, lang in rows:
        sums[lang] += plain_buckets(text)
    like = {k: plain_likelihood(v) for k, v in sums.items()}
    assert model.langs == tuple(sorted(WORDS)) and model.prior.tolist() == pytest.approx([(sum(r[2] == k for r in rows) + L.SMOOTHING) / (60 + 3 * L.SMOOTHING) for k in sorted(WORDS)])
    for i, k in enumerate(model.langs):
        assert all(model.like[i, b] == pytest.approx(like[k](b), rel=1e-12) for b in [*sums[k], 0, 1, L.BUCKETS - 1])
    got = {r.doc_id: r for r in L.identify_languages(frame, model).collect()}
    for doc, text, _ in rows:
        grams = plain_buckets(text)
        n = sum(grams.values())
        pi = {k: 1 / 3 for k in like}
        for _ in range(L.EM_STEPS):
            new = dict.fromkeys(pi, 0.0)
            for b, c in grams.items():
                mix = sum(pi[k] * like[k](b) for k in pi)
                for k in pi:
                    new[k] += c * pi[k] * like[k](b) / mix / n
            pi = {k: v / sum(new.values()) for k, v in new.items()}
        best = max(sorted(pi), key=lambda k: sum(c * math.log(like[k](b)) for b, c in grams.items()))
        r = got[doc]
        assert r.score == pytest.approx(min(1.0, pi[r.lang_pred]), rel=1e-9) and (len(r.langs) > 1 or r.lang_pred == best)


def plain_fit(rows, grades, features):
    """Cumulative logits with shared weights by Adam, in loops."""
    levels = max(grades)
    w, cuts = dict.fromkeys(features, 0.0), [float(k + 1) for k in range(levels)]
    mean, var = Counter(), Counter()
    for step in range(1, S.STEPS + 1):
        grad = {("w", f): S.RIDGE * w[f] for f in features} | {("c", k): 0.0 for k in range(levels)}
        for held, g in zip(rows, grades, strict=True):
            line = sum(w[f] for f in held if f in w)
            for k in range(levels):
                d = (1 / (1 + math.exp(-max(-30.0, min(30.0, line - cuts[k])))) - (g > k)) / len(rows)
                grad["c", k] -= d
                for f in held:
                    if f in w:
                        grad["w", f] += d
        for key, g in grad.items():
            mean[key] += 0.1 * (g - mean[key])
            var[key] += 0.001 * (g * g - var[key])
            change = S.RATE * (mean[key] / (1 - 0.9**step)) / (math.sqrt(var[key] / (1 - 0.999**step)) + 1e-8)
            if key[0] == "w":
                w[key[1]] -= change
            else:
                cuts[key[1]] -= change
        for k in range(1, levels):
            cuts[k] = max(cuts[k], cuts[k - 1])
    return w, cuts


def test_severity_against_plain_regression(spark):
    rng = random.Random(4)
    toxic = [i % 3 == 0 for i in range(90)]
    rows = [sorted({rng.randint(0, 40)} | {rng.randint(100, 130) for _ in range(6)} | ({200 + rng.randint(0, 3) for _ in range(rng.randint(1, 4))} if t else set())) for t in toxic]
    model = S.fit_grades([np.array(r) for r in rows], np.array([int(t) for t in toxic]))
    features = set(model.features.tolist())
    assert {200, 201, 202, 203} <= features
    lift = lambda f, own: ((sum(f in r for r, t, o in zip(rows, toxic, own, strict=True) if t and o) + 0.1) / (sum(t and o for t, o in zip(toxic, own, strict=True)) + 0.2)) / ((sum(f in r for r, t, o in zip(rows, toxic, own, strict=True) if not t and o) + 0.1) / (sum(not t and o for t, o in zip(toxic, own, strict=True)) + 0.2))
    held = lambda f, own: sum(f in r for r, t, o in zip(rows, toxic, own, strict=True) if t and o)
    every = [True] * len(rows)
    known = {f for r in rows for f in r}
    assert features == {f for f in known if held(f, every) >= S.MIN_SUPPORT and lift(f, every) >= S.MIN_LIFT}
    half = [False] * len(rows)
    for kind in (True, False):
        for i in [i for i, t in enumerate(toxic) if t is kind][::2]:
            half[i] = True
    # graded by the markers of the other half; a pair of halves counts all texts, their own labels telling the rest
    grades = []
    marks_of = {side: {f for f in known if held(f, every) >= S.MIN_SUPPORT and (lambda own: held(f, own) >= S.MIN_SUPPORT)([h is not side for h in half])} for side in (True, False)}
    for i, r in enumerate(rows):
        other = [h is not half[i] for h in half]
        n1, n0 = sum(toxic), len(toxic) - sum(toxic)
        marks = 0
        for f in r:
            if f in marks_of[half[i]]:
                ones, zeros = held(f, other), sum(f in x for x, t, o in zip(rows, toxic, other, strict=True) if not t and o)
                marks += ((ones + 0.1) / (n1 + 0.2)) / ((zeros + 0.1) / (n0 + 0.2)) >= 4 * S.MIN_LIFT
        grades.append(max(1, int(np.searchsorted(S.GRADE_STEPS, marks, side="right"))) if toxic[i] else 0)
    w, cuts = plain_fit(rows, grades, features)
    assert dict(zip(model.features.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(w, abs=1e-4) and model.cuts.tolist() == pytest.approx(cuts, abs=1e-4)


def test_severity_of_texts_against_plain_sums(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["Good", "bad", "awful", "fine", "é1", "x"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "!!"]
    ids = {}
    for t in texts:
        data = (t or "").encode()
        ids[t] = set(S.feature_ids(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[1].tolist())
    features = np.array(sorted(set().union(*ids.values())))
    model = S.SeverityModel(features, np.array([rng.uniform(-1, 1) for _ in features], np.float32), np.array([0.2, 0.9, 1.5]))
    weight = dict(zip(features.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r for r in S.score_severity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        above = [1 / (1 + math.exp(-(sum(weight[f] for f in ids[t]) - c))) if ids[t] else 0.0 for c in model.cuts]
        r = got[i]
        assert r.severity == pytest.approx(sum(above), abs=1e-5) and r.score == pytest.approx(above[0], abs=1e-5) and r.toxic == (above[0] >= S.REJECT) and r.grade == sum(p >= 0.5 for p in above)
