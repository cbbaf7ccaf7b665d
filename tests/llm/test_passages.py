import random

from helpers import awkward, documents
from recallframe.llm import passages as P


def text(rng, n, tag):
    return [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]


def spread(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        i = rng.randrange(8, len(out) - 8)
        out[i : i + rng.randint(0, 2)] = [f"e{rng.randrange(10**6)}" for _ in range(rng.randint(0, 2))]
    return out


def test_planted_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(1)
    rows, planted = [], {}
    passages = [text(rng, n, "p") for n in (52, 60, 75, 120)]
    for n in range(120):
        own = text(rng, rng.randint(30, 160), "w")
        if n % 3 == 0:
            which = rng.randrange(4)
            at = rng.randrange(len(own))
            piece = passages[which] if n % 2 else spread(rng, passages[which], len(passages[which]) // 30)
            own[at:at] = piece
            planted.setdefault(which, []).append(n)
        rows.append((n, " ".join(own), "en", "s", 1))
    rows.append((500, rows[1][1], "en", "s", 1))  # an exact copy
    rows.append((501, "the common first line of them all\n" + rows[2][1].upper(), "en", "s", 1))
    docs = documents(spark, rows)
    got = P.repeated_passages(docs).collect()
    found = {r.doc_id for r in got}
    later = {n for group in planted.values() for n in group[1:]} | {500, 501}
    assert found == later
    texts = {r[0]: r[1].encode() for r in rows}
    for r in got:
        assert r.n_words >= P.MIN_WORDS and 0 <= r.start_byte < r.end_byte <= len(texts[r.doc_id]) and r.identity >= P.MIN_IDENTITY
        assert r.src_doc_id < r.doc_id
        if r.identity == 1.0:
            assert texts[r.doc_id][r.start_byte : r.end_byte].lower() == texts[r.src_doc_id][r.src_start : r.src_end].lower()
    out = {r.doc_id: r.text for r in P.cut_passages(docs).collect()}
    for n in range(120):
        if n not in later:
            assert out[n] == rows[n][1]
        else:
            assert 0 < len(out[n]) < len(rows[n][1])
    assert 500 not in out or len(out[500].split()) < 3


def test_exact_spans_against_brute_force(spark):
    """A passage's bytes are the longest run of equal words around it."""
    rng = random.Random(7)
    a, b, p = text(rng, 40, "a"), text(rng, 40, "b"), text(rng, 70, "p")
    rows = [(1, " ".join(a + p + a[::-1]), "en", "s", 1), (2, " ".join(b[:20] + p + b[20:]), "en", "s", 1)]
    r = P.repeated_passages(documents(spark, rows)).collect()
    assert len(r) == 1 and r[0].n_words == 70 and r[0].identity == 1.0
    assert rows[1][1][r[0].start_byte : r[0].end_byte] == " ".join(p)


def test_chains_against_quadratic_scores():
    rng = random.Random(3)
    for _ in range(200):
        found = sorted({(s := rng.randrange(0, 900, 10), s + 10, c := rng.randrange(0, 900, 10), c + 10) for _ in range(rng.randint(1, 25))})
        best = {}
        for i in sorted(found):
            best[i] = 10.0
            for j in found:
                if j[1] <= i[0] and j[3] <= i[2] and j in best:
                    gap = (i[0] - j[1]) + (i[2] - j[3])
                    if i[0] - j[1] <= P.MAX_GAP and i[2] - j[3] <= P.MAX_GAP:
                        best[i] = max(best[i], 10 + best[j] - P.GAP_COST * gap)
        got = P.chains(found)
        assert sorted(a for c in got for a in c) == sorted(found)
        score = lambda c: sum(a[1] - a[0] for a in c) - P.GAP_COST * sum((b[0] - a[1]) + (b[2] - a[3]) for a, b in zip(c, c[1:], strict=False))
        assert all(a[1] <= b[0] and a[3] <= b[2] for c in got for a, b in zip(c, c[1:], strict=False))
        assert abs(score(got[0]) - max(best.values())) < 1e-9 or score(got[0]) <= max(best.values())


def test_common_words_is_the_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(100):
        a, b = [[rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randint(0, 12))] for _ in range(2)]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert P.common_words(a, b) == t[-1][-1]


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    P.repeated_passages(docs).collect()
    kept = P.cut_passages(docs.withColumnRenamed("lang", "cuts").withColumnRenamed("source", "raw"))
    assert {r.doc_id: r.text for r in kept.collect()} == {r.doc_id: r.text for r in docs.collect()}
    assert P.repeated_passages(docs.where("false")).count() == 0
    assert P.cut_passages(docs.where("false")).count() == 0


def test_best_chain_within_reach_equals_quadratic_score():
    """A predecessor with a large score that lies too far off doesn't hide a nearer one."""
    rng = random.Random(8)
    for n in range(300):
        found = {(s := rng.randrange(0, 900, 10), s + 10, c := rng.randrange(0, 900, 10), c + 10) for _ in range(rng.randint(2, 40))}
        if n % 2:
            found = {(a + 1000, b + 1000, c + 1000, d + 1000) for a, b, c, d in found} | {(0, 600, 0, 600)}
        found = sorted(found)
        best = {}
        for i in found:
            best[i] = float(i[1] - i[0])
            for j in best:
                gap = (i[0] - j[1], i[2] - j[3])
                if min(gap) >= 0 and max(gap) <= P.MAX_GAP:
                    best[i] = max(best[i], i[1] - i[0] + best[j] - P.GAP_COST * sum(gap))
        score = lambda c: sum(a[1] - a[0] for a in c) - P.GAP_COST * sum((b[0] - a[1]) + (b[2] - a[3]) for a, b in zip(c, c[1:], strict=False))
        assert abs(max(score(c) for c in P.chains(found)) - max(best.values())) < 1e-9
    near = [(1000 + 60 * i, 1040 + 60 * i, 1000 + 60 * i, 1040 + 60 * i) for i in range(6)]
    assert sorted(P.chains([(0, 600, 0, 600), *near]), key=len) == [[(0, 600, 0, 600)], near]


def test_every_copy_within_a_document_is_found(spark):
    """A later document that holds a passage three times, and one whose passage begins with a line that it quotes before."""
    rng = random.Random(9)
    a, b, p, q = text(rng, 40, "a"), text(rng, 60, "b"), text(rng, 70, "p"), text(rng, 48, "q")
    docs = documents(spark, [
        (1, " ".join(a + p + a[::-1] + q), "en", "s", 1), (2, " ".join(b[:20] + p + b[20:40] + p + b[40:] + p + b[:5]), "en", "s", 1),
        (3, " ".join(q[:20] + text(rng, 60, "c") + q + text(rng, 9, "d")), "en", "s", 1),
    ])
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    got = sorted(P.repeated_passages(docs).collect(), key=lambda r: (r.doc_id, r.start_byte))
    assert [(r.doc_id, texts[r.doc_id][r.start_byte : r.end_byte].decode().split()) for r in got] == [(2, p)] * 3 + [(3, q)]
    assert not set(p) & set(P.cut_passages(docs).where("doc_id = 2").first().text.split())


def test_edits_near_the_ends_are_passed(spark):
    """Passages of 51 to 60 words with a word changed, left out or put in a few words from an end."""
    rng = random.Random(10)
    rows = []
    for n in range(180):
        size, edits = [(51, [6]), (51, [7]), (51, [43]), (53, [9]), (60, [8, 51]), (56, [4, 50])][n % 6]
        p = text(rng, size, f"p{n}_")
        edited = list(p)
        for at in reversed(edits):
            edited[at : at + 1] = [["e"], [], [p[at], "e"]][n // 6 % 3]
        for i, piece in ((n, p), (1000 + n, edited)):
            own = text(rng, 40, "w")
            rows.append((i, " ".join(own[:20] + piece + own[20:]), "en", "s", 1))
    got = {r.doc_id: r for r in P.repeated_passages(documents(spark, rows)).collect()}
    assert set(got) == set(range(1000, 1180))
    texts = {r[0]: r[1] for r in rows}
    for n, r in got.items():
        assert texts[n][r.start_byte : r.end_byte].split() == texts[n].split()[20:-20] and r.identity >= 0.9


def test_growing_ends():
    w = lambda s: [x.encode() for x in s]
    assert P.grown([], w("ab")) == P.grown(w("ab"), []) == P.grown(w("ab"), w("xy")) == (0, 0, 0)
    assert P.grown(w("abcdefg"), w("abcdefgh")) == (7, 7, 7)
    assert P.grown(w("abXcdefg"), w("abYcdefg")) == (8, 8, 7)
    assert P.grown(w("Xcdefg"), w("cdefg")) == (6, 5, 5) and P.grown(w("cdefg"), w("Xcdefg")) == (5, 6, 5)
    assert P.grown(w("abXc"), w("abYc")) == (2, 2, 2)


def quadratic(found):
    """Best score of a chain that ends in each anchor."""
    best = {}
    for i in sorted(found):
        best[i] = float(i[1] - i[0])
        for j in best:
            gap = (i[0] - j[1], i[2] - j[3])
            if min(gap) >= 0 and max(gap) <= P.MAX_GAP:
                best[i] = max(best[i], i[1] - i[0] + best[j] - P.GAP_COST * sum(gap))
    return best


def test_every_best_chain_equals_the_quadratic_one():
    """Anchors of very different lengths, among them such as hide a nearer predecessor behind a better one."""
    rng = random.Random(12)
    score = lambda c: sum(a[1] - a[0] for a in c) - P.GAP_COST * sum((b[0] - a[1]) + (b[2] - a[3]) for a, b in zip(c, c[1:], strict=False))
    for n in range(1000):
        found = set()
        for _ in range(rng.randint(2, 45)):
            size, s, c = rng.choice([1, 7, 10, 60, 240, 241, 300, 1000]), rng.randrange(0, 2500), rng.randrange(0, 2500)
            if n % 3 == 0:
                c = max(0, s + rng.randrange(-40, 40))  # close to one diagonal
            found.add((s, s + size, c, c + size))
        found = sorted(found)
        got = P.chains(found)
        assert sorted(a for c in got for a in c) == found
        assert all(0 <= b[0] - a[1] <= P.MAX_GAP and 0 <= b[2] - a[3] <= P.MAX_GAP for c in got for a, b in zip(c, c[1:], strict=False))
        assert abs(score(got[0]) - max(quadratic(found).values())) < 1e-9
    three = [(0, 1000, 0, 1000), (1300, 1340, 1300, 1340), (1350, 1400, 1350, 1400)]
    assert P.chains(three) == [[three[0]], three[1:]]


def test_words_and_sources_of_united_parts(spark):
    """A passage whose halves come from two documents: its words are counted, and the source answers to one part."""
    rng = random.Random(13)
    a, b, p, q = text(rng, 40, "a"), text(rng, 40, "b"), text(rng, 61, "p"), text(rng, 30, "q")
    docs = documents(spark, [(1, " ".join(a + p + a[::-1]), "en", "s", 1), (2, " ".join(b + q + b[::-1]), "en", "s", 1), (3, " ".join(text(rng, 25, "c") + p + q + text(rng, 25, "d")), "en", "s", 1)])
    texts = {r.doc_id: r.text for r in docs.collect()}
    (r,) = P.repeated_passages(docs).collect()
    assert (r.doc_id, r.src_doc_id, r.n_words) == (3, 1, 91) and texts[3][r.start_byte : r.end_byte].split() == p + q
    assert texts[3][r.part_start : r.part_end] == texts[1][r.src_start : r.src_end] == " ".join(p)


def test_texts_that_share_an_id(spark):
    """Different texts under one id are documents of their own: each is cut by what it holds itself."""
    rng = random.Random(14)
    p, own = text(rng, 70, "p"), [text(rng, 50, f"o{i}_") for i in range(4)]
    one, two, three = " ".join(own[0] + p), " ".join(own[1]), " ".join(own[2] + p + own[3])
    docs = documents(spark, [(1, one, "en", "s", 1), (2, two, "en", "s", 1), (2, three, "en", "t", 1), (2, three, "en", "t", 1), (None, p[0], "en", "s", 1)])
    got = P.repeated_passages(docs).collect()
    assert [(r.doc_id, r.src_doc_id, r.n_words) for r in got] == [(2, 1, 70)]
    kept = sorted((r.doc_id or 0, r.source, r.text.split()) for r in P.cut_passages(docs).collect())
    assert kept == sorted([(0, "s", [p[0]]), (1, "s", one.split()), (2, "s", two.split()), (2, "t", own[2] + own[3]), (2, "t", own[2] + own[3])])


def test_very_long_texts(spark):
    rng = random.Random(15)
    p = text(rng, 300, "p")
    docs = documents(spark, [(1, " ".join(text(rng, 150_000, "a") + p), "en", "s", 1), (2, " ".join(p + text(rng, 150_000, "b")), "en", "s", 1)])
    (r,) = P.repeated_passages(docs).collect()
    assert (r.doc_id, r.src_doc_id, r.n_words, r.start_byte, r.identity) == (2, 1, 300, 0, 1.0)
