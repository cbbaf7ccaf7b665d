import random

from helpers import awkward, components, documents, jaccard_links
from recallframe.llm import jaccard as J
from recallframe.llm.components import connected_components


def check(docs):
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    links, sets = jaccard_links(texts)
    want = components(texts, links)
    got = {r.doc_id: r for r in J.jaccard_classes(docs).collect()}
    for k in texts:
        assert (got[k].n_shingles, got[k].component_id) == (len(sets[k]), want[k]), k
    return links


def test_against_brute_force(spark, small):
    assert check(spark.read.parquet(f"{small}/documents.parquet"))


def test_groups_and_borders(spark):
    """Chains of copies, a passage that all share, frequent words, and pairs just at and below the threshold."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows, n = [], 0
    for g in range(12):
        base = passage + [rng.choice(vocab) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 14)):
            base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            rows.append((n, " ".join(base), "en", f"s{g}", 1))
            n += 1
    for size in range(1, 24):  # sets that differ by their last words
        a = [f"x{size}_{i}" for i in range(size + 4)]
        for cut in range(5):
            rows.append((n, " ".join(a[: len(a) - cut] + [f"y{n}_{i}" for i in range(cut)]), "en", "t", 1))
            n += 1
    rows += [(n + i, "the same short", "en", "u", 1) for i in range(40)]
    rng.shuffle(rows)
    assert len(check(documents(spark, rows))) > 800


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    check(docs)
    assert J.jaccard_classes(docs).count() == 11
    assert J.jaccard_classes(docs.where("false")).count() == 0
    extra = docs.withColumnRenamed("lang", "component").withColumnRenamed("source", "node").unionByName(docs.withColumnRenamed("lang", "component").withColumnRenamed("source", "node"))
    kept = J.keep_first_of_class(extra)
    assert kept.columns == extra.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 5, 6, 7, 8, 10]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    want = components({x for l in links if l[0] != l[1] for x in l}, links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bridges_between_components(spark):
    """Families of variants around the threshold, each in several copies: a pair's shared tokens meet under several
    largest components."""
    rng = random.Random(11)
    rows, n = [], 0
    for g in range(150):
        size = rng.randint(14, 60)
        base = [f"f{g}_{i}" for i in range(size)]
        for v in range(rng.randint(2, 6)):
            variant = list(base)
            for _ in range(rng.choice([1, 1, 2])):
                variant[rng.choice([rng.randrange(size), size - 1 - rng.randrange(3), rng.randrange(3)])] = f"v{g}_{v}_{rng.randrange(10**6)}"
            for _ in range(rng.randint(2, 7)):
                rows.append((n, " ".join(variant), "en", f"s{g}", 1))
                n += 1
    ids = list(range(n))
    rng.shuffle(ids)
    rows = [(ids[i], *r[1:]) for i, r in enumerate(rows)]
    assert len(check(documents(spark, rows))) > 3000


def test_texts_that_share_an_id(spark):
    """Different texts under one id are documents of their own; equal rows are one."""
    a, b, c = ("x%d " * 1 + " ".join(f"{t}{i}" for i in range(30)) for t in "abc")
    rows = [(1, a, "en", "s", 1), (2, b, "en", "s", 1), (2, a, "en", "t", 1), (3, c, "en", "s", 1), (3, c, "en", "s", 1), (4, b + " more", "en", "s", 1), (None, a, "en", "n", 1)]
    docs = documents(spark, rows)
    kept = sorted((r.doc_id or 0, r.source) for r in J.keep_first_of_class(docs).collect())
    assert kept == [(0, "n"), (1, "s"), (2, "s"), (3, "s")]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in J.jaccard_classes(docs).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (2, 2), (3, 3), (3, 3), (4, 2)]


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long, "en", "s", 1), (2, long + " end", "en", "s", 1), (3, long[: len(long) // 2], "en", "s", 1)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(documents(spark, rows)).collect()}
    assert got[1] == (199_996, 1) and got[2] == (199_997, 1) and got[3][1] == 3
