import numpy as np
from helpers import components
from recallframe.llm import capfilters as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    good = {}
    for i, v, l in rows:
        if i is not None and v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = (x / np.linalg.norm(x), l)
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= C.COSINE]
    return links, components([r[0] for r in rows if r[0] is not None], links)


def check(spark, rows):
    links, want = brute(rows)
    got = {r.vec_id: r for r in C.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, c in want.items():
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (sum(k in l for l in links), c, c == k), k
    return links


def near(rng, x, cos):
    z = rng.normal(size=x.shape)
    z -= (z @ x) * x / (x @ x)
    return cos * x + np.sqrt(1 - cos * cos) * z / np.linalg.norm(z) * np.linalg.norm(x)


def test_clusters_copies_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(C, "TILE", 16)
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for g in range(8):
        x = rng.normal(size=64)
        for _ in range(70 if g == 0 else 6):
            rows.append((n, near(rng, x, 0.985).astype(np.float32).tolist(), g % 3))
            n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(30)]
    assert len(check(spark, rows)) > 1000


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    y = np.stack([near(rng, v, 0.9305) for v in x])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(C.list_decode(unit(x)), C.list_decode(unit(y)), strict=True)]
    assert np.mean(met) > 0.99


def test_list_decoding_is_complete():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, a, b = C.product_code(10)
    r = x @ q
    full = (r[:, :5] @ a.T)[:, :, None] + (r[:, 5:] @ b.T)[:, None, :]
    for i, got in enumerate(C.list_decode(x)):
        want = np.flatnonzero(full[i].reshape(-1) >= C.HEIGHT * np.sqrt(2 / 10))
        assert set(want) <= set(got.tolist())


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0),
            (10, [2.0], 0), (11, [3.0], 0), (12, [-1.0], 0), (None, [1.0, 0.0], 0), (13, [1e30, 0.0], 0), (14, [1.0, 0.0], 1)]
    check(spark, rows)
    assert C.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_that_repeat_with_other_vectors_or_labels(spark):
    """Each row is a vector of its own, linked within its label alone."""
    rng = np.random.default_rng(4)
    a, b = (rng.normal(size=64).astype(np.float32) for _ in range(2))
    close = lambda v: near(rng, v, 0.99).astype(np.float32).tolist()
    rows = [(1, a.tolist(), 0), (1, b.tolist(), 1), (2, close(a), 0), (3, close(b), 1), (4, b.tolist(), 0), (4, b.tolist(), 0), (5, None, 0), (5, a.tolist(), None), (None, a.tolist(), 0)]
    got = C.near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert of[1] == [(1, 1, True)] * 2 and of[2] == of[3] == [(1, 1, False)] and of[4] == [(0, 4, True)] * 2 and of[5] == [(0, 5, True)] * 2
    assert of[None] == [(0, None, True)]
    odd = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("vec_id", "kept")
    assert C.near_duplicate_vectors(odd, id_col="kept").columns == ["kept_", "n_links", "component_id", "kept"]


def test_a_tile_against_plain_comparison():
    """Counts and spanning links of one group, with few and many filters before, one tile and two."""
    rng = np.random.default_rng(1)
    for t in range(12):
        n = int(rng.integers(2, 600))
        x, copies = rng.normal(size=(n, 4)), rng.integers(1, 4, n)
        tile = rng.integers(0, 2, n) if t % 2 else np.zeros(n, np.int64)
        below = [np.sort(rng.choice(5000, rng.integers(0, 4), replace=False)).astype(np.int32) for _ in range(n)]
        count, links = C.linked_in_tile(copies, tile, x, below, 0.93)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        close = unit @ unit.T >= 0.93
        apart = tile.min() != tile.max()
        pairs = [(i, j) for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True) if (not apart or tile[i] != tile[j]) and not set(below[i]) & set(below[j])]
        want = np.zeros(n, np.int64)
        for i, j in pairs:
            want[i] += copies[j]
            want[j] += copies[i]
        assert np.array_equal(count, want) and components(range(n), links) == components(range(n), pairs)


def test_near_copies_travel_seldom(spark):
    """Of 8,000 near copies (equal ones are one class) each is dealt out fewer than 64 times."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=64)
    vectors = np.stack([near(rng, x, 0.985) for _ in range(8000)])
    lists = C.list_decode(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    _, size = np.unique(np.concatenate(lists), return_counts=True)
    tiles = np.ceil(size / C.TILE).astype(int)
    assert (size * tiles)[size > 1].sum() < 64 * 8000
