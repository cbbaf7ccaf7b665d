"""Proximity graphs, collections that last, documents read in ranges, matrices with pushdown, selection and ranks."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from recallframe.operators import graph, retrieval
from recallframe.operators.collections import Collections, Conflict
from recallframe.plans.queries import QUERIES
from recallframe.sources import conversations, json_array, npy


# --- proximity graph ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, copies and a zero vector in 16 dimensions."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.standard_normal((3000, 16))
    x[100:140], x[200] = x[100], 0
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rows = [(f"v{i}", i, [float(v) for v in np.float32(x[i])]) for i in range(3000)]
    return spark.createDataFrame(rows, "id string, ordinal long, vector array<float>"), [r[2] for r in rows]


@pytest.fixture(scope="module")
def fitted(vectors):
    return graph.fit_graph(vectors[0])


def test_recall_against_the_exact_search(spark, vectors, fitted):
    frame, x = vectors
    asked = frame.where("ordinal % 100 = 0").select(F.col("ordinal").alias("query_id"), F.col("vector").alias("query_vector"))
    got = graph.graph_top_k(fitted, asked, 10, beam=48)
    hits = {}
    for r in got.collect():
        assert abs(r.score - float(np.dot(np.float64(x[r.query_id]), np.float64(x[r.ordinal])))) < 1e-12 and r.id == f"v{r.ordinal}" and r.distance == -r.score
        hits.setdefault(r.query_id, []).append((r.rank, r.ordinal))
    exact = {}
    for r in retrieval.top_k(frame, asked, 10).collect():
        exact.setdefault(r.query_id, set()).add(int(r.id[1:]))
    assert all(sorted(rank for rank, _ in v) == list(range(1, 11)) for v in hits.values()) and set(hits) == set(exact)
    right = sum(len({o for _, o in hits[q]} & exact[q]) for q in exact)
    assert right >= 9 * len(exact)


def test_graph_table(fitted):
    nodes = {r.ordinal: r.neighbours for r in fitted.nodes.collect()}
    assert len(nodes) == 3000 and fitted.pivots.count() <= graph.PIVOTS
    assert all(len(v) <= 2 * graph.DEGREE and k not in v and len(set(v)) == len(v) for k, v in nodes.items())


def test_saved_graph_and_padding(spark, fitted, tmp_path):
    graph.save_graph(fitted, str(tmp_path / "g"))
    again = graph.load_graph(spark, str(tmp_path / "g"))
    asked = spark.createDataFrame([(1, [1.0] * 16)], "query_id int, query_vector array<double>")
    assert sorted(graph.graph_top_k(again, asked, 5).collect()) == sorted(graph.graph_top_k(fitted, asked, 5).collect())
    few = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("c", 2, None)], "id string, ordinal long, vector array<float>")
    one = spark.createDataFrame([(7, [1.0, 0.5])], "query_id int, query_vector array<double>")
    got = graph.graph_top_k(graph.fit_graph(few), one, 4, padded=True).orderBy("rank").collect()
    assert [(r.rank, r.ordinal, r.id) for r in got] == [(1, 0, "a"), (2, 1, "b"), (3, -1, None), (4, -1, None)]
    assert graph.graph_top_k(graph.fit_graph(few.limit(0)), one.select("query_id", F.array().cast("array<double>").alias("query_vector")), 2).count() == 0
    with pytest.raises(Exception, match="dim"):
        graph.graph_top_k(again, one, 2).collect()
    with pytest.raises(ValueError, match="at least 1"):
        graph.beam_search(again, asked, 0)


def test_exact_fallback_where_the_beam_finds_too_few(spark):
    """A graph without edges: the beam finds its starts alone."""
    frame = spark.createDataFrame([(str(i), i, [math.cos(i), math.sin(i)]) for i in range(40)], "id string, ordinal long, vector array<float>")
    bare = graph.ProximityGraph(frame.withColumn("neighbours", F.array().cast("array<long>")), frame.limit(3).select("ordinal", "vector"), 40, 2)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    assert graph.beam_search(bare, asked, 10).count() == 3
    assert sorted(r.id for r in graph.graph_top_k(bare, asked, 10).collect()) == sorted(r.id for r in retrieval.top_k(frame, asked, 10).collect())


@pytest.mark.parametrize("recall", [0.9, 1.0])
def test_a_search_reaches_the_recall_that_it_names(spark, recall):
    """A graph without edges, whose starts are hits enough but the wrong ones."""
    frame = spark.createDataFrame([(str(i), i, [math.cos(i), math.sin(i)]) for i in range(40)], "id string, ordinal long, vector array<float>")
    bare = graph.ProximityGraph(frame.withColumn("neighbours", F.array().cast("array<long>")), frame.where("ordinal % 5 = 1").select("ordinal", "vector"), 40, 2)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "query_id int, query_vector array<double>")
    rows = lambda got: sorted((r.query_id, r["rank"], r.id, r.score) for r in got.collect())
    exact = rows(retrieval.top_k(frame, asked, 4))
    assert rows(graph.graph_top_k(bare, asked, 4)) != exact
    assert rows(graph.graph_top_k(bare, asked, 4, recall=recall)) == exact
    assert rows(graph.graph_top_k(bare, asked, 40, recall=recall)) == rows(retrieval.top_k(frame, asked, 40))


# --- collections ----------------------------------------------------------------------------------------------


def points(spark, *rows):
    return spark.createDataFrame([(i, v and [float(x) for x in v], p, n) for n, (i, v, p) in enumerate(rows)], "id string, vector array<float>, payload map<string,string>, seq int")


def live(c):
    return [(r.id, r.ordinal, list(r.vector), r.payload) for r in c.rows().orderBy("ordinal").collect()]


def test_collection_life(spark, tmp_path):
    home = Collections(spark, str(tmp_path / "root"))
    assert home.names() == []
    c = home.create("tea", 2)
    c = c.insert(points(spark, ("a", [1, 0], {"user": "x"}), ("b", [0, 1], {"user": "y"}), ("a", [2, 0], {"user": "z"})))
    assert live(c) == [("a", 0, [2.0, 0.0], {"user": "z"}), ("b", 1, [0.0, 1.0], {"user": "y"})]
    c = c.insert(points(spark, ("c", [1, 1], None), ("b", [0, 3], {"user": "w"})))
    old = c
    c = c.update(spark.createDataFrame([("c", {"user": "x"})], "id string, payload map<string,string>"))
    c = c.delete(spark.createDataFrame([("a",), ("unknown",), (None,)], "id string"))
    again = Collections(spark, str(tmp_path / "root")).open("tea")
    assert again.version == c.version == 4 and live(again) == [("b", 1, [0.0, 3.0], {"user": "w"}), ("c", 2, [1.0, 1.0], {"user": "x"})]
    assert [r[0] for r in live(old)] == ["a", "b", "c"] and [r[0] for r in live(again.refreshed())] == ["b", "c"]
    again = again.insert(points(spark, ("a", [5, 5], {})))
    assert live(again)[-1][:2] == ("a", 3)
    packed = again.compact()
    assert [(r[0], r[1]) for r in live(packed)] == [("b", 0), ("c", 1), ("a", 2)] and len(packed.about["parts"]) == 1
    assert [r.id for r in packed.search([0.0, 1.0], 2).orderBy("rank").collect()] == ["a", "b"]
    assert [r.id for r in packed.search([0.0, 1.0], 2, {"user": "x"}).collect()] == ["c"]
    info = packed.info().first()
    assert (info.name, info.backend, info.distance, info.vectors, info.embedding_dim) == ("tea", "local", "inner_product", 3, 2)
    empty = packed.reset()
    assert live(empty) == [] and live(empty.insert(points(spark, ("q", [1, 2, 3], None)))) == [("q", 0, [1.0, 2.0, 3.0], None)]
    home.create("other.one")
    assert home.names() == ["other.one", "tea"] and home.drop("tea") and not home.drop("tea") and home.names() == ["other.one"]


def test_of_two_writers_one_fails(spark, tmp_path):
    home = Collections(spark, str(tmp_path / "root"))
    mine = home.create("c", 2)
    theirs = home.open("c")
    mine = mine.insert(points(spark, ("a", [1, 0], None)))
    for change in (lambda: theirs.insert(points(spark, ("b", [0, 1], None))), lambda: theirs.delete(spark.createDataFrame([("a",)], "id string")), theirs.reset):
        with pytest.raises(Conflict):
            change()
    assert live(home.open("c")) == live(mine) and len(list((tmp_path / "root/c/parts").iterdir())) == 1
    assert len(live(theirs.refreshed().insert(points(spark, ("b", [0, 1], None))))) == 2


def test_collections_refuse(spark, tmp_path):
    home = Collections(spark, str(tmp_path / "root"))
    c = home.create("c", 2).insert(points(spark, ("a", [1, 0], None)))
    before = live(c)
    for bad in (points(spark, ("b", [1, 0, 0], None)), points(spark, (None, [1, 0], None)), points(spark, ("b", None, None)), points(spark, ("b", [], None))):
        with pytest.raises(Exception, match="store's dim"):
            c.insert(bad)
    with pytest.raises(Exception, match="unknown id"):
        c.update(spark.createDataFrame([("zz", [1.0, 2.0])], "id string, vector array<float>"))
    with pytest.raises(ValueError, match="different dimensions"):
        home.create("free").insert(points(spark, ("a", [1], None), ("b", [1, 2], None)))
    with pytest.raises(ValueError, match="inner_product"):
        home.create("d", 2, "cosine")
    for wrong in (lambda: home.create("c", 3), lambda: home.create("c", 2, backend="graph"), lambda: home.create("../up")):
        with pytest.raises(ValueError):
            wrong()
    for absent in (lambda: home.open("nothing"), lambda: home.open("c", 9)):
        with pytest.raises(KeyError):
            absent()
    with pytest.raises(ValueError, match="dim"):
        c.search([1.0], 1)
    assert live(home.open("c")) == before and home.create("c").version == 1


# --- documents in ranges --------------------------------------------------------------------------------------


def scanned(spark, path, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return [(r.key, r.pos, r.nth_object, r.record) for r in json_array.entries(spark, path).orderBy("file", "list", "pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def odd_records(seed, n=12):
    rng = random.Random(seed)
    texts = ["plain", 'quote " inside', "brace } and { and ] [", "back\\slash", '\\"', "é日本😀", "comma, colon: ", "\n\t", "}", '"}, {"', "x" * 300]
    value = lambda deep: rng.choice([None, True, 3, -2.5e3, rng.choice(texts), [] if deep > 3 else [value(deep + 1) for _ in range(rng.randint(0, 3))], {} if deep > 3 else {rng.choice(texts) + str(i): value(deep + 1) for i in range(rng.randint(0, 3))}])
    return [value(0) if rng.random() < 0.2 else {"id": i, rng.choice(texts): value(0), "turns": [{"text": rng.choice(texts)} for _ in range(rng.randint(0, 4))]} for i in range(n)]


@pytest.mark.parametrize("size", [150, 400, 1000, 1 << 20])
@pytest.mark.parametrize("form", ["list", "object", "pretty"])
def test_one_document_in_ranges(spark, tmp_path, size, form):
    own = odd_records(size)
    document = own if form == "list" else {"version": "1, {x}", "meta": {"a": [1, {"b": "]}"}], "samples": 0}, "samples": own, "tail": [], "other": [{"z": 1}, 2]}
    text = json.dumps(document, ensure_ascii=size % 2 == 0, indent=2 if form == "pretty" else None)
    (tmp_path / "d.json").write_text(("\ufeff" if size == 150 else "") + ("\n  " if size == 400 else "") + text + "\n" * (size == 1000))
    got = scanned(spark, str(tmp_path / "d.json"), size)
    mine = [g for g in got if g[0] == (None if form == "list" else "samples")]
    assert [json.loads(g[3]) for g in mine] == own and [g[1] for g in mine] == list(range(len(own)))
    assert [g[2] for g in mine] == [sum(isinstance(x, dict) for x in own[:i]) for i in range(len(own))]
    if form != "list":
        assert [json.loads(g[3]) for g in got if g[0] == "other"] == [{"z": 1}, 2] and {g[0] for g in got} == {"samples", "other"}


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"sample_id": f"s{i}", "conversation": [{"speaker": "u", "text": "hi " * 50}]} for i in range(500)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert json_array._ranges(spark, str(tmp_path)).rdd.getNumPartitions() > 10
        samples = conversations.records(spark, str(tmp_path / "d.json"))
        assert sorted((r.ord, r.sample_id) for r in samples.collect()) == [(i, f"s{i}") for i in range(500)]
        assert conversations.turns(samples).count() == 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_document_is_one_file_where_partitions_are_not_merged(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"said {c} {t} " + "word " * 20) for c in range(300) for t in range(1 + c % 3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        got = sorted((int(r.sample_id), r.ord, r.turns) for r in QUERIES["conversation_files"](spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert got == [(c, c // 8, 1 + c % 3) for c in range(300)]


@pytest.mark.parametrize("text", ['"text"', "3", '[{"a": 1}', '[{"a": "x]', '{"a": [1, 2}', ""])
def test_what_is_no_document_raises(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    if text in ("", '{"a": [1, 2}'):  # nothing to read; brackets that end at the right depth
        return
    with pytest.raises(Exception, match="unsupported root|not one JSON document"):
        json_array.entries(spark, str(tmp_path / "d.json")).collect()


# --- matrices -------------------------------------------------------------------------------------------------


@pytest.fixture
def matrices(spark, tmp_path):
    rows = [(f"k{k}", i, [float(k), float(i), -1.5]) for k in range(5) for i in range(20 + k)]
    npy.write_npy(spark.createDataFrame(rows, "key string, row long, vector array<float>"), str(tmp_path / "m"))
    return tmp_path / "m", rows


def test_matrices_round_trip(spark, matrices):
    path, rows = matrices
    assert sorted(p.name for p in path.iterdir()) == [f"k{k}.npy" for k in range(5)]
    for k in range(5):
        assert np.load(path / f"k{k}.npy").tolist() == [r[2] for r in rows if r[0] == f"k{k}"]
    np.save(path / "one.npy", np.array([1.0, 2.0, 3.0]))
    np.save(path / "half.npy", np.ones((2, 3), np.float16))
    got = [(r.key, r.row, list(r.vector)) for r in npy.read_npy(spark, str(path)).collect()]
    assert sorted(got) == sorted([*rows, ("one", 0, [1.0, 2.0, 3.0]), ("half", 0, [1.0] * 3), ("half", 1, [1.0] * 3)])


def test_pushed_and_residual_filters(spark, matrices):
    path, rows = matrices
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains, StringStartsWith

    reader = npy.NpyReader(str(path), 60)
    left = [EqualTo(("vector",), None), StringContains(("key",), "k")]
    assert list(reader.pushFilters([In(("key",), ("k1", "k2", "nothing")), StringStartsWith(("key",), "k"), GreaterThan(("row",), 3), LessThanOrEqual(("row",), 12), *left])) == left
    parts = reader.partitions()
    assert {npy.key_of(p.path) for p in parts} == {"k1", "k2"} and len(parts) == 4  # five rows of 12 bytes in a part
    assert sorted((b.column(0)[i].as_py(), b.column(1)[i].as_py()) for p in parts for b in reader.read(p) for i in range(len(b))) == [(k, i) for k in ("k1", "k2") for i in range(4, 13)]
    frame = npy.read_npy(spark, str(path)).where("key in ('k1', 'k4') and row >= 18 and vector[1] > 18 and (row = 19 or key = 'k4')")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "vector" in plan.split("Filter", 1)[1].split("\n")[0]
    assert sorted((r.key, r.row) for r in frame.collect()) == [("k1", 19), ("k1", 20)][:1] + [("k4", i) for i in range(19, 24)]
    assert npy.read_npy(spark, str(path)).where("key = 'absent'").count() == 0


def test_matrices_refuse(spark, matrices):
    path, _ = matrices
    make = lambda *rows: spark.createDataFrame(list(rows), "key string, row long, vector array<float>")
    for bad in (make(("a/b", 0, [1.0])), make(("", 0, [1.0])), make(("a", 0, [1.0]), ("a", 1, [1.0, 2.0]))):
        with pytest.raises(Exception, match="keys are names|different dimensions"):
            npy.write_npy(bad, str(path))
    assert sorted(p.name for p in path.iterdir() if p.suffix == ".npy") == [f"k{k}.npy" for k in range(5)]
    (path / "bad.npy").write_bytes(b"no matrix at all")
    with pytest.raises(Exception, match="no matrix"):
        npy.read_npy(spark, str(path)).collect()
    (path / "bad.npy").write_bytes(npy.matrix_header(9, 3) + b"\0" * 12)
    with pytest.raises(Exception, match="ends early"):
        npy.read_npy(spark, str(path)).collect()


# --- selection and ranks --------------------------------------------------------------------------------------


def test_keys_rise_as_bits_do(spark):
    rng = random.Random(1)
    edges = [f(2.0**e) for e in range(-1074, 1024, 7) for f in (float, lambda x: math.nextafter(x, 0), lambda x: math.nextafter(x, math.inf))]
    values = [0.0, -0.0, 5e-324, -5e-324, math.inf, -math.inf, *edges, *[-x for x in edges], *[rng.uniform(-1, 1) * 10 ** rng.randint(-320, 308) for _ in range(2000)]]
    for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", retrieval.order_key(F.col("v")).alias("k")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.k == (-bits if r.v < 0 else bits), r.v


def test_quantiles_of_awkward_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1e3), rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300), 7.0, None])) for _ in range(3000)] + [("one", 4.0), ("none", None)]
    got = {(r.g, r.fraction): r.quantile for r in retrieval.order_statistics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", (0.0, 0.05, 0.5, 0.95, 1.0)).collect()}
    assert {g for g, _ in got} == {"a", "b", None, "one"}
    for (g, f), q in got.items():
        want = float(np.quantile([v for h, v in rows if h == g and v is not None], f))
        assert q == pytest.approx(want, rel=1e-9), (g, f)


def test_quantiles_with_one_dominant_value(spark):
    frame = spark.range(1_000_000).select(F.when(F.col("id") % 10 > 0, 5.5).otherwise(F.col("id") * 1.25).alias("v"))
    got = {r.fraction: r.quantile for r in retrieval.order_statistics(frame, [], "v", (0.0, 0.5, 0.95, 1.0)).collect()}
    own = np.sort(np.where(np.arange(1_000_000) % 10 > 0, 5.5, np.arange(1_000_000) * 1.25))
    assert got == {f: pytest.approx(float(np.quantile(own, f))) for f in (0.0, 0.5, 0.95, 1.0)}


def test_repeated_keys_are_spread_over_ranges(spark):
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(1_000_000).select((F.col("id") % 10).alias("k"))
        sizes = [r["count"] for r in retrieval.numbered(rows, "k").groupBy(F.shiftright("__at", 33)).count().collect()]
        assert sum(sizes) == 1_000_000 and max(sizes) <= 1_000_000 / 16
        got = retrieval.ranked_by(rows, "k").groupBy("k").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("n")).orderBy("k").collect()
        assert [(r.lo, r.hi, r.n) for r in got] == [(1 + i * 100_000, (i + 1) * 100_000, 100_000) for i in range(10)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
