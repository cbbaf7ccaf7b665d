"""Ranks and quantiles beyond sampled sizes, records, contracts that raise, and files that a failed write leaves."""

import json
import subprocess
import sys

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recallframe.operators import records, retrieval, store, workload
from recallframe.sources import files, sinks

RAISED = (PySparkException, Py4JJavaError)  # several stages may fail at once


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ranks_beyond_a_million_rows(spark, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        n = 1_200_000
        df = spark.range(0, n, 1, 23).select(F.pmod(F.xxhash64("id"), F.lit(n // 3)).alias("k"), "id")
        got = retrieval.ranked_by(df, "k", "id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).first()
        assert tuple(got) == (n, n, 1, n)
        place = retrieval.ranked_by(df, "k", "id")
        wrong = place.alias("a").join(place.alias("b"), F.col("b.rank") == F.col("a.rank") + 1).where("struct(a.k, a.id) >= struct(b.k, b.id)").count()
        assert wrong == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ranks_of_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(None, "x"), (2.0, None), (float("nan"), "y"), (2.0, "a"), (None, None), (2.0, "a")], "k double, s string")
    got = retrieval.ranked_by(df, "k", "s").orderBy("rank").collect()
    assert [r.rank for r in got] == [1, 2, 3, 4, 5, 6] and [r.k for r in got][:2] == [None, None] and [r.s for r in got] == [None, "x", None, "a", "a", "y"]
    assert retrieval.ranked_by(df.where("false"), "k").count() == 0


def test_order_statistics(spark):
    rows = [("a", float(v)) for v in (5, 1, 9, 2)] + [("b", 3.0), ("b", None), (None, 7.0), (None, 8.0)]
    got = retrieval.order_statistics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", (0.0, 0.5, 0.95, 1.0)).collect()
    found = {(r.g, r.fraction): round(r["quantile"], 9) for r in got}
    assert [found["a", f] for f in (0.0, 0.5, 0.95, 1.0)] == [1, 3.5, 8.4, 9] and {found["b", f] for f in (0.0, 0.5, 1.0)} == {3} and found[None, 0.5] == 7.5


def test_dispatch(spark):
    assert retrieval.dispatch(0, 5, 5, True, False, 8) == {"k": 1, "candidates": 1, "beam": 8, "approximate": True}
    assert retrieval.dispatch(9, 5, 5, True, False, 2) == {"k": 5, "candidates": 5, "beam": 5, "approximate": False}
    assert retrieval.dispatch(2, 5, 3, True, True, 2)["approximate"] is False and retrieval.dispatch(2, 5, 5, True, True, 2)["approximate"] is True
    rows = spark.createDataFrame([(f"r{i}", i, [float(i % 7), 1.0], "s" if i % 2 else "t") for i in range(40)], "id string, ordinal long, vector array<float>, scope string")
    cells = spark.createDataFrame([(0, [0.0, 1.0]), (1, [6.0, 1.0])], "cell int, centre array<double>")
    exact = [r.id for r in retrieval.search(rows, [1.0, 0.0], 6).collect()]
    assert [r.id for r in retrieval.dispatched_search(rows, [1.0, 0.0], 6, cells=cells).orderBy("rank").collect()][:5] == exact[:5]
    assert retrieval.dispatched_search(rows, [1.0, 0.0], 500, cells=cells).count() == 40
    assert {r.id for r in retrieval.dispatched_search(rows, [1.0, 0.0], 3, {"scope": "s"}, cells).collect()} == {r.id for r in retrieval.search(rows, [1.0, 0.0], 3, {"scope": "s"}).collect()}
    lone = spark.createDataFrame([(7, [9.0, 9.0])], "cell int, centre array<double>").union(spark.createDataFrame([(8, [-9.0, -9.0])], "cell int, centre array<double>"))
    assert retrieval.dispatched_search(rows, [-1.0, -1.0], 30, cells=lone).count() == 30  # the index is short: exact search answers
    assert retrieval.dispatched_search(rows.where("false"), [1.0, 0.0], 3).count() == 0
    with pytest.raises(ValueError):
        retrieval.dispatched_search(rows, [1.0], 3)
    for bad in (lambda: retrieval.adapter_search(rows, [1.0, 0.0], 0), lambda: retrieval.adapter_search(rows, []), lambda: retrieval.approximate_top_k(rows, rows, 1, spark.range(5000).select(F.col("id").alias("cell"), F.array(F.lit(1.0)).alias("centre")))):
        with pytest.raises(ValueError):
            bad()
    assert retrieval.adapter_search(rows, [1.0, 0.0]).count() == 5 and retrieval.adapter_search(rows, [1.0, 0.0], 9, {"scope": "none"}).count() == 0
    twice = rows.union(rows.where("id = 'r6'"))
    with pytest.raises(RAISED):
        retrieval.adapter_search(twice, [1.0, 0.0], 9).collect()


def test_inserts(spark):
    base = spark.createDataFrame([("a", 0, [1.0, 2.0])], "id string, ordinal long, vector array<float>")
    row = "id string, fact_id string, vector array<double>, seq int"
    got = store.inserted(base, spark.createDataFrame([("x", None, [1.0, 1.0], 0), ("y", "f", [2.0, 2.0], 1)], row)).orderBy("ordinal").collect()
    assert [(r.id, r.ordinal) for r in got] == [("a", 0), ("x", 1), ("f", 2)]
    fresh = store.inserted(base, spark.createDataFrame([("x", None, [1.0, 1.0], 0), (None, None, [2.0, 2.0], 1)], row)).collect()
    assert len({r.id for r in fresh}) == 3 and not {"x"} & {r.id for r in fresh}
    for vector in ([1.0], None):
        with pytest.raises(RAISED):
            store.inserted(base, spark.createDataFrame([("x", None, vector, 0)], row)).collect()
    assert store.reset(base).count() == 0 and store.collection_info(store.reset(base), "n", "local").first().vectors == 0
    with pytest.raises(ValueError):
        store.require_inner_product("cosine")
    store.require_inner_product("inner_product")


def test_contracts_raise(spark):
    one = spark.range(1)
    for bad in ('"x"', "[1]", '{"a": 1}'):
        with pytest.raises(RAISED):
            one.select(records.strict_number(F.parse_json(F.lit(bad)))).collect()
    rows = spark.createDataFrame([("kv", 1)], "condition string, num_users int")
    with pytest.raises(ValueError):
        records.validated_rows(rows, ["condition", "absent"], ["kv"])
    for bad in (lambda: records.validated_rows(rows, ["condition"], ["other"]), lambda: one.select(records.condition_backend(F.lit("no"))), lambda: records.require_parity(one.select(F.array(F.lit(1)).alias("a"), F.array(F.lit(2)).alias("b")), "a", "b"),
                lambda: one.select(records.split_template(F.lit("none"), "<M>")), lambda: one.select(records.block_tail(F.lit(40), F.lit(33), 16)),
                lambda: one.select(records.memory_prompt(*[F.array(F.lit(1))] * 5, F.lit(3)))):
        with pytest.raises(RAISED):
            bad().collect()
    assert one.select(records.block_tail(F.lit(40), F.lit(32), 16).alias("t")).select("t.*").first().asDict() == {"loaded": 32, "tail": 8}


def test_catalogs(spark):
    expected = {k: f"v-{k}" for k in records.CATALOG_IDENTITY}
    assert len(records.CATALOG_IDENTITY) == 17
    schema = "identity map<string,string>, facts array<struct<fact_id:string,text:string>>"
    load = lambda identity, facts: records.load_facts(spark.createDataFrame([(identity, facts)], schema), expected).collect()
    assert [(r.ord, r.fact_id) for r in load(expected, [("a", "x"), ("b", "y")])] == [(0, "a"), (1, "b")]
    for identity, facts in ((expected | {"model": "other"}, []), (expected, None), (expected, [("a", "x"), ("a", "y")]), (expected, [(None, "x")]), (expected, [None])):
        with pytest.raises(RAISED):
            load(identity, facts)


def test_settled_responses_keep_the_baseline_key(spark):
    asked = records.attempts(spark.createDataFrame([("k",)], "key string"))
    assert [(r.attempt, r.temperature, r.top_p) for r in asked.orderBy("attempt").collect()] == [(1, 0.0, None), (2, 0.2, 1.0), (3, 0.5, 1.0)]
    said = spark.createDataFrame([("k", 1, "bad"), ("k", 2, "good"), ("k", 3, "bad"), ("l", 1, "bad")], "key string, attempt int, response string")
    kept, bad = records.settled_responses(said, F.when(F.col("response") == "bad", "bad"))
    assert sorted(map(tuple, kept.collect())) == [("k", "good", 2, True), ("l", None, 1, False)] and sorted((r.key, r.attempt) for r in bad.collect()) == [("k", 1), ("l", 1)]


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    path = f"{tmp_path}/lines"
    rows = spark.createDataFrame([(1,)], "a int")
    files.write_json_lines(rows, path)
    with pytest.raises(RAISED):
        files.write_json_lines(rows.select(F.raise_error(F.lit("no")).cast("string").alias("a")), path)
    assert files.read_json_lines(spark, path, "a int").collect() == [(1,)]
    files.write_json_lines(rows.selectExpr("a + 1 as a"), path)
    assert files.read_json_lines(spark, path, "a int").collect() == [(2,)]
    document = f"{tmp_path}/d.json"
    sinks.write_document(spark, document, {"a": 1})
    sinks.write_document(spark, document, {"a": 2})
    assert sinks.read_document(spark, document, {}) == {"a": 2}
    (tmp_path / "d.json").rename(tmp_path / "d.json.old")  # a write that was cut off between its renames
    assert sinks.read_document(spark, document, {}) == {"a": 2}


def test_workloads_draw_distinct_questions_without_listing_them(spark):
    samples = spark.createDataFrame([("a", 0)], "sample_id string, ord long")
    asked = spark.range(1000).select(F.lit("a").alias("sample_id"), F.col("id").alias("question_ord"), F.col("id").cast("string").alias("question_id"), F.lit("?").alias("query"))
    big = workload.requests(spark, samples, asked, 50, 40).collect()
    small = workload.requests(spark, samples, asked, 20, 7).collect()
    per = {u: [r.question_id for r in big if r.user_index == u] for u in range(50)}
    assert all(len(set(x)) == 40 for x in per.values()) and set(map(tuple, small)) <= set(map(tuple, big))
    assert len({tuple(x) for x in per.values()}) == 50 and len({q for x in per.values() for q in x}) > 700


def test_entry_stands_without_the_training_data_part():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'op1_license_scan' in q, 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, cwd=str(files.__file__).rsplit("/recallframe/", 1)[0])
    n, op1, pipeline = out.stdout.split()
    assert int(n) > 80 and op1 == pipeline == "False", json.dumps([out.stdout, out.stderr[-400:]])
