"""Literal fixtures: edges and contracts that the driver's tables don't reach."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recallframe.functions import numbers as N
from recallframe.functions import text as X
from recallframe.functions import time as Tm
from recallframe.operators import cache, context, evaluate, guards, models, retrieval, store, throughput, workload
from recallframe.sources import conversations as C
from recallframe.sources import files
from recallframe.streaming import events as E


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if hasattr(v, "cast") else F.lit(v))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("speaker", "text", "query", "caption", "want"),
    [
        ("Alice", "Look at this.", "What color is it?", "a green kayak", "Alice: Look at this. [Sharing image - query: What color is it?. The image shows: a green kayak]"),
        ("", " hi ", None, None, "hi"), ("Bob", "", "q", "", "Bob: [Sharing image - query for: q]"), ("Bob", None, None, "c", "Bob: [Sharing image that shows: c]"), (None, "", "", "", ""),
    ],
)
def test_memory_text(spark, speaker, text, query, caption, want):
    values = {k: F.lit(v).cast("string") for k, v in zip("abcd", (speaker, text, query, caption), strict=True)}
    assert one(spark, X.memory_text("a", "b", "c", "d"), **values) == want


@pytest.mark.parametrize(("text", "epoch"), [("1:56 pm on 8 May, 2023", 1683554160), ("1:56 pm on 8 Sep, 2023", 1694181360), ("2023-05-08", 1683504000), ("2023-05-08T13:56:00Z", 1683554160), ("", 0), (None, 0)])
def test_times(spark, text, epoch):
    assert one(spark, Tm.epoch_and_iso("t")["epoch"], t=F.lit(text).cast("string")) == epoch


def test_unreadable_time_raises(spark):
    with pytest.raises(PySparkException):
        one(spark, Tm.epoch_and_iso("t")["epoch"], t="sometime last spring")


@pytest.mark.parametrize(("said", "want"), [("true", True), ("false", False), ('{"correct": true}', True), ("not parseable", None), ('{"correct": 1}', None), ("```json\n{\"correct\": false}\n```", False), ("TRUE.", True), ("'false'!", False)])
def test_verdicts(spark, said, want):
    assert one(spark, X.verdict("s"), s=said) is want


def test_uuid5(spark):
    import uuid

    for name in ("", "abc", "naïve 日本", '{"a":1}'):
        assert one(spark, X.uuid5("n"), n=name) == str(uuid.uuid5(uuid.UUID(X.FACT_NAMESPACE), name))
    want = json.dumps({"sample_id": "s", "source_turn_id": "t:1", "text": 'a "b" ü'}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert one(spark, X.fact_id(F.lit("s"), F.lit("t:1"), "x"), x='  a  "b"\n ü ') == str(uuid.uuid5(uuid.UUID(X.FACT_NAMESPACE), want))


def test_small_text_functions(spark):
    assert one(spark, X.endpoint("x"), x=" HTTPS://Api.Example.COM/V1/#f ") == "https://api.example.com/V1"
    assert one(spark, X.endpoint("x"), x="  ") == "<provider-default>"
    assert one(spark, X.path_part("x"), x="a/b c") == "a_b_c" and one(spark, X.path_part("x"), x="//") == "default"
    assert one(spark, X.label_slug("x"), x="Big Model/7B") == "big-model-7b"
    assert one(spark, X.final_answer("x"), x="ANSWER: a\nANSWER:  b ") == "b" and one(spark, X.final_answer("x"), x="c") == "c"
    assert one(spark, X.mask_prompt_date("x"), x="a\n## Current Date\n2024-01-02\nb") == "a\n## Current Date\n<preembed-date>\nb"
    assert one(spark, X.user_counts("x"), x="10; 20,30  40") == [10, 20, 30, 40]
    for bad in ("", "0", "-5", "10,10", "10:512"):
        with pytest.raises(PySparkException):
            one(spark, X.user_counts("x"), x=bad)
    assert one(spark, X.content_text("x"), x=F.parse_json(F.lit('["a", {"text": "b"}, {"content": "c"}, 1]'))) == "abc"
    assert one(spark, X.content_text("x"), x=F.parse_json(F.lit('"plain"'))) == "plain"
    assert one(spark, X.truthy("x"), x=" Yes ") and not one(spark, X.truthy("x"), x="no")
    assert one(spark, X.category_name("x"), x="2") == "temporal" and one(spark, X.category_name("x"), x="9") == "unknown"
    assert one(spark, X.context_limit_error("x"), x="Maximum context length exceeded") and not one(spark, X.context_limit_error("x"), x="timeout")
    assert one(spark, X.turn_role(F.lit("Bob"), F.lit("Alice"), F.lit("Bob"))) == "assistant" and one(spark, X.turn_role(F.lit(" AI "), F.lit(None).cast("string"), F.lit("Bob"))) == "assistant"


def test_numbers(spark):
    assert [one(spark, N.number("x"), x=v) for v in ("1.5", " 2 ", "true", "x", "")] == [1.5, 2.0, None, None, None]
    assert one(spark, N.wilson(F.lit(0), F.lit(0))) == (0.0, 0.0)
    low, high = one(spark, N.wilson(F.lit(5), F.lit(5)))
    assert 0.5 < low < high == 1.0
    assert one(spark, N.slot_mapping("b", 2, F.lit(3)), b=F.array(F.lit(4), F.lit(1))) == [8, 9, 2]
    with pytest.raises(PySparkException):
        one(spark, N.slot_mapping("b", 2, F.lit(9)), b=F.array(F.lit(4)))
    assert one(spark, N.overlap_ratio(F.lit(0.0), F.lit(1.0))) == 0.0 and one(spark, N.overlap_ratio(F.lit(10.0), F.lit(2.5))) == 0.75
    assert one(spark, N.time_to_first_token(F.lit(None).cast("double"), F.lit(3.0), F.lit(1.0))) == 2000.0
    with pytest.raises(PySparkException):
        one(spark, N.time_to_first_token(F.lit(0.0), F.lit(1.0), F.lit(3.0)))
    assert one(spark, N.positive_delta(F.lit(5), F.lit(3))) == 0 and one(spark, N.positive_delta(F.lit(None).cast("int"), F.lit(3))) is None
    assert one(spark, N.ratio_text(F.lit(20.0), F.lit(10.0))) == "2.00x" and one(spark, N.ratio_text(F.lit(2.0), F.lit(0.0))) == "-" and one(spark, N.two_digits(F.lit(None).cast("double"))) == "-"
    assert one(spark, N.per_second(F.lit(0), F.lit(5.0))) is None and one(spark, N.safe_ratio(F.lit(1), F.lit(0))) is None


def vectors(spark):
    return spark.createDataFrame([("one", 0, [1.0, 0.0], "sample-1"), ("two", 1, [0.5, 0.5], "sample-2"), ("three", 2, [0.0, 1.0], "sample-1")], "id string, ordinal long, vector array<float>, user_id string")


def test_search(spark):
    v = vectors(spark)
    assert [(r.id, r["rank"]) for r in retrieval.search(v, [1.0, 0.0], 2, {"user_id": "sample-1"}).orderBy("rank").collect()] == [("one", 1), ("three", 2)]
    assert [r.id for r in retrieval.search(v, [1.0, 0.0], 500).orderBy("rank").collect()] == ["one", "two", "three"]
    big = spark.createDataFrame([("smaller", 0, [0.9, 0.1]), ("larger", 1, [2.0, 0.0])], "id string, ordinal long, vector array<float>")
    top = retrieval.search(big, [1.0, 0.0], 2).orderBy("rank").first()
    assert (top.id, top.score, top.distance) == ("larger", 2.0, -2.0)
    ties = spark.createDataFrame([("b", 1, [1.0]), ("a", 0, [1.0])], "id string, ordinal long, vector array<float>")
    assert [r.id for r in retrieval.search(ties, [1.0], 2).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        retrieval.top_k(v, v, 0)


def test_blocks_of_queries_agree_with_broadcast(spark, monkeypatch):
    v = vectors(spark)
    q = v.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    want = sorted(map(tuple, retrieval.top_k(v, q, 2).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 1)
    assert sorted(map(tuple, retrieval.top_k(v, q, 2).collect())) == want


def test_rows_meet_queries_as_matrices(spark, monkeypatch):
    """The rows of a join with every row, without making a row for each pair: odd vectors, ties and floors too."""
    import random

    from pyspark.sql import Window
    from recallframe.operators import blocks

    rng = random.Random(3)

    def vector():
        v = [rng.choice([-1.0, 0.0, 0.5, 1.0, 2.0]) for _ in range(3)]
        v[rng.randrange(3)] = rng.choice([None, float("nan"), float("inf"), 1.0, 1.0, 1.0])
        return rng.choice([v, v, v, v, None, [1.0], []])

    v = spark.createDataFrame([(f"v{i}", i, vector()) for i in range(200)], "id string, ordinal long, vector array<double>")
    q = spark.createDataFrame([(i, vector()) for i in range(40)], "query_id int, query_vector array<double>")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")
    plain = v.crossJoin(q).select("query_id", "id", "ordinal", retrieval.inner_product(F.col("vector"), F.col("query_vector")).alias("score")).withColumn("rank", F.row_number().over(best))
    said = lambda rows: sorted(str((r.query_id, r.id, r.score, r["rank"])) for r in rows)
    monkeypatch.setattr(blocks, "QUERIES", 7)
    for k, most in ((1, 4096), (5, 10), (190, 10)):
        monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", most)
        got = retrieval.top_k(v, q, k)
        assert said(got.collect()) == said(plain.where(F.col("rank") <= k).collect())
        assert "zip_with" not in got._jdf.queryExecution().toString()
    floored = retrieval.top_k(v, q.withColumn("least", F.lit(1.5)), 5, floor="least")
    assert said(floored.collect()) == said(plain.where("rank <= 5 and score >= 1.5").collect())


def test_payload_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i int, k string")
    ids = lambda f: [r.i for r in df.where(retrieval.payload_matches(f)).orderBy("i").collect()]
    assert ids({"k": None}) == [2] and ids({"k": {"ne": "a"}}) == [2, 3] and ids({"k": {"in": ["a", None]}}) == [1, 2] and ids({"k": {"in": []}}) == [] and ids(None) == [1, 2, 3]
    assert ids({"k": {"eq": "a", "ne": "b"}, "i": 1}) == [1]
    with pytest.raises(ValueError):
        ids({"k": {"like": "a"}})


def test_search_contract(spark):
    rows = [(1, "a", 1, 1.0, 2), (1, "b", 2, 0.5, 2), (2, "a", 1, 1.0, 2), (3, "a", 1, 1.0, 2), (3, "a", 2, 1.0, 2), (4, "a", 1, 3.4e38, 1), (5, "a", 2, 1.0, 1)]
    got = guards.valid_hits(spark.createDataFrame(rows, "query_id int, id string, rank int, score double, expected int"), F.col("expected"))
    assert {r.query_id: r.problem for r in got.collect()} == {2: "count", 3: "duplicate ids", 4: "scores", 5: "ranks"}


def test_ranks_across_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(7)
    got = retrieval.ranked_by(df, "x").collect()
    assert all(r["rank"] == r.x + 1 for r in got) and len(got) == 1000


def test_approximate_search_recall(spark):
    own = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    v = own.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"))
    cells = own.groupBy("label").agg(F.array(*[F.avg(F.col("embedding")[i]) for i in range(64)]).alias("centre")).select(F.col("label").alias("cell"), "centre")
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    exact = {(r.query_id, r.id) for r in retrieval.top_k(v, q, 5).collect()}
    near = {(r.query_id, r.id) for r in retrieval.approximate_top_k(v, q, 5, cells, 6).collect()}
    assert len(exact & near) / len(exact) >= 0.7


def test_context(spark):
    turns = spark.createDataFrame([("s", i, f"t{i}") for i in range(4)], "sample_id string, ord int, turn_id string")
    ask = lambda w: {r.turn_id: r.context for r in context.preceding_turns(turns, w).collect()}
    assert ask(2)["t2"] == ["t0", "t1"] and ask(3)["t0"] == [] and ask(0)["t3"] == []
    with pytest.raises(ValueError):
        ask(-1)
    facts = spark.createDataFrame([("s", "nowhere")], "sample_id string, source_turn_id string")
    with pytest.raises(PySparkException):
        context.fact_context(facts, turns, 1).collect()
    hits = spark.createDataFrame([(1, i, t, r) for r, (i, t) in enumerate([("m3b", "x"), ("m1", "y"), ("m3a", "z"), ("m2", "w"), ("m2", "w")], 1)], "query_id int, id string, text string, rank int")
    assert [r.id for r in context.unique_facts(hits).orderBy("pos").collect()] == ["m2", "m3a", "m1", "m3b"]
    with pytest.raises(PySparkException):
        context.unique_facts(spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2)], "query_id int, id string, text string, rank int")).collect()


def test_token_plans(spark):
    ids = lambda *x: F.array(*[F.lit(i) for i in x]) if x else F.array().cast("array<int>")
    p = one(spark, context.encoding_plan(ids(1, 2, 3, 4, 5), ids(8, 9), 4))
    assert (p.context_token_ids, p.input_token_ids, p.slice_start, p.slice_end, p.context_truncated_tokens) == ([4, 5], [4, 5, 8, 9], 2, 4, 3)
    with pytest.raises(PySparkException):
        one(spark, context.encoding_plan(ids(1), ids(1, 2, 3), 2))
    assert one(spark, context.pad_scaffold(ids(7), F.lit(0), 4)) == [0, 0, 7]
    assert one(spark, context.joined_prompt(ids(1, 5), ids(1, 6), 1)) == [1, 5, 6] and one(spark, context.joined_prompt(ids(), ids(1, 6), 1)) == [1, 6]
    assert one(spark, context.is_memory_prefix(ids(1, 2), ids(1, 2, 3))) and not one(spark, context.is_memory_prefix(ids(1, 2), ids(1, 2)))
    assert one(spark, context.first_mismatch(ids(1, 2, 3), ids(1, 9, 3))) == 1 and one(spark, context.first_mismatch(ids(1), ids(1))) is None and one(spark, context.first_mismatch(ids(1), ids(1, 2))) == 1
    assert one(spark, context.memory_budget(F.lit(10), 5, 100, 50)) == 35
    with pytest.raises(PySparkException):
        one(spark, context.memory_budget(F.lit(60), 5, 100, 50))
    req = spark.createDataFrame([("r1", "u2", [9]), ("r2", None, [1, 2, 3]), ("r3", None, [4, 4])], "request_id string, user_id string, prompt array<int>")
    mem = spark.createDataFrame([("u1", 0, [1, 2]), ("u2", 1, [1]), ("u3", 2, [4, 4])], "user_id string, ord int, tokens array<int>")
    assert {r.request_id: r.user_id for r in context.route_requests(req, mem).collect()} == {"r1": "u2", "r2": "u1", "r3": None}


def test_memory_plan_guards_its_budget(spark):
    facts = spark.createDataFrame([(1, 0, "a", "h", 5, 2, 0, ["t1", ""]), (1, 1, "b", "h2", 6, 3, 1, ["t1", "t2"])], "query_id int, pos int, fact_id string, text_hash string, tokens int, context_tokens int, truncated int, turn_ids array<string>")
    r = context.memory_plan(facts, "query_id", 20, 4, 2).first()
    assert (r.fact_ids, r.context_turn_ids, r.memory_tokens, r.context_tokens_max, r.context_tokens_truncated) == (["a", "b"], ["t1", "t2"], 15, 3, 1)
    with pytest.raises(PySparkException):
        context.memory_plan(facts, "query_id", 14, 4, 2).collect()


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (1, [1]), (10, [4, 4, 2]), (11, [4, 4, 3]), (100, [10] * 10)])
def test_bins(spark, n, sizes):
    rows = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(n)], "id int, tokens double, correct int")
    got = sorted(evaluate.accuracy_bins(rows).collect(), key=lambda r: r.bin)
    assert [r.judged_count for r in got] == sizes


def test_categories_and_summary(spark):
    rec = spark.createDataFrame([("1", True, 2.0), ("1", False, None), ("2", True, 4.0), ("4", None, 6.0)], "category string, correct boolean, query_ms double")
    got = {r.category: (r.name, r.accuracy, r.total) for r in evaluate.accuracy_by_category(rec).collect()}
    assert got == {"1": ("multi-hop", 0.5, 2), "2": ("temporal", 1.0, 1)}
    s = evaluate.run_summary(rec).first()
    assert (s.question_count, s.judged_count, s.correct_count, s.query_count, s.queries_per_sec) == (4, 3, 2, 3, 250.0)
    n = {r.metric: r for r in evaluate.numeric_summary(rec, "query_ms").collect()}["query_ms"]
    assert (n["count"], n.p50, n.p95) == (3, 4.0, 5.8)


def test_throughput_rows(spark):
    old = spark.createDataFrame([("kv", 10, 10.0), ("graph", 10, 10.0)], "condition string, num_users int, throughput_qps double")
    new = spark.createDataFrame([("kv", 10, 20.0)], "condition string, num_users int, throughput_qps double")
    merged = throughput.merge_rows(old, new).withColumn("fact_count", F.lit(3.0))
    wide = throughput.pivot_throughput(merged, ["store", "graph", "kv"], "kv", "graph")
    r = wide.first()
    assert (r.store, r.graph, r.kv, r.ratio, r.facts_per_user) == (None, 10.0, 20.0, 2.0, 3.0)
    assert throughput.report_lines(wide, ["store", "graph", "kv"])[-1] == "| 10 | 3 | - | 10.00 | 20.00 | 2.00x |"
    legacy = throughput.coerce_rows(spark.createDataFrame([("kv", "3.0", "")], "condition string, num_users string, throughput_qps string")).first()
    assert (legacy.num_users, legacy.throughput_qps, legacy.kv_store_backend, legacy.kv_h2d_bytes) == (3, None, "gpu", 0)
    assert [r.condition for r in throughput.in_condition_order(merged, ["graph", "kv"]).collect()] == ["graph", "kv"]
    empty = throughput.transfer_summary(spark.createDataFrame([], "num_bytes long, h2d_latency_ms double, staging_stall_ms double")).first()
    assert empty.total_transfers == 0 and empty.p99_h2d_latency_ms == 0.0
    asked = spark.createDataFrame([(c, n) for c in ("a", "kv") for n in (2, 1, 2)], "condition string, num_users int")
    assert sorted(map(tuple, throughput.worker_specs(asked, ["kv"]).collect())) == [("a", [1, 2]), ("kv", [1]), ("kv", [2])]
    grid = spark.createDataFrame([(m, k, w) for m in "abcd" for k in (5, 10, 20, 50) for w in (0, 5, 20, 50)], "model string, k int, window int")
    assert throughput.sweep(grid.union(grid), "text").count() == 80


def test_stores(spark):
    base = spark.createDataFrame([("tea", 0, "hot"), ("coffee", 1, "cold")], "id string, ordinal long, note string")
    fresh = spark.createDataFrame([("tea", "iced", 1), ("milk", "warm", 2), ("milk", "cool", 3)], "id string, note string, seq int")
    assert {(r.id, r.ordinal, r.note) for r in store.upsert(base, fresh).collect()} == {("tea", 0, "iced"), ("coffee", 1, "cold"), ("milk", 2, "cool")}
    assert [(r.id, r.ordinal) for r in store.append(base, fresh).orderBy("ordinal").collect()] == [("tea", 0), ("coffee", 1), ("tea", 2), ("milk", 3), ("milk", 4)]
    gone = store.delete(base, spark.createDataFrame([("tea",), ("none",)], "id string")).collect()
    assert [(r.id, r.ordinal) for r in gone] == [("coffee", 0)]
    with pytest.raises(PySparkException):
        store.update(base, spark.createDataFrame([("x", "y")], "id string, note string")).collect()
    top, inner = store.mirrored("p", "m")
    r = spark.range(1).select(F.expr("map('fact_id', 'f', 'role', null, 'other', 'o')").alias("p"), F.expr("map('role', 'user', 'x', 'y')").alias("m")).select(top.alias("t"), inner.alias("i")).first()
    assert r.t == {"fact_id": "f", "other": "o", "role": "user"} and r.i == {"role": "user", "x": "y", "fact_id": "f"}
    p = spark.range(1).select(F.expr("map('a', null)").alias("p"), F.expr("map('old', 'v')").alias("m"), F.expr("cast(null as map<string,string>)").alias("z"), F.expr("map('old', 'w')").alias("q"))
    assert p.select(store.promoted("p", "m", "new", "old").alias("v")).first().v == "v" and p.select(store.promoted("q", "z", "new", "old").alias("v")).first().v == "w"
    t = spark.createDataFrame([("", None, "x")], "memory string, data string, text string").select(*[c.alias(k) for k, c in store.payload_text().items()]).first()
    assert (t.memory, t.data, t.text) == ("", "x", "x")


def test_caches_and_models(spark):
    asked = spark.createDataFrame([("k1", 0), ("k2", 1), ("k2", 2)], "key string, pos int")
    known = spark.createDataFrame([("k1", "v1")], "key string, value string")
    out, grown = cache.memoised(asked, known, lambda m: models.answered(m.withColumn("prompt", F.col("key")), lambda ps: [p.upper() for p in ps]))
    assert {(r.pos, r.value) for r in out.collect()} == {(0, "v1"), (1, "K2"), (2, "K2")} and grown.count() == 2
    with pytest.raises(PySparkException):
        cache.memoised(asked, known, None)[0].collect()
    s = cache.cache_stats(asked, known, "pos").first()
    assert (s.hits, s.misses, s.computed) == (1, 2, 1)
    e = asked.select(models.embedder()("key").alias("v")).collect()
    assert len(e[0].v) == 8 and e[1].v == e[2].v
    assert one(spark, models.character_tokens("t"), t="ab") == [97, 98]
    facts = models.extracted_facts(spark.createDataFrame([("s", 1, "b"), ("s", 0, "a")], "sample_id string, ord int, text string"), lambda g: g.assign(fact=g.text.cumsum())[["sample_id", "fact"]], "sample_id string, fact string")
    assert [r.fact for r in facts.collect()] == ["a", "ab"]


def test_extraction_responses(spark):
    fact = lambda **x: {"id": "7", "text": " one ", "attributed_to": "user"} | x
    said = lambda *f: json.dumps({"memory": list(f)})
    rows = [
        (said(fact(), fact(text="two", linked_memory_ids=[])), None), ("[1]", "not an object"), ('{"memory": [], "x": 1}', "keys"), (said(fact(text=" ")), "blank text"), (said(*[fact()] * 6), "too many"),
        (said(fact(text="a" * 601)), "long text"), (said({"text": "a"}), "fields"), (said(fact(), fact(attributed_to=1)), "attributed_to"), (said(fact(linked_memory_ids="x")), "links"), (None, "not an object"),
    ]
    df = spark.createDataFrame([(r,) for r, _ in rows], "response string")
    assert [r.p for r in df.select(guards.extraction_problem().alias("p")).collect()] == [w for _, w in rows]
    assert [tuple(f) for f in df.select(guards.renumbered_facts().alias("f")).first().f] == [("0", "one"), ("1", "two")]


def test_workload_properties(spark):
    samples = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "sample_id string, ord long")
    asked = spark.createDataFrame([(s, q, f"{s}{q}", "?") for s in "abc" for q in range(5)], "sample_id string, question_ord int, question_id string, query string")
    big = workload.requests(spark, samples, asked, 7, 2).collect()
    small = workload.requests(spark, samples, asked, 4, 2).collect()
    assert [{r.sample_id for r in big if r.user_index == u} for u in range(7)] == [{"abc"[u % 3]} for u in range(7)]
    assert set(map(tuple, small)) <= set(map(tuple, big)) and len(big) == 14
    assert all(len({r.question_id for r in big if r.user_index == u}) == 2 for u in range(7))
    few = workload.requests(spark, samples, asked.where("question_ord < 2"), 1, 5).collect()
    assert len(few) == 5 and big[0].user_id.startswith("user_000")
    with pytest.raises(PySparkException):
        workload.requests(spark, samples, asked.where("sample_id = 'a'"), 2, 1).collect()
    p = spark.createDataFrame([(0, [5, 6, 7]), (1, [])], "ord int, tokens array<int>")
    assert [len(r.tokens) for r in workload.warmup_prompts(p, 100).orderBy("ord").collect()] == [3, 0]


def test_nested_conversations(spark, tmp_path):
    data = {"samples": [
        {"sample_id": "S", "conversation": {"speaker_a": "Alice", "speaker_b": "Bob", "session_1_date_time": "1:00 pm on 2 May, 2023", "session_1": [{"speaker": "Alice", "text": " late ", "dia_id": "D1:1"}, {"speaker": "Bob", "text": ""}, "bare"],
          "session_2_date_time": "1:00 pm on 1 May, 2023", "session_2": [{"role": "Bob", "content": "early", "blip_caption": "a dog", "query": "dog"}], "session_3": [{"text": "undated"}], "session_x": [1]},
         "qa": [{"question": "Q?", "answer": ["a", "b"], "category": 2, "evidence": ["D1:1"]}, {"question": " "}, {"query": "R?", "evidence": "D1:1"}]},
        7, {"conversation": ["hello"], "questions": {"z": {"question": "first"}, "a": {"question": "second", "gold_answer": 3}}},
    ]}
    (tmp_path / "c.json").write_text(json.dumps(data))
    rec = C.records(spark, str(tmp_path / "c.json"))
    assert [(r.sample_id, r.ord) for r in rec.orderBy("ord").collect()] == [("S", 0), ("sample-2", 1)]
    turns = C.turns(rec).orderBy("sample_id", "session_index", "turn_index").collect()
    assert [(t.sample_id, t.session_id, t.session_index, t.turn_index, t.speaker, t.text) for t in turns] == [
        ("S", "session_2", 1, 0, "Bob", "early"), ("S", "session_1", 2, 0, "Alice", "late"), ("S", "session_1", 2, 2, "", "bare"), ("S", "session_3", 3, 0, "", "undated"), ("sample-2", "session_1", 1, 0, "", "hello"),
    ]
    assert turns[0].image_caption == "a dog" and turns[0].image_query == "dog"
    qa = C.questions(rec).orderBy("sample_id", "pos").collect()
    assert [(q.question_id, q.question, q.answer, q.category, q.evidence) for q in qa] == [("q0", "Q?", "a; b", "2", ["D1:1"]), ("q2", "R?", "", "unknown", ["D1:1"]), ("q0", "first", "", "unknown", None), ("q1", "second", "3", "unknown", None)]
    assert C.records(spark, str(tmp_path / "c.json"), 1).count() == 1
    (tmp_path / "bad.json").write_text("3")
    with pytest.raises(PySparkException):
        C.records(spark, str(tmp_path / "bad.json")).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "x int").count() == 2
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n[1]\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_json_lines(spark, str(tmp_path / "b.jsonl"), "x int").collect()
    df = spark.createDataFrame([('say "hi"', None, [1, 2])], "a string, b double, c array<int>")
    files.write_csv(df.coalesce(1), str(tmp_path / "out"), ["a", "b", "c"])
    text = next((tmp_path / "out").glob("part*")).read_text()
    assert text == 'a,b,c\n"say ""hi""",,"[1,2]"\n'
    back = files.read_run_csv(spark, str(tmp_path / "out"), ["a", "b", "c"], ["b"]).first()
    assert back.a == 'say "hi"' and back.b is None
    assert files.read_run_csv(spark, str(tmp_path / "none"), ["a"], []).count() == 0
    files.write_catalog(spark.createDataFrame([("f1",), ("f1",)], "fact_id string"), str(tmp_path / "cat"), "i1")
    with pytest.raises(PySparkException):
        files.read_catalog(spark, str(tmp_path / "cat"), "i1").collect()
    assert files.available_memory(spark.createDataFrame([("MemTotal: 9 kB",), ("MemAvailable:    12 kB",)], "value string")).first().bytes == 12288
    files.write_json_lines(df, str(tmp_path / "j"))
    files.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    (tmp_path / "runs/r1-T1").mkdir(parents=True)
    (tmp_path / "runs/r1-T1/x.json").write_text("{}")
    assert [r.run_id for r in files.run_ids(spark, str(tmp_path / "runs"), "T1").collect()] == ["r1-T1"]
    assert files.union_by_name([df.select("a"), df.select("a", "b")]).columns == ["a", "b"]


def test_streams_agree_with_batches(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = E.event_stream(spark, str(tmp_path / "in"), src.schema)
    q = E.windowed_metrics(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = E.windowed_metrics(src.withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda r: (r.window_start, r.event_type, r.n)
    assert sorted(map(key, spark.table("hourly").collect())) == sorted(map(key, batch.collect()))
    E.append_json_lines(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == src.count()


def test_requests_meet_memories_of_every_length(spark):
    tokens = lambda n: F.array_repeat(F.col("id").cast("short"), (F.col("id") + n).cast("int"))
    mem = spark.range(10_600, 0, -1).select(F.col("id").alias("user_id"), F.col("id").alias("ord"), tokens(0).alias("tokens"))
    req = spark.range(1, 201).select(F.col("id").alias("request_id"), F.lit(None).cast("long").alias("user_id"), tokens(1).alias("prompt"))
    assert {r.request_id: r.user_id for r in context.route_requests(req, mem).collect()} == {n: n for n in range(1, 201)}
