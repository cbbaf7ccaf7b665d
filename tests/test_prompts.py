"""Routing by prefixes, query tokens behind a memory, request parameters and judge payloads."""

import random

import pytest
from pyspark.sql import functions as F
from recallframe.functions import text as X
from recallframe.operators import context, models, retrieval


def test_routing_against_plain_search(spark):
    rng = random.Random(3)
    memories = [(f"u{i}", i, [rng.choice([1, 2, None]) for _ in range(rng.randint(0, 6))]) for i in range(40)]
    asked = [(i, rng.choice([None, None, "u3", "nobody"]), [rng.choice([1, 2, None]) for _ in range(rng.randint(0, 9))]) for i in range(200)] + [(900, None, None)]
    got = context.route_requests(spark.createDataFrame(asked, "request_id long, user_id string, prompt array<int>"), spark.createDataFrame(memories, "user_id string, ord int, tokens array<int>"))

    def plain(user, prompt):
        if user is not None:
            return user
        hits = [(o, u) for u, o, t in memories if prompt is not None and len(prompt) > len(t) and prompt[: len(t)] == t]
        return min(hits)[1] if hits else None

    assert {r.request_id: r.user_id for r in got.collect()} == {i: plain(u, p) for i, u, p in asked}
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_routing_without_listed_lengths(spark, monkeypatch):
    monkeypatch.setattr(context, "LISTED_LENGTHS", 1)
    test_routing_against_plain_search(spark)


def test_query_behind_a_memory(spark):
    rows = [([1, 5], [1, 7]), ([2, 5], [1, 7]), ([1], [7]), ([], [1]), ([1], [1]), ([1], []), (None, [1])]
    frame = spark.createDataFrame(rows, "m array<int>, q array<int>")
    got = frame.select(context.query_for_memory(F.col("m"), F.col("q"), 1).alias("x")).select("x.*").collect()
    assert [(r.token_ids, r.stripped) for r in got] == [([7], True), ([1, 7], False), ([7], False), ([1], False), ([], True), ([], False), ([1], False)]
    assert all(not r.x.stripped for r in frame.select(context.query_for_memory(F.col("m"), F.col("q"), None).alias("x")).collect())
    behind = frame.limit(1).select(context.equivalence_prompt(F.col("m"), F.col("q"), 1, F.array(F.lit(1), F.lit(8))).alias("x")).first().x
    assert (behind.memory_token_ids, behind.query_token_ids, behind.prompt_token_ids, behind.stripped) == ([1, 5], [8, 1, 7], [1, 5, 8, 1, 7], True)


def test_largest_prompt_and_turns(spark):
    prompts = spark.createDataFrame([([1, 2],), ([1],), ([],)], "tokens array<int>")
    assert context.largest_prompt(prompts, 2).first().largest == 2 and context.largest_prompt(prompts.limit(0), 0).first().largest == 0
    with pytest.raises(Exception, match="2 tokens, more than 1"):
        context.largest_prompt(prompts, 1).collect()
    turns = spark.createDataFrame([("a", "xy", 1), ("a", "xy", 2), ("b", "", 3)], "turn_id string, line string, n int")
    assert sorted((r.n, r.token_ids) for r in context.turn_tokens(turns, models.character_tokens).collect()) == [(1, [120, 121]), (2, [120, 121]), (3, [])]
    with pytest.raises(Exception, match="different texts of turn a"):
        context.turn_tokens(turns.union(spark.createDataFrame([("a", "z", 4)], turns.schema)), models.character_tokens).collect()


def test_request_parameters_are_clones(spark):
    frame = spark.createDataFrame([(1, "u"), (2, None)], "n int, user_id string")
    got = context.routed_params(frame, F.create_map(F.lit("top_p"), F.lit("1"), F.lit("memory_user_id"), F.lit("old"))).orderBy("n").collect()
    assert [r.params for r in got] == [{"top_p": "1", "memory_user_id": "u"}, {"top_p": "1"}]


def test_judge_payload_says_why(spark):
    rows = [("true", None, False), ("what?", None, False), ("true", "timeout", False), (None, "timeout", None), ("true", None, True)]
    got = spark.createDataFrame(rows, "x string, e string, s boolean").select(X.judge_payload("x", F.col("e"), F.col("s")).alias("j")).collect()
    assert [tuple(r.j) for r in got] == [(True, "", "true", "ok"), (None, "what?", "what?", "unparsed"), (None, "timeout", None, "error"), (None, "timeout", None, "error"), (None, "", None, "skipped")]


def test_prepared_hits(spark):
    facts = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "fact_id int, text string")
    found = spark.createDataFrame([("q", i, f"t{i}", float(i % 3)) for i in range(6)], "query_id string, fact_id int, text string, score double")
    got = retrieval.prepared_hits(found, facts, 4).orderBy("rank").collect()
    assert [(r.fact_id, r.rank, r.distance) for r in got] == [(2, 1, -1.0), (5, 2, -1.0), (1, 3, 0.0), (4, 4, 0.0)]
    bad = {"found twice": found.union(found.limit(1)), "text differs": found.withColumn("text", F.lit("x")), "unknown fact": found.withColumn("fact_id", F.col("fact_id") + 9), "not finite": found.withColumn("score", F.lit(float("nan")))}
    for match, rows in bad.items():
        with pytest.raises(Exception, match=match):
            retrieval.prepared_hits(rows, facts, 9).collect()
    with pytest.raises(ValueError, match="at least 1"):
        retrieval.prepared_hits(found, facts, 0)
