"""Chunk caches, settings and measurements on literal fixtures."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recallframe.operators import chunks, settings

RAISED = (PySparkException, Py4JJavaError)
CHUNKS = "key string, kind string, name string, token_ids array<int>, context_turn_ids array<string>, context_prefix_tokens int, raw_context_prefix_tokens int, context_prefix_truncated_tokens int, kv binary"


def chunk(key, kind, name, tokens=(1, 2)):
    return key, kind, name, None if tokens is None else list(tokens), [], 0, 0, 0, b"kv"


def cache(spark, rows, meta=None, version=1, tables=True):
    payloads = spark.createDataFrame([("a", version, meta, tables)], "key string, version int, meta map<string,string>, has_tables boolean")
    expected = spark.createDataFrame([("a", {"model": "m", "none": None})], "key string, meta map<string,string>")
    facts = spark.createDataFrame([("a", "f"), ("a", "f")], "key string, name string")
    return payloads, spark.createDataFrame(rows, CHUNKS), expected, facts


WHOLE = [chunk("a", "fact", "f"), chunk("a", "scaffold", "header"), chunk("a", "scaffold", "footer", ())]
META = {"model": "m", "more": "x"}


@pytest.mark.parametrize(
    ("rows", "meta", "version", "tables", "problem"),
    [
        (WHOLE, META, 1, True, None),  # an expected null is met by an entry that is missing, and an empty part is there
        (WHOLE + [chunk("a", "fact", "f"), chunk("a", "scaffold", "empty_memory")], META, 1, True, None),
        (WHOLE, META, 2, True, "version"),
        (WHOLE, META, None, True, "version"),
        (WHOLE, None, 1, True, "meta"),
        (WHOLE, {"model": "n"}, 1, True, "meta"),
        (WHOLE, {}, 1, True, "meta"),
        (WHOLE[1:], META, 1, True, "facts"),
        (WHOLE + [chunk("a", "fact", "g")], META, 1, True, "facts"),
        (WHOLE[:2], META, 1, True, "scaffold"),
        (WHOLE[:2] + [chunk("a", "scaffold", "footer", None)], META, 1, True, "scaffold"),
        (WHOLE, META, 1, None, "tables"),
    ],
)
def test_payload_problems(spark, rows, meta, version, tables, problem):
    own = cache(spark, rows, meta, version, tables)
    assert [tuple(r) for r in chunks.payload_problems(*own).collect()] == [("a", problem)]
    got = chunks.load_chunks(*own)
    assert "kv" not in got.columns and got.count() == (len(rows) if problem is None else 0)


def test_unknown_payload_and_empty_caches(spark):
    payloads, rows, expected, facts = cache(spark, WHOLE, META)
    assert chunks.payload_problems(payloads.where("false"), rows, expected, facts).first().problem == "missing"
    assert chunks.payload_problems(payloads, rows, expected.where("false"), facts).count() == 0
    nothing = chunks.payload_problems(payloads, rows.where("kind = 'scaffold'"), expected, facts.where("false"))
    assert nothing.first().problem is None  # no facts were asked for and none are there


def test_failed_save_leaves_the_old_cache(spark, tmp_path):
    payloads, rows, expected, facts = cache(spark, WHOLE, META)
    path = str(tmp_path / "cache")
    chunks.save_chunks(payloads, rows, path)
    with pytest.raises(RAISED):
        chunks.save_chunks(payloads, rows.withColumn("name", F.raise_error(F.lit("lost")).cast("string")), path)
    assert chunks.load_chunks(*chunks.read_chunks(spark, path), expected, facts).count() == 3


def test_batches_must_match_their_prompts(spark):
    prompts = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "batch int, ord int")
    outputs = spark.createDataFrame([(1, 0, [1, 2], [3]), (1, 1, [1], None), (2, 0, None, [])], "batch int, ord int, prompt_tokens array<int>, output_tokens array<int>")
    assert sorted(tuple(r) for r in settings.batch_totals(prompts, outputs).collect()) == [(1, 3, 1), (2, 0, 0)]
    assert settings.batch_totals(prompts.where("false"), outputs.where("false")).count() == 0
    for p, o in ((prompts, outputs.where("batch = 1")), (prompts.where("batch = 1"), outputs), (prompts.where("ord = 0"), outputs)):
        with pytest.raises(RAISED, match="outputs for"):
            settings.batch_totals(p, o).collect()


def test_progress_on_odd_numbers(spark):
    got = spark.createDataFrame([(1, 9, 4), (4, 9, 4), (5, 9, 4), (9, 9, 4), (1, 9, 0), (1, 0, 4), (4, 9, -4), (None, 9, 4)], "i int, n int, k int")
    assert [r[0] for r in got.select(settings.progress_due(F.col("i"), F.col("n"), F.col("k"))).collect()] == [True, True, False, True, False, False, False, False]


def test_arguments_that_are_no_objects_stay(spark):
    said = ["[1]", "no json", None, '{"response_format": "json_object"}', '{"response_format": {"type": "json_object"}}']
    got = spark.createDataFrame([(s,) for s in said], "s string").select(settings.bounded_arguments(F.col("s"), '{"type": "x"}', 5).alias("a")).select("a.*").collect()
    assert [r.arguments for r in got[:4]] == said[:4] and [r.bounded for r in got] == [False] * 4 + [True]
    assert json.loads(got[4].arguments) == {"max_tokens": 5, "response_format": {"type": "x"}}


def test_configs_of_every_kind(spark):
    own = spark.createDataFrame([("embedding_api_key", "s"), ("judge_api_key", ""), ("memory_llm_api_key", None), ("model", "m")], "key string, value string")
    shown = settings.shown_config(own)
    assert [r.value for r in shown.collect()] == [settings.REDACTED, "", None, "m"]
    assert [r.value for r in settings.restored_config(shown, {}).collect()] == [None, "", None, "m"]


def test_requirements_and_time(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert settings.missing_requirements(spark, ["json", "no_such_module"], [str(tmp_path), gone]) == ["no_such_module", gone]
    assert settings.timed(spark.range(10)) > 0
