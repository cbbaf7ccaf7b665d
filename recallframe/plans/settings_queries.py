"""Queries of chunk caches, run settings and measurements, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, settings
from ..sources.written import folder
from .queries import query, read


def _chunk_cache(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Turns stand for facts of their conversation; every seventh conversation has something stale."""
    turns = read(spark, d, "conversations").select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("name"), "turn", "text")
    fields = lambda df: df.select(F.col("conv_id").cast("string").alias("key"), "kind", "name", F.split("text", " ").alias("token_ids"), F.array("name").alias("context_turn_ids"), *[F.col("turn").alias(c) for c in chunks.CHUNK_FIELDS[2:]], F.lit(b"tensor").alias("kv"))
    facts = turns.where("conv_id % 7 <> 1 or turn > 0").withColumn("kind", F.lit(chunks.FACT))
    extra = turns.where("conv_id % 7 = 2 and turn = 0").withColumns({"kind": F.lit(chunks.FACT), "name": F.lit("unasked")})
    ids = turns.where("turn = 0")
    scaffold = ids.withColumn("kind", F.lit(chunks.SCAFFOLD)).withColumn("name", F.explode(F.array(F.lit("header"), F.lit("footer")))).where("conv_id % 7 <> 3 or name <> 'footer'")
    meta = lambda stale: F.create_map(F.lit("model"), F.when(stale, "old").otherwise("m"), F.lit("sample"), F.col("conv_id").cast("string"))
    payloads = ids.where("conv_id % 14 <> 7").select(F.col("conv_id").cast("string").alias("key"), F.when(F.col("conv_id") % 7 == 4, 0).otherwise(1).alias("version"), F.map_concat(meta(F.col("conv_id") % 7 == 5), F.create_map(F.lit("note"), F.lit("x"))).alias("meta"), (F.col("conv_id") % 7 != 6).alias("has_tables"))
    expected = ids.select(F.col("conv_id").cast("string").alias("key"), meta(F.lit(False)).alias("meta"))
    return payloads, fields(facts).union(fields(extra)).union(fields(scaffold)), expected, turns.select(F.col("conv_id").cast("string").alias("key"), "name")


@query("""
SELECT DISTINCT conv_id::VARCHAR AS key, CASE WHEN conv_id % 14 = 7 THEN 'missing' ELSE [NULL, 'facts', 'facts', 'scaffold', 'version', 'meta', 'tables'][conv_id % 7 + 1] END AS problem FROM conversations
""")
def chunk_payload_problems(spark: SparkSession, d: str) -> DataFrame:
    return chunks.payload_problems(*_chunk_cache(spark, d))


@query("""
SELECT conv_id::VARCHAR AS key, count(*) + 2 AS chunks, sum(len(string_split(text, ' '))) + 2 * max(len(string_split(text, ' '))) FILTER (turn = 0) AS tokens, 8::INT AS columns FROM conversations WHERE conv_id % 14 = 0 GROUP BY conv_id
""")
def cached_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A cache written twice, read back and loaded where it is valid."""
    payloads, rows, expected, facts = _chunk_cache(spark, d)
    path = folder(spark, "chunks")
    chunks.save_chunks(payloads.where("false"), rows.where("false"), path)
    chunks.save_chunks(payloads, rows, path)
    got = chunks.load_chunks(*chunks.read_chunks(spark, path), expected, facts)
    return got.groupBy("key").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size("token_ids")).alias("tokens")).withColumn("columns", F.lit(len(got.columns)))


@query("""
SELECT doc_id, 'embedding_api_key' AS key, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN '<redacted>' END AS shown, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'again' END AS restored FROM documents
UNION ALL SELECT doc_id, 'model', lang, lang FROM documents
UNION ALL SELECT doc_id, 'judge_api_key', '<redacted>', NULL FROM documents
""")
def redacted_configs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    own = read(spark, d, "documents").select("doc_id", F.explode(F.array(entry("embedding_api_key", F.when(k == 0, "").when(k == 1, "secret")), entry("model", F.col("lang")), entry("judge_api_key", F.lit("secret")))).alias("e")).select("doc_id", "e.*")
    shown = settings.shown_config(own).withColumn("shown", F.col("value"))
    return settings.restored_config(shown, {"embedding_api_key": "again"}).withColumnRenamed("value", "restored")


@query("""
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'top_k must be greater than zero' WHEN 1 THEN 'block must be greater than zero' WHEN 2 THEN 'window must be at least zero' WHEN 3 THEN 'memory must be between zero and one' WHEN 4 THEN 'beam width must be at most 959' END AS problem FROM events
""")
def option_problems(spark: SparkSession, d: str) -> DataFrame:
    """Each rule broken in turn; a wide beam without a graph breaks none."""
    k = F.col("event_id") % 7
    given = lambda at, bad, good: F.when(k == at, bad).otherwise(good)
    problem = settings.option_problem({"top_k": given(0, 0, 10), "block": F.when(k == 1, F.lit(None).cast("int")).otherwise(16)}, {"window": given(2, -1, 0)}, ("memory", given(3, 1.0, 0.4)), F.when(k >= 4, 960).otherwise(64), F.lit(10), k == 4)
    return read(spark, d, "events").select("event_id", problem.alias("problem"))


@query("""
SELECT doc_id, doc_id % 3 = 0 AS bounded, CASE WHEN doc_id % 3 = 0 THEN 100 ELSE 7 END::BIGINT AS max_tokens, CASE doc_id % 3 WHEN 0 THEN 'json_schema' WHEN 1 THEN 'text' END AS kind, lang AS kept FROM documents
""")
def bounded_arguments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    fmt = F.when(k == 0, ', "response_format": {"type": "json_object"}').when(k == 1, ', "response_format": {"type": "text"}').otherwise("")
    said = F.concat(F.lit('{"max_tokens": 7, "user": "'), "lang", F.lit('"'), fmt, F.lit("}"))
    own = read(spark, d, "documents").select("doc_id", settings.bounded_arguments(said, '{"type": "json_schema"}', 100).alias("a"))
    of = lambda path: F.get_json_object("a.arguments", path)
    return own.select("doc_id", "a.bounded", of("$.max_tokens").cast("long").alias("max_tokens"), of("$.response_format.type").alias("kind"), of("$.user").alias("kept"))


@query("SELECT doc_id, [lang, source]::VARCHAR[] || CASE WHEN doc_id % 2 = 0 THEN ['e8']::VARCHAR[] ELSE [] END AS entities FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def question_entities(spark: SparkSession, d: str) -> DataFrame:
    """Repeats in another case, blanks and what stands behind the eighth don't count."""
    repeats = F.array("lang", F.upper("lang"), F.lit(" "), "source", F.concat(F.lit(" "), "source"), F.lit(None).cast("string"), F.lit(""))
    return read(spark, d, "documents").where("lang is not null and source is not null").select("doc_id", settings.entities_to_embed(F.when(F.col("doc_id") % 2 == 0, F.concat(repeats, F.array(F.lit("e8"), F.lit("e9")))).otherwise(repeats)).alias("entities"))


@query("SELECT conv_id AS batch, sum(len(string_split(text, ' ')))::BIGINT AS total_input_tokens, (count(*) FILTER (turn % 2 = 0))::BIGINT AS total_output_tokens FROM conversations GROUP BY conv_id")
def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("ord"), F.split("text", " ").alias("prompt_tokens"), F.when(F.col("turn") % 2 == 0, F.array("turn")).alias("output_tokens"))
    return settings.batch_totals(own.select("batch", "ord"), own)


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN false WHEN 3 THEN event_id % 3 = 0 WHEN 4 THEN event_id % 4 = 0 WHEN 2 THEN event_id % 2 = 0 ELSE true END OR (event_id % 5 > 0 AND event_id IN (1, 1000)) AS due FROM events")
def progress_steps(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events")
    return own.select("event_id", settings.progress_due(F.col("event_id"), F.lit(1000), F.col("event_id") % 5).alias("due"))


@query(f"SELECT conv_id, turn, 'user' AS role, '{settings.ASK}' || text AS content FROM conversations")
def question_messages(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "conversations").select("conv_id", "turn", F.explode(settings.question_message(F.col("text"))).alias("m"))
    return own.select("conv_id", "turn", "m.role", "m.content")


@query("SELECT doc_id, doc_id % 3 < 2 AS present FROM documents")
def metrics_present(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    metrics = F.parse_json(F.when(k == 0, '{"tokens": 1}').when(k == 1, '{"tokens": null}').otherwise('{"other": 1}'))
    return read(spark, d, "documents").select("doc_id", settings.metric_present(metrics, "tokens").alias("present"))


@query("SELECT lang AS name, source AS driver_version, n_chars || ' MiB' AS memory_total FROM documents WHERE doc_id % 2 = 0 AND lang IS NOT NULL AND source IS NOT NULL")
def device_reports(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents").where("lang is not null and source is not null")
    lines = own.select(F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit(", "), "source", F.lit(" ,  "), F.col("n_chars").cast("string"), F.lit(" MiB"))).otherwise("No devices, found").alias("value"))
    return settings.device_rows(lines)
