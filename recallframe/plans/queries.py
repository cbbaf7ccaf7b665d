"""One query for each family of operators, bound to the driver's tables, with DuckDB SQL for the same rows.

conversations stand for turns, embeddings for stored vectors (label is the scope), labels joined to documents for
judged records, events for metric rows and transfers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..functions import time as Tm
from ..operators import cache, context, evaluate, guards, retrieval, store, throughput, workload
from ..sources import conversations as C
from ..streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# --- retrieval ------------------------------------------------------------------------------------------------


@query("""
SELECT query_id, id, round(score, 6) AS score, round(-score, 6) AS distance, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0) WHERE rank <= 10
""")
def scoped_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: every hundredth vector asks for the ten best of its scope."""
    own = read(spark, d, "embeddings")
    asked = own.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    got = retrieval.top_k(own, asked, 10, "label", "vec_id", "vec_id", "embedding")
    return got.select("query_id", "id", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"), "rank")


@query("""
SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 5
""")
def global_top_k(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "embeddings")
    asked = own.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = retrieval.top_k(own, asked, 5, None, "vec_id", "vec_id", "embedding")
    return got.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("""
SELECT query_id, count(*) AS n, count(DISTINCT id) AS ids, min(rank) AS lo, max(rank) AS hi FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0) WHERE rank <= 10 GROUP BY query_id
""")
def search_contract(spark: SparkSession, d: str) -> DataFrame:
    """Per query: hits, distinct ids and rank bounds; any breach of the contract would raise."""
    hits = scoped_top_k(spark, d)
    bad = guards.valid_hits(hits.withColumn("expected", F.count(F.lit(1)).over(Window.partitionBy("query_id"))), F.col("expected"))
    fine = hits.join(bad, "query_id", "left")
    fine = guards.require(fine, F.col("problem").isNull(), F.concat(F.lit("bad hits: "), F.col("query_id").cast("string")))
    return fine.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))


@query("""
SELECT vec_id, label FROM embeddings WHERE label IN (1, 3) AND label IS DISTINCT FROM 2
""")
def payload_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").where(retrieval.payload_matches({"label": {"in": [1, 3], "ne": 2}})).select("vec_id", "label")


@query("""
SELECT event_type, count(*) AS n FROM events WHERE event_type IS DISTINCT FROM 'view' AND (user_id IN (1, 2, 3) OR user_id IS NULL) GROUP BY event_type
""")
def filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").where(retrieval.payload_matches({"event_type": {"ne": "view"}, "user_id": {"in": [1, 2, 3, None]}}))
    return own.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rank, 0.0::DOUBLE AS score, 0.0::DOUBLE AS distance FROM embeddings WHERE label = 1")
def listed_rows(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.list_rows(read(spark, d, "embeddings").select("vec_id", "label"), {"label": 1}, None, "vec_id")


@query("SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rank, 0.0::DOUBLE AS score, 0.0::DOUBLE AS distance FROM embeddings WHERE label = 1 ORDER BY vec_id LIMIT 7")
def listed_rows_limit(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.list_rows(read(spark, d, "embeddings").select("vec_id", "label"), {"label": 1}, 7, "vec_id")


@query("SELECT doc_id, lang, 1.0::DOUBLE AS score, 0.0::DOUBLE AS distance, doc_id + 1 AS rank FROM documents WHERE doc_id = 17")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.point_lookup(read(spark, d, "documents").select("doc_id", "lang"), 17, "doc_id", "doc_id")


@query("""
SELECT doc_id AS fact_id, text, lang, n_chars / 1e6 AS score, 1 - n_chars / 1e6 AS distance FROM documents
""")
def hits_with_facts(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    hits = docs.select(F.col("doc_id").alias("fact_id"), "text", (F.col("n_chars") / 1e6).alias("score"))
    return retrieval.hits_with_facts(hits, docs.select(F.col("doc_id").alias("fact_id"), "text", "lang")).select("fact_id", "text", "lang", "score", "distance")


@query("SELECT count(*) AS vector_count, max(len(embedding))::INT AS dim, count(*) * max(len(embedding)) * 4 AS matrix_bytes, count(*) * max(len(embedding)) * 4 / 1048576.0 AS matrix_mb FROM embeddings")
def store_statistics(spark: SparkSession, d: str) -> DataFrame:
    return store.store_stats(read(spark, d, "embeddings"), "embedding")


# --- text -----------------------------------------------------------------------------------------------------


@query("""
SELECT conv_id, turn, CASE WHEN coalesce(role, '') <> '' THEN role || ': ' ELSE '' END || concat_ws(' ', nullif(trim(text), ''), CASE
  WHEN turn % 4 = 0 THEN '[Sharing image - query: q' || turn || '. The image shows: a kayak]' WHEN turn % 4 = 1 THEN '[Sharing image - query for: q' || turn || ']'
  WHEN turn % 4 = 2 THEN '[Sharing image that shows: a kayak]' END) AS memory FROM conversations
""")
def memory_texts(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "conversations")
    q = F.when(F.col("turn") % 4 < 2, F.concat(F.lit("q"), F.col("turn").cast("string")))
    caption = F.when(F.col("turn") % 4 % 2 == 0, F.lit(" a kayak "))
    return own.select("conv_id", "turn", X.memory_text("role", "text", q, caption).alias("memory"))


@query("""
SELECT conv_id || ':session_1:' || turn AS turn_id, trim(text) || chr(10) AS line, nullif(trim(role), '') AS role, printf('user_%04d', conv_id) AS user_id,
  CASE WHEN lower(role) IN ('assistant', 'ai', 'bot') THEN 'assistant' ELSE 'user' END AS turn_role FROM conversations
""")
def turn_lines(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "conversations")
    return own.select(X.turn_id("conv_id", F.lit("session_1"), "turn").alias("turn_id"), X.prompt_line("text").alias("line"), X.trim_or_null("role").alias("role"), X.user_name("conv_id").alias("user_id"), X.turn_role("role", F.lit("Alice"), F.lit("Bob")).alias("turn_role"))


@query("""
SELECT doc_id, sha256(text) AS text_hash, sha256('model' || chr(0) || 'endpoint' || chr(0) || lang || chr(0) || text) AS cache_key, substr(sha256('https://host.example/v1'), 1, 16) AS endpoint_key,
  regexp_replace(regexp_replace(source || '/' || lang, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS part, lower(source) || '-' || lower(lang) AS label FROM documents
""")
def identity_keys(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents")
    return own.select(
        "doc_id", X.text_hash(F.lit(""), "text").alias("text_hash"), X.cache_key(F.lit("model"), F.lit("endpoint"), "lang", "text").alias("cache_key"), X.endpoint_key(F.lit("HTTPS://Host.Example/v1/#part")).alias("endpoint_key"),
        X.path_part(F.concat_ws("/", "source", "lang")).alias("part"), X.label_slug(F.concat_ws(" ", "source", "lang")).alias("label"),
    )


@query("""
WITH h AS (SELECT doc_id, sha1(unhex('55bbc26062d54a8497246686fd41798e') || encode('{"sample_id":"' || source || '","source_turn_id":"' || doc_id || '","text":' || to_json(trim(regexp_replace(text, '\\s+', ' ', 'g')))::VARCHAR || '}')) AS x FROM documents)
SELECT doc_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(x, 17, 1))::INT + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS fact_id FROM h
""")
def fact_ids(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("turn"), "text")
    return X.with_fact_id(own, "source", "turn", "text").select("doc_id", "fact_id")


@query("""
SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS answer FROM documents
""")
def final_answers(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Thinking... ANSWER: none. ANSWER: "), "text")
    return read(spark, d, "documents").select("doc_id", X.final_answer(said).alias("answer"))


_SAID = ["true", " False.", "```\ntrue\n```", '{"correct": true}', 'Well: {"correct": false} indeed', '"TRUE"', "not parseable", '{"correct": "true"}', "<|eot_id|>false</s>", "[1, 2]", "", "true false"]


@query("""
SELECT doc_id, [true, false, true, true, false, true, NULL, NULL, false, NULL, NULL, NULL][doc_id % 12 + 1] AS verdict,
  CASE WHEN [true, false, true, true, false, true, NULL, NULL, false, NULL, NULL, NULL][doc_id % 12 + 1] IS NULL THEN 'unparsed' ELSE 'ok' END AS status FROM documents
""")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.col("doc_id") % len(_SAID) + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", X.verdict(said).alias("verdict"), X.judge_payload(said)["status"].alias("status"))


@query("""
SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS epoch, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, epoch(o_orderdate)::BIGINT AS spoken_epoch, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS stamp FROM orders
""")
def order_times(spark: SparkSession, d: str) -> DataFrame:
    """Times read back from an ISO text and from a spoken one."""
    own = read(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    iso = Tm.epoch_and_iso(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    spoken = Tm.epoch_and_iso(F.date_format("ts", "h:mm a 'on' d MMMM, yyyy"))
    return own.select("o_orderkey", iso["epoch"].alias("epoch"), iso["iso"].alias("iso"), spoken["epoch"].alias("spoken_epoch"), Tm.run_stamp("ts").alias("stamp"))


@query("""
SELECT event_id, try_cast(json_extract_string(props, '$.' || json_keys(props)[1]) AS DOUBLE) AS number, len(json_keys(props))::INT AS fields FROM events
""")
def event_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Dynamic JSON: the first field of each object as a number where it is one."""
    m = F.from_json("props", "map<string,string>")
    return read(spark, d, "events").select("event_id", N.number(F.map_values(m)[0]).alias("number"), F.size(m).alias("fields"))


# --- ingestion ------------------------------------------------------------------------------------------------


@query("""
SELECT conv_id::VARCHAR AS sample_id, 'session_1' AS session_id, 1 AS session_index, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn_index, role AS speaker, trim(text) AS text FROM conversations
""")
def ingested_turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as nested JSON records, read back into turns."""
    own = read(spark, d, "conversations")
    conv = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))).alias("session_1"))
    rec = conv.select(F.col("conv_id").cast("string").alias("sample_id"), F.to_json(F.struct(F.struct("session_1").alias("conversation"))).alias("record"))
    return C.turns(rec).select("sample_id", "session_id", "session_index", "turn_index", "speaker", "text")


@query("""
SELECT conv_id::VARCHAR AS sample_id, 'q' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS question_id, trim(text) AS question, role AS answer, (turn % 5 + 1)::VARCHAR AS category FROM conversations
""")
def ingested_questions(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "conversations")
    qa = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("question"), F.col("role").alias("answer"), (F.col("turn") % 5 + 1).alias("category")))).alias("qa"))
    rec = qa.select(F.col("conv_id").cast("string").alias("sample_id"), F.to_json(F.struct("qa")).alias("record"))
    return C.questions(rec).select("sample_id", "question_id", "question", "answer", "category")


# --- context --------------------------------------------------------------------------------------------------


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("ord"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"), F.col("role").alias("speaker"), "text")


@query("""
SELECT conv_id AS sample_id, turn AS ord, coalesce(string_agg(conv_id || ':' || turn, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations
""")
def preceding_turns(spark: SparkSession, d: str) -> DataFrame:
    return context.preceding_turns(_turns(spark, d), 3).select("sample_id", "ord", F.array_join("context", "|").alias("context"))


@query("""
SELECT conv_id AS sample_id, conv_id || ':' || turn AS source_turn_id, coalesce(string_agg(conv_id || ':' || turn, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS context
FROM conversations
""")
def fact_context(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    facts = turns.select("sample_id", F.col("turn_id").alias("source_turn_id"))
    return context.fact_context(facts, turns, 2).select("sample_id", "source_turn_id", F.array_join("context", "|").alias("context"))


@query("""
SELECT conv_id AS sample_id, 'q' || conv_id AS question_id, string_agg('[D' || turn || '] ' || role || ': "' || text || '"', chr(10) ORDER BY turn DESC) AS evidence FROM conversations WHERE turn < 2 GROUP BY conv_id
""")
def evidence_text(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d).withColumn("dia_id", F.concat(F.lit("D"), F.col("ord").cast("string"))).withColumn("timestamp", F.lit(""))
    asked = turns.select("sample_id").distinct().select("sample_id", F.concat(F.lit("q"), F.col("sample_id").cast("string")).alias("question_id"), F.array(F.lit("D1"), F.lit("none"), F.lit("D0")).alias("evidence"))
    return context.evidence_text(asked, turns)


@query("""
WITH c AS (SELECT f.conv_id AS query_id, f.turn AS fact_pos, t.turn AS turn_pos FROM conversations f JOIN conversations t ON f.conv_id = t.conv_id AND t.turn < f.turn AND t.turn >= f.turn - 2)
SELECT query_id, fact_pos, turn_pos FROM c QUALIFY row_number() OVER (PARTITION BY query_id, turn_pos ORDER BY fact_pos) = 1
""")
def first_need(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    wide = context.preceding_turns(turns, 2, value="ord")
    need = wide.select(F.col("sample_id").alias("query_id"), F.col("ord").alias("fact_pos"), F.posexplode("context").alias("turn_pos", "turn_id"))
    return context.first_need(need).select("query_id", "fact_pos", F.col("turn_id").alias("turn_pos"))


@query("""
SELECT conv_id AS sample_id, turn AS ord, (sum(length(text)) OVER w)::BIGINT AS slice_end, (sum(length(text)) OVER w)::BIGINT - length(text) AS slice_start FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
""")
def running_positions(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d).withColumn("tokens", F.length("text").cast("long"))
    return context.running_positions(turns, "sample_id", "ord").select("sample_id", "ord", "slice_end", "slice_start")


@query("""
SELECT conv_id AS sample_id, turn AS ord, least(length(text), 20)::INT AS target, greatest(0, length(text) + least(length(text), 20) - 100)::INT AS truncated, (length(text) - greatest(0, length(text) + least(length(text), 20) - 100))::INT AS slice_start,
  (length(text) - greatest(0, length(text) + least(length(text), 20) - 100) + least(length(text), 20))::INT AS slice_end FROM conversations WHERE length(text) > 0
""")
def encoding_plans(spark: SparkSession, d: str) -> DataFrame:
    """Context cut to 100 tokens, with characters as tokens and the first 20 as target."""
    own = _turns(spark, d).where(F.length("text") > 0)
    ids = F.sequence(F.lit(1), F.length("text"))
    plan = context.encoding_plan(ids, F.slice(ids, 1, 20), 100)
    own = own.withColumn("p", plan)
    return own.select("sample_id", "ord", F.size("p.target_token_ids").alias("target"), F.col("p.context_truncated_tokens").alias("truncated"), "p.slice_start", "p.slice_end")


@query("""
SELECT conv_id AS query_id, count(*) AS facts, sum(length(text))::BIGINT AS fact_tokens, sum(length(text))::BIGINT + 7 AS memory_tokens, sum(turn)::BIGINT AS context_tokens_total, max(turn) AS context_tokens_max FROM conversations GROUP BY conv_id
""")
def memory_plans(spark: SparkSession, d: str) -> DataFrame:
    own = _turns(spark, d).select(F.col("sample_id").alias("query_id"), F.col("ord").alias("pos"), F.col("turn_id").alias("fact_id"), F.sha2("text", 256).alias("text_hash"), F.length("text").cast("long").alias("tokens"), F.col("ord").alias("context_tokens"), F.lit(0).alias("truncated"), F.array("turn_id").alias("turn_ids"))
    got = context.memory_plan(own, "query_id", 1_000_000, 7, 2)
    return got.select("query_id", F.size("fact_ids").cast("long").alias("facts"), "fact_tokens", "memory_tokens", "context_tokens_total", "context_tokens_max")


@query("""
SELECT event_id, (event_id - event_id % 16) AS aligned, 32 + user_id * (64 * 2 + 1 + 16 * 4) AS graph_bytes, value / 1048576.0 AS mb, CASE WHEN value <= 0 THEN 0 ELSE greatest(0, least(1, 1 - (value / 2) / value)) END AS overlap,
  greatest(0, user_id - 50) AS delta, coalesce(value, 0) + coalesce(user_id, 0) AS total, (value + 1) * 1000 AS ttft FROM events
""")
def event_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events")
    return own.select(
        "event_id", N.align_down("event_id", 16).alias("aligned"), N.graph_bytes("user_id", F.lit(64), F.lit(16)).alias("graph_bytes"), N.mebibytes("value").alias("mb"), N.overlap_ratio("value", F.col("value") / 2).alias("overlap"),
        N.positive_delta(F.lit(50), "user_id").alias("delta"), N.sum_of_present("value", "user_id").alias("total"), N.time_to_first_token(F.abs("value") + 1, F.lit(None).cast("double"), F.lit(None).cast("double")).alias("ttft"),
    )


# --- evaluation -----------------------------------------------------------------------------------------------


def _judged(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read(spark, d, "labels"), "doc_id", "left").withColumn("correct", F.col("quality") == 1)


@query("""
SELECT event_type, count(value) AS count, avg(value) AS avg, min(value) AS min, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, max(value) AS max, 'value' AS metric FROM events GROUP BY event_type
""")
def numeric_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.numeric_summary(read(spark, d, "events"), "value", by=["event_type"])


@query("""
SELECT count(*) AS question_count, count(quality) AS judged_count, count(*) FILTER (quality = 1) AS correct_count, count(n_chars) AS query_count, sum(n_chars)::DOUBLE AS query_total_ms, count(*) FILTER (quality = 1) / count(quality) AS accuracy,
  count(n_chars) / (sum(n_chars) / 1000) AS queries_per_sec FROM documents LEFT JOIN labels USING (doc_id)
""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.run_summary(_judged(spark, d), "n_chars").withColumn("query_total_ms", F.col("query_total_ms").cast("double"))


@query("""
SELECT lang AS category, 'unknown' AS name, count(*) AS total, count(*) FILTER (quality = 1) AS correct, count(*) FILTER (quality = 1) / count(*) AS accuracy FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang
""")
def accuracy_by_category(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.accuracy_by_category(_judged(spark, d), "lang")


@query("""
WITH r AS (SELECT n_chars::DOUBLE AS x, quality AS y, row_number() OVER (ORDER BY n_chars, doc_id) AS rn, count(*) OVER () AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
b AS (SELECT floor((rn - 1) / ceil(n / least(10, greatest(1, round_even(sqrt(n), 0)))))::BIGINT AS bin, min(x) AS lo, max(x) AS hi, count(*) AS c, sum(y) AS k FROM r GROUP BY 1)
SELECT bin, lo AS token_bin_start, hi AS token_bin_end, (lo + hi) / 2 AS token_bin_midpoint, c AS judged_count, k::BIGINT AS correct_count, round(k / c, 6) AS accuracy,
  round(greatest(0, (k / c + 3.8416 / (2 * c)) / (1 + 3.8416 / c) - 1.96 * sqrt((k / c * (1 - k / c) + 3.8416 / (4 * c)) / c) / (1 + 3.8416 / c)), 6) AS ci_lower,
  round(least(1, (k / c + 3.8416 / (2 * c)) / (1 + 3.8416 / c) + 1.96 * sqrt((k / c * (1 - k / c) + 3.8416 / (4 * c)) / c) / (1 + 3.8416 / c)), 6) AS ci_upper FROM b
""")
def accuracy_bins(spark: SparkSession, d: str) -> DataFrame:
    got = evaluate.accuracy_bins(_judged(spark, d), "n_chars", "correct", "doc_id")
    return got.select("bin", "token_bin_start", "token_bin_end", "token_bin_midpoint", "judged_count", "correct_count", *[F.round(c, 6).alias(c) for c in ("accuracy", "ci_lower", "ci_upper")])


@query("SELECT count(*) FILTER (n_chars IS NULL AND quality IS NOT NULL) AS missing_x_count FROM documents LEFT JOIN labels USING (doc_id)")
def missing_axis(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.missing_axis(_judged(spark, d), "n_chars", "quality")


@query("""
SELECT doc_id, 'run' AS run_id, n_chars::DOUBLE AS memory_tokens, 10.0::DOUBLE AS query_tokens, n_chars + 10.0::DOUBLE AS total_prompt_tokens, coalesce(quality, -1) AS judge_correct, 1 AS retrieved_count, lang AS first_fact FROM documents LEFT JOIN labels USING (doc_id)
""")
def query_metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nested records flattened to the report's columns."""
    own = _judged(spark, d)
    metrics = F.to_json(F.struct(F.col("n_chars").alias("kv_memory_tokens"), F.lit("10").alias("kv_query_tokens"), F.array("lang").alias("memory_retrieved_fact_ids")))
    rec = own.select(F.lit("run").alias("run_id"), F.lit("mode").alias("mode"), "source", F.col("doc_id").cast("string").alias("question_id"), F.lit("1").alias("category"), F.col("source").alias("sample_id"), F.parse_json(metrics).alias("metrics"), F.parse_json(F.to_json(F.struct("correct"))).alias("judge"), F.array("lang").alias("retrieved"))
    got = evaluate.query_metric_rows(rec)
    return got.select(F.col("question_id").cast("long").alias("doc_id"), "run_id", "memory_tokens", "query_tokens", "total_prompt_tokens", F.coalesce("judge_correct", F.lit(-1)).alias("judge_correct"), "retrieved_count", F.col("memory_retrieved_fact_ids")[0].alias("first_fact"))


@query("""
SELECT doc_id AS question_id, coalesce(quality = 1, toxic IS NULL) AS correct FROM documents LEFT JOIN labels USING (doc_id)
""")
def filled_judgements(spark: SparkSession, d: str) -> DataFrame:
    rec = _judged(spark, d).select(F.col("doc_id").alias("question_id"), "correct")
    fresh = rec.where("correct is null").select("question_id", F.lit(True).alias("correct"))
    return evaluate.fill_judgements(rec, fresh)


# --- throughput -----------------------------------------------------------------------------------------------


def _rates(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").groupBy(F.col("event_type").alias("condition"), (F.col("user_id") % 4).alias("num_users"))
    return own.agg(F.avg("value").alias("throughput_qps"), F.count(F.lit(1)).cast("double").alias("fact_count"))


_RATES = "r AS (SELECT event_type AS condition, user_id % 4 AS num_users, avg(value) AS throughput_qps, count(*)::DOUBLE AS fact_count FROM events GROUP BY 1, 2)"


@query(f"WITH {_RATES} SELECT condition, count(*) AS row_count, avg(throughput_qps) AS average_qps, min(throughput_qps) AS minimum_qps, max(throughput_qps) AS maximum_qps FROM r GROUP BY condition")
def condition_summary(spark: SparkSession, d: str) -> DataFrame:
    return throughput.condition_summary(_rates(spark, d))


@query(f"""
WITH {_RATES} SELECT num_users, max(throughput_qps) FILTER (condition = 'click') AS click, max(throughput_qps) FILTER (condition = 'purchase') AS purchase, arg_min(fact_count, list_position(['click', 'purchase'], condition)) FILTER (condition IN ('click', 'purchase')) AS facts_per_user,
  max(throughput_qps) FILTER (condition = 'click') / max(throughput_qps) FILTER (condition = 'purchase') AS ratio FROM r GROUP BY num_users
""")
def throughput_pivot(spark: SparkSession, d: str) -> DataFrame:
    own = _rates(spark, d)
    return throughput.pivot_throughput(own.where(F.col("condition").isin("click", "purchase")), ["click", "purchase"], "click", "purchase")


@query(f"WITH {_RATES} SELECT condition, num_users, CASE WHEN num_users = 1 THEN -1 ELSE throughput_qps END AS throughput_qps, fact_count FROM r")
def merged_rows(spark: SparkSession, d: str) -> DataFrame:
    own = _rates(spark, d)
    return throughput.merge_rows(own, own.where("num_users = 1").withColumn("throughput_qps", F.lit(-1.0))).select("condition", "num_users", "throughput_qps", "fact_count")


@query("SELECT c AS num_users, count(*) AS requests, sum(value) AS value FROM events, unnest([10, 25, 50]) t(c) WHERE user_id < c GROUP BY c")
def nested_user_counts(spark: SparkSession, d: str) -> DataFrame:
    return throughput.nested_user_counts(read(spark, d, "events").withColumn("user_index", F.col("user_id")), [10, 25, 50], "value").withColumn("num_users", F.col("num_users").cast("long"))


@query("""
SELECT event_type, count(*) AS total_transfers, sum(user_id)::BIGINT AS total_bytes_transferred, avg(value) AS avg_h2d_latency_ms, quantile_cont(value, 0.5) AS p50_h2d_latency_ms, quantile_cont(value, 0.95) AS p95_h2d_latency_ms, quantile_cont(value, 0.99) AS p99_h2d_latency_ms,
  coalesce(avg(greatest(0, least(1, 1 - (value / 4) / value))) FILTER (value > 0), 0) AS avg_overlap_ratio, coalesce(avg(user_id / 1e9 / (value / 1e3)) FILTER (value > 0), 0) AS avg_effective_bandwidth_gb_per_s, sum(value / 4) AS total_staging_stall_ms, avg(value / 4) AS avg_staging_stall_ms,
  quantile_cont(value / 4, 0.95) AS p95_staging_stall_ms FROM events GROUP BY event_type
""")
def transfer_summary(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").select("event_type", F.col("user_id").alias("num_bytes"), F.col("value").alias("h2d_latency_ms"), (F.col("value") / 4).alias("staging_stall_ms"))
    return throughput.transfer_summary(own, ["event_type"])


@query("SELECT event_id, 2 * user_id AS total_requests, 2 * user_id / (value + 1) AS throughput_qps, (value + 1) / (2 * user_id) * 1000 AS avg_latency_ms, 100 / (value + 1) AS input_tokens_per_second, 50 / (value + 1) AS output_tokens_per_second FROM events WHERE user_id > 0 AND value >= 0")
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").where("user_id > 0 and value >= 0")
    return own.select("event_id", *[c.alias(k) for k, c in N.result_columns("user_id", 2, F.col("value") + 1, F.lit(100), F.lit(50)).items()])


# --- sets, stores, caches -------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def unique_texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT text AS key, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return guards.duplicate_ids(read(spark, d, "documents").select(F.col("text").alias("key")), "key")


@query("""
SELECT vec_id AS id, (CASE WHEN vec_id % 3 = 0 THEN 100 ELSE label END)::INT AS label, row_number() OVER (ORDER BY vec_id) - 1 AS ordinal FROM embeddings
UNION ALL SELECT id, -1, ordinal FROM (SELECT vec_id + 1000000000 AS id, (SELECT count(*) FROM embeddings) + row_number() OVER (ORDER BY vec_id) - 1 AS ordinal FROM embeddings WHERE vec_id % 5 = 0)
""")
def upserted_store(spark: SparkSession, d: str) -> DataFrame:
    """A store into which some known and some new rows are written."""
    own = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    base = retrieval.ranked_by(own, "id", name="n").select("id", "label", (F.col("n") - 1).alias("ordinal"))
    known = own.where("id % 3 = 0").select("id", F.lit(100).alias("label"), F.col("id").alias("seq"))
    new = own.where("id % 5 = 0").select((F.col("id") + 1_000_000_000).alias("id"), F.lit(-1).alias("label"), (F.col("id") + 1_000_000_000).alias("seq"))
    return store.upsert(base, known.unionByName(new))


@query("SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS ordinal FROM embeddings WHERE label <> 4")
def deleted_rows(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ordinal"), "label")
    return store.delete(own, own.where("label = 4")).select("id", "ordinal")


@query("SELECT vec_id AS id, (CASE WHEN label = 4 THEN 44 ELSE label END)::INT AS label FROM embeddings")
def updated_rows(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return store.update(own, own.where("label = 4").select("id", F.lit(44).alias("label")))


@query("SELECT count(*) FILTER (doc_id % 2 = 0) AS hits, count(*) FILTER (doc_id % 2 = 1) AS misses, count(DISTINCT doc_id) FILTER (doc_id % 2 = 1) AS computed FROM labels")
def cache_statistics(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key"), "doc_id")
    return cache.cache_stats(own, own.where("doc_id % 2 = 0").select("key"), "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE 'made' END AS value FROM labels")
def memoised_values(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key"), "doc_id")
    known = own.where("doc_id % 2 = 0").select("key", F.lit("kept").alias("value"))
    out, _ = cache.memoised(own, known, lambda m: m.select("key", F.lit("made").alias("value")))
    return out.select("doc_id", "value")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def missing_catalogs(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id")
    return cache.missing_catalogs(docs, read(spark, d, "labels"), "doc_id")


@query("SELECT doc_id AS user_id, n_chars AS num_tokens, n_chars * 2 AS num_bytes FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)")
def latest_memories(spark: SparkSession, d: str) -> DataFrame:
    """Registered memories; those of toxic documents are removed again."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("user_id"), F.col("n_chars").alias("num_tokens"), (F.col("n_chars") * 2).alias("num_bytes"), F.lit(1).alias("seq"))
    gone = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("user_id"), F.lit(None).cast("long").alias("num_tokens"), F.lit(None).cast("long").alias("num_bytes"), F.lit(2).alias("seq"))
    return store.latest_memories(docs.unionByName(gone))


_DRAW = "('0x' || substr(md5('42:' || {0}), 1, 11))::BIGINT"


@query(f"""
WITH s AS (SELECT conv_id AS sample_id, count(*) AS have, row_number() OVER (ORDER BY conv_id) - 1 AS ord FROM conversations GROUP BY conv_id),
d AS (SELECT u AS user_index, sample_id, k AS draw, have, CASE WHEN have >= 3
  THEN ({_DRAW.format("'start:' || u")} + (k - 1) * ({list(workload.STRIDES)}[{_DRAW.format("'stride:' || u")} % {len(workload.STRIDES)} + 1] % have)) % have ELSE {_DRAW.format("'again:' || u || ':' || k")} % have END AS q
  FROM range(100) t(u), range(1, 4) r(k), s WHERE s.ord = u % (SELECT count(*) FROM s)),
n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS q FROM conversations)
SELECT printf('user_%04d', user_index) AS user_id, user_index, sample_id, draw::INT AS draw, n.conv_id || ':' || n.turn AS question_id, n.text AS query FROM d JOIN n ON n.conv_id = d.sample_id AND n.q = d.q
""")
def sampled_requests(spark: SparkSession, d: str) -> DataFrame:
    """Seeded workload: draws come from a hash that SQL can compute."""
    own = _turns(spark, d)
    samples = retrieval.ranked_by(own.select("sample_id").distinct(), "sample_id", name="n").select("sample_id", (F.col("n") - 1).alias("ord"))
    asked = own.select("sample_id", F.col("ord").alias("question_ord"), F.col("turn_id").alias("question_id"), F.col("text").alias("query"))
    return workload.requests(spark, samples, asked, 100, 3)


# --- extensions over the event stream's rows ------------------------------------------------------------------


@query("""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, sum(value) AS total, avg(value) AS mean FROM events GROUP BY 1, 2, 3
""")
def hourly_metrics(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = E.windowed_metrics(own)
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k
""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sessions(own).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
