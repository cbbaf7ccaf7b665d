"""Queries of records, contracts, fingerprints, prompts, stores and text parsers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import context, evaluate, guards, models, records, retrieval, runs, store, throughput, workload
from .queries import _judged, query, read


def pick(key: str, values: list) -> Column:
    """One of the values by a key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def sql_pick(key: str, values: list[str]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


# --- judging and runs -----------------------------------------------------------------------------------------


@query(f"""
SELECT conv_id, turn, '{X.JUDGE_SYSTEM_PROMPT}' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Reference answer: ' || role || chr(10) || 'Predicted answer: ' || conv_id || chr(10) || chr(10) || '{X.JUDGE_RULES}' AS prompt FROM conversations
""")
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", X.judge_prompt("text", "role", F.col("conv_id").cast("string")).alias("prompt"))


_ABOUT = ["The Context", "this PROMPT", "a token", "Sequence", "connection", "timeout"]
_LIMIT = [" is too long", " over the maximum", " hits max_len", " limit reached", " length", " refused", " must not exceed it"]


@query(f"SELECT doc_id, doc_id % 6 < 4 AND doc_id % 7 < 5 AS limit_error FROM documents")
def context_limit_errors(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(pick("doc_id", _ABOUT), pick("doc_id", _LIMIT))
    return read(spark, d, "documents").select("doc_id", X.context_limit_error(said).alias("limit_error"))


@query("""
SELECT event_type, count(v) AS n, sum(v) AS total FROM (SELECT event_type, CASE event_id % 4 WHEN 0 THEN user_id::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN user_id + 0.5 END AS v FROM events) GROUP BY event_type
""")
def strict_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, booleans, numeric texts and nulls under the strict rule."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, "true").when(k == 2, F.concat(F.lit('" '), F.col("user_id"), F.lit('.5 "'))).otherwise("null")
    own = read(spark, d, "events").select("event_type", records.strict_number(F.parse_json(raw)).alias("v"))
    return own.groupBy("event_type").agg(F.count("v").alias("n"), F.sum("v").alias("total"))


@query("""
SELECT 'n_chars' AS metric, count(n_chars) AS count, avg(n_chars) AS avg, min(n_chars)::DOUBLE AS min, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.95) AS p95, max(n_chars)::DOUBLE AS max FROM documents
UNION ALL SELECT 'quality', count(quality), avg(quality), min(quality), quantile_cont(quality, 0.5), quantile_cont(quality, 0.95), max(quality) FROM labels
UNION ALL SELECT 'never', 0, NULL, NULL, NULL, NULL, NULL
""")
def run_metric_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A core metric stays without observations, an optional one goes."""
    own = _judged(spark, d).withColumns({"never": F.lit(None).cast("double"), "absent": F.lit(None).cast("double")})
    return records.metric_blocks(own, ["n_chars", "never"], ["quality", "absent"])


@query("""
SELECT doc_id AS question_id, lang AS question, quality AS answer, CASE WHEN toxic IS NOT NULL THEN 2 ELSE 0 END AS hits, CASE WHEN toxic IS NOT NULL THEN doc_id || ':1' END AS best FROM documents LEFT JOIN labels USING (doc_id)
""")
def evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Questions with their answers and ranked hits; those without keep their row."""
    docs, labels = read(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.col("lang").alias("question")), read(spark, d, "labels")
    hits = labels.select(F.col("doc_id").alias("question_id"), F.explode(F.array(F.lit(2), F.lit(1))).alias("rank")).withColumn("id", F.concat_ws(":", "question_id", "rank"))
    got = evaluate.evaluation_records(docs, hits, labels.select(F.col("doc_id").alias("question_id"), F.col("quality").alias("answer")))
    return got.select("question_id", "question", "answer", F.coalesce(F.size("retrieved_memories"), F.lit(0)).alias("hits"), F.get("retrieved_memories.id", F.lit(0)).alias("best"))


_COLUMNS = ("condition", "num_users", "throughput_qps")


@query("SELECT event_type AS condition, user_id % 4 AS num_users, avg(value) AS throughput_qps FROM events GROUP BY 1, 2")
def validated_rows(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").groupBy(F.col("event_type").alias("condition"), (F.col("user_id") % 4).alias("num_users")).agg(F.avg("value").alias("throughput_qps"), F.count(F.lit(1)).alias("extra"))
    known = read(spark, d, "events").select("event_type").distinct()
    return records.validated_rows(own, _COLUMNS, known)


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE 'unknown condition: ' || event_type END AS problem FROM events")
def row_problems(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", records.row_problem(["condition"], ["condition"], F.col("event_type"), ["click", "view"]).alias("problem"))


@query("""
SELECT event_id, ['local', 'graph', 'graph'][event_id % 3 + 1] AS backend, greatest(event_id % 7, event_id % 5 + 4)::INT AS slots FROM events
""")
def condition_backends(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", records.condition_backend(pick("event_id", ["exact", "graph", "injection"])).alias("backend"), records.staging_slots(F.col("event_id") % 7, F.col("event_id") % 5).alias("slots"))


@query("SELECT conv_id AS sample_id, conv_id || ':' || turn AS question_id, text AS question, '' AS answer, '' AS category FROM conversations")
def request_questions(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), F.concat_ws(":", "conv_id", "turn").alias("question_id"), F.col("text").alias("query"))
    return records.request_questions(own)


@query("SELECT conv_id::VARCHAR AS sample_id, count(*)::BIGINT AS turn_count, NULL::DOUBLE AS memory_setup_time_ms, NULL::BIGINT AS kv_precomputed_chunks FROM conversations GROUP BY conv_id")
def setup_rows(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("sample_id")).agg(F.count(F.lit(1)).alias("turn_count"))
    return records.setup_rows(own, {"sample_id": "string", "turn_count": "bigint", "memory_setup_time_ms": "double", "kv_precomputed_chunks": "bigint"})


@query("SELECT count(*) AS samples, sum(n_chars)::BIGINT AS hits, coalesce(sum(quality), 0)::BIGINT AS misses FROM documents LEFT JOIN labels USING (doc_id)")
def counter_totals(spark: SparkSession, d: str) -> DataFrame:
    return records.counter_totals(_judged(spark, d).select(F.col("n_chars").alias("hits"), F.col("quality").alias("misses")), ["hits", "misses"])


@query("""
SELECT r_regionkey::BIGINT AS run_id, 'kv_store_backend' AS key, 'gpu' AS recorded, 'cpu' AS expected FROM region WHERE r_regionkey % 2 = 0
UNION ALL SELECT r_regionkey, 'users', r_regionkey::VARCHAR, '1' FROM region WHERE r_regionkey <> 1
UNION ALL SELECT r_regionkey, 'new', NULL, 'x' FROM region
""")
def config_problems(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose saved configuration lacks a legacy key, differs, or knows a key not."""
    own = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("run_id"))
    saved = own.select("run_id", F.lit("users").alias("key"), F.col("run_id").cast("string").alias("value")).union(own.where("run_id % 2 = 1").select("run_id", F.lit("kv_store_backend"), F.lit("cpu"))).union(own.select("run_id", F.lit("conditions"), F.lit("a")))
    wanted = spark.createDataFrame([("users", "1"), ("kv_store_backend", "cpu"), ("new", "x"), ("conditions", "b"), ("context_window", "0")], "key string, value string")
    return records.config_problems(saved, wanted)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'inject-mode' WHEN doc_id % 3 = 1 THEN 'first' ELSE 'default' END AS mode FROM documents")
def run_modes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    saved, unit, first = F.when(k == 0, "inject"), F.when(k == 0, "fact"), F.when(k == 1, "first")
    return read(spark, d, "documents").select("doc_id", runs.run_mode(saved, unit, first, "default", {"inject": "inject-mode"}, "fact").alias("mode"))


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN '-' ELSE printf('%.2fx', (event_id % 400)::DOUBLE / (user_id % 4 * 4)) END AS ratio, CASE WHEN user_id % 4 = 0 THEN '-' ELSE printf('%.2f', (user_id % 4)::DOUBLE / 4) END AS qps FROM events WHERE (event_id % 400) % 4 = 0 OR user_id % 4 <> 3")
def ratio_texts(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").where("(event_id % 400) % 4 = 0 or user_id % 4 <> 3").withColumn("b", F.col("user_id") % 4)
    return own.select("event_id", N.ratio_text((F.col("event_id") % 400).cast("double"), F.col("b") * 4).alias("ratio"), N.two_digits(F.when(F.col("b") != 0, F.col("b") / 4)).alias("qps"))


# --- fingerprints, keys, responses ----------------------------------------------------------------------------


@query("""
WITH t AS (SELECT conv_id, turn, '{"id":"' || conv_id || ':session_1:' || turn || '","image_caption":null,"session_index":1,"speaker":' || to_json(role)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || ',"timestamp":null,"turn_index":' || turn || '}' AS j FROM conversations)
SELECT conv_id::VARCHAR AS sample_id, substr(sha256('{"sample_id":"' || conv_id || '","speaker_a":"user","speaker_b":null,"turns":[' || string_agg(j, ',' ORDER BY turn) || ']}'), 1, 20) AS fingerprint FROM t GROUP BY conv_id
""")
def sample_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "conversations").withColumn("sample_id", F.col("conv_id").cast("string"))
    samples = own.select("sample_id").distinct().withColumns({"speaker_a": F.lit("user"), "speaker_b": F.lit(None).cast("string")})
    turns = own.select("sample_id", F.col("turn").alias("ord"), X.turn_id("conv_id", F.lit("session_1"), "turn").alias("id"), F.lit(1).alias("session_index"), F.col("turn").alias("turn_index"), F.col("role").alias("speaker"), "text", F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("image_caption"))
    return records.sample_fingerprints(samples, turns)


@query("""
SELECT conv_id AS sample_id, sha256(string_agg(conv_id || '-' || turn || chr(0) || sha256(text) || chr(0) || 't' || turn || chr(0), '' ORDER BY turn)) AS fingerprint FROM conversations GROUP BY conv_id
""")
def facts_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "conversations")
    return records.facts_fingerprints(own.select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("ord"), F.concat_ws("-", "conv_id", "turn").alias("fact_id"), "text", F.concat(F.lit("t"), "turn").alias("source_turn_id")))


@query("""
SELECT conv_id, turn, sha256('{"args":[],"endpoint":"<provider-default>","kwargs":{"max_tokens":5},"messages":[{"content":' || to_json('## Current Date' || chr(10) || '<preembed-date>' || chr(10) || text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}],"model":"m","provider":"p","version":"1"}') AS key FROM conversations
""")
def request_keys(spark: SparkSession, d: str) -> DataFrame:
    """The date in a prompt doesn't change its key."""
    dated = F.concat(F.lit("## Current Date\n2024-01-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0"), F.lit("\n"), "text")
    said = F.array(F.struct("role", dated.alias("content")))
    key = records.request_key(F.lit("p"), F.lit("m"), F.lit(None).cast("string"), F.lit("1"), said, F.lit('{"max_tokens":5}'))
    return read(spark, d, "conversations").select("conv_id", "turn", key.alias("key"))


@query("""
SELECT doc_id, 'fact-catalogs/library-1.2/pro_vider/m_odel/protocol/context-10/tokens-20/facts-5/text-600/' || substr(sha256('<provider-default>'), 1, 16) || '/embed/' || substr(sha256('https://host.example/v1'), 1, 16) || '/' || lang || '-' || substr(sha256(text), 1, 20) || '.json' AS path FROM documents
""")
def catalog_paths(spark: SparkSession, d: str) -> DataFrame:
    fixed = {"library_version": "1.2", "provider": "pro vider", "model": "m/odel", "protocol": "protocol", "max_model_len": "10", "max_tokens": "20", "max_facts": "5", "max_text_chars": "600", "endpoint": None, "embedding_model": "embed", "embedding_endpoint": "HTTPS://Host.Example/v1/"}
    identity = {k: F.lit(v).cast("string") for k, v in fixed.items()} | {"sample_id": F.col("lang"), "sample_fingerprint": F.substring(F.sha2("text", 256), 1, 20)}
    return read(spark, d, "documents").select("doc_id", records.catalog_path(identity).alias("path"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'model' WHEN 2 THEN 'sample_fingerprint' END AS problem FROM documents")
def catalog_problems(spark: SparkSession, d: str) -> DataFrame:
    """Identities of which one key is another's, or missing."""
    expected = {k: f"v-{k}" for k in records.CATALOG_IDENTITY}
    full = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    other = F.transform_values(full, lambda k, v: F.when(k == "model", "other").otherwise(v))
    short = F.map_filter(full, lambda k, v: k != "sample_fingerprint")
    found = F.when(F.col("doc_id") % 3 == 0, full).when(F.col("doc_id") % 3 == 1, other).otherwise(short)
    return read(spark, d, "documents").select("doc_id", records.catalog_problem(found, expected).alias("problem"))


@query("""
SELECT doc_id::VARCHAR AS key, (CASE WHEN doc_id % 4 < 3 THEN doc_id % 4 + 1 ELSE 3 END)::INT AS attempts, doc_id % 4 < 3 AS valid, (doc_id % 4)::BIGINT AS quarantined FROM documents
""")
def settled_responses(spark: SparkSession, d: str) -> DataFrame:
    """Attempts with rising temperature: the first valid response counts, earlier ones are set aside."""
    own = records.attempts(read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "doc_id"))
    good = '{"memory": [{"id": "0", "text": "fact", "attributed_to": "user"}]}'
    said = own.withColumn("response", F.when(F.col("attempt") > F.col("doc_id") % 4, good).otherwise('{"memory": 1}'))
    kept, bad = records.settled_responses(said, guards.extraction_problem())
    per = bad.groupBy("key").agg(F.count(F.lit(1)).alias("quarantined"))
    return kept.join(per, "key", "left").select("key", "attempts", "valid", F.coalesce("quarantined", F.lit(0)).cast("long").alias("quarantined"))


@query("SELECT sha256('model' || chr(0) || 'base' || chr(0) || text) AS key, text FROM (SELECT DISTINCT text FROM conversations) ANTI JOIN (SELECT DISTINCT text FROM conversations WHERE turn % 2 = 0) USING (text)")
def texts_to_embed(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "conversations")
    known = own.where("turn % 2 = 0").select(X.cache_key(F.lit("model"), F.lit("base"), "text").alias("key")).distinct()
    return records.texts_to_embed(own, known, "model", "base")


_FACTS = [
    '{"memory": []}', '{"memory": [{"id": "7", "text": " a ", "attributed_to": "user", "linked_memory_ids": ["x"]}]}', "[1]", "no json", '{"memory": [], "x": 1}', '{"memory": {}}', '{"memory": [1]}',
    '{"memory": [{"id": "0", "text": "a"}]}', '{"memory": [{"id": "0", "text": "a", "attributed_to": "user", "more": 1}]}', '{"memory": [{"id": 0, "text": "a", "attributed_to": "user"}]}',
    '{"memory": [{"id": "0", "text": " \\t", "attributed_to": "user"}]}', '{"memory": [{"id": "0", "text": "a", "attributed_to": "bot"}]}', '{"memory": [{"id": "0", "text": "a", "attributed_to": "user", "linked_memory_ids": [1]}]}',
    '{"memory": [{"id": "0", "text": 5, "attributed_to": "user"}]}', '{"memory": [{"id": "0", "text": "' + "a" * 601 + '", "attributed_to": "user"}]}', '{"memory": [1, 2, 3, 4, 5, 6]}',
]
_PROBLEMS = [None, None, "not an object", "not an object", "keys", "facts", "not a fact", "fields", "fields", "id", "blank text", "attributed_to", "links", "blank text", "long text", "too many"]


@query(f"SELECT doc_id, {sql_pick('doc_id', _PROBLEMS)} AS problem FROM documents")
def extraction_problems(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of an extraction's validation."""
    return read(spark, d, "documents").select("doc_id", pick("doc_id", _FACTS).alias("response")).select("doc_id", guards.extraction_problem().alias("problem"))


@query("SELECT doc_id, '0' AS first_id, 'text ' || doc_id AS first_text FROM documents")
def renumbered_facts(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit('{"memory": [{"id": "9", "text": " text '), F.col("doc_id"), F.lit(' ", "attributed_to": "user"}]}'))
    f = read(spark, d, "documents").select("doc_id", said.alias("response")).select("doc_id", guards.renumbered_facts().alias("f"))
    return f.select("doc_id", F.col("f")[0]["id"].alias("first_id"), F.col("f")[0]["text"].alias("first_text"))


# --- searches and stores --------------------------------------------------------------------------------------


@query("""
WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score, row_number() OVER (ORDER BY list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id) AS rank FROM embeddings, q WHERE label = 1 QUALIFY rank <= 7
""")
def dispatched_hits(spark: SparkSession, d: str) -> DataFrame:
    """A selective filter is answered exactly, index or not."""
    own = read(spark, d, "embeddings")
    asked = own.orderBy("vec_id").first().embedding
    got = retrieval.dispatched_search(own, asked, 7, {"label": 1}, id_col="vec_id", ordinal="vec_id", vector="embedding")
    return got.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""
WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id AS id, row_number() OVER (ORDER BY list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id) AS rank FROM embeddings, q WHERE label IN (2, 3) QUALIFY rank <= 5
""")
def adapter_hits(spark: SparkSession, d: str) -> DataFrame:
    """The adapter's default of five hits under its contract."""
    own = read(spark, d, "embeddings")
    asked = own.orderBy("vec_id").first().embedding
    got = retrieval.adapter_search(own, [asked], None, {"label": {"in": [2, 3]}}, id_col="vec_id", ordinal="vec_id", vector="embedding")
    return got.select("id", F.col("rank").cast("long").alias("rank"))


_FILTERS = {"lang": {"in": ["en", "de"]}, "source": {"ne": "src1"}, "n_chars": {"ne": 416.5, "in": [None, *range(0, 4000, 2)]}, "text": {"ne": None}}


@query("""
SELECT doc_id, lang IN ('en', 'de') AND source IS DISTINCT FROM 'src1' AS pushed, coalesce(lang IN ('en', 'de') AND source IS DISTINCT FROM 'src1' AND (n_chars IS NULL OR n_chars < 4000 AND n_chars % 2 = 0) AND text IS NOT NULL, false) AS passed
FROM documents
""")
def pushable_filters(spark: SparkSession, d: str) -> DataFrame:
    """Filters parted into those that a scan can take and the rest, and the rows that pass the first and both."""
    pushed, rest = retrieval.split_filters(_FILTERS)
    taken, kept = retrieval.payload_matches(pushed), retrieval.payload_matches(rest)
    return read(spark, d, "documents").select("doc_id", taken.alias("pushed"), (taken & kept).alias("passed"))


@query("""
SELECT vec_id::VARCHAR AS id, row_number() OVER (ORDER BY vec_id) - 1 AS ordinal, len(embedding)::INT AS dim FROM embeddings
UNION ALL SELECT CASE WHEN vec_id % 2 = 0 THEN 'fact-' || vec_id ELSE 'given-' || vec_id END, (SELECT count(*) FROM embeddings) + row_number() OVER (ORDER BY vec_id) - 1, len(embedding) FROM embeddings WHERE label = 3
""")
def inserted_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows inserted under their fact id, else under the id that was given."""
    own = read(spark, d, "embeddings")
    base = retrieval.ranked_by(own.select("vec_id", F.col("embedding").alias("vector")), "vec_id", name="n").select(F.col("vec_id").cast("string").alias("id"), (F.col("n") - 1).alias("ordinal"), "vector")
    new = own.where("label = 3").select(F.concat(F.lit("given-"), "vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit("fact-"), "vec_id")).alias("fact_id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("seq"))
    return store.inserted(base, new).select("id", "ordinal", F.size("vector").alias("dim"))


@query("SELECT 'c' AS name, 'local' AS backend, count(*) AS vectors, max(len(embedding))::INT AS embedding_dim FROM embeddings")
def collection_info(spark: SparkSession, d: str) -> DataFrame:
    return store.collection_info(read(spark, d, "embeddings"), "c", "local", "embedding")


@query("SELECT 'c' || doc_id AS id, ['lang']::VARCHAR[] AS keys, CASE WHEN doc_id % 2 = 0 THEN n_chars::DOUBLE ELSE 0 END AS score, CASE WHEN doc_id % 2 = 0 THEN -n_chars::DOUBLE ELSE 0 END AS distance FROM documents")
def point_hits(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents")
    points = own.select(F.col("doc_id").cast("string").alias("id"), F.create_map(F.lit("__id"), F.concat(F.lit("c"), "doc_id"), F.lit("lang"), "lang").alias("payload"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("double")).alias("score"), F.lit(1).alias("rank"))
    got = store.point_hits(points, "__id")
    return got.select("id", F.map_keys("payload").alias("keys"), "score", "distance")


@query("SELECT count(*) AS users, sum(n_chars)::BIGINT AS tokens, sum(n_chars * 2)::BIGINT AS bytes FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)")
def memory_totals(spark: SparkSession, d: str) -> DataFrame:
    """Statistics over the latest memory of each user; replaced and removed ones don't count."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("user_id"), F.col("n_chars").alias("num_tokens"), (F.col("n_chars") * 2).alias("num_bytes"))
    old = docs.withColumns({"num_tokens": F.lit(1_000_000).cast("long"), "seq": F.lit(0)})
    gone = read(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("user_id"), F.lit(None).cast("long").alias("num_tokens"), F.lit(None).cast("long").alias("num_bytes"), F.lit(2).alias("seq"))
    return store.memory_stats(old.unionByName(docs.withColumn("seq", F.lit(1))).unionByName(gone))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'top' WHEN 1 THEN 'meta' WHEN 2 THEN 'old' ELSE 'legacy' END AS v FROM documents")
def promoted_values(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    payload = F.when(k == 0, F.create_map(F.lit("new"), F.lit("top"))).otherwise(F.create_map(F.lit("former"), F.lit("legacy")))
    meta = F.when(k == 0, F.create_map(F.lit("new"), F.lit("meta"))).when(k == 1, F.create_map(F.lit("new"), F.lit("meta"), F.lit("former"), F.lit("old"))).when(k == 2, F.create_map(F.lit("former"), F.lit("old")))
    return read(spark, d, "documents").select("doc_id", payload.alias("p"), meta.alias("m")).select("doc_id", store.promoted("p", "m", "new", "former").alias("v"))


@query("SELECT doc_id, lang AS top_role, source AS meta_user, NULL::VARCHAR AS other, 'm' AS memory, 'm' AS text FROM documents")
def mirrored_payloads(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents").select("doc_id", F.create_map(F.lit("user_id"), "source", F.lit("other"), F.lit("x")).alias("p"), F.create_map(F.lit("role"), "lang").alias("m"), F.lit(None).cast("string").alias("memory"), F.lit("m").alias("data"), F.lit(None).cast("string").alias("text"))
    top, meta = store.mirrored("p", "m")
    filled = store.payload_text()
    return own.select("doc_id", F.try_element_at(top, F.lit("role")).alias("top_role"), F.try_element_at(meta, F.lit("user_id")).alias("meta_user"), F.try_element_at(meta, F.lit("other")).alias("other"), filled["memory"].alias("memory"), filled["text"].alias("text"))


# --- prompts and tokens ---------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT conv_id, count(*) FILTER (turn > 0) AS facts FROM conversations GROUP BY conv_id)
SELECT conv_id, (CASE WHEN facts > 0 THEN 2 + 1 + facts ELSE 2 + 3 END + 15)::BIGINT AS tokens, ((CASE WHEN facts > 0 THEN 2 + 1 + facts ELSE 2 + 3 END + 15) // 16 * 16)::BIGINT AS loaded, ((CASE WHEN facts > 0 THEN 2 + 1 + facts ELSE 2 + 3 END + 15) % 16)::BIGINT AS tail FROM p
""")
def memory_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of each conversation's later turns: header, heading or what stands for none, facts, padded footer."""
    ints = lambda *x: F.array(*[F.lit(v) for v in x])
    per = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") > 0, F.col("turn").cast("int"))).alias("stream"))
    footer = context.pad_scaffold(ints(8, 9), F.lit(1), 16)
    head = F.when(F.size("stream") > 0, 1).otherwise(3)
    planned = 2 + head + F.size("stream") + F.size(footer)
    per = per.withColumn("prompt", records.memory_prompt(ints(5, 6), ints(7), ints(1, 2, 3), F.col("stream"), footer, planned))
    tail = records.block_tail(F.size("prompt"), 2 + F.when(F.size("stream") > 0, 1).otherwise(0) + F.size("stream"), 16)
    return per.withColumn("t", tail).select("conv_id", F.size("prompt").cast("long").alias("tokens"), "t.loaded", "t.tail")


@query("SELECT doc_id, lang || ' before ' AS header, ' after <M> ' || source AS footer FROM documents")
def split_templates(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents").select("doc_id", records.split_template(F.concat("lang", F.lit(" before <M> after <M> "), "source"), "<M>").alias("t"))
    return own.select("doc_id", "t.header", "t.footer")


@query("SELECT doc_id, least(400, 500 - doc_id % 90 - 50)::INT AS budget FROM documents")
def memory_budgets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", context.memory_budget((F.col("doc_id") % 90).cast("int"), 50, 400, 500).alias("budget"))


@query("SELECT conv_id AS query_id, turn::VARCHAR AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos FROM conversations")
def unique_facts(spark: SparkSession, d: str) -> DataFrame:
    """Every fact twice; the best of each counts and the best of all comes last."""
    own = read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").cast("string").alias("id"), "text", F.explode(F.array(F.col("turn"), F.col("turn") + 100)).alias("rank"))
    return context.unique_facts(own).select("query_id", "id", F.col("pos").cast("long").alias("pos"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN lang || source || source ELSE '' END AS content FROM documents")
def message_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.to_json(F.struct(F.col("lang").alias("v")))).when(k == 1, F.concat(F.lit('{"v": ["'), "lang", F.lit('", {"text": "'), "source", F.lit('"}, {"content": "'), "source", F.lit('"}, {"type": "image"}]}'))).otherwise('{"v": null}')
    v = F.try_variant_get(F.parse_json(raw), "$.v", "variant")
    return read(spark, d, "documents").select("doc_id", X.content_text(v).alias("content"))


@query("SELECT doc_id, [doc_id + 1, doc_id + 2, doc_id + 3]::INT[] AS counts FROM documents")
def parsed_user_counts(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit(" "), F.col("doc_id") + 1, F.lit(", "), F.col("doc_id") + 2, F.lit(";\n"), F.col("doc_id") + 3)
    return read(spark, d, "documents").select("doc_id", X.user_counts(said).alias("counts"))


@query("SELECT doc_id, [lang, source]::VARCHAR[] AS texts FROM documents")
def result_texts(spark: SparkSession, d: str) -> DataFrame:
    said = F.array(F.create_map(F.lit("memory"), F.concat(F.lit(" "), "lang")), F.create_map(F.lit("text"), F.concat("source", F.lit(" "))), F.create_map(F.lit("memory"), F.lit("  ")))
    return read(spark, d, "documents").select("doc_id", runs.texts_of_results(said).alias("texts"))


@query("SELECT conv_id AS ord, sum(1)::INT AS tokens FROM conversations GROUP BY conv_id ORDER BY conv_id LIMIT 10")
def warmup_lengths(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("ord")).agg(F.collect_list("turn").alias("tokens"))
    return workload.warmup_prompts(own, 100).select("ord", F.size("tokens").alias("tokens"))


@query("""
SELECT event_type AS condition, [user_id % 4]::INT[] AS user_counts FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL
UNION ALL SELECT event_type, list_sort(list(DISTINCT user_id % 4))::INT[] FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1
""")
def worker_specs(spark: SparkSession, d: str) -> DataFrame:
    return throughput.worker_specs(read(spark, d, "events").select(F.col("event_type").alias("condition"), (F.col("user_id") % 4).alias("num_users")), ["view", "click"])


@query("""
WITH g AS (SELECT DISTINCT lang AS m, doc_id % 7 AS k, n_chars % 3 AS w FROM documents)
SELECT m || '-k' || k || '-w' || w AS run_id FROM g UNION ALL SELECT DISTINCT m || '-k' || k || '-base' FROM g
""")
def sweep_runs(spark: SparkSession, d: str) -> DataFrame:
    grid = read(spark, d, "documents").select(F.col("lang").alias("model"), (F.col("doc_id") % 7).alias("k"), (F.col("n_chars") % 3).alias("window"))
    return throughput.sweep(grid, "base").select("run_id")


@query("SELECT turn AS n, conv_id AS key, '> ' || text AS value FROM conversations")
def answered_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a chat client, which here quotes the prompt, in Arrow batches."""
    own = read(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text")
    got = models.answered(own, lambda texts: [f"> {t}" for t in texts], "key", "text")
    return got.select(F.substring_index("key", ":", -1).cast("long").alias("n"), F.substring_index("key", ":", 1).cast("long").alias("key"), "value")


@query("SELECT conv_id, turn, round(('0x' || substr(sha256(text), 1, 2))::INT / 255.0, 5) AS first, 8 AS dim FROM conversations")
def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "conversations").select("conv_id", "turn", models.embedder()("text").alias("v"))
    return own.select("conv_id", "turn", F.round(F.col("v")[0].cast("double"), 5).alias("first"), F.size("v").alias("dim"))


@query("SELECT conv_id AS sample_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS seen FROM conversations GROUP BY conv_id")
def extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    """A stateful extractor reads each conversation's turns in order."""
    def extract(turns):
        return turns.head(1).assign(seen=",".join(map(str, turns["ord"])))[["sample_id", "seen"]]

    own = read(spark, d, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("ord"))
    return models.extracted_facts(own, extract, "sample_id long, seen string")
