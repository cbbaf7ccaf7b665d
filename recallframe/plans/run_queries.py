"""Queries of run records, chunk fetches, capacity models and set operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import cache, context, guards, models, retrieval, runs, store, throughput, workload
from .queries import query, read


@query("""
SELECT doc_id, CASE WHEN quality = 1 THEN 'correct' WHEN quality = 0 THEN 'incorrect' ELSE 'skipped' END AS verdict, 'run_id=r doc=' || doc_id AS label, (doc_id % 6)::VARCHAR IN ('1', '2', '3', '4') AS eligible,
  ['multi-hop', 'temporal', 'open-domain', 'single-hop', 'adversarial', 'unknown'][CASE WHEN doc_id % 6 = 0 THEN 6 ELSE doc_id % 6 END] AS category_name FROM documents LEFT JOIN labels USING (doc_id)
""")
def record_labels(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    cat = (F.col("doc_id") % 6).cast("string")
    return own.select("doc_id", runs.judge_label(F.col("quality") == 1).alias("verdict"), runs.record_label(run_id=F.lit("r"), doc=F.col("doc_id")).alias("label"), runs.eligible(F.concat(F.lit(" "), cat)).alias("eligible"), X.category_name(cat).alias("category_name"))


@query("""
SELECT event_id, ['llama', 'mistral', 'qwen3-14b', 'other'][event_id % 4 + 1] AS model, CASE WHEN event_id % 4 = 2 THEN 'qwen3' END AS parser, (CASE WHEN event_id % 2 = 0 THEN least(959, greatest(64, 100)) ELSE -1 END)::INT AS beam, event_id % 3 = 0 AS flag FROM events
""")
def model_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in (" Llama3.1 ", "mistral-7B", "Qwen3", "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    flag = F.element_at(F.array(*[F.lit(x) for x in (" YES", "no", "")]), (F.col("event_id") % 3 + 1).cast("int"))
    backend = F.when(F.col("event_id") % 2 == 0, "graph").otherwise("local")
    return read(spark, d, "events").select("event_id", runs.model_key(name).alias("model"), runs.reasoning_parser(name).alias("parser"), F.coalesce(runs.beam_width(backend, 64, 100), F.lit(-1)).alias("beam"), X.truthy(flag).alias("flag"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN toxic = 1 ELSE quality = 1 END AS with_evidence FROM labels WHERE doc_id % 2 = 0 OR quality = 1 OR toxic = 0")
def evidence_protocols(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "labels").where("doc_id % 2 = 0 or quality = 1 or toxic = 0")
    return own.select("doc_id", runs.evidence_protocol(F.col("quality") == 1, F.col("toxic") == 1, F.col("doc_id") % 2 == 0).alias("with_evidence"))


@query("SELECT least(count(*) FILTER (turn % 6 BETWEEN 1 AND 4), 50) AS planned FROM conversations")
def planned_questions(spark: SparkSession, d: str) -> DataFrame:
    return runs.planned_questions(read(spark, d, "conversations").select((F.col("turn") % 6).cast("string").alias("category")), 50)


@query("SELECT conv_id AS sample_ord, turn AS question_ord FROM conversations ORDER BY conv_id, turn LIMIT 50")
def capped_questions(spark: SparkSession, d: str) -> DataFrame:
    return workload.capped_questions(read(spark, d, "conversations").select(F.col("conv_id").alias("sample_ord"), F.col("turn").alias("question_ord")), 50)


@query("""
WITH s AS (SELECT conv_id AS sample_id, row_number() OVER (ORDER BY conv_id) - 1 AS ord FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT u.user_id AS user_index, sample_id FROM (SELECT DISTINCT user_id FROM events) u JOIN s ON u.user_id % (SELECT count(*) FROM s) = s.ord
""")
def round_robin_users(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "conversations").select(F.col("conv_id").alias("sample_id")).distinct()
    samples = retrieval.ranked_by(ids, "sample_id", name="n").select("sample_id", (F.col("n") - 1).alias("ord"))
    users = read(spark, d, "events").select(F.col("user_id").alias("user_index")).distinct()
    return runs.round_robin(users, samples).select("user_index", "sample_id")


@query("SELECT conv_id AS user_id, min(role) AS sample_id, count(*) AS requests FROM conversations GROUP BY conv_id")
def grouped_requests(spark: SparkSession, d: str) -> DataFrame:
    return runs.grouped_requests(read(spark, d, "conversations").select(F.col("conv_id").alias("user_id"), F.col("role").alias("sample_id")))


@query("SELECT conv_id AS request_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1)::INT AS pos, turn AS fact_id, length(text)::INT AS tokens FROM conversations")
def fetched_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each conversation, fetched best last."""
    own = read(spark, d, "conversations")
    asked = own.groupBy(F.col("conv_id").alias("request_id")).agg(F.sort_array(F.collect_list(F.concat_ws(":", F.lpad("turn", 6, "0"), F.col("conv_id"))), asc=False).alias("fact_ids"))
    chunks = own.select(F.concat_ws(":", F.lpad("turn", 6, "0"), F.col("conv_id")).alias("fact_id"), F.length("text").alias("tokens"))
    got = runs.fetch_chunks(asked, chunks)
    return got.select("request_id", "pos", F.substring_index("fact_id", ":", 1).cast("long").alias("fact_id"), "tokens")


@query("SELECT count(DISTINCT user_id) AS covered FROM events WHERE event_type IN ('click', 'view') OR value > 150")
def load_coverage(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").withColumnRenamed("user_id", "request_id")
    return runs.load_coverage(own.where("event_type in ('click', 'view')"), own.where("value > 150"))


@query("""
SELECT user_id, event_id AS seq, (sum(user_id) OVER w)::BIGINT AS bytes_total, round(sum(value) OVER w, 4) AS latency_total, user_id AS bytes_delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)
""")
def transfer_deltas(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.col("user_id").alias("num_bytes"), F.col("value").alias("h2d_latency_ms"))
    return runs.transfer_deltas(own).select("user_id", "seq", "bytes_total", F.round("latency_total", 4).alias("latency_total"), "bytes_delta")


@query("SELECT ((count(*) - count(*) FILTER (lower(trim(source)) = lower(trim(lang)))) * 2 + count(*) FILTER (lower(trim(source)) = lower(trim(lang))))::BIGINT AS entities FROM documents")
def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents").select(F.array(F.col("source"), F.upper("source"), F.col("lang"), F.lit(" ")).alias("entities"))
    return runs.entity_counts(own)


@query("SELECT event_type AS condition, list_position(['view', 'click', 'purchase'], event_type)::BIGINT AS place FROM (SELECT DISTINCT event_type FROM events) WHERE event_type IN ('view', 'click', 'purchase')")
def resumed_conditions(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").select(F.col("event_type").alias("condition")).where("condition in ('view', 'click', 'purchase')")
    return runs.conditions_to_run(own, own.where("condition = 'view'"), ["view", "click", "purchase"])


@query("""
SELECT conv_id, max(turn) <> count(*) - 1 AS gaps, list_distinct(list(role))::VARCHAR[] <> [] AS any_role, true AS same FROM conversations GROUP BY conv_id
""")
def id_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of expected and actual turn numbers of each conversation."""
    per = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("t"), F.max("turn").alias("m"), F.collect_set("role").alias("r"))
    gap = runs.missing_counts(F.sequence(F.lit(0).cast("long"), F.col("m")), F.col("t"))
    return per.select("conv_id", (F.size(gap["missing"]) > 0).alias("gaps"), (F.size("r") > 0).alias("any_role"), runs.same_ids(F.col("t"), F.reverse("t")).alias("same"))


@query("""
SELECT conv_id || ':s:' || turn AS memory_id, trim(text) AS text, (conv_id % 7)::INT AS session_index, 'session_' || (conv_id % 7) AS session_id, turn::INT AS turn_index FROM conversations WHERE trim(text) <> ''
""")
def facts_from_hits(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "conversations").where("trim(text) <> ''")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.lit("s"), F.col("turn").cast("string"))
    hits = own.select(key.alias("id"), F.create_map(F.lit("memory"), "text").alias("payload"), F.create_map(F.lit("session_index"), (F.col("conv_id") % 7).cast("string"), F.lit("turn_id"), key).alias("metadata"), F.lit(1).alias("rank"))
    return runs.fact_from_hit(hits).select("memory_id", "text", "session_index", "session_id", "turn_index")


@query("SELECT source AS device, count(*) AS chunks, sum(n_chars)::BIGINT AS bytes, sum(n_chars)::BIGINT / 1048576.0 AS mb FROM documents GROUP BY source")
def chunk_residency(spark: SparkSession, d: str) -> DataFrame:
    return runs.chunk_residency(read(spark, d, "documents").select(F.col("source").alias("device"), F.col("n_chars").alias("bytes")))


@query("SELECT count(*) AS chunks, sum(n_chars)::BIGINT AS tokens, max(length(lang))::INT AS layers, sum(n_chars * 2)::BIGINT AS bytes, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT source AS s FROM documents)) AS devices FROM documents")
def chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents")
    return store.chunk_stats(own.select(F.col("n_chars").alias("tokens"), F.length("lang").alias("layers"), (F.col("n_chars") * 2).alias("bytes"), F.col("source").alias("device")))


@query("""
WITH s AS (SELECT sum(n_chars)::DOUBLE AS t, sum(n_chars * 8)::DOUBLE AS b, count(*) AS c FROM documents), p AS (SELECT (100 + least(50, c) * (t / c)) * (b / t) AS one, b * 3 AS src FROM s)
SELECT round(3 * 1000 + one * 20 + src, 2) AS setup_peak, round(0.4 * 8e9 + 3 * 1000 + one * 20, 2) AS generate_peak, greatest(3 * 1000 + one * 20 + src, 0.4 * 8e9 + 3 * 1000 + one * 20) <= 0.97 * 8e9 AS fits FROM p
""")
def device_projection(spark: SparkSession, d: str) -> DataFrame:
    corpus = read(spark, d, "documents").select(F.col("n_chars").alias("tokens"), (F.col("n_chars") * 8).alias("bytes"))
    got = runs.device_projection(corpus, 20, 50, 100, 3, 8_000_000_000, 0.4, 1000)
    return got.select(F.round("setup_peak", 2).alias("setup_peak"), F.round("generate_peak", 2).alias("generate_peak"), "fits")


@query("SELECT doc_id, 'm_odel/fp16/w5/p4096/b16/' || lang || '-' || substr(sha256(text), 1, 20) AS path FROM documents")
def chunk_cache_paths(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents")
    return own.select("doc_id", runs.cache_path(F.lit("m odel"), F.lit("fp16"), F.lit(5), F.lit(4096), F.lit(16), F.col("lang"), F.substring(F.sha2("text", 256), 1, 20)).alias("path"))


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS encoded, count(*) FILTER (l.doc_id IS NOT NULL) AS skipped FROM documents d LEFT JOIN labels l USING (doc_id)")
def precompute_counts(spark: SparkSession, d: str) -> DataFrame:
    docs, have = read(spark, d, "documents").select(F.col("doc_id").alias("path")), read(spark, d, "labels").select(F.col("doc_id").alias("path"))
    return runs.already_cached(docs, have)


@query("SELECT q.vec_id AS query_id, v.vec_id AS ordinal, v.label FROM embeddings q JOIN embeddings v ON v.vec_id = q.vec_id")
def ordinal_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Padded result lists joined to their rows: what follows the first padding is ignored."""
    rows = read(spark, d, "embeddings").select(F.col("vec_id").alias("ordinal"), "label")
    found = rows.select(F.col("ordinal").alias("query_id"), F.posexplode(F.array(F.col("ordinal"), F.lit(-1).cast("long"), F.col("ordinal") + 1)).alias("place", "ordinal"))
    return runs.by_payload_ordinal(found, rows).select("query_id", "ordinal", "label")


@query("""
SELECT conv_id AS request_id, turn, CASE WHEN turn % 3 = 0 THEN conv_id WHEN turn % 3 = 1 THEN conv_id + 1000000 ELSE -1 END AS user_id FROM conversations
""")
def routed_requests(spark: SparkSession, d: str) -> DataFrame:
    """Prompts routed by the memory that they begin with (memories of several lengths, of which some begin with others) or
    by their user; those that begin with none get none."""
    own = read(spark, d, "conversations")
    start = F.array(F.col("conv_id"), F.lit(7).cast("long"))
    longer = F.concat(start, F.transform(F.sequence(F.lit(0), (F.col("conv_id") % 5).cast("int")), lambda i: i.cast("long")))
    k = F.col("turn") % 3
    prompt = F.when(k == 0, F.concat(longer, F.array(F.lit(-5).cast("long")))).otherwise(F.array(F.lit(-1).cast("long"), F.col("conv_id"), F.col("turn")))
    asked = own.select(F.struct("conv_id", "turn").alias("request_id"), F.when(k == 1, F.col("conv_id") + 1_000_000).alias("user_id"), prompt.alias("prompt"))
    one = own.select("conv_id").distinct()
    memories = one.select(F.col("conv_id").alias("user_id"), F.col("conv_id").alias("ord"), longer.alias("tokens"))
    memories = memories.union(one.select(F.col("conv_id") + 1_000_000, F.col("conv_id") + 1_000_000, start))  # shorter, but later
    got = context.route_requests(asked, memories)
    return got.select(F.col("request_id.conv_id").alias("request_id"), F.col("request_id.turn").alias("turn"), F.coalesce("user_id", F.lit(-1)).alias("user_id"))


@query("""
SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 5 END::INT AS mismatch, event_id % 6 > 0 AS prefixed, (event_id % 6 + CASE WHEN event_id % 6 = 0 THEN 4 ELSE 3 END)::INT AS joined FROM events
""")
def token_streams(spark: SparkSession, d: str) -> DataFrame:
    """First mismatch of two streams, prefix test, and joined prompts without a second begin token."""
    own = read(spark, d, "events")
    begin = F.array(F.lit(1), F.lit(2))
    a = F.concat(begin, F.array(F.col("user_id").cast("int"), F.col("event_id").cast("int"), F.lit(9)))
    k = (F.col("user_id") % 5).cast("int")
    b = F.transform(a, lambda x, i: F.when((i == k) & (k > 0), -1).otherwise(x))
    m = (F.col("event_id") % 6).cast("int")
    memory = F.when(m == 0, F.array().cast("array<int>")).otherwise(F.slice(F.concat(a, F.array(F.lit(5))), F.lit(1), m))
    prompt = F.when(m == 0, F.array().cast("array<int>")).otherwise(F.concat(memory, F.array(F.lit(3))))
    query_ids = F.array(F.lit(1), F.lit(2), F.lit(3), F.col("user_id").cast("int"))
    return own.select("event_id", context.first_mismatch(a, b).alias("mismatch"), context.is_memory_prefix(memory, prompt).alias("prefixed"), F.size(context.joined_prompt(memory, query_ids, 1)).alias("joined"))


@query("""
SELECT doc_id, doc_id % 3 AS kind, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'keys' ELSE 'blank text' END AS problem FROM documents
""")
def extraction_checks(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents")
    said = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.array(F.struct(F.lit("1").alias("id"), F.lit("fact").alias("text"), F.lit("user").alias("attributed_to"))).alias("memory")))).when(F.col("doc_id") % 3 == 1, '{"memory": [], "other": 1}').otherwise('{"memory": [{"id": "0", "text": "  ", "attributed_to": "user"}]}')
    return own.withColumn("response", said).select("doc_id", (F.col("doc_id") % 3).alias("kind"), guards.extraction_problem().alias("problem"))


@query("SELECT o_custkey AS key, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def first_of_each(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("first_order"))
    return cache.first_of_each(own, "key", "first_order")


@query("""
SELECT event_type AS condition, user_id % 4 AS num_users, printf('| %s | %d | %.3f | %.3f | 0.000 | 0.000 | 0.000 | %.3f |', event_type, user_id % 4, count(*) / 8.0 + 0.5, count(*) / 4.0, count(*) / 2.0) AS line FROM events GROUP BY 1, 2
""")
def timing_lines(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").groupBy(F.col("event_type").alias("condition"), (F.col("user_id") % 4).alias("num_users")).agg(F.count(F.lit(1)).alias("n"))
    rows = own.withColumns({"memory_setup_time_s": F.col("n") / 8, "kv_precompute_time_s": F.lit(0.5), "retrieval_time_s": F.col("n") / 4, "generation_time_s": F.col("n") / 2})
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("kv_compose_time_s", "kv_verify_time_s", "prompt_build_time_s")})
    return runs.markdown_timing(rows)


@query("""
WITH g AS (SELECT event_type AS condition, user_id % 3 AS num_users, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2)
SELECT condition, num_users, n, row_number() OVER (ORDER BY num_users, list_position(['view', 'click'], condition)) AS place FROM g
""")
def condition_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows in the report's order; their place tells of it."""
    own = read(spark, d, "events").where("event_type in ('view', 'click')").groupBy(F.col("event_type").alias("condition"), (F.col("user_id") % 3).alias("num_users")).agg(F.count(F.lit(1)).alias("n"))
    return throughput.in_condition_order(own, ["view", "click"])


@query("SELECT event_type AS condition, num_users::BIGINT AS num_users, 0::BIGINT AS total_requests, v AS throughput_qps, 'gpu' AS kv_store_backend FROM (SELECT event_type, count(*) AS num_users, round(avg(value), 6) AS v FROM events GROUP BY 1)")
def coerced_rows(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").groupBy(F.col("event_type").alias("condition")).agg(F.count(F.lit(1)).cast("string").alias("num_users"), F.round(F.avg("value"), 6).cast("string").alias("throughput_qps"))
    own = own.withColumns({"total_requests": F.lit(""), "kv_store_backend": F.lit("")})
    return throughput.coerce_rows(own).select("condition", "num_users", "total_requests", "throughput_qps", "kv_store_backend")


@query("SELECT user_id, count(*) AS transfers, coalesce(avg(value), 0) AS mean, CASE WHEN sum(value) > 0 THEN count(*) / (sum(value) / 1000) END AS qps FROM events GROUP BY user_id")
def user_rates(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("transfers"), F.avg("value").alias("mean"), F.sum("value").alias("total"))
    return own.select("user_id", "transfers", F.coalesce("mean", F.lit(0.0)).alias("mean"), N.per_second("transfers", "total").alias("qps"))


@query("""
WITH g AS (SELECT lang, count(*) AS total, count(*) FILTER (quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang), p AS (SELECT *, k / total AS s, 1 + 3.8416 / total AS scale FROM g)
SELECT lang, total, round(s, 6) AS share, round(greatest(0, (s + 3.8416 / (2 * total)) / scale - 1.96 * sqrt((s * (1 - s) + 3.8416 / (4 * total)) / total) / scale), 6) AS lower,
  round(least(1, (s + 3.8416 / (2 * total)) / scale + 1.96 * sqrt((s * (1 - s) + 3.8416 / (4 * total)) / total) / scale), 6) AS upper FROM p
""")
def wilson_by_language(spark: SparkSession, d: str) -> DataFrame:
    own = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality") == 1).alias("k"))
    ci = N.wilson("k", "total")
    return own.withColumn("ci", ci).select("lang", "total", F.round(N.safe_ratio("k", "total"), 6).alias("share"), F.round("ci.lower", 6).alias("lower"), F.round("ci.upper", 6).alias("upper"))


@query("""
SELECT conv_id AS sample_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END END AS source_role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, 0.0::DOUBLE AS score FROM conversations
""")
def catalog_hits(spark: SparkSession, d: str) -> DataFrame:
    """Facts as ranked hits with their source's metadata."""
    own = read(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    meta = F.struct(F.col("conv_id").alias("sample_id"), F.col("turn"), X.turn_role("role", F.lit(None).cast("string"), F.lit(None).cast("string")).alias("source_role"))
    return own.select(meta.alias("m"), F.row_number().over(w).cast("long").alias("rank"), F.lit(0.0).alias("score")).select("m.*", "rank", "score")


@query("""
SELECT conv_id, turn, turn % 6 = 0 AS stripped, CASE WHEN turn % 6 = 0 THEN [turn, length(text)] WHEN turn % 3 = 0 THEN [1, turn, length(text)] ELSE [9, 1, turn, length(text)] END::BIGINT[] AS query,
  list_concat([CASE WHEN turn % 2 = 0 THEN 1 ELSE 2 END, conv_id], CASE WHEN turn % 6 = 0 THEN [turn, length(text)] WHEN turn % 3 = 0 THEN [1, turn, length(text)] ELSE [9, 1, turn, length(text)] END)::BIGINT[] AS prompt
FROM conversations
""")
def query_tokens_for_memory(spark: SparkSession, d: str) -> DataFrame:
    """Query tokens behind a footer, as they follow a memory, and the prompt that both stand for; a begin token that both start
    with stands once."""
    own = read(spark, d, "conversations")
    memory = F.array(F.when(F.col("turn") % 2 == 0, 1).otherwise(2).cast("long"), "conv_id")
    asked = F.array(F.lit(1).cast("long"), F.col("turn"), F.length("text").cast("long"))
    footer = F.when(F.col("turn") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.lit(9).cast("long")))
    got = context.equivalence_prompt(memory, asked, 1, footer)
    return own.select("conv_id", "turn", got.alias("p")).select("conv_id", "turn", "p.stripped", F.col("p.query_token_ids").alias("query"), F.col("p.prompt_token_ids").alias("prompt"))


@query("SELECT conv_id, turn, length(text) AS tokens, role AS user, CASE WHEN turn % 2 = 0 THEN ['memory_user_id', 'top_p'] ELSE ['top_p'] END AS keys, max(length(text)) OVER ()::INT AS largest FROM conversations")
def request_params(spark: SparkSession, d: str) -> DataFrame:
    """A clone of the sampling parameters for each request, with the user of its memory; turns are tokenised once each."""
    own = read(spark, d, "conversations").withColumn("turn_id", F.concat_ws(":", "conv_id", "turn"))
    asked = own.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("role")).alias("user_id"), F.col("role").alias("user"))
    params = F.create_map(F.lit("top_p"), F.lit("0.9"), F.lit("memory_user_id"), F.lit("old"))
    keyed = context.routed_params(asked, params).withColumn("turn_id", F.concat_ws(":", "conv_id", "turn"))
    twice = own.union(own)  # each turn in two requests
    counted = context.turn_tokens(twice.select("turn_id", F.col("text").alias("line")), models.character_tokens).dropDuplicates(["turn_id"])
    largest = context.largest_prompt(counted.withColumnRenamed("token_ids", "tokens"), 1 << 20)
    out = keyed.join(counted.select("turn_id", F.size("token_ids").alias("tokens")), "turn_id").join(F.broadcast(largest))
    return out.select("conv_id", "turn", F.col("tokens").cast("long").alias("tokens"), "user", F.array_sort(F.map_keys("params")).alias("keys"), "largest")
