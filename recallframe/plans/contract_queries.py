"""Contracts and parsers on what stands in the tables: responses, facts and hits are built of their columns, breakages included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import guards, records, retrieval
from .queries import query, read


@query("""
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'keys' WHEN text IS NULL THEN 'fields' WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) = 0 THEN 'blank text' WHEN length(text) > 600 THEN 'long text'
  WHEN turn = 3 THEN 'attributed_to' WHEN turn = 5 THEN 'links' WHEN turn = 6 THEN 'too many' END AS problem FROM conversations
""")
def extraction_of_turns(spark: SparkSession, d: str) -> DataFrame:
    """Responses of an extractor, as JSON made of the turns: their texts are the facts, some turns break a rule."""
    own = read(spark, d, "conversations")
    fact = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text"), F.when(F.col("turn") == 3, "narrator").otherwise("user").alias("attributed_to"))
    linked = F.when(F.col("turn") == 5, F.lit("{}")).otherwise(F.to_json(F.array(F.concat_ws("-", "conv_id", "turn"))))
    one = F.concat(F.expr("regexp_replace(to_json(fact), '\\\\}$', '')"), F.lit(', "linked_memory_ids": '), linked, F.lit("}"))
    own = own.withColumn("fact", fact)
    listed = F.when((F.col("turn") == 6) & (F.col("role") != "system") & F.col("text").isNotNull() & (F.length("text") <= 600) & F.col("text").rlike(r"\S"), F.array_join(F.array_repeat(one, 6), ",")).otherwise(one)
    response = F.concat(F.lit('{"memory": ['), listed, F.lit("]"), F.when(F.col("role") == "system", ', "more": 1').otherwise(""), F.lit("}"))
    return own.withColumn("response", response).select("conv_id", "turn", guards.extraction_problem().alias("problem"))


@query("""
SELECT doc_id, CASE WHEN quality IS NOT NULL THEN quality = 1 END AS correct, CASE WHEN quality IS NULL THEN 'unparsed' ELSE 'ok' END AS status, CASE WHEN quality IS NULL THEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE '' END AS reason
FROM documents LEFT JOIN labels USING (doc_id)
""")
def verdicts_on_documents(spark: SparkSession, d: str) -> DataFrame:
    """A judge's responses: a JSON verdict, in words before and behind it where the text is toxic; unlabelled texts say none."""
    own = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    said = F.to_json(F.struct((F.col("quality") == 1).alias("correct"), F.col("source").alias("why")))
    said = F.when(F.col("quality").isNull(), F.col("text")).when(F.col("toxic") == 1, F.concat(F.lit("So I say "), said, F.lit(" and that is it."))).otherwise(said)
    return own.select("doc_id", X.judge_payload(said).alias("j")).select("doc_id", "j.correct", "j.status", "j.reason")


_IDENTITY = {"version": 3, "model": "m", "sample_id": "all"}


@query("SELECT conv_id || ':' || turn AS fact_id, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ord FROM conversations")
def loaded_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of catalogs, one for each conversation, whose identity has every key; another identity, a fact without text or a
    repeated id would raise."""
    identity = F.create_map(*[x for k in records.CATALOG_IDENTITY for x in (F.lit(k), F.lit(None if _IDENTITY.get(k) is None else str(_IDENTITY[k])))])
    own = read(spark, d, "conversations").select("conv_id", "turn", F.struct(F.concat_ws(":", "conv_id", "turn").alias("fact_id"), "text").alias("fact"))
    catalogs = own.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "fact"))), lambda x: x["fact"]).alias("facts")).withColumn("identity", identity)
    return records.load_facts(catalogs, _IDENTITY).select("fact_id", "text", "ord")


@query("""
SELECT query_id, fact_id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS fact_id, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0) WHERE rank <= 7
""")
def prepared_search(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a ranker that hands out more than was asked for, as a prepared store returns them."""
    own = read(spark, d, "embeddings")
    asked = own.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    ranked = retrieval.top_k(own, asked, 20, "label", "vec_id", "vec_id", "embedding")
    found = ranked.select("query_id", F.col("id").alias("fact_id"), F.concat(F.lit("fact "), "id").alias("text"), "score")
    facts = own.select(F.col("vec_id").alias("fact_id"), F.concat(F.lit("fact "), "vec_id").alias("text"))
    return retrieval.prepared_hits(found, facts, 7).select("query_id", "fact_id", F.round(1 - F.col("distance"), 6).alias("score"), "rank")


@query("""
SELECT conv_id AS query_id, CASE WHEN min(turn) <> 0 THEN 'ranks' WHEN count(DISTINCT text) < count(*) THEN 'duplicate ids' WHEN bool_or(length(text) = 0) THEN 'scores' ELSE 'fine' END AS problem FROM conversations GROUP BY conv_id
""")
def hit_problems(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as a list of hits (a text is an id, an empty one has no score): what breaks the contract."""
    own = read(spark, d, "conversations")
    hits = own.select(F.col("conv_id").alias("query_id"), F.col("text").alias("id"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) + F.min("turn").over(Window.partitionBy("conv_id"))).cast("int").alias("rank"), F.when(F.length("text") > 0, F.length("text").cast("double")).alias("score"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("expected"))
    bad = guards.valid_hits(hits, F.col("expected"))
    return own.select(F.col("conv_id").alias("query_id")).distinct().join(bad, "query_id", "left").select("query_id", F.coalesce("problem", F.lit("fine")).alias("problem"))
