"""Queries over cache files, observed builds and jobs that run side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import builds
from ..sources import cache_files
from ..sources.written import folder
from .queries import query, read


@query("""
SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS hit, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 THEN lang ELSE 'new ' || source END AS value FROM documents
""")
def cached_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Every third value isn't cached, every fifth entry is broken and older ones are of another version: what is no hit is computed,
    written and found by a reader that may not write."""
    docs, base = read(spark, d, "documents").select("doc_id", "lang", "source", F.col("doc_id").cast("string").alias("key")), folder(spark, "cache")
    cache_files.write_entries(docs.where("doc_id % 3 = 0").select("key", F.lit("stale").alias("value")), f"{base}/c", 1)
    cache_files.write_entries(docs.where("doc_id % 3 <> 0").select("key", F.col("lang").alias("value")), f"{base}/whole", 2)
    entries = cache_files.read_entries(spark, f"{base}/whole")
    entries.withColumn("value", F.when(F.col("key").cast("long") % 5 == 0, "broken").otherwise(F.col("value"))).write.mode("append").parquet(f"{base}/c")
    got = cache_files.memoised_in_files(docs, f"{base}/c", 2, lambda missing: missing.select("key", F.concat(F.lit("new "), "source").alias("value")))
    again = cache_files.memoised_in_files(got.select("key", "doc_id", F.col("hit").alias("found")), f"{base}/c", 2, lambda missing: missing.select("key", F.lit("never").alias("value")))
    return again.select("doc_id", F.col("found").alias("hit"), "value")


@query("""
SELECT 'texts' AS step, unnest(['rows', 'bytes', 'null_doc_id', 'null_text', 'null_lang', 'longest']) AS metric,
  unnest([count(*), coalesce(sum(strlen(coalesce(text, '')) + strlen(coalesce(lang, ''))), 0), 0, count(*) FILTER (text IS NULL), count(*) FILTER (lang IS NULL), max(n_chars)])::BIGINT AS value FROM documents
UNION ALL SELECT 'vectors', unnest(['rows', 'bytes', 'null_vec_id', 'null_embedding']), unnest([count(*), coalesce(sum(4 * len(embedding)), 0), 0, count(*) FILTER (embedding IS NULL)])::BIGINT FROM embeddings
""")
def observed_builds(spark: SparkSession, d: str) -> DataFrame:
    """Two steps of a build and what they tell of themselves, seen in the jobs that write."""
    base = folder(spark, "build")
    docs = read(spark, d, "documents")
    _, texts = builds.written_step(docs.select("doc_id", "text", "lang"), f"{base}/texts", "texts")
    longest = read(spark, d, "documents").agg(F.max("n_chars").cast("long").alias("v")).select(F.lit("texts").alias("step"), F.lit("longest").alias("metric"), F.col("v").alias("value"))
    _, vectors = builds.written_step(read(spark, d, "embeddings").select("vec_id", "embedding"), f"{base}/vectors", "vectors")
    return builds.build_metrics(spark, [texts, vectors]).unionByName(longest)


@query("""
SELECT dense_rank() OVER (ORDER BY r_regionkey)::INT - 1 AS part, n_name AS nation, count(c_custkey) AS customers, round(coalesce(sum(c_acctbal), 0), 2) AS balance
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey, n_name
""")
def regional_jobs(spark: SparkSession, d: str) -> DataFrame:
    """A job for each region, side by side; their rows make one table."""
    nations, customers = read(spark, d, "nation"), read(spark, d, "customer")
    keys = [r.r_regionkey for r in read(spark, d, "region").orderBy("r_regionkey").collect()]  # one row a region

    def work(key: int) -> DataFrame:
        own = nations.where(F.col("n_regionkey") == key).join(customers, F.col("c_nationkey") == F.col("n_nationkey"))
        return own.groupBy(F.col("n_name").alias("nation")).agg(F.count("c_custkey").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))

    return builds.mapped_parts(spark, keys, work, f"{folder(spark, 'regions')}/t").select("part", "nation", "customers", "balance")
