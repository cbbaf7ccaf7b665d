"""Chunk caches as tables: metadata of encoded chunks without their tensors, written whole and loaded only where nothing is
stale. A payload is one row (key, version, meta map of texts, has_tables) and its chunks one row each (key, kind, name, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import replace_folder

# The payload's version, what it tells of a chunk beside its tensors, and the scaffold parts that it needs.
PAYLOAD_VERSION = 1
CHUNK_FIELDS = ("token_ids", "context_turn_ids", "context_prefix_tokens", "raw_context_prefix_tokens", "context_prefix_truncated_tokens")
NEEDED_SCAFFOLD = ("header", "footer")
FACT, SCAFFOLD = "fact", "scaffold"


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Chunks (key, kind, name) with their metadata alone; tensors and other columns go."""
    return chunks.select("key", "kind", "name", *CHUNK_FIELDS)


def payload_problems(payloads: DataFrame, chunks: DataFrame, expected: DataFrame, facts: DataFrame, version: int = PAYLOAD_VERSION) -> DataFrame:
    """(key, problem) for every expected key (key, meta map): why its payload can't be loaded, null where it can.

    Looked at in this order: no payload, its version, each expected entry of its meta (further ones don't count), its facts
    against ``facts`` (key, name) as sets, the scaffold's parts, the tables. Facts meet by key and name, so that a key with
    many of them is spread over tasks.
    """
    same = F.forall(F.map_entries("wanted"), lambda e: F.try_element_at("meta", e["key"]).eqNullSafe(e["value"]))
    own = expected.select("key", F.col("meta").alias("wanted")).join(payloads.withColumn("__there", F.lit(True)), "key", "left")
    had = chunks.where(F.col("kind") == FACT).select("key", "name").distinct().withColumn("__had", F.lit(1))
    asked = facts.select("key", "name").distinct().withColumn("__asked", F.lit(1))
    odd = had.join(asked, ["key", "name"], "full").where("__had is null or __asked is null").select("key").distinct().withColumn("__odd", F.lit(True))
    parts = chunks.where((F.col("kind") == SCAFFOLD) & F.col("name").isin(*NEEDED_SCAFFOLD) & F.col("token_ids").isNotNull())
    whole = parts.groupBy("key").agg((F.countDistinct("name") == len(NEEDED_SCAFFOLD)).alias("__whole"))
    met = own.join(odd, "key", "left").join(whole, "key", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    problem = (
        F.when(F.col("__there").isNull(), "missing").when(no(F.col("version") == version), "version").when(F.col("meta").isNull() | no(same), "meta")
        .when(F.col("__odd"), "facts").when(no(F.col("__whole")), "scaffold").when(no(F.col("has_tables")), "tables")
    )
    return met.select("key", problem.alias("problem"))


def load_chunks(payloads: DataFrame, chunks: DataFrame, expected: DataFrame, facts: DataFrame, version: int = PAYLOAD_VERSION) -> DataFrame:
    """Chunk metadata of the expected keys whose payload is valid; any other payload is a miss as a whole."""
    good = payload_problems(payloads, chunks, expected, facts, version).where("problem is null").select("key")
    return chunk_metadata(chunks).join(good, "key", "left_semi")


def save_chunks(payloads: DataFrame, chunks: DataFrame, path: str) -> None:
    """Both tables below a folder that is swapped in as one: readers find the old cache or the new one."""

    def write(at: str) -> None:
        payloads.write.parquet(f"{at}/payloads")
        chunk_metadata(chunks).write.parquet(f"{at}/chunks")

    replace_folder(payloads.sparkSession, path, write)


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Payloads and chunks as ``save_chunks`` wrote them."""
    return spark.read.parquet(f"{path}/payloads"), spark.read.parquet(f"{path}/chunks")
