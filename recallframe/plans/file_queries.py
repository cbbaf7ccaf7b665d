"""Queries that write files into the shared folder and read them back, with the SQL of what must be found there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs
from ..sources import files, sinks
from ..sources.written import folder
from .queries import query, read


@query("SELECT event_id, event_type, user_id, value FROM events")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows written twice as JSON lines: the second write replaces the first."""
    own, path = read(spark, d, "events").select("event_id", "event_type", "user_id", "value"), folder(spark, "lines")
    files.write_json_lines(own.limit(1), path)
    files.write_json_lines(own, path)
    return files.read_json_lines(spark, path, "event_id long, event_type string, user_id long, value double")


@query("""SELECT conv_id::VARCHAR AS conv_id, turn::DOUBLE AS turn, CASE WHEN turn % 2 = 0 THEN text END AS text, '["' || role || '"]' AS roles FROM conversations""")
def csv_reports(spark: SparkSession, d: str) -> DataFrame:
    """Fixed columns, null as an empty cell, nested values as compact JSON; numbers come back as numbers."""
    own = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"), F.array("role").alias("roles"))
    files.write_csv(own, path := folder(spark, "csv"), own.columns)
    return files.read_run_csv(spark, path, own.columns, ["turn"])


@query("""
SELECT row_number() OVER (ORDER BY list_position(['view', 'click', 'purchase'], event_type), event_id) AS place, event_id, event_type AS condition, CASE WHEN event_type <> 'view' THEN value END AS extra FROM events WHERE event_type IN ('view', 'click', 'purchase')
""")
def condition_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each condition, of which older ones lack a column, read in the conditions' order."""
    from ..operators.retrieval import ranked_by

    own, base = read(spark, d, "events"), folder(spark, "conditions")
    for c in ("click", "view", "purchase"):
        rows = own.where(F.col("event_type") == c).select("event_id", F.col("event_type").alias("condition"), F.col("value").alias("extra"))
        files.write_csv(rows.drop("extra") if c == "view" else rows, f"{base}/throughput_{c}.csv", rows.columns[:2] if c == "view" else rows.columns)
    got = files.read_condition_files(spark, base, ["view", "click", "absent", "purchase"])
    typed = got.select("__condition_order", F.col("event_id").cast("long").alias("event_id"), "condition", F.col("extra").cast("double").alias("extra"))
    return ranked_by(typed, "__condition_order", "event_id", name="place").drop("__condition_order")


@query("SELECT doc_id::VARCHAR AS fact_id, text FROM documents")
def catalog_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of one of two catalogs that share a folder."""
    own = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("fact_id"), "text")
    path = folder(spark, "catalog")
    files.write_catalog(own, path, "mine")
    files.write_catalog(own.limit(3), path, "other")
    return files.read_catalog(spark, path, "mine").select("fact_id", "text")


@query("SELECT r_name AS run_id FROM region WHERE r_regionkey % 2 = 0 ORDER BY 1")
def discovered_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a stamp that hold a marker file."""
    base = folder(spark, "runs")
    for r in read(spark, d, "region").collect():  # one row a region
        stamp = "20240101T000000Z" if r.r_regionkey % 2 == 0 else "20250101T000000Z"
        sinks.write_document(spark, f"{base}/{stamp}/{r.r_name}/summary.json", {"run": r.r_name})
        sinks.write_document(spark, f"{base}/20240101T000000Z/{r.r_name}-unfinished/config.json", {})
    return files.run_ids(spark, base, "20240101T000000Z", marker="summary.json")


@query("SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'kept' ELSE 'not an object' END AS place FROM documents")
def quarantined_responses(spark: SparkSession, d: str) -> DataFrame:
    """Invalid responses go to a table of their own, with what is wrong with them."""
    from ..operators import guards

    own = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, '{"memory": []}').otherwise("[]").alias("response"))
    good, bad = runs.quarantine(own, guards.extraction_problem())
    files.write_json_lines(bad, path := folder(spark, "quarantine"))
    found = files.read_json_lines(spark, path, "doc_id long, response string, problem string")
    return good.select("doc_id", F.lit("kept").alias("place")).union(found.select("doc_id", "problem"))


@query("SELECT 1024 * event_id AS bytes FROM events WHERE event_type <> 'view'")
def available_memory(spark: SparkSession, d: str) -> DataFrame:
    """Of reports' lines those that tell available memory; the amounts are the events' ids."""
    kind = F.when(F.col("event_type") == "view", "MemTotal:  ").otherwise("MemAvailable:     ")
    return files.available_memory(read(spark, d, "events").select(F.concat(kind, "event_id", F.lit(" kB")).alias("value")))
