"""JSON-lines, CSV and throughput files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects, one a line; blank lines are skipped and any other row raises."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_run_csv(spark: SparkSession, path: str, columns: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """A report with a header: numeric columns as numbers, empty cells as null; a missing file is an empty table."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        df = spark.createDataFrame([], schema)
    else:
        df = spark.read.schema(schema).csv(path, header=True, nullValue="", escape='"', enforceSchema=False, multiLine=True)
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in numeric else F.col(c) for c in columns])


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables whose columns grew over time."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def csv_cells(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """The columns as CSV cells: nested values as compact JSON, the rest as they are."""
    kinds = dict(df.dtypes)
    return [F.to_json(c).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c) for c in columns]


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """A header and fixed columns; null is an empty cell and quotes are doubled."""
    df.select(*csv_cells(df, columns)).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", escape='"')


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write a folder beside its place, then swap by renames: the old one is kept aside until the new one stands, and a job
    that fails leaves it untouched."""
    jvm = spark.sparkContext._jvm
    at, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):  # a swap was cut off
        fs.delete(old, True) if fs.exists(at) else fs.rename(old, at)
    fs.delete(new, True)
    write(f"{path}.new")
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"could not write {path}")
    fs.delete(old, True)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Replace the rows at a path; a failed job leaves the old ones."""
    replace_folder(df.sparkSession, path, lambda p: df.write.json(p))


def write_catalog(facts: DataFrame, path: str, identity: str) -> None:
    """A fact catalog below a folder for its identity, which is swapped in whole: other identities stay as they are."""
    named = facts.sparkSession.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(identity)
    replace_folder(facts.sparkSession, f"{path}/identity={named}", lambda p: facts.write.parquet(p))


def read_catalog(spark: SparkSession, path: str, identity: str) -> DataFrame:
    """Facts of an identity (partition pruning); repeated ids raise."""
    from ..operators.guards import require_unique

    return require_unique(spark.read.parquet(path).where(F.col("identity") == identity), "fact_id")


def run_ids(spark: SparkSession, path: str, stamp: str, pattern: str = r"([^/]+)/[^/]+$", marker: str | None = None) -> DataFrame:
    """Distinct run ids of files whose path holds a stamp; with ``marker`` only runs that hold a file of that name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    own = files.where(F.col("path").contains(stamp))
    if marker is not None:
        own = own.where(F.col("path").endswith(f"/{marker}"))
    return own.select(F.regexp_extract("path", pattern, 1).alias("run_id")).where("run_id <> ''").distinct().orderBy("run_id")


def read_condition_files(spark: SparkSession, path: str, conditions: Sequence[str], name: str = "throughput_{}.csv") -> DataFrame:
    """Rows of each condition's report below a folder as text, with the condition's place in ``__condition_order``; missing
    reports are skipped and columns that older ones lack are null."""
    jvm = spark.sparkContext._jvm
    found = []
    for i, c in enumerate(conditions):
        at = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name.format(c)}")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            rows = spark.read.csv(at.toString(), header=True, nullValue="", escape='"', inferSchema=False, multiLine=True)
            found.append(rows.withColumn("__condition_order", F.lit(i)))
    if not found:
        return spark.createDataFrame([], "condition string, __condition_order int")
    return union_by_name(found)


def available_memory(lines: DataFrame) -> DataFrame:
    """Bytes of available memory from lines of a memory report."""
    kb = F.regexp_extract("value", r"^MemAvailable:\s*(\d+)\s*kB", 1)
    return lines.where(F.col("value").startswith("MemAvailable:")).select((kb.cast("long") * 1024).alias("bytes"))
