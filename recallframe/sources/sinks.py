"""Driver-side documents: small JSON files written whole or not at all, and report bundles."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .files import write_csv


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_document(spark: SparkSession, path: str, data: Any, canonical: bool = False) -> None:
    """A JSON document in any Hadoop file system: written beside its place and renamed. Canonical form is compact with
    sorted keys; numbers that JSON lacks are refused."""
    text = json.dumps(data, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False) if canonical else json.dumps(data, indent=2, ensure_ascii=False) + "\n"
    at, fs = _fs(spark, path)
    part, _ = _fs(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(text.encode())
    out.close()
    old, _ = _fs(spark, f"{path}.old")
    fs.delete(old, False)
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"could not set {path} aside")
    if not fs.rename(part, at):
        fs.rename(old, at)
        raise OSError(f"could not write {path}")
    fs.delete(old, False)


def read_document(spark: SparkSession, path: str, default: dict[str, Any]) -> dict[str, Any]:
    """A JSON object, or the default where the file is missing or holds something else."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        old, _ = _fs(spark, f"{path}.old")  # a write was cut off between its renames
        if not fs.exists(old):
            return default
        path = f"{path}.old"
    rows = spark.read.text(path, wholetext=True).collect()  # one small document
    try:
        value = json.loads(rows[0].value) if rows else None
    except ValueError:
        return default
    return value if isinstance(value, dict) else default


def write_query_reports(rows: DataFrame, bins: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Flat metric rows and accuracy bins as CSV below a folder."""
    write_csv(rows, f"{path}/query_metrics", columns or rows.columns)
    write_csv(bins, f"{path}/accuracy_bins", bins.columns)


def write_throughput_reports(rows: DataFrame, path: str, summary: dict[str, Any], lines: Sequence[str]) -> None:
    """Rows by condition, all rows, the summary and the Markdown lines."""
    rows.write.mode("overwrite").partitionBy("condition").csv(f"{path}/by_condition", header=True)
    write_csv(rows, f"{path}/all", rows.columns)
    spark = rows.sparkSession
    write_document(spark, f"{path}/summary.json", summary)
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
