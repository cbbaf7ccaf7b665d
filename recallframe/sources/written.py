"""Tables that are written once into the shared folder and read again, so that lineage ends there; and folders of a process."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

_PATHS: list[tuple[SparkSession, str]] = []


def hadoop_path(spark: SparkSession, path: str):  # noqa: ANN201
    """A path of any file system and that file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder; what is written there goes when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/recallframe-{name}-{uuid.uuid4().hex}"
    _PATHS.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    at, fs = hadoop_path(spark, path)
    fs.delete(at, True)
    _PATHS[:] = [x for x in _PATHS if x[1] != path]


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        for spark, path in list(_PATHS):
            if any(path in f for f in table.inputFiles()):
                delete_folder(spark, path)


def _delete_all() -> None:
    while _PATHS:
        spark, path = _PATHS.pop()
        try:
            at, fs = hadoop_path(spark, path)
            fs.delete(at, True)
        except Exception:  # the session may be gone at exit
            return


atexit.register(_delete_all)
