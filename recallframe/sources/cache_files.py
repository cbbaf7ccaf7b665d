"""A cache of values by key in Parquet files, with Bloom filters for its keys, versions and digests of its entries.

An entry is (key, version, value, written, digest), the digest being that of the rest. A look-up of few keys pushes them into the
scan, where each file's Bloom filter tells which parts may hold one; others aren't read. An entry of another version isn't
found. An entry whose digest differs, or a file that can't be read, is a miss where the cache may be written, so that its value is
computed anew; where it is only read, it raises. Of entries with one key the last written counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.guards import require
from .written import folder, hadoop_path

ENTRY = "key string, version int, value string, written long, digest string"
#: Rows of a file, for which its Bloom filter is laid out, and keys that a look-up pushes into the scan.
FILE_ROWS, PUSHED_KEYS = 100_000, 100
_ABSENT = "\u0001"


def _digest():  # noqa: ANN202
    fields = [F.coalesce(F.col(c).cast("string"), F.lit(_ABSENT)) for c in ("key", "version", "value", "written")]
    return F.sha2(F.concat_ws("\u0000", *fields), 256)


def write_entries(entries: DataFrame, path: str, version: int) -> None:
    """Add entries (key, value); null keys raise."""
    own = require(entries.select("key", "value"), F.col("key").isNotNull(), "a cache entry without a key")
    own = own.select("key", F.lit(version).alias("version"), F.col("value").cast("string").alias("value"), F.lit(time.time_ns()).alias("written"))
    writer = own.withColumn("digest", _digest()).write.mode("append").option("maxRecordsPerFile", FILE_ROWS)
    writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(FILE_ROWS)).option("parquet.enable.dictionary#key", "false").parquet(path)


def read_entries(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    at, fs = hadoop_path(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("ignoreCorruptFiles", str(skip_unreadable).lower()).parquet(path)


def looked_up(keys: DataFrame, path: str, version: int, may_write: bool = False) -> DataFrame:
    """Entries (key, value) of this version for distinct keys (key): what is broken is left out if the cache may be written, else
    raises. Few keys are pushed into the scan; many are joined."""
    spark = keys.sparkSession
    asked = keys.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    listed = [r.key for r in asked.limit(PUSHED_KEYS + 1).collect()]
    rows = read_entries(spark, path, may_write)
    if len(listed) <= PUSHED_KEYS:
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(PUSHED_KEYS))
        rows = rows.where(F.col("key").isin(*listed) if listed else F.lit(False))
    else:
        rows = rows.join(asked, "key")
    rows = rows.where(F.col("version") == version)
    whole = F.col("digest").eqNullSafe(_digest())
    rows = rows.where(whole) if may_write else require(rows, whole, F.concat(F.lit("broken cache entry: "), "key"))
    return rows.groupBy("key").agg(F.max_by("value", "written").alias("value"))


def memoised_in_files(inputs: DataFrame, path: str, version: int, compute: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """``inputs`` (key, ...) with their value and whether it was a hit. ``compute`` maps the rows of missing keys, one for each, to (key,
    value), which are written; without it a missing key raises."""
    spark = inputs.sparkSession
    found = looked_up(inputs, path, version, compute is not None).withColumn("hit", F.lit(True))
    if compute is None:
        out = inputs.join(found, "key", "left")
        return require(out, F.col("hit"), F.concat(F.lit("not cached: "), F.coalesce("key", F.lit("null"))))
    held = folder(spark, "cache-hits")
    found.write.parquet(held)  # what was there before the new entries
    found = spark.read.schema(found.schema).parquet(held)
    missing = inputs.join(found.select("key"), "key", "left_anti").dropDuplicates(["key"])
    write_entries(compute(missing), path, version)
    fresh = looked_up(missing, path, version, True).withColumn("hit", F.lit(False))
    return inputs.join(found.union(fresh), "key", "left")
