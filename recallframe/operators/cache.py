"""Memoised model calls as cache tables: a left join finds hits, distinct misses are computed once and joined back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .guards import require


def lookup(inputs: DataFrame, cache: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Inputs with their cached value (or null) and whether they hit."""
    own = cache.select(key, F.col(value), F.lit(True).alias("__hit"))
    return inputs.join(own, key, "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def misses(inputs: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """One input for every key that the cache lacks."""
    return inputs.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def memoised(inputs: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame] | None, key: str = "key", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Inputs with values, and the grown cache. ``compute`` maps (key, ...) to (key, value), once for each missing key;
    without it (read mode) a missing key raises."""
    if compute is None:
        found = lookup(inputs, cache, key, value)
        return require(found, F.col("hit"), F.concat(F.lit("not cached: "), F.col(key))).drop("hit"), cache
    grown = cache.select(key, value).unionByName(compute(misses(inputs, cache, key)).select(key, value))
    return inputs.join(grown, key, "left"), grown


def cache_stats(inputs: DataFrame, cache: DataFrame, order: str, key: str = "key") -> DataFrame:
    """Hits and misses of a batch: every input whose key is missing counts as a miss."""
    found = lookup(inputs.select(key, order), cache.withColumn("value", F.lit(None).cast("string")) if "value" not in cache.columns else cache, key)
    return found.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.countDistinct(F.when(~F.col("hit"), F.col(key))).alias("computed"))


def missing_catalogs(samples: DataFrame, catalogs: DataFrame, key: str = "fingerprint") -> DataFrame:
    return samples.join(catalogs.select(key), key, "left_anti")


def first_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """First row of each key in an order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
