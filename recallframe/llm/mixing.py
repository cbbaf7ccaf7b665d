"""Mixing sources to target weights by Poisson replication: each document's hash picks its count from the Poisson
distribution whose mean is its source's repetition rate; documents are exploded by their counts and shuffled.

A null source is a source of its own. Sources of weight 0 vanish. Rows that repeat get the same count. All columns
stay as they are, whatever their names: added columns take names that no column has, with underscores behind where
theirs is taken. Texts may be null, empty or of any length, as none is looked at. An empty table stays empty.
Everything runs in DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage_table

#: Share of a source without a given weight: its size to this power (1 keeps the mixture, 0 levels it).
TEMPERATURE = 0.5
SEED = 11
#: A mean above this is drawn as a sum of independent Poisson counts with smaller means.
PART_MEAN = 8.0
#: Terms of a part's distribution: beyond them lies less than 1e-30 of a Poisson distribution of mean 8.
TERMS = 60
#: Hash digits (hex) that make a uniform number: 52 bits, exact in a double.
DIGITS = 13
#: Sources up to this number are broadcast with their distributions (some 600 bytes each); more meet the documents in
#: SALTS parts each, so that no source is one task's alone.
BROADCAST_SOURCES = 10_000
SALTS = 64


def repetition_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, source_col: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """Each source's number of documents, target share and mean repetition rate; rates keep the corpus size.

    With ``weights`` these are the shares (scaled to 1; a source that isn't named gets 0).
    """
    sizes = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("mix_source")).agg(F.count(F.lit(1)).alias("mix_docs"))
    if weights is None:
        want = F.pow(F.col("mix_docs").cast("double"), F.lit(float(temperature)))
    else:
        want = F.lit(0.0)
        for name, w in sorted(weights.items()):
            want = F.when(F.col("mix_source") == name, F.lit(float(w))).otherwise(want)
    sizes = sizes.withColumn("want", want)
    total = sizes.agg(F.sum("want").alias("all_want"), F.sum("mix_docs").alias("all_docs"))
    rated = sizes.join(F.broadcast(total))  # one row
    share = F.when(F.col("all_want") > 0, F.col("want") / F.col("all_want")).otherwise(F.lit(0.0))
    rated = rated.withColumn("mix_share", share).withColumn("mix_rate", F.col("mix_share") * F.col("all_docs") / F.col("mix_docs"))
    return rated.select("mix_source", "mix_docs", "mix_share", "mix_rate")


def _with_distribution(rates: DataFrame) -> DataFrame:
    """Cumulative Poisson probabilities of each source's part mean."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / PART_MEAN)).cast("int")
    rates = rates.withColumn("mix_parts", parts).withColumn("mix_mean", F.col("mix_rate") / F.col("mix_parts"))
    rates = rates.select("*", F.posexplode(F.sequence(F.lit(0), F.lit(TERMS))).alias("k", "_k")).drop("_k")
    # log p_k = k log m - m - log k!, summed in order of k
    log_p = F.expr("case when mix_mean > 0 then k * ln(mix_mean) - mix_mean - aggregate(sequence(0, k), cast(0 as double), (a, i) -> a + ln(greatest(i, 1))) when k = 0 then 0d else -1e9 end")
    terms = rates.withColumn("p", F.exp(log_p)).groupBy("mix_source", "mix_docs", "mix_share", "mix_rate", "mix_parts").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("terms"))
    running = F.expr(f"transform(sequence(1, {TERMS}), n -> aggregate(slice(terms, 1, n), cast(0 as double), (a, t) -> a + t.p))")
    return terms.withColumn("mix_cdf", running).drop("terms")


def added_names(docs: DataFrame) -> tuple[str, str, str]:
    """Names of the columns that ``replicate`` adds: rate, copies drawn, and the copy's number."""
    return fresh(docs.columns, "mix_rate"), fresh(docs.columns, "mix_count"), fresh(docs.columns, "mix_copy")


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """``docs`` with mix_rate, mix_count (copies drawn) and mix_copy (from 0), one row per copy, not yet shuffled."""
    rates = stage_table(_with_distribution(repetition_rates(docs, weights, source_col, temperature)), "rates")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rate, count, copy = added_names(docs)
    key, id_text, salt, source, parts, cdf = (fresh(docs.columns, n) for n in ("mix_key", "mix_id", "mix_salt", "mix_source", "mix_parts", "mix_cdf"))
    rates = rates.select(F.col("mix_source").alias(source), F.col("mix_rate").alias(rate), F.col("mix_parts").alias(parts), F.col("mix_cdf").alias(cdf))
    keyed = docs.select(*own, F.col(f"`{source_col}`").cast("string").alias(key), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias(id_text))
    same = F.col(key).eqNullSafe(F.col(source))
    if rates.count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(rates), same)
    else:
        dealt = rates.withColumn(f"{salt}2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn(salt, F.pmod(F.xxhash64(id_text), F.lit(SALTS)).cast("int"))
        joined = keyed.join(dealt, same & (F.col(salt) == F.col(f"{salt}2")))
    uniform = f"conv(substr(md5(concat('{int(seed)}', ':', {id_text}, ':', cast(j as string))), 1, {DIGITS}), 16, 10) / {float(16**DIGITS)!r}D"
    drawn = f"aggregate(transform(sequence(1, {parts}), j -> named_struct('v', cast({uniform} as double))), 0, (a, u) -> a + size(filter({cdf}, c -> c <= u.v)))"
    joined = joined.select(*own, rate, F.when(F.col(rate) > 0, F.expr(drawn)).otherwise(F.lit(0)).alias(count)).where(F.col(count) > 0)
    return joined.select(*own, rate, count, F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(copy))


def shuffled(df: DataFrame, id_col: str = "doc_id", copy_col: str = "mix_copy", seed: int = SEED) -> DataFrame:
    """Rows in a global random order fixed by a hash of id and copy: dealt over all partitions by it and sorted by
    it within each, so that copies of a document or a source don't stay together."""
    key = fresh(df.columns, "shuffle_key")
    keyed = df.withColumn(key, F.xxhash64(F.lit(int(seed)), F.col(f"`{id_col}`").cast("string"), F.col(f"`{copy_col}`")))
    return keyed.repartition(key).sortWithinPartitions(key).drop(key)


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """The mixed corpus with the columns of ``docs`` alone, in global random order."""
    return shuffled(replicate(docs, weights, seed=seed), copy_col=added_names(docs)[2], seed=seed).select(*[F.col(f"`{c}`") for c in docs.columns])
