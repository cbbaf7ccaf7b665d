"""Throughput reports over measured rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import overlap_ratio
from .retrieval import order_statistics, ranked_by

# The report's columns by their type.
INT_COLUMNS = ("num_users", "requests_per_user", "total_requests", "kv_prefix_caching", "kv_h2d_bytes", "kv_requests_loaded", "total_input_tokens", "total_output_tokens")
FLOAT_COLUMNS = (
    "fact_count", "throughput_qps", "avg_latency_ms", "generation_time_s", "retrieval_time_s", "vector_search_time_s", "prompt_build_time_s", "kv_compose_time_s", "kv_verify_time_s",
    "memory_setup_time_s", "kv_precompute_time_s", "engine_startup_time_s", "kv_store_gpu_mb", "kv_store_host_mb", "kv_store_write_time_s", "kv_h2d_avg_ms", "kv_h2d_p95_ms",
    "kv_h2d_overlap_ratio", "kv_staging_stall_ms", "input_tokens_per_second", "output_tokens_per_second",
)
DEFAULT_STORE = "gpu"


def coerce_rows(rows: DataFrame) -> DataFrame:
    """Text rows as typed rows: counts default to 0, numbers to null, the store to its default; columns that older
    files lack are added."""
    def have(name: str) -> Column:
        return F.nullif(F.trim(F.col(name).cast("string")), F.lit("")) if name in rows.columns else F.lit(None).cast("string")

    out = {c: F.coalesce(have(c).try_cast("double").cast("long"), F.lit(0).cast("long")) for c in INT_COLUMNS}
    out |= {c: have(c).try_cast("double") for c in FLOAT_COLUMNS}
    out |= {"vector_backend": have("vector_backend"), "effective_beam_width": have("effective_beam_width").try_cast("double").cast("int"), "kv_store_backend": F.coalesce(have("kv_store_backend"), F.lit(DEFAULT_STORE))}
    return rows.withColumns(out)


def merge_rows(existing: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("condition", "num_users")) -> DataFrame:
    """Rows by key; a fresh row replaces an existing one."""
    both = existing.withColumn("__seq", F.lit(0)).unionByName(fresh.withColumn("__seq", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c != "__seq" and c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), "__seq").alias("r"))
    return best.select(*keys, "r.*")


def in_condition_order(rows: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Rows by users and the conditions' order, with their place from 1 (unknown conditions last)."""
    order = F.array_position(F.array(*[F.lit(c) for c in conditions]), F.col("condition"))
    keyed = rows.withColumn("__order", F.when(order > 0, order).otherwise(len(conditions) + 1))
    return ranked_by(keyed, "num_users", "__order", "condition", name="place").drop("__order").orderBy("place")


def condition_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("condition").agg(F.count(F.lit(1)).alias("row_count"), F.avg("throughput_qps").alias("average_qps"), F.min("throughput_qps").alias("minimum_qps"), F.max("throughput_qps").alias("maximum_qps"))


def pivot_throughput(rows: DataFrame, conditions: Sequence[str], numerator: str, denominator: str) -> DataFrame:
    """Users by condition with the ratio of two of them, and facts per user from the first condition that has any."""
    order = F.array_position(F.array(*[F.lit(c) for c in conditions]), F.col("condition"))
    wide = rows.groupBy("num_users").pivot("condition", list(conditions)).agg(F.max("throughput_qps"))
    facts = rows.groupBy("num_users").agg(F.min_by("fact_count", F.when(F.coalesce("fact_count", F.lit(0.0)) > 0, order)).alias("facts_per_user"))
    ratio = F.when(F.col(denominator) > 0, F.col(numerator) / F.col(denominator))
    return wide.join(facts, "num_users").withColumn("ratio", ratio)


def setup_time(setup: str = "memory_setup_time_s", precompute: str = "kv_precompute_time_s") -> Column:
    return F.coalesce(F.col(setup), F.lit(0.0)) + F.coalesce(F.col(precompute), F.lit(0.0))


def transfer_summary(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals, latency percentiles, overlap and bandwidth of transfers; 0 where there are none."""
    timed = F.col("h2d_latency_ms") > 0
    avg = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    sums = records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_transfers"), F.coalesce(F.sum("num_bytes"), F.lit(0)).alias("total_bytes_transferred"), avg("h2d_latency_ms").alias("avg_h2d_latency_ms"),
        avg(F.when(timed, overlap_ratio("h2d_latency_ms", "staging_stall_ms"))).alias("avg_overlap_ratio"), avg(F.when(timed, F.col("num_bytes") / 1e9 / (F.col("h2d_latency_ms") / 1e3))).alias("avg_effective_bandwidth_gb_per_s"),
        F.coalesce(F.sum("staging_stall_ms"), F.lit(0.0)).alias("total_staging_stall_ms"), avg("staging_stall_ms").alias("avg_staging_stall_ms"),
    )
    long = records.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("h2d_latency_ms", "staging_stall_ms")])).alias("x")).select(*by, "x.*")
    found = order_statistics(long, [*by, "metric"], "value", (0.5, 0.95, 0.99))
    pick = lambda c, f, name: F.max(F.when((F.col("metric") == c) & (F.col("fraction") == f), F.col("quantile"))).alias(name)
    names = {"p50_h2d_latency_ms": ("h2d_latency_ms", 0.5), "p95_h2d_latency_ms": ("h2d_latency_ms", 0.95), "p99_h2d_latency_ms": ("h2d_latency_ms", 0.99), "p95_staging_stall_ms": ("staging_stall_ms", 0.95)}
    wide = found.groupBy(*by).agg(*[pick(c, f, n) for n, (c, f) in names.items()]).alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by], F.lit(True))
    return sums.alias("a").join(wide, same, "left").select("a.*", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def nested_user_counts(requests: DataFrame, counts: Sequence[int], *sums: str) -> DataFrame:
    """For every count c the sums over requests of the first c users.

    Each request is summed once per user group between two counts; the groups then accumulate.
    """
    marks = sorted(set(counts))
    first = F.expr(f"array_min(filter(array({','.join(map(str, marks))}), c -> user_index < c))")
    parts = requests.withColumn("__c", first).where("__c is not null").groupBy("__c").agg(F.count(F.lit(1)).alias("requests"), *[F.sum(s).alias(s) for s in sums])
    spread = parts.withColumn("num_users", F.explode(F.expr(f"filter(array({','.join(map(str, marks))}), c -> c >= __c)")))
    return spread.groupBy("num_users").agg(F.sum("requests").alias("requests"), *[F.sum(s).alias(s) for s in sums])


def report_lines(pivot: DataFrame, conditions: Sequence[str]) -> list[str]:
    """Markdown table of a pivot (one row per user count)."""
    show = lambda x, end="": "-" if x is None else f"{x:.2f}{end}"
    lines = ["| Users | Facts/user | " + " | ".join(conditions) + " | Ratio |", "| ---: " * (len(conditions) + 3) + "|"]
    for r in pivot.orderBy("num_users").collect():
        facts = "-" if not r["facts_per_user"] else f"{r['facts_per_user']:.0f}"
        lines.append(f"| {r['num_users']} | {facts} | " + " | ".join(show(r[c]) for c in conditions) + f" | {show(r['ratio'], 'x')} |")
    return lines


def worker_specs(asked: DataFrame, per_count: Sequence[str]) -> DataFrame:
    """Workers for a table of (condition, num_users): one for each condition with all its counts, or for those named one for each
    count."""
    pairs = asked.select("condition", F.col("num_users").cast("int").alias("n")).where("condition is not null and n is not null").distinct()
    apart = F.col("condition").isin(*per_count) if per_count else F.lit(False)
    return pairs.groupBy("condition", F.when(apart, F.col("n")).alias("alone")).agg(F.array_sort(F.collect_list("n")).alias("user_counts")).select("condition", "user_counts")


def sweep(grid: DataFrame, baseline: str) -> DataFrame:
    """Runs of a sweep for a table of (model, k, window): one for each distinct row, and a baseline for each model and k."""
    rows = grid.select("model", F.col("k").cast("int").alias("k"), F.col("window").cast("int").alias("window")).distinct()
    named = rows.withColumn("run_id", F.concat(F.col("model"), F.lit("-k"), F.col("k"), F.lit("-w"), F.col("window")))
    base = rows.select("model", "k").distinct().select("model", "k", F.lit(0).alias("window"), F.concat(F.col("model"), F.lit("-k"), F.col("k"), F.lit(f"-{baseline}")).alias("run_id"))
    return named.union(base)
