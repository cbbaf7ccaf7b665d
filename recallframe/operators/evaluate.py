"""Accuracy and latency reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import number, per_second, safe_ratio, wilson
from ..functions.text import category_name
from .retrieval import order_statistics, ranked_by


def numeric_summary(df: DataFrame, *metrics: str, by: Sequence[str] = ()) -> DataFrame:
    """count, avg, min, p50, p95 and max of each metric over its non-null values, one row per metric (and group)."""
    long = df.unpivot([F.col(b) for b in by], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value") if by else df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*")
    quantiles = order_statistics(long, [*by, "metric"], "value", (0.5, 0.95)).groupBy(*by, "metric").agg(
        F.max(F.when(F.col("fraction") == 0.5, F.col("quantile"))).alias("p50"), F.max(F.when(F.col("fraction") == 0.95, F.col("quantile"))).alias("p95"))
    out = long.groupBy(*by, "metric").agg(F.count("value").alias("count"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))
    mine, theirs = out.alias("a"), quantiles.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "metric")])
    return mine.join(theirs, same, "left").select(*[F.col(f"a.{c}") for c in (*by, "metric", "count", "avg", "min")], "p50", "p95", F.col("a.max"))


def run_summary(records: DataFrame, query_ms: str = "query_ms") -> DataFrame:
    """Questions, judged, correct, accuracy and query rate of a run."""
    s = records.agg(
        F.count(F.lit(1)).alias("question_count"), F.count("correct").alias("judged_count"), F.count_if(F.col("correct")).alias("correct_count"),
        F.count(query_ms).alias("query_count"), F.coalesce(F.sum(query_ms), F.lit(0.0)).alias("query_total_ms"),
    )
    return s.withColumns({"accuracy": safe_ratio("correct_count", "judged_count"), "queries_per_sec": per_second("query_count", "query_total_ms")})


def accuracy_by_category(records: DataFrame, category: str = "category") -> DataFrame:
    """Judged records by category: name, total, correct and accuracy."""
    own = records.where("correct is not null").groupBy(F.coalesce(F.col(category), F.lit("")).alias("category"))
    out = own.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("correct")).alias("correct"))
    return out.select("category", category_name("category").alias("name"), "total", "correct", safe_ratio("correct", "total").alias("accuracy"))


def accuracy_bins(rows: DataFrame, axis: str = "tokens", correct: str = "correct", tie: str = "id", most: int = 10) -> DataFrame:
    """Bins of equal counts along an axis, with accuracy and its interval.

    Rows are numbered by a range partitioning, not by one global window.
    """
    own = rows.where(F.col(axis).isNotNull() & F.col(correct).isNotNull()).select(F.col(axis).cast("double").alias("x"), F.col(correct).cast("int").alias("y"), F.col(tie).alias("tie"))
    total = own.agg(F.count(F.lit(1)).alias("n"))
    bins = F.least(F.lit(most), F.greatest(F.lit(1), F.rint(F.sqrt("n")).cast("int")))
    chunk = total.withColumn("chunk", F.ceil(F.col("n") / bins)).select("chunk")
    placed = ranked_by(own, "x", "tie", name="rn").crossJoin(F.broadcast(chunk))  # one row
    out = placed.groupBy(F.floor((F.col("rn") - 1) / F.col("chunk")).alias("bin")).agg(F.min("x").alias("token_bin_start"), F.max("x").alias("token_bin_end"), F.count(F.lit(1)).alias("judged_count"), F.sum("y").alias("correct_count"))
    ci = wilson("correct_count", "judged_count")
    return out.select(
        "bin", "token_bin_start", "token_bin_end", ((F.col("token_bin_start") + F.col("token_bin_end")) / 2).alias("token_bin_midpoint"), "judged_count", "correct_count",
        (F.col("correct_count") / F.col("judged_count")).alias("accuracy"), ci["lower"].alias("ci_lower"), ci["upper"].alias("ci_upper"),
    )


def plottable(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rows with both values."""
    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)


def missing_axis(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Number of rows that have the value but not the axis."""
    return rows.agg(F.count_if(F.col(x).isNull() & F.col(y).isNotNull()).alias("missing_x_count"))


#: Numeric metrics of a query record, in report order (report name: path in the metrics).
QUERY_METRICS = (
    "memory_context_turn_count", "memory_context_encoding_tokens_total", "memory_context_encoding_tokens_max", "memory_context_encoding_truncated_tokens",
    "memory_context_text_tokens", "memory_token_budget", "kv_block_size", "kv_loaded_memory_tokens", "kv_recomputed_memory_tail_tokens", "kv_fact_tokens_end",
    "kv_verify_time_ms", "time_to_first_token_ms", "query_to_first_token_ms", "query_to_answer_ms",
)
QUERY_LISTS = ("memory_retrieved_fact_ids", "memory_retrieved_fact_text_hashes", "memory_injected_fact_ids", "memory_context_turn_ids")


def query_metric_rows(records: DataFrame) -> DataFrame:
    """Nested records (run_id, mode, sample_id, question_id, category, metrics variant, judge variant, retrieved
    array) as one flat row each; a total needs both its parts."""
    def metric(name: str) -> Column:
        return number(F.try_variant_get("metrics", f"$.{name}", "string"))

    def listed(name: str) -> Column:
        v = F.try_variant_get("metrics", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get("metrics", f"$.{name}", "array<string>"))

    judged = F.try_variant_get("judge", "$.correct", "variant")
    correct = F.when(F.schema_of_variant(judged) == "BOOLEAN", F.try_variant_get("judge", "$.correct", "boolean").cast("int"))
    memory, query = metric("kv_memory_tokens"), metric("kv_query_tokens")
    return records.select(
        "run_id", "mode", "sample_id", "question_id", "category", F.try_variant_get("metrics", "$.resolved_vector_backend", "string").alias("resolved_vector_backend"), metric("effective_beam_width").alias("effective_beam_width"),
        memory.alias("memory_tokens"), query.alias("query_tokens"), (memory + query).alias("total_prompt_tokens"), F.coalesce(metric("memory_context_window"), metric("kv_context_window")).alias("memory_context_window"),
        *[listed(n).alias(n) for n in QUERY_LISTS], *[metric(n).alias(n) for n in QUERY_METRICS], correct.alias("judge_correct"), F.when(F.col("retrieved").isNotNull(), F.size("retrieved")).alias("retrieved_count"),
    )


def evaluation_records(questions: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with their answer and their hits as an ordered array of structs."""
    cols = [c for c in hits.columns if c != "question_id"]
    ranked = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in cols if c != "rank"]))).alias("retrieved_memories"))
    return questions.join(answers, "question_id", "left").join(ranked, "question_id", "left")


def fill_judgements(records: DataFrame, fresh: DataFrame, rejudge: bool = False) -> DataFrame:
    """Records with judgements filled in: missing ones only, or all that ``fresh`` has."""
    new = fresh.select("question_id", F.col("correct").alias("__new"))
    order = ["__new", "correct"] if rejudge else ["correct", "__new"]
    return records.join(new, "question_id", "left").withColumn("correct", F.coalesce(*order)).drop("__new")
