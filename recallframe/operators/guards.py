"""Contracts that raise: each is a filter on a column that raises, so that the optimizer can't prune it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require(df: DataFrame, condition: Column, message: str | Column) -> DataFrame:
    """``df`` itself; a row that fails the condition (or leaves it null) raises when the row is read."""
    said = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(said).cast("boolean")))


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Raise where a key has more than one row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = df.withColumn("__n", n)
    return require(out, F.col("__n") == 1, F.concat(F.lit("duplicate key: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))).drop("__n")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one row, sorted."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(key)


def valid_hits(hits: DataFrame, expected: Column, group: str = "query_id") -> DataFrame:
    """Groups whose hits break the search contract: wrong count, repeated ids, rank gaps, or scores that are not
    finite or as large as a sentinel. Columns: the group and the problem."""
    per = hits.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.max(expected).alias("expected"),
        F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("ranks"),
        F.max(F.when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") >= 1e30), 1).otherwise(0)).alias("odd"),
    )
    problem = (
        F.when(F.col("n") != F.col("expected"), "count").when(F.col("ids") != F.col("n"), "duplicate ids")
        .when((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("ranks") != F.col("n")), "ranks").when(F.col("odd") == 1, "scores")
    )
    return per.select(group, problem.alias("problem")).where("problem is not null")


def extraction_problem(response: str = "response", limit: int = 5, longest: int = 600) -> Column:
    """What is wrong with a model's JSON list of facts (null: nothing): its keys, size, and each fact's fields, id, text,
    speaker and links, in the order in which they are looked at."""
    v = F.try_parse_json(F.col(response))
    keys = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.json_object_keys(F.to_json(v)))
    listed = F.schema_of_variant(F.try_variant_get(v, "$.memory", "variant"))
    facts = F.try_variant_get(v, "$.memory", "array<variant>")

    def fact_problem(f: Column) -> Column:
        kind = lambda name: F.schema_of_variant(F.try_variant_get(f, f"$.{name}", "variant"))
        text = F.try_variant_get(f, "$.text", "string")
        fields = F.json_object_keys(F.to_json(f))
        named = (F.size(F.array_intersect(fields, F.array(*[F.lit(x) for x in ("id", "text", "attributed_to")]))) == 3) & (F.size(F.array_except(fields, F.array(*[F.lit(x) for x in ("id", "text", "attributed_to", "linked_memory_ids")]))) == 0)
        blank = (kind("text") != "STRING") | (F.length(F.regexp_replace(text, r"^\s+|\s+$", "")) == 0)
        speaker = (kind("attributed_to") == "STRING") & F.try_variant_get(f, "$.attributed_to", "string").isin("user", "assistant")
        linked = F.coalesce(kind("linked_memory_ids"), F.lit("ARRAY<STRING>"))  # absent links are none
        return (
            F.when(~F.coalesce(F.schema_of_variant(f).startswith("OBJECT"), F.lit(False)), "not a fact").when(~named, "fields").when(kind("id") != "STRING", "id")
            .when(blank, "blank text").when(F.length(text) > longest, "long text").when(~F.coalesce(speaker, F.lit(False)), "attributed_to").when(~linked.isin("ARRAY<STRING>", "ARRAY<VOID>"), "links")
        )

    first = F.get(F.filter(F.transform(facts, fact_problem), lambda p: p.isNotNull()), F.lit(0))
    return (
        F.when(keys.isNull(), "not an object").when((F.size(keys) != 1) | (keys[0] != "memory"), "keys").when(~F.coalesce(listed.startswith("ARRAY"), F.lit(False)), "facts")
        .when(F.size(facts) > limit, "too many").otherwise(first)
    )


def renumbered_facts(response: str = "response") -> Column:
    """Facts of a valid response with ids by position."""
    facts = F.from_json(F.get_json_object(F.col(response), "$.memory"), "array<map<string,string>>")
    return F.transform(facts, lambda f, i: F.struct(i.cast("string").alias("id"), F.trim(f["text"]).alias("text")))
