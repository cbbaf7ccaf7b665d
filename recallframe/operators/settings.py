"""Run settings and measurements: configurations without secrets, option rules, model arguments, batches and progress."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Mapping, Sequence
from time import perf_counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .guards import require

# What stands for a secret, the keys that hold one, how many of a question's entities count, the widest search,
# and what is asked after a memory.
REDACTED = "<redacted>"
SECRET_KEYS = ("judge_api_key", "embedding_api_key", "memory_llm_api_key")
ENTITIES = 8
WIDEST_BEAM = 959
ASK = "Based on the conversation above, answer concisely.\nQuestion: "


def shown_config(config: DataFrame, secrets: Sequence[str] = SECRET_KEYS) -> DataFrame:
    """A configuration (key, value) to be written: filled secrets are hidden, empty and missing ones stay as they are."""
    hidden = F.col("key").isin(*secrets) & (F.col("value") != "")
    return config.withColumn("value", F.when(hidden, REDACTED).otherwise(F.col("value")))


def restored_config(config: DataFrame, secrets: Mapping[str, str | None]) -> DataFrame:
    """A configuration that was read: hidden values are taken from ``secrets``, null where it lacks them."""
    known = F.coalesce(*[F.when(F.col("key") == k, F.lit(v)) for k, v in secrets.items()], F.lit(None).cast("string"))
    return config.withColumn("value", F.when(F.col("value") == REDACTED, known).otherwise(F.col("value")))


def option_problem(positive: Mapping[str, Column], not_negative: Mapping[str, Column], share: tuple[str, Column], beam: Column, top_k: Column, graph: Column, widest: int = WIDEST_BEAM) -> Column:
    """The first rule that options break, in the order given (null: none): numbers above zero, numbers from zero, a share
    strictly between zero and one, and a search width that a graph allows. A null breaks its rule."""
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    rules = [F.when(bad(c > 0), f"{n} must be greater than zero") for n, c in positive.items()]
    rules += [F.when(bad(c >= 0), f"{n} must be at least zero") for n, c in not_negative.items()]
    rules.append(F.when(bad((share[1] > 0) & (share[1] < 1)), f"{share[0]} must be between zero and one"))
    rules.append(F.when(F.coalesce(graph, F.lit(False)) & bad(F.greatest(beam, top_k) <= widest), f"beam width must be at most {widest}"))
    return F.coalesce(*rules)


def bounded_arguments(arguments: Column, response_format: str, max_tokens: int) -> Column:
    """Arguments of a model request (JSON object) whose response format is any JSON object get a bounded one (JSON) and a
    limit of tokens. A struct: the arguments as JSON and whether they changed; others stay letter by letter."""
    whole = F.try_parse_json(arguments)
    asked = F.coalesce(F.try_variant_get(whole, "$.response_format.type", "string") == "json_object", F.lit(False))
    rest = F.map_filter(F.try_variant_get(whole, "$", "map<string,variant>"), lambda k, _: ~k.isin("response_format", "max_tokens"))
    own = F.map_from_arrays(F.array(F.lit("response_format"), F.lit("max_tokens")), F.array(F.parse_json(F.lit(response_format)), F.parse_json(F.lit(str(max_tokens)))))
    return F.struct(F.when(asked, F.to_json(F.map_concat(rest, own))).otherwise(arguments).alias("arguments"), asked.alias("bounded"))


def entities_to_embed(entities: Column, normal: Callable[[Column], Column] = lambda t: F.lower(F.trim(t)), most: int = ENTITIES) -> Column:
    """Of a question's first entities (array of texts) those that a search looks up: the first of each normal form, none
    whose form is empty."""
    own = F.slice(entities, 1, most)
    keys = F.transform(own, lambda t: F.coalesce(normal(t), F.lit("")))
    return F.filter(own, lambda t, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1))


def batch_totals(prompts: DataFrame, outputs: DataFrame) -> DataFrame:
    """Tokens in and out of each batch: prompts (batch, ord), outputs (batch, ord, prompt_tokens, output_tokens: arrays;
    null: nothing came out). Another number of outputs than of prompts raises."""
    asked = prompts.groupBy("batch").agg(F.count(F.lit(1)).alias("__asked"))
    size = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0)).cast("long")
    got = outputs.groupBy("batch").agg(F.count(F.lit(1)).alias("__got"), size("prompt_tokens").alias("total_input_tokens"), size("output_tokens").alias("total_output_tokens"))
    met = asked.join(got, "batch", "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    said = F.concat(n("__got").cast("string"), F.lit(" outputs for "), n("__asked").cast("string"), F.lit(" prompts"))
    return require(met, n("__got") == n("__asked"), said).select("batch", "total_input_tokens", "total_output_tokens")


def timed(df: DataFrame) -> float:
    """Seconds that every row of a table takes."""
    started = perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return perf_counter() - started


def progress_due(index: Column, total: Column, interval: Column) -> Column:
    """Whether a step is reported: the first, the last, and each whole interval; never without steps or interval."""
    each = F.when(interval > 0, index % interval == 0)  # remainders by zero raise
    return F.coalesce((interval > 0) & (total > 0) & ((index == 1) | (index == total) | each), F.lit(False))


def question_message(question: Column) -> Column:
    """What a user asks after a memory, as chat messages."""
    return F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(ASK), question).alias("content")))


def metric_present(metrics: Column, key: str) -> Column:
    """Whether a variant object has a key, be its value null or not."""
    return F.try_variant_get(metrics, f"$.{key}", "variant").isNotNull()


def device_rows(lines: DataFrame) -> DataFrame:
    """Devices of a report (value: name, driver and memory between commas); shorter lines are none."""
    part = F.transform(F.split("value", ","), lambda t: F.trim(t))
    return lines.select(part.alias("p")).where(F.size("p") >= 3).select(F.col("p")[0].alias("name"), F.col("p")[1].alias("driver_version"), F.col("p")[2].alias("memory_total"))


def missing_requirements(spark: SparkSession, modules: Sequence[str], paths: Sequence[str]) -> list[str]:
    """Modules that can't be found and paths that don't exist, in this order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = {p: jvm.org.apache.hadoop.fs.Path(p) for p in paths}
    return [m for m in modules if importlib.util.find_spec(m) is None] + [p for p, a in at.items() if not a.getFileSystem(conf).exists(a)]
