"""Result rows, set-up rows, configurations, fingerprints, cached responses and prompts: what runs record and check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key, canonical_json, endpoint, endpoint_key, json_string, mask_prompt_date, path_part
from .evaluate import numeric_summary
from .guards import require, require_unique

# Conditions in canonical order with the backend that each retrieves with, slots that a store keeps beyond
# a full fetch, and what configurations without a key meant by it.
CONDITION_BACKENDS = {"exact": "local", "graph": "graph", "injection": "graph"}
STAGING_HEADROOM = 4
LEGACY_CONFIG = {"kv_enable_prefix_caching": "false", "kv_store_backend": "gpu", "context_window": "0"}
#: Configuration keys that two runs of one folder may differ in.
FREE_CONFIG = ("conditions", "embedding_api_key")
#: What makes a fact catalog the one that is asked for, in the order of its path; the last two name the file.
CATALOG_PATH = (
    "library_version", "provider", "model", "protocol", "max_model_len", "max_tokens", "max_facts", "max_text_chars", "endpoint", "embedding_model", "embedding_endpoint",
)
CATALOG_IDENTITY = ("version", *CATALOG_PATH, "temperature", "vector_distance", "ingestion_protocol", "sample_id", "sample_fingerprint")


def strict_number(x: Column) -> Column:
    """A number from a variant: booleans count as 1 and 0, numeric texts as their number; null stays null, other values
    raise."""
    kind = F.schema_of_variant(x)
    text = F.try_variant_get(x, "$", "string")
    value = F.when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("double")).otherwise(F.trim(text).try_cast("double"))
    bad = text.isNotNull() & value.isNull()
    odd = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    return F.when(bad | odd, F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(text, kind))).cast("double")).otherwise(value)


def metric_blocks(records: DataFrame, core: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Summaries of a run's metrics, a row each: core ones even without an observation (count 0), optional ones only with."""
    found = numeric_summary(records, *core, *optional)
    asked = records.sparkSession.createDataFrame([(m, m in core) for m in [*core, *optional]], "metric string, core boolean")
    out = asked.join(found, "metric", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    return out.where("core or count > 0").drop("core")


def row_problem(row: Mapping[str, Any] | Sequence[str], required: Sequence[str], condition: Column, conditions: Sequence[str]) -> Column:
    """What is wrong with a result row (null: nothing): columns that are missing, or an unknown condition."""
    missing = [c for c in required if c not in row]
    if missing:
        return F.lit("missing columns: " + ", ".join(missing))
    known = F.coalesce(condition.isin(*conditions), F.lit(False))
    return F.when(~known, F.concat(F.lit("unknown condition: "), F.coalesce(condition.cast("string"), F.lit("null"))))


def validated_rows(rows: DataFrame, required: Sequence[str], conditions: Sequence[str] | DataFrame) -> DataFrame:
    """Result rows with the required columns alone; a missing column or an unknown condition raises. Conditions are listed, or
    the first column of a table of any size."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    if isinstance(conditions, DataFrame):
        known = conditions.select(F.col(conditions.columns[0]).alias("__known")).distinct()
        both = rows.join(known, F.col("condition") == F.col("__known"), "left")
        return require(both, F.col("__known").isNotNull(), F.concat(F.lit("unknown condition: "), F.coalesce(F.col("condition").cast("string"), F.lit("null")))).select(*required)
    problem = row_problem(rows.columns, required, F.col("condition"), conditions)
    return require(rows, problem.isNull(), F.coalesce(problem, F.lit(""))).select(*required)


def condition_backend(condition: Column, backends: Mapping[str, str] = CONDITION_BACKENDS) -> Column:
    """Vector backend of a condition; unknown ones raise."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in backends.items() for x in kv]), condition)
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown condition: "), F.coalesce(condition, F.lit("null")))).cast("string")).otherwise(found)


def staging_slots(asked: Column, top_k: Column) -> Column:
    """Slots of a staging pool: a full fetch and some headroom at least."""
    return F.greatest(asked.cast("int"), top_k.cast("int") + STAGING_HEADROOM)


def request_questions(requests: DataFrame) -> DataFrame:
    """Requests as questions without answer and category."""
    return requests.select("sample_id", "question_id", F.col("query").alias("question"), F.lit("").alias("answer"), F.lit("").alias("category"))


def setup_rows(samples: DataFrame, template: Mapping[str, str]) -> DataFrame:
    """Set-up rows in the template's columns and types: what ``samples`` has, null elsewhere."""
    return samples.select(*[(F.col(c) if c in samples.columns else F.lit(None)).cast(kind).alias(c) for c, kind in template.items()])


def counter_totals(results: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Sums of workers' counters; a counter that a worker lacks counts 0."""
    return results.agg(F.count(F.lit(1)).alias("samples"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters])


def config_problems(saved: DataFrame, wanted: DataFrame, legacy: Mapping[str, str] = LEGACY_CONFIG, free: Sequence[str] = FREE_CONFIG) -> DataFrame:
    """Keys (run_id, key, recorded, expected) in which a saved configuration (run_id, key, value) differs from the wanted
    one (key, value). A key that the saved one lacks has its legacy value where there is one."""
    asked = saved.select("run_id").distinct().crossJoin(wanted.where(~F.col("key").isin(*free)).select("key", F.col("value").alias("expected")))
    own = saved.select("run_id", "key", F.col("value").alias("recorded"), F.lit(True).alias("__known"))
    old = F.try_element_at(F.create_map(*[F.lit(x) for kv in legacy.items() for x in kv]), F.col("key"))
    met = asked.join(own, ["run_id", "key"], "left").withColumn("recorded", F.when(F.col("__known"), F.col("recorded")).otherwise(old)).drop("__known")
    return met.where(~F.col("recorded").eqNullSafe(F.col("expected")))


# --- fingerprints and keys ------------------------------------------------------------------------------------


def _json_number(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("null"))


def sample_fingerprints(samples: DataFrame, turns: DataFrame) -> DataFrame:
    """sample_id and the first 20 digits of the digest of its canonical JSON: speakers and turns in order. A sample is a
    conversation, whose turns two people said."""
    one = canonical_json(id=json_string("id"), session_index=_json_number(F.col("session_index")), turn_index=_json_number(F.col("turn_index")), speaker=json_string("speaker"), text=json_string("text"), timestamp=json_string("timestamp"), image_caption=json_string("image_caption"))
    rows = turns.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("ord", one.alias("json")))).alias("t"))
    own = samples.join(rows, "sample_id", "left")
    listed = F.concat(F.lit("["), F.coalesce(F.array_join("t.json", ","), F.lit("")), F.lit("]"))
    whole = canonical_json(sample_id=json_string("sample_id"), speaker_a=json_string("speaker_a"), speaker_b=json_string("speaker_b"), turns=listed)
    return own.select("sample_id", F.substring(F.sha2(whole, 256), 1, 20).alias("fingerprint"))


def facts_fingerprints(facts: DataFrame, by: str = "sample_id", order: str = "ord") -> DataFrame:
    """Digest of a sample's facts (fact_id, text, source_turn_id) in order."""
    part = F.concat(F.col("fact_id"), F.lit("\u0000"), F.sha2("text", 256), F.lit("\u0000"), F.col("source_turn_id"), F.lit("\u0000"))
    rows = facts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, part.alias("p")))).alias("r"))
    return rows.select(by, F.sha2(F.array_join("r.p", ""), 256).alias("fingerprint"))


def request_key(provider: Column, model: Column, base: Column, version: Column, messages: Column, kwargs: Column, temperature: float = 0.0) -> Column:
    """Digest of a model request (messages: array of role and content; kwargs: canonical JSON text). The date in a prompt
    doesn't count, nor does a temperature of 0."""
    said = F.transform(messages, lambda m: canonical_json(role=json_string(m["role"]), content=json_string(mask_prompt_date(m["content"]))))
    parts = {"provider": json_string(provider), "model": json_string(model), "endpoint": json_string(endpoint(base)), "version": json_string(version), "messages": F.concat(F.lit("["), F.array_join(said, ","), F.lit("]")), "args": F.lit("[]"), "kwargs": kwargs}
    if temperature:
        parts["temperature"] = F.lit(repr(float(temperature)))
    return F.sha2(canonical_json(**parts), 256)


def catalog_path(identity: Mapping[str, Column]) -> Column:
    """Folder and name of a fact catalog: a part for each key of CATALOG_PATH, then sample and fingerprint."""
    shown = {"library_version": "library-", "max_model_len": "context-", "max_tokens": "tokens-", "max_facts": "facts-", "max_text_chars": "text-"}
    parts = []
    for key in CATALOG_PATH:
        value = identity[key].cast("string")
        parts.append(endpoint_key(value) if key.endswith("endpoint") else F.concat(F.lit(shown.get(key, "")), path_part(value)))
    return F.concat_ws("/", F.lit("fact-catalogs"), *parts, F.concat(path_part(identity["sample_id"].cast("string")), F.lit("-"), identity["sample_fingerprint"], F.lit(".json")))


def catalog_problem(found: Column, expected: Mapping[str, Any]) -> Column:
    """The first key in which a catalog's identity (map of texts) differs from what is expected; null where none does."""
    tests = [F.when(~F.try_element_at(found, F.lit(k)).eqNullSafe(F.lit(None if expected.get(k) is None else str(expected[k]))), k) for k in CATALOG_IDENTITY]
    return F.coalesce(*tests)


def load_facts(catalog: DataFrame, expected: Mapping[str, Any]) -> DataFrame:
    """Facts of a catalog (identity map, facts array of structs): another identity, a missing list, a fact without id or
    text and repeated ids raise. No catalog is an error of the caller's."""
    problem = catalog_problem(F.col("identity"), expected)
    own = require(catalog, problem.isNull(), F.concat(F.lit("identity mismatch: "), F.coalesce(problem, F.lit(""))))
    kind = catalog.schema["facts"].dataType.simpleString()
    listed = F.when(F.col("facts").isNull(), F.raise_error(F.lit("no facts list")).cast(kind)).otherwise(F.col("facts"))  # a filter would come after explode's own
    facts = own.select(F.posexplode(listed).alias("ord", "fact"))
    facts = require(facts, F.col("fact").isNotNull() & F.col("fact.fact_id").isNotNull() & F.col("fact.text").isNotNull(), "invalid fact")
    return require_unique(facts.select("ord", "fact.*"), "fact_id")


# --- cached responses -----------------------------------------------------------------------------------------

# Temperatures of the attempts after the first, whose own is the request's, and their top_p.
RETRY_TEMPERATURES, RETRY_TOP_P = (0.2, 0.5), 1.0


def attempts(requests: DataFrame, temperature: float = 0.0) -> DataFrame:
    """Every attempt that a request (key) may take: the first as asked, later ones warmer; the key stays the same."""
    plan = [F.struct(F.lit(1).alias("attempt"), F.lit(float(temperature)).alias("temperature"), F.lit(None).cast("double").alias("top_p"))]
    plan += [F.struct(F.lit(i).alias("attempt"), F.lit(t).alias("temperature"), F.lit(RETRY_TOP_P).alias("top_p")) for i, t in enumerate(RETRY_TEMPERATURES, start=2)]
    return requests.withColumn("__a", F.explode(F.array(*plan))).select(*requests.columns, "__a.*")


def settled_responses(responses: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(key, attempt, response) of several attempts: the first valid response of each key (null where none is) with the
    number of attempts that were needed, and the invalid responses up to it with what is wrong with them."""
    marked = responses.withColumn("problem", problem)
    good = F.col("problem").isNull()
    first = marked.groupBy("key").agg(F.min(F.when(good, F.col("attempt"))).alias("used"), F.min_by("response", F.when(good, F.col("attempt"))).alias("response"), F.max("attempt").alias("tried"))
    bad = marked.join(first.select("key", "used"), "key").where(~good & (F.col("used").isNull() | (F.col("attempt") < F.col("used")))).drop("used")
    return first.select("key", "response", F.coalesce("used", "tried").alias("attempts"), F.col("used").isNotNull().alias("valid")), bad


def texts_to_embed(texts: DataFrame, cache: DataFrame, model: str, base: str, text: str = "text") -> DataFrame:
    """Distinct texts whose vectors the cache (key) lacks, with their keys."""
    keyed = texts.select(F.col(text).alias("text")).distinct().withColumn("key", cache_key(F.lit(model), F.lit(base), "text"))
    return keyed.join(cache.select("key"), "key", "left_anti")


# --- prompts --------------------------------------------------------------------------------------------------


def split_template(template: Column, placeholder: str) -> Column:
    """Text before and after the first placeholder; a template without it raises."""
    at = F.locate(placeholder, template)
    whole = F.when(at == 0, F.raise_error(F.lit("the template lost its placeholder")).cast("string")).otherwise(template)
    return F.struct(F.substring(whole, F.lit(1), at - 1).alias("header"), F.substring(whole, at + len(placeholder), F.length(whole)).alias("footer"))


def memory_prompt(header: Column, heading: Column, empty: Column, stream: Column, footer: Column, planned: Column) -> Column:
    """Tokens of a memory prompt: header, the list's heading (or what stands for no memory), the facts and the footer; another
    length than planned raises."""
    whole = F.concat(header, F.when(F.size(stream) > 0, heading).otherwise(empty), stream, footer)
    return F.when(F.size(whole) != planned, F.raise_error(F.lit("planned tokens differ from the prompt")).cast("array<int>")).otherwise(whole)


def block_tail(memory: Column, facts_end: Column, block: int) -> Column:
    """Tokens that load in whole blocks and the tail that is computed again, which must not reach the facts."""
    loaded = memory - memory % block
    return F.struct(F.when(loaded < facts_end, F.raise_error(F.lit("the tail reaches the facts")).cast("long")).otherwise(loaded.cast("long")).alias("loaded"), (memory % block).cast("long").alias("tail"))


def require_parity(probe: DataFrame, a: str, b: str) -> DataFrame:
    """Rows on which two tokenizers agree; any other raises."""
    return require(probe, F.col(a).eqNullSafe(F.col(b)), "tokenizers differ")
