"""Run records: labels, modes, eligibility, deferred judging, chunk fetches, capacity models and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import fixed, mebibytes
from ..functions.text import ELIGIBLE_CATEGORIES, first_filled
from .guards import require

# Names that an answer model goes by, and the parser that a reasoning model needs.
MODEL_ALIASES = {
    "llama": "llama", "llama3": "llama", "llama3.1": "llama", "llama-3.1": "llama", "llama-3.1-8b-instruct": "llama", "mistral": "mistral", "mistral-7b": "mistral",
    "mistral-7b-instruct-v0.3": "mistral", "qwen": "qwen", "qwen2.5": "qwen", "qwen2.5-7b": "qwen", "qwen2.5-7b-instruct": "qwen", "qwen3": "qwen3-14b", "qwen3-14b": "qwen3-14b",
}
REASONING_PARSERS = {"qwen3-14b": "qwen3"}
#: Share of a device, and of available host memory, that a projection may fill.
DEVICE_SHARE, HOST_SHARE = 0.97, 0.9


def _lookup(table: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def model_key(name: Column, configured: Mapping[str, str] | None = None) -> Column:
    """Configured model of an alias; a name that is none stays itself."""
    alias = _lookup(MODEL_ALIASES, F.lower(F.trim(name)))
    return F.coalesce(_lookup(configured, alias) if configured else alias, name)


def reasoning_parser(name: Column) -> Column:
    return _lookup(REASONING_PARSERS, _lookup(MODEL_ALIASES, F.lower(F.trim(name))))


def run_mode(saved: Column, unit: Column, first_mode: Column, default: str, modes: Mapping[str, str], unit_name: str) -> Column:
    """Mode of a saved run: by its backend and unit, else the backend itself, else its first record's, else the default."""
    known = F.when(unit == unit_name, _lookup(modes, saved))
    return F.coalesce(known, F.nullif(saved, F.lit("")), first_mode, F.lit(default))


def judge_label(correct: Column) -> Column:
    return F.when(correct, "correct").when(~correct, "incorrect").otherwise("skipped")


def record_label(**ids: Column) -> Column:
    """name=value of the ids that a record has."""
    return F.concat_ws(" ", *[F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in ids.items()])


def eligible(category: Column) -> Column:
    return F.coalesce(F.trim(category).isin(*ELIGIBLE_CATEGORIES), F.lit(False))


def evidence_protocol(saved: Column, asked: Column, rejudge: Column) -> Column:
    """Protocol that deferred judging follows: what is asked when everything is judged anew, else what the run was
    recorded with; asking for evidence that the run lacks raises."""
    s, a = F.coalesce(saved, F.lit(False)), F.coalesce(asked, F.lit(False))
    clash = ~F.coalesce(rejudge, F.lit(False)) & a & ~s
    return F.when(clash, F.raise_error(F.lit("evidence conflicts with the saved run")).cast("boolean")).when(F.coalesce(rejudge, F.lit(False)), a).otherwise(s)


def planned_questions(questions: DataFrame, cap: int | None) -> DataFrame:
    out = questions.agg(F.count_if(eligible(F.col("category"))).alias("eligible"))
    return out.select((F.least("eligible", F.lit(cap)) if cap is not None else F.col("eligible")).alias("planned"))


def round_robin(users: DataFrame, samples: DataFrame) -> DataFrame:
    """Users with their sample: index modulo the number of samples, an equality join."""
    n = samples.agg(F.count(F.lit(1)).alias("__n"))  # one row
    return users.crossJoin(F.broadcast(n)).withColumn("ord", F.col("user_index") % F.col("__n")).drop("__n").join(samples, "ord")


def grouped_requests(requests: DataFrame) -> DataFrame:
    """Each user's sample and how many requests it has."""
    return requests.groupBy("user_id").agg(F.min("sample_id").alias("sample_id"), F.count(F.lit(1)).alias("requests"))


def fetch_chunks(requests: DataFrame, chunks: DataFrame, capacity: int = 0) -> DataFrame:
    """Requested chunks in order (request_id, pos, fact_id, tokens); an unknown id or more ids than slots raises."""
    if capacity:
        requests = require(requests, F.size("fact_ids") <= capacity, "more chunks than slots")
    asked = requests.select("request_id", F.posexplode("fact_ids").alias("pos", "fact_id"))
    got = asked.join(chunks.withColumn("__known", F.lit(True)), "fact_id", "left")
    return require(got, F.col("__known"), F.concat(F.lit("no chunk: "), F.col("fact_id").cast("string"))).drop("__known")


def load_coverage(loaded: DataFrame, native: DataFrame) -> DataFrame:
    """Distinct requests whose memory was loaded or already covered."""
    both = loaded.select("request_id").union(native.select("request_id")).distinct()
    return both.agg(F.count(F.lit(1)).alias("covered"))


def by_payload_ordinal(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Search results (query_id, place, ordinal) with their rows, up to the first padding (-1); an unknown ordinal raises."""
    w = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = found.withColumn("__padded", F.max(F.when(F.col("ordinal") == -1, 1).otherwise(0)).over(w)).where("__padded = 0").drop("__padded")
    got = own.join(rows.withColumn("__known", F.lit(True)), "ordinal", "left")
    return require(got, F.col("__known"), F.concat(F.lit("invalid ordinal: "), F.col("ordinal").cast("string"))).drop("__known")


def transfer_deltas(records: DataFrame, user: str = "user_id", order: str = "seq") -> DataFrame:
    """Running totals of each user's transfers and what each added."""
    w = Window.partitionBy(user).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = records.withColumns({"bytes_total": F.sum("num_bytes").over(w), "latency_total": F.sum("h2d_latency_ms").over(w)})
    step = Window.partitionBy(user).orderBy(order)
    return out.withColumn("bytes_delta", F.col("bytes_total") - F.coalesce(F.lag("bytes_total").over(step), F.lit(0)))


def entity_counts(questions: DataFrame, cap: int = 8) -> DataFrame:
    """Entities to embed: each question's first ``cap``, normalised and distinct."""
    per = F.array_distinct(F.filter(F.transform(F.slice("entities", 1, cap), lambda e: F.lower(F.trim(e))), lambda e: e != ""))
    return questions.select(F.size(per).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entities"))


def conditions_to_run(done: DataFrame, asked: DataFrame, order: Sequence[str]) -> DataFrame:
    """Completed and requested conditions once each, in canonical order."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("condition"))
    return done.select("condition").union(asked.select("condition")).distinct().withColumn("place", place).orderBy("place")


def missing_counts(expected: Column, actual: Column) -> Column:
    """What is missing and what is unexpected in a worker's user counts."""
    return F.struct(F.array_except(expected, actual).alias("missing"), F.array_except(actual, expected).alias("unexpected"))


def same_ids(a: Column, b: Column) -> Column:
    """Equal length and equal sets of ids."""
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def fact_from_hit(hits: DataFrame) -> DataFrame:
    """Search hits (id, payload and metadata maps) as facts; blank ids or texts and negative indexes raise.

    The turn's index comes from its field or, without one, from the last part of its id.
    """
    def value(key: str, old: str) -> Column:
        return F.coalesce(F.try_element_at("payload", F.lit(key)), F.try_element_at("metadata", F.lit(key)), F.try_element_at("metadata", F.lit(old)))

    turn = F.trim(F.coalesce(value("source_turn_id", "turn_id"), F.lit("")))
    out = hits.select(
        F.trim(F.col("id")).alias("memory_id"), F.trim(F.coalesce(F.try_element_at("payload", F.lit("memory")), F.lit(""))).alias("text"), value("source_session_index", "session_index").try_cast("int").alias("session_index"),
        first_filled(value("source_session_id", "session_id")).alias("session_id"), turn.alias("turn_id"),
        F.coalesce(value("source_turn_index", "turn_index").try_cast("int"), F.element_at(F.split(turn, ":"), -1).try_cast("int")).alias("turn_index"), "rank",
    )
    out = out.withColumn("session_id", F.coalesce("session_id", F.concat(F.lit("session_"), F.col("session_index").cast("string"))))
    out = require(out, F.col("memory_id") != "", "empty memory id")
    out = require(out, F.col("text") != "", F.concat(F.lit("no text: "), F.col("memory_id")))
    return require(out, (F.col("session_index") >= 0) & (F.col("turn_index") >= 0), F.concat(F.lit("bad index: "), F.col("memory_id")))


def texts_of_results(results: Column) -> Column:
    """Filled texts of an array of {memory, text} maps."""
    return F.filter(F.transform(results, lambda r: F.trim(F.coalesce(F.try_element_at(r, F.lit("memory")), F.try_element_at(r, F.lit("text")), F.lit("")))), lambda t: t != "")


def device_projection(corpus: DataFrame, requests: int, top_k: int, scaffold_tokens: int, samples: int, device_bytes: int, pool_share: float, graph_bytes: int, corpus_on_device: bool = True) -> DataFrame:
    """Peak bytes of the set-up and the generation phase from a sample's chunks (tokens, bytes), and whether they fit."""
    s = corpus.agg(F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("chunks")).where("tokens > 0")
    per_token = F.col("bytes") / F.col("tokens")
    composed = F.lit(scaffold_tokens) + F.least(F.lit(top_k), F.col("chunks")) * (F.col("tokens") / F.col("chunks"))
    s = s.withColumns({"composed_bytes": composed * per_token * requests, "source_bytes": F.col("bytes") * samples, "staged_bytes": composed * per_token})
    resident = F.col("source_bytes") if corpus_on_device else F.col("staged_bytes")
    s = s.withColumns({"setup_peak": F.lit(samples * graph_bytes) + F.col("composed_bytes") + resident, "generate_peak": F.lit(pool_share * device_bytes + samples * graph_bytes) + F.col("composed_bytes")})
    return s.withColumn("fits", F.greatest("setup_peak", "generate_peak") <= DEVICE_SHARE * device_bytes)


def host_projection(corpus_bytes: Column, available: Column) -> Column:
    """Whether a pinned corpus leaves enough host memory."""
    return corpus_bytes <= HOST_SHARE * available


def chunk_residency(chunks: DataFrame) -> DataFrame:
    """Chunks and bytes by residency, with MiB."""
    out = chunks.groupBy("device").agg(F.count(F.lit(1)).alias("chunks"), F.sum("bytes").alias("bytes"))
    return out.withColumn("mb", mebibytes("bytes"))


def beam_width(backend: Column, beam: int, k: int, graph: str = "graph", most: int = 959) -> Column:
    """Search width: at least k for the graph backend and at most the cap, none for others."""
    return F.when(backend == graph, F.least(F.lit(most), F.greatest(F.lit(beam), F.lit(k))))


def cache_path(model: Column, dtype: Column, window: Column, position: Column, block: Column, sample: Column, facts: Column) -> Column:
    """Path key of a chunk cache: readable parts, then the fingerprints of sample and facts."""
    from ..functions.text import path_part

    parts = [path_part(model), dtype, F.concat(F.lit("w"), window.cast("string")), F.concat(F.lit("p"), position.cast("string")), F.concat(F.lit("b"), block.cast("string"))]
    return F.concat_ws("/", *parts, F.concat(sample, F.lit("-"), facts))


def already_cached(wanted: DataFrame, cache: DataFrame, key: str = "path") -> DataFrame:
    """Counts of what a precompute would encode and skip."""
    hit = wanted.join(cache.select(key, F.lit(True).alias("__hit")).distinct(), key, "left")
    return hit.agg(F.count_if(F.col("__hit").isNull()).alias("encoded"), F.count_if(F.col("__hit")).alias("skipped"))


def quarantine(responses: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Valid responses, and invalid ones with what is wrong with them."""
    marked = responses.withColumn("problem", problem)
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null")


def markdown_timing(rows: DataFrame) -> DataFrame:
    """Seconds of each part of a row as a line of the report's table."""
    from .throughput import setup_time

    cell = lambda c: fixed(F.coalesce(c, F.lit(0.0)), 3)
    parts = [setup_time(), *[F.col(c) for c in ("retrieval_time_s", "kv_compose_time_s", "kv_verify_time_s", "prompt_build_time_s", "generation_time_s")]]
    cells = F.concat_ws(" | ", "condition", F.col("num_users").cast("string"), *[cell(p) for p in parts])
    return rows.select("condition", "num_users", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
