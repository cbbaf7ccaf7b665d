"""Context windows and token plans over turns and facts.

Order is always an explicit column. Windows partition by sample: a sample is a conversation, whose length is
bounded by what two people say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .guards import require

#: Distinct lengths of memories that travel with the function that hashes prompts.
LISTED_LENGTHS = 1 << 16


def preceding_turns(turns: DataFrame, width: int, sample: str = "sample_id", order: str = "ord", value: str = "turn_id", name: str = "context") -> DataFrame:
    """Each turn with the up to ``width`` turns before it, oldest first."""
    if width < 0:
        raise ValueError("width must not be negative")
    if width == 0:
        return turns.withColumn(name, F.array().cast(f"array<{turns.schema[value].dataType.simpleString()}>"))
    w = Window.partitionBy(sample).orderBy(order).rowsBetween(-width, -1)
    return turns.withColumn(name, F.collect_list(value).over(w))


def fact_context(facts: DataFrame, turns: DataFrame, width: int, sample: str = "sample_id") -> DataFrame:
    """Facts with the turns before their source turn; an unknown source raises."""
    windows = preceding_turns(turns, width, sample).select(sample, F.col("turn_id").alias("source_turn_id"), "context", F.lit(True).alias("__known"))
    out = facts.join(windows, [sample, "source_turn_id"], "left")
    return require(out, F.col("__known"), F.concat(F.lit("unknown source turn: "), F.col("source_turn_id").cast("string"))).drop("__known")


def evidence_text(questions: DataFrame, turns: DataFrame) -> DataFrame:
    """question_id with its evidence turns' texts in order of the evidence; ids without a turn are skipped, the last
    turn of an id counts."""
    asked = questions.select("sample_id", "question_id", F.posexplode("evidence").alias("pos", "dia_id"))
    said = turns.where("coalesce(dia_id, '') <> ''").groupBy("sample_id", "dia_id").agg(F.max_by(F.struct("timestamp", "speaker", "text"), "ord").alias("t"))
    dated = F.when(F.coalesce(F.col("t.timestamp"), F.lit("")) != "", F.concat(F.lit(", said on "), F.col("t.timestamp"))).otherwise("")
    line = F.concat(F.lit("["), "dia_id", dated, F.lit("] "), F.col("t.speaker"), F.lit(': "'), F.col("t.text"), F.lit('"'))
    found = asked.join(said, ["sample_id", "dia_id"]).groupBy("sample_id", "question_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    out = questions.select("sample_id", "question_id").join(found, ["sample_id", "question_id"], "left")
    return out.select("sample_id", "question_id", F.coalesce(F.array_join("lines.line", "\n"), F.lit("")).alias("evidence"))


def first_need(context: DataFrame, query: str = "query_id") -> DataFrame:
    """Context turns (query, fact_pos, turn_pos, turn_id) at the first fact that needs each."""
    w = Window.partitionBy(query, "turn_id").orderBy("fact_pos", "turn_pos")
    return context.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unique_facts(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Hits by descending rank (the best last), one per id; an id with two texts raises."""
    per = hits.groupBy(query, "id").agg(F.min_by("text", "rank").alias("text"), F.min("rank").alias("rank"), F.countDistinct("text").alias("__texts"))
    per = require(per, F.col("__texts") <= 1, F.concat(F.lit("conflicting fact: "), F.col("id").cast("string"))).drop("__texts")
    w = Window.partitionBy(query).orderBy(F.desc("rank"))
    return per.withColumn("pos", F.row_number().over(w))


def running_positions(chunks: DataFrame, group: str, order: str, tokens: str = "tokens") -> DataFrame:
    """Start and end of each chunk in the stream of its group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("slice_end", F.sum(tokens).over(w)).withColumn("slice_start", F.col("slice_end") - F.col(tokens))


def encoding_plan(context: Column, target: Column, longest: int) -> Column:
    """Context and target tokens cut to ``longest``: the oldest context goes first, the target never."""
    if longest < 1:
        raise ValueError("longest must be at least 1")
    bad = (F.size(target) < 1) | (F.size(target) > longest)
    cut = F.greatest(F.lit(0), F.size(context) + F.size(target) - longest)
    kept = F.slice(context, cut + 1, F.greatest(F.lit(0), F.size(context) - cut))
    kept = F.when(bad, F.raise_error(F.lit("target does not fit")).cast("array<int>")).otherwise(kept)
    return F.struct(
        target.alias("target_token_ids"), kept.alias("context_token_ids"), F.concat(kept, target).alias("input_token_ids"), F.size(kept).alias("slice_start"),
        (F.size(kept) + F.size(target)).alias("slice_end"), F.size(context).alias("raw_context_tokens"), cut.alias("context_truncated_tokens"),
    )


def memory_plan(facts: DataFrame, query: str, budget: int, scaffold: int, window: int) -> DataFrame:
    """One plan per query from its facts (pos, fact_id, text_hash, tokens, context_tokens, truncated, turn_ids):
    ids and hashes in order, distinct context turns, token sums; raises beyond the budget."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "fact_id", "text_hash", "turn_ids"))).alias("r")
    per = facts.groupBy(query).agg(
        rows, F.sum("tokens").alias("fact_tokens"), F.coalesce(F.sum("context_tokens"), F.lit(0)).alias("context_tokens_total"),
        F.coalesce(F.max("context_tokens"), F.lit(0)).alias("context_tokens_max"), F.coalesce(F.sum("truncated"), F.lit(0)).alias("context_tokens_truncated"),
    )
    per = per.withColumn("memory_tokens", F.col("fact_tokens") + scaffold)
    per = require(per, F.col("memory_tokens") <= budget, "facts exceed the memory budget")
    turns = F.array_distinct(F.filter(F.flatten("r.turn_ids"), lambda t: t != ""))
    return per.select(
        query, F.lit(window).alias("context_window"), F.col("r.fact_id").alias("fact_ids"), F.col("r.text_hash").alias("fact_hashes"), turns.alias("context_turn_ids"), F.size(turns).alias("context_turn_count"),
        "context_tokens_total", "context_tokens_max", "context_tokens_truncated", F.lit(scaffold).alias("scaffold_tokens"), "fact_tokens", "memory_tokens", F.lit(budget).alias("memory_token_budget"),
    )


def pad_scaffold(footer: Column, newline: Column, block: int) -> Column:
    """Footer tokens, preceded by newline tokens until they fill a block but one."""
    need = F.greatest(F.lit(0), F.lit(block - 1) - F.size(footer))
    return F.concat(F.array_repeat(newline, need.cast("int")), footer)


def memory_budget(query_tokens: Column, answer_tokens: int, max_position: int, model_length: int) -> Column:
    """Tokens left for memory; raises where none are."""
    left = F.least(F.lit(max_position), F.lit(model_length) - query_tokens - answer_tokens)
    return F.when(left < 0, F.raise_error(F.lit("no room for memory")).cast("int")).otherwise(left)


def joined_prompt(memory: Column, query: Column, bos: int) -> Column:
    """Memory then query tokens, with one begin token where both start with it."""
    double = (F.try_element_at(memory, F.lit(1)) == bos) & (F.try_element_at(query, F.lit(1)) == bos)
    tail = F.when(double, F.slice(query, F.lit(2), F.greatest(F.size(query) - 1, F.lit(0)))).otherwise(query)
    return F.concat(memory, tail)


def is_memory_prefix(memory: Column, prompt: Column) -> Column:
    """The memory's tokens begin the prompt, which goes on after them."""
    return (F.size(prompt) > F.size(memory)) & (F.slice(prompt, F.lit(1), F.size(memory)) == memory)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits in which each depends on all of a number's."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def prefix_hashes(rows: DataFrame, tokens: str, lengths: np.ndarray | None, whole: bool = False) -> DataFrame:
    """The columns of ``rows`` but ``tokens``, with len and h for each prefix of the tokens whose length is listed (all where none
    are), or for all tokens alone: one pass over each row's tokens, whatever the number of lengths.

    A prefix's hash is the exclusive or of its tokens' hashes, each mixed with its place. Null tokens count as one value."""
    keep = [c for c in rows.columns if c != tokens]
    own = rows.select(*keep, F.col(tokens).cast("array<long>").alias(tokens))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held = [], []
            column = batch.column(len(keep))
            for i in range(batch.num_rows):
                if not column[i].is_valid:
                    continue
                x = column[i].values.fill_null(-1).to_numpy().astype(np.int64).view(np.uint64)
                place = _mixed(np.arange(1, len(x) + 1, dtype=np.uint64))
                h = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(_mixed(x ^ place))])
                n = np.array([len(x)]) if whole else np.arange(len(x) + 1) if lengths is None else lengths[: np.searchsorted(lengths, len(x), side="right")]
                at.append((i, n))
                held.append(h[n])
            if not at:
                continue
            who = np.repeat([i for i, _ in at], [len(n) for _, n in at])
            picked = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(picked) for k in range(len(keep))), pa.array(np.concatenate([n for _, n in at]).astype(np.int64)), pa.array(np.concatenate(held).view(np.int64))], names=[*keep, "len", "h"])

    schema = T.StructType([*(own.schema[c] for c in keep), T.StructField("len", T.LongType()), T.StructField("h", T.LongType())])
    return own.mapInArrow(work, schema)


def route_requests(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """Each request's memory: by its user where it names one, else the first memory that its prompt begins with and goes on after.

    Prompts and memories meet on length and hash of the prefix, which a prompt tells for all lengths in one pass over its tokens;
    what meets is compared whole. Up to LISTED_LENGTHS distinct lengths of memories thin the prefixes before they are shuffled.
    """
    named = requests.where("user_id is not null").join(memories.select("user_id", F.col("tokens").alias("memory")), "user_id", "left")
    named = named.select("request_id", "user_id")
    asked = requests.where("user_id is null").select("request_id", F.col("prompt").cast("array<long>").alias("prompt"))
    own = memories.select(F.col("user_id").alias("m_user"), "ord", F.col("tokens").cast("array<long>").alias("tokens"))
    some = [r.n for r in own.select(F.size("tokens").alias("n")).where("n >= 0").distinct().limit(LISTED_LENGTHS + 1).collect()]
    lengths = np.array(sorted(some), np.int64) if len(some) <= LISTED_LENGTHS else None
    whole = prefix_hashes(own.withColumn("all", F.col("tokens")), "all", None, whole=True)
    hit = prefix_hashes(asked, "prompt", lengths).join(whole, ["len", "h"]).select("request_id", "m_user", "ord", "tokens")
    hit = hit.join(asked, "request_id").where(is_memory_prefix(F.col("tokens"), F.col("prompt")))
    first = hit.groupBy("request_id").agg(F.min_by("m_user", "ord").alias("user_id"))
    rest = requests.where("user_id is null").select("request_id").join(first, "request_id", "left")
    return named.unionByName(rest)


def largest_prompt(prompts: DataFrame, limit: int, tokens: str = "tokens") -> DataFrame:
    """Tokens of the longest prompt (0 without any); one longer than the limit raises."""
    out = prompts.agg(F.coalesce(F.max(F.size(tokens)), F.lit(0)).alias("largest"))
    return require(out, F.col("largest") <= limit, F.concat(F.lit("a prompt has "), F.col("largest").cast("string"), F.lit(f" tokens, more than {limit}")))


def query_for_memory(memory: Column, query: Column, bos: int | None, footer: Column | None = None) -> Column:
    """Query tokens (behind a scaffold's footer) as they follow a memory: token_ids, and whether they lost a begin token that both
    start with."""
    whole = F.concat(footer, query) if footer is not None else query
    double = F.lit(False) if bos is None else F.coalesce((F.try_element_at(memory, F.lit(1)) == bos) & (F.try_element_at(whole, F.lit(1)) == bos), F.lit(False))
    return F.struct(F.when(double, F.slice(whole, F.lit(2), F.greatest(F.size(whole) - 1, F.lit(0)))).otherwise(whole).alias("token_ids"), double.alias("stripped"))


def equivalence_prompt(memory: Column, query: Column, bos: int | None, footer: Column | None = None) -> Column:
    """The prompt that a loaded memory and its query stand for: memory, query, both joined, and whether a begin token went."""
    own = query_for_memory(memory, query, bos, footer)
    return F.struct(memory.alias("memory_token_ids"), own["token_ids"].alias("query_token_ids"), F.concat(memory, own["token_ids"]).alias("prompt_token_ids"), own["stripped"].alias("stripped"))


def turn_tokens(turns: DataFrame, tokenised: Callable[[Column], Column], key: str = "turn_id", text: str = "line") -> DataFrame:
    """``turns`` with token_ids: each distinct turn is tokenised once; texts that differ under one id raise."""
    one = turns.groupBy(key).agg(F.min(text).alias("__line"), F.max(text).alias("__other"))
    one = require(one, F.col("__line").eqNullSafe(F.col("__other")), F.concat(F.lit("different texts of turn "), F.col(key).cast("string")))
    return turns.join(one.select(key, tokenised(F.col("__line")).alias("token_ids")), key, "left")


def routed_params(requests: DataFrame, params: Column, user: str = "user_id") -> DataFrame:
    """A clone of the sampling parameters (a map of texts) for each request, with its memory's user where it has one."""
    own = F.map_filter(params, lambda k, v: k != "memory_user_id")
    named = F.map_concat(own, F.create_map(F.lit("memory_user_id"), F.col(user).cast("string")))
    return requests.withColumn("params", F.when(F.col(user).isNotNull(), named).otherwise(own))


def first_mismatch(a: Column, b: Column) -> Column:
    """0-based place where two token streams first differ; null where they are equal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(at > 0, at - 1)
