"""Text, hash and JSON projections as Spark columns (no UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str

# They must equal the reference's for equal results.
CATEGORY_NAMES = {"1": "multi-hop", "2": "temporal", "3": "open-domain", "4": "single-hop", "5": "adversarial"}
ELIGIBLE_CATEGORIES = ("1", "2", "3", "4")
ASSISTANT_NAMES = ("assistant", "ai", "bot")
MODEL_TOKENS = ("<end_of_turn>", "<eos>", "</s>", "<|eot_id|>", "<|endoftext|>")
VERDICT_MARKS = " \t\r\n`'\".,;:!()[]{}"
FACT_NAMESPACE = "55bbc260-62d5-4a84-9724-6686fd41798e"
TRUTHY = ("1", "true", "yes", "on")

_SPACE = r"\s+"


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_all(x: ColumnOrName) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def trim_or_null(x: ColumnOrName) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(trim_all(_c(x).cast("string")), F.lit(""))


def first_filled(*xs: ColumnOrName) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(x).cast("string"), F.lit("")) for x in xs])


def squeeze(x: ColumnOrName) -> Column:
    """White space runs as single spaces, none at the ends."""
    return trim_all(F.regexp_replace(_c(x), _SPACE, " "))


def turn_id(sample: ColumnOrName, session: ColumnOrName, index: ColumnOrName) -> Column:
    return F.concat_ws(":", _c(sample), _c(session), _c(index).cast("string"))


def memory_text(speaker: ColumnOrName, text: ColumnOrName, query: ColumnOrName, caption: ColumnOrName) -> Column:
    """A turn as memory text: speaker, text and a tag that tells of a shared image."""
    q, c = trim_or_null(query), trim_or_null(caption)
    tag = (
        F.when(q.isNotNull() & c.isNotNull(), F.concat(F.lit("[Sharing image - query: "), q, F.lit(". The image shows: "), c, F.lit("]")))
        .when(q.isNotNull(), F.concat(F.lit("[Sharing image - query for: "), q, F.lit("]")))
        .when(c.isNotNull(), F.concat(F.lit("[Sharing image that shows: "), c, F.lit("]")))
    )
    content = F.concat_ws(" ", trim_or_null(text), tag)
    name = F.nullif(_c(speaker), F.lit(""))
    return F.when(name.isNotNull(), F.concat(name, F.lit(": "), content)).otherwise(content)


def prompt_line(text: ColumnOrName) -> Column:
    return F.concat(trim_all(text), F.lit("\n"))


def turn_role(speaker: ColumnOrName, speaker_a: ColumnOrName, speaker_b: ColumnOrName) -> Column:
    """user or assistant: by the two named speakers, else by name."""
    a, b, s = trim_or_null(speaker_a), trim_or_null(speaker_b), F.coalesce(_c(speaker), F.lit(""))
    return F.when(s.eqNullSafe(a), "user").when(s.eqNullSafe(b), "assistant").when(F.lower(trim_all(s)).isin(*ASSISTANT_NAMES), "assistant").otherwise("user")


def uuid5(name: ColumnOrName, namespace: str = FACT_NAMESPACE) -> Column:
    """Version-5 UUID of a name, from SHA-1 and bit operations on its hexadecimal digits."""
    return uuid5_of(F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(_c(name), "UTF-8"))))


def uuid5_of(sha1: ColumnOrName) -> Column:
    """The UUID that a name's SHA-1 (hexadecimal) makes."""
    digest = _c(sha1)
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (nibble % 4) + 1)
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def json_string(x: ColumnOrName) -> Column:
    """A string as a JSON literal; non-ASCII characters stay."""
    wrapped = F.to_json(F.struct(F.coalesce(_c(x), F.lit("")).alias("v")))
    return F.when(_c(x).isNull(), F.lit("null")).otherwise(F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON object with sorted keys; the values are JSON texts already."""
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "{") + f'"{key}":'), fields[key]]
    return F.concat(*parts, F.lit("}"))


def fact_id(sample: ColumnOrName, source_turn: ColumnOrName, text: ColumnOrName) -> Column:
    """Deterministic id of a fact: UUID over its canonical identity."""
    return uuid5(canonical_json(sample_id=json_string(sample), source_turn_id=json_string(source_turn), text=json_string(squeeze(text))))


def with_fact_id(df: DataFrame, sample: str, source_turn: str, text: str, name: str = "fact_id") -> DataFrame:
    """``fact_id`` as a column, in steps that each name the one before several times but compute it once."""
    identity = canonical_json(sample_id=json_string(sample), source_turn_id=json_string(source_turn), text=json_string("__text"))
    steps = df.withColumn("__text", squeeze(text)).withColumn("__identity", identity)
    steps = steps.withColumn("__digest", F.sha1(F.concat(F.unhex(F.lit(FACT_NAMESPACE.replace("-", ""))), F.encode("__identity", "UTF-8"))))
    return steps.withColumn(name, uuid5_of("__digest")).drop("__text", "__identity", "__digest")


def text_hash(memory: ColumnOrName, text: ColumnOrName) -> Column:
    return F.sha2(F.coalesce(first_filled(memory, text), F.lit("")), 256)


def cache_key(*parts: ColumnOrName) -> Column:
    """SHA-256 over parts separated by zero characters."""
    return F.sha2(F.concat_ws("\u0000", *[_c(p) for p in parts]), 256)


def mask_prompt_date(x: ColumnOrName) -> Column:
    """Replace the date below a current-date heading, which must not change a cache key."""
    return F.regexp_replace(_c(x), r"(?m)^(## Current Date\n)\d{4}-\d{2}-\d{2}$", "$1<preembed-date>")


def endpoint(x: ColumnOrName) -> Column:
    """Lower-case scheme and host, without a fragment or trailing slashes; blank is the provider's default."""
    t = trim_or_null(x)
    bare = F.regexp_replace(F.regexp_replace(t, "#.*$", ""), "/+$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    shown = F.when(head == "", bare).otherwise(F.concat(F.lower(head), F.regexp_replace(F.substring(bare, F.length(head) + 1, F.length(bare)), r"/+(?=$|\?)", "")))
    return F.coalesce(shown, F.lit("<provider-default>"))


def endpoint_key(x: ColumnOrName) -> Column:
    return F.substring(F.sha2(endpoint(x), 256), 1, 16)


def path_part(x: ColumnOrName) -> Column:
    slug = F.regexp_replace(F.regexp_replace(_c(x), r"[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", "default").otherwise(slug)


def label_slug(x: ColumnOrName) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(_c(x), r"[^A-Za-z0-9]+", "-")), "^-+|-+$", "")


def final_answer(x: ColumnOrName) -> Column:
    """What follows the last ``ANSWER:``."""
    return trim_all(F.substring_index(_c(x), "ANSWER:", -1))


def without_fence(x: ColumnOrName) -> Column:
    """The inside of a text that is one fenced block, else the trimmed text."""
    return trim_all(F.regexp_replace(trim_all(x), r"(?s)^```[^\n]*\n(.*?)\n?[^\n]*```$", "$1"))


_MODEL_TOKEN = "|".join(re.escape(t) for t in MODEL_TOKENS)
_JSON_TEXT = r'(?s)^(\{.*\}|\[.*\]|"([^"\\]|\\.)*"|true|false)$'


def boolean_token(x: ColumnOrName) -> Column:
    """true or false said in one word, with model tokens, a fence and punctuation around it; else null."""
    word = F.lower(F.btrim(without_fence(F.regexp_replace(_c(x), _MODEL_TOKEN, " ")), F.lit(VERDICT_MARKS)))
    return F.element_at(F.create_map(F.lit("true"), F.lit(True), F.lit("false"), F.lit(False)), word)


def _json_verdict(text: Column) -> Column:
    """What a JSON text says: a boolean, a string that is one, or an object's boolean field ``correct``."""
    v = F.try_parse_json(F.when(text.rlike(_JSON_TEXT), text))
    kind = F.schema_of_variant(v)
    field = F.try_variant_get(v, "$.correct", "variant")
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", boolean_token(F.try_variant_get(v, "$", "string")))
        .when(F.schema_of_variant(field) == "BOOLEAN", F.try_variant_get(field, "$", "boolean"))
    )


def verdict(x: ColumnOrName) -> Column:
    """A judge's verdict from JSON (plain, fenced or embedded in braces) or from one word; else null."""
    t = trim_all(x)
    texts = F.array(t, without_fence(t), F.regexp_extract(t, r"(?s)(\{.*\})", 1))
    said = F.filter(F.transform(texts, _json_verdict), lambda v: v.isNotNull())
    return F.coalesce(F.get(said, F.lit(0)), boolean_token(t))


def judge_payload(x: ColumnOrName, error: Column | None = None, skipped: Column | None = None) -> Column:
    """correct, reason, raw and status of a judge's response: skipped where none was asked for, error (with what went wrong as
    reason) where the call failed, unparsed (with the response as reason) where it says no verdict, else ok."""
    v, nothing = verdict(x), F.lit(None)
    left_out = F.coalesce(skipped, F.lit(False)) if skipped is not None else F.lit(False)
    failed = error.isNotNull() if error is not None else F.lit(False)
    why = error.cast("string") if error is not None else nothing.cast("string")
    return F.struct(
        F.when(~left_out & ~failed, v).alias("correct"), F.when(left_out, "").when(failed, why).when(v.isNull(), trim_all(x)).otherwise("").alias("reason"),
        F.when(~left_out & ~failed, _c(x)).alias("raw"), F.when(left_out, "skipped").when(failed, "error").when(v.isNull(), "unparsed").otherwise("ok").alias("status"),
    )


# The judge's instruction, on which cached verdicts depend.
JUDGE_SYSTEM_PROMPT = (
    "You are evaluating the correctness of an answer about a conversation. "
    "Compare the predicted answer to the reference answer. "
    "Answer with exactly one lowercase word: true or false."
)
JUDGE_RULES = (
    "Return true if the prediction conveys the same essential information as the reference answer, even if worded differently. "
    "Return false for contradictions, unsupported answers, or missing key facts. "
    "Output only true or false. Do not return JSON, punctuation, or an explanation."
)


def judge_prompt(question: ColumnOrName, answer: ColumnOrName, predicted: ColumnOrName) -> Column:
    """Instruction for a judge that answers with one lower-case word."""
    parts = [F.lit(f"{JUDGE_SYSTEM_PROMPT}\n\nQuestion: "), _c(question), F.lit("\nReference answer: "), _c(answer), F.lit("\nPredicted answer: "), _c(predicted), F.lit(f"\n\n{JUDGE_RULES}")]
    return F.concat(*parts)


def category_name(x: ColumnOrName) -> Column:
    names = F.create_map(*[F.lit(v) for kv in CATEGORY_NAMES.items() for v in kv])
    return F.coalesce(F.element_at(names, _c(x)), F.lit("unknown"))


def truthy(x: ColumnOrName) -> Column:
    return F.coalesce(F.lower(F.trim(_c(x))).isin(*TRUTHY), F.lit(False))


def user_name(i: ColumnOrName) -> Column:
    return F.format_string("user_%04d", _c(i).cast("long"))


def user_counts(x: ColumnOrName) -> Column:
    """Positive, distinct whole numbers from a text with commas, semicolons or spaces; raises otherwise."""
    parts = F.filter(F.split(trim_all(x), r"[;,\s]+"), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast("int"))
    bad = (F.size(numbers) == 0) | F.exists(numbers, lambda n: n.isNull() | (n <= 0)) | (F.size(F.array_distinct(numbers)) != F.size(numbers))
    return F.when(bad, F.raise_error(F.concat(F.lit("invalid user counts: "), F.coalesce(_c(x), F.lit("null")))).cast("array<int>")).otherwise(numbers)


def content_text(x: ColumnOrName) -> Column:
    """Text of a message whose content (variant) is a string or a list of strings and {text} parts."""
    v = _c(x)
    whole = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    parts = F.try_variant_get(v, "$", "array<variant>")
    def text(p: Column) -> Column:
        kind = F.schema_of_variant(p)
        return F.coalesce(F.when(kind == "STRING", F.try_variant_get(p, "$", "string")), F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$.content", "string"), F.lit(""))
    return F.coalesce(whole, F.array_join(F.transform(parts, text), ""), F.lit(""))


# An error speaks of the context limit if it holds a term of each list.
CONTEXT_TERMS = ("context", "prompt", "token", "sequence")
LIMIT_TERMS = ("too long", "maximum", "max", "limit", "length")


def context_limit_error(x: ColumnOrName) -> Column:
    """Whether an error text speaks of a context limit."""
    t = F.lower(_c(x))
    hold = [F.exists(F.array(*[F.lit(w) for w in terms]), lambda w: t.contains(w)) for terms in (CONTEXT_TERMS, LIMIT_TERMS)]
    return F.coalesce(hold[0] & hold[1], F.lit(False))
