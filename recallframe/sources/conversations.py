"""Conversation JSON: nested records as tables of samples, turns and questions.

Files are read in ranges and cut at the borders of records, which are parsed natively and exploded; insertion order of objects
that matter is kept by reading them as maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim_all, trim_or_null
from ..functions.time import parsed_time
from .json_array import entries

_JSON_MAP = "map<string,string>"


def _field(record: str | Column, *names: str) -> Column:
    """First filled field of a JSON text (objects and lists as JSON text)."""
    col = F.col(record) if isinstance(record, str) else record
    def read(name: str) -> Column:
        v = F.get_json_object(col, f"$.{name}")
        bare = F.schema_of_variant(F.try_variant_get(F.try_parse_json(col), f"$.{name}", "variant")) != "STRING"  # text counts as filled
        return F.when(v.isin("", "[]", "{}"), None).when(v.isin("null", "0", "false"), F.when(~bare, v)).otherwise(v)

    return F.coalesce(*[read(n) for n in names])


def records(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """sample_id, ord and record (JSON text) of each conversation in the files at ``path``.

    The root is a list, or an object whose first filled of data, samples and conversations is one; anything else
    raises. Entries that are no objects are skipped but count for default ids.
    """
    items = entries(spark, path)
    named = F.when(F.col("key").isNull(), 0).when(F.col("key") == "data", 1).when(F.col("key") == "samples", 2).when(F.col("key") == "conversations", 3)
    chosen = items.select("file", "list", named.alias("place")).where("place is not null").groupBy("file").agg(F.min(F.struct("place", (-F.col("list")).alias("list"))).alias("best"))
    own = items.join(chosen.select("file", (-F.col("best.list")).alias("list")), ["file", "list"]).where(F.col("record").startswith("{"))
    default = F.concat(F.lit("sample-"), F.col("pos"))
    own = own.select("file", "pos", "record", F.coalesce(_field("record", "sample_id", "conversation_id", "id"), default).alias("sample_id"), F.col("nth_object").cast("int").alias("ord"))
    return own.where(F.col("ord") < most) if most is not None else own


def turns(samples: DataFrame) -> DataFrame:
    """Turns of every session, sessions in time order (dated ones first, then by number)."""
    conv = F.coalesce(F.get_json_object("record", "$.conversation"), F.col("record"))
    base = samples.withColumn("conv", conv)
    bare = base.where(F.col("conv").startswith("[")).select("sample_id", F.lit("session_1").alias("session_id"), F.lit(1).alias("no"), F.lit(None).cast("string").alias("timestamp"), F.col("conv").alias("list"), F.lit(None).cast("string").alias("speaker_a"), F.lit(None).cast("string").alias("speaker_b"))
    fields = base.where(F.col("conv").startswith("{")).withColumn("m", F.from_json("conv", _JSON_MAP))
    entry = fields.select("sample_id", "m", F.explode("m").alias("session_id", "list"))
    number = F.regexp_extract("session_id", r"^session_(\d+)$", 1)
    keyed = entry.where((number != "") & F.col("list").startswith("[")).select("sample_id", "session_id", number.cast("int").alias("no"), trim_or_null(F.try_element_at("m", F.concat("session_id", F.lit("_date_time")))).alias("timestamp"), "list", F.try_element_at("m", F.lit("speaker_a")).alias("speaker_a"), F.try_element_at("m", F.lit("speaker_b")).alias("speaker_b"))
    sessions = bare.unionByName(keyed).withColumn("at", parsed_time("timestamp"))
    w = Window.partitionBy("sample_id").orderBy(F.col("at").isNull(), F.col("at"), F.when(F.col("at").isNull(), F.col("no")), "no")
    sessions = sessions.withColumn("session_index", F.row_number().over(w))
    slots = sessions.select("sample_id", "session_id", "session_index", "timestamp", "speaker_a", "speaker_b", F.posexplode(F.from_json("list", "array<variant>")).alias("turn_index", "v"))
    raw = F.to_json("v")
    is_text, is_object = F.schema_of_variant("v") == "STRING", F.schema_of_variant("v").startswith("OBJECT")
    slots = slots.where(is_text | is_object).withColumn("raw", raw).withColumn("is_text", is_text)
    said = F.when(F.col("is_text"), F.try_variant_get("v", "$", "string")).otherwise(_field("raw", "text", "content", "message", "utterance"))
    out = slots.select(
        "sample_id", "session_id", "session_index", "turn_index", F.coalesce(F.when(~F.col("is_text"), _field("raw", "speaker", "role")), F.lit("")).alias("speaker"),
        F.coalesce(trim_all(said), F.lit("")).alias("text"), "timestamp", trim_or_null(F.when(~F.col("is_text"), _field("raw", "blip_caption", "image_caption", "caption"))).alias("image_caption"),
        trim_or_null(F.when(~F.col("is_text"), _field("raw", "query"))).alias("image_query"), F.when(~F.col("is_text"), _field("raw", "dia_id")).alias("dia_id"), "speaker_a", "speaker_b",
    )
    return out.where((F.col("text") != "") | F.col("image_caption").isNotNull())


def questions(samples: DataFrame) -> DataFrame:
    """Questions of every sample: id, question, answer, category and evidence."""
    listed = _field("record", "qa", "qas", "questions", "question_answering")
    own = samples.select("sample_id", listed.alias("qa")).where("qa is not null")
    in_order = F.when(F.col("qa").startswith("{"), F.map_values(F.from_json("qa", _JSON_MAP))).otherwise(F.transform(F.from_json("qa", "array<variant>"), lambda v: F.to_json(v)))
    items = own.select("sample_id", F.posexplode(in_order).alias("pos", "raw")).where(F.col("raw").startswith("{"))
    answer = F.coalesce(F.get_json_object("raw", "$.answer"), F.get_json_object("raw", "$.gold_answer"), F.lit(""))
    answer = F.when(answer.startswith("["), F.array_join(F.from_json(answer, "array<string>"), "; ")).otherwise(answer)
    evidence = F.get_json_object("raw", "$.evidence")
    evidence = F.when(evidence.startswith("["), F.from_json(evidence, "array<string>")).when(evidence.isNotNull(), F.array(evidence))
    return items.select(
        "sample_id", "pos", F.coalesce(_field("raw", "question_id", "qa_id", "id"), F.concat(F.lit("q"), F.col("pos"))).alias("question_id"),
        trim_all(F.coalesce(_field("raw", "question", "query"), F.lit(""))).alias("question"), answer.alias("answer"),
        F.coalesce(_field("raw", "category", "type"), F.lit("unknown")).alias("category"), evidence.alias("evidence"),
    ).where("question <> ''")
