"""Queries over streams that are killed and started again, and over tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokens
from ..sources.written import folder
from ..streaming import registry
from ..streaming.judged import JudgedRecords
from .queries import query, read


class _Killed(Exception):
    pass


def _judge(fail_at: str | None = None, resolved: bool = False):  # noqa: ANN202
    """A stand-in for a judge that takes the verdict from the record: users' turns say one in JSON, assistants' texts are what they
    are, long ones fail until ``resolved`` and system turns are left out."""

    def judge(records: DataFrame) -> DataFrame:
        if fail_at is not None and records.where(F.col("question_id") == fail_at).limit(1).count():
            raise _Killed(fail_at)
        long = F.length("text") > 300
        said = F.when(F.col("role") == "user", F.concat(F.lit('{"correct": '), (F.col("turn") % 4 == 0).cast("string"), F.lit("}"))).otherwise(F.col("text"))
        said = F.when(long & F.lit(resolved), "False.").otherwise(said)
        return records.withColumns({"response": said, "error": F.when(long & ~F.lit(resolved), "too long"), "skipped": F.col("role") == "system"})

    return judge


@query("""
SELECT conv_id || ':' || turn AS question_id, CASE WHEN role = 'system' THEN NULL WHEN length(text) > 300 THEN false WHEN role = 'user' THEN turn % 4 = 0 END AS correct,
  CASE WHEN role = 'system' THEN 'skipped' WHEN length(text) > 300 OR role = 'user' THEN 'ok' ELSE 'unparsed' END AS status FROM conversations
""")
def judged_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Records judged batch by batch: the stream is killed within a batch and started again, then what failed is judged once more by
    a rewrite that is killed and started again."""
    own = read(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), "turn", "role", "text")
    base = folder(spark, "judged")
    own.repartition(6, "question_id").write.parquet(f"{base}/in")
    out = JudgedRecords(spark, f"{base}/out", "question_id string, turn long, role string, text string")
    stream = lambda: spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    victim = own.agg(F.max("question_id")).first()[0]
    try:
        out.start(stream(), _judge(victim), f"{base}/checkpoint").awaitTermination()
    except Exception as e:
        if victim is None or victim not in str(e):
            raise
    out.start(stream(), _judge(), f"{base}/checkpoint").awaitTermination()
    try:
        out.rejudge(_judge(victim, True), everything=True)
    except _Killed:
        pass
    out.rejudge(_judge(None, True))
    return out.read().select("question_id", "judge.correct", "judge.status")


@query(r"""
SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '''s|''t|''re|''ve|''m|''ll|''d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+'), ' ') AS spoken FROM conversations
""")
def token_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts encoded by byte pairs and decoded again; encoding what was decoded gives the same ids, or the query raises."""
    import public_tokenizers

    known = tokens.load_vocabulary(spark, public_tokenizers.path("word_bpe_49k.json"))
    ids, texts = tokens.token_ids(known), tokens.token_texts(known)
    own = read(spark, d, "conversations").select("conv_id", "turn", ids("text").alias("first"))
    own = own.withColumn("spoken", texts("first"))
    return tokens.checked_parity(own, F.col("first"), ids("spoken")).select("conv_id", "turn", "spoken")


def _operations(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "view", registry.LOOK_UP).when(F.col("event_id") % 97 == 0, registry.CLEAR).otherwise(registry.REGISTER)
    space = F.concat(F.lit("n"), F.col("user_id") % 7)
    return read(spark, d, "events").select(space.alias("namespace"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("user_id") % 3).cast("string").alias("name"), F.lit("graph").alias("backend"), F.col("value").cast("string").alias("value"))


_LOOK_UPS = """
WITH ops AS (SELECT 'n' || user_id % 7 AS namespace, ts, event_id AS seq, CASE WHEN event_type = 'view' THEN 'look' WHEN event_id % 97 = 0 THEN 'clear' ELSE 'register' END AS op, (user_id % 3)::VARCHAR AS name, event_id AS value FROM events),
asked AS (
  SELECT o.namespace, o.seq, o.name, (SELECT max((r.ts, r.seq)) FROM ops r WHERE r.op = 'register' AND r.namespace = o.namespace AND r.name = o.name AND (r.ts, r.seq) < (o.ts, o.seq)) AS put,
    (SELECT max((c.ts, c.seq)) FROM ops c WHERE c.op = 'clear' AND c.namespace = o.namespace AND (c.ts, c.seq) < (o.ts, o.seq)) AS gone FROM ops o WHERE o.op = 'look')
SELECT asked.namespace, seq, name, round(e.value, 6) AS value FROM asked LEFT JOIN events e ON put IS NOT NULL AND (gone IS NULL OR put > gone) AND e.event_id = put[2]
"""


@query(_LOOK_UPS)
def registry_answers(spark: SparkSession, d: str) -> DataFrame:
    """Look-ups in namespaces that are filled and cleared, as a table."""
    return registry.batch_answers(_operations(spark, d)).select("namespace", "seq", "name", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(_LOOK_UPS)
def streamed_registry(spark: SparkSession, d: str) -> DataFrame:
    """The same look-ups over a stream whose operations arrive in any order, in files; a last one lets the watermark pass all."""
    own, base = _operations(spark, d), folder(spark, "registry")
    shuffled = own.repartition(4, F.xxhash64("seq"))
    shuffled.write.parquet(f"{base}/in")
    last = own.agg((F.max("ts") + F.expr("interval 800 days")).alias("ts")).select(F.lit("end").alias("namespace"), "ts", F.lit(-1).cast("long").alias("seq"), F.lit(registry.LOOK_UP).alias("op"), *[F.lit(None).cast("string").alias(c) for c in ("name", "backend", "value")])
    for n, part in ((1, None), (4, last)):
        if part is not None:
            part.write.mode("append").parquet(f"{base}/in")
        stream = registry.streamed_answers(registry.operations_stream(spark, f"{base}/in", own.schema, n), "400 days")
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(registry.ANSWERS).parquet(f"{base}/out")
    return got.where("namespace <> 'end'").select("namespace", "seq", "name", F.round(F.col("value").cast("double"), 6).alias("value"))
