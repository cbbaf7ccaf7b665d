"""Request workloads: users meet samples round-robin and draw questions by a hash, so that a smaller workload is a
prefix of a larger one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import user_name


#: Primes beyond the number of questions of any sample.
STRIDES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def hashed(seed: int, *parts: str) -> Column:
    """44 bits of the MD5 of the seed and further parts (a column's name stands for its value), which SQL can draw too."""
    cells = [F.col(p).cast("string") if p in ("user_index", "draw") else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *cells)), 1, 11), 16, 10).cast("long")


def requests(spark, samples: DataFrame, questions: DataFrame, users: int, per_user: int, seed: int = 42) -> DataFrame:
    """user_id, user_index, sample_id, draw, question_id, query. ``samples`` holds sample_id and ord (from 0).

    Distinct questions per user where the sample has enough, else drawn with replacement; a sample without
    questions raises.
    """
    if users < 1 or per_user < 1:
        raise ValueError("users and per_user must be positive")
    n = samples.agg(F.count(F.lit(1)).alias("n"))
    everyone = spark.range(users).withColumnRenamed("id", "user_index").crossJoin(F.broadcast(n)).withColumn("ord", F.col("user_index") % F.col("n"))
    counts = questions.groupBy("sample_id").agg(F.count(F.lit(1)).alias("have"))
    met = everyone.join(samples.select("sample_id", "ord").join(counts, "sample_id", "left"), "ord")
    # the count itself raises: a filter beside the ones below might be evaluated after them
    none = F.raise_error(F.concat(F.lit("no questions: "), F.col("sample_id").cast("string"))).cast("long")
    met = met.withColumn("have", F.when(F.col("have") > 0, F.col("have")).otherwise(none))
    w = Window.partitionBy("sample_id").orderBy("question_ord")
    numbered = questions.withColumn("q", F.row_number().over(w) - 1).select("sample_id", "q", "question_id", "query")
    # the i-th draw of a user: enough questions are walked through from a hashed start in a hashed stride that shares no
    # factor with their number, so that draws differ; too few are drawn by hash, again and again
    drawn = met.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(per_user))))
    stride = F.element_at(F.array(*[F.lit(p) for p in STRIDES]), (hashed(seed, "stride", "user_index") % len(STRIDES) + 1).cast("int"))
    walk = (hashed(seed, "start", "user_index") + (F.col("draw") - 1) * (stride % F.col("have"))) % F.col("have")
    drawn = drawn.withColumn("q", F.when(F.col("have") >= per_user, walk).otherwise(hashed(seed, "again", "user_index", "draw") % F.col("have")))
    cols = ["user_index", "sample_id", "draw", "q"]
    drawn = drawn.select(*cols).join(numbered, ["sample_id", "q"], "left")  # each number is one; an inner join with nothing would not look at the counts
    return drawn.select(user_name("user_index").alias("user_id"), "user_index", "sample_id", "draw", "question_id", "query")


def warmup_prompts(prompts: DataFrame, vocab: int, seed: int = 42, most: int = 10) -> DataFrame:
    """Up to ``most`` prompts of the same lengths with seeded token ids."""
    first = prompts.orderBy("ord").limit(most)
    ids = F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("ord"), i), F.lit(vocab)).cast("int"))
    return first.select("ord", F.when(F.size("tokens") > 0, ids).otherwise(F.array().cast("array<int>")).alias("tokens"))


def capped_questions(questions: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` questions in order of samples and questions."""
    return questions.orderBy("sample_ord", "question_ord").limit(cap)
