"""Five stages that make a training corpus: each takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; all but the last return the columns of ``documents``, further columns included.

Null and empty texts pass every stage but for what is said below, and so do rows with a null id. Texts of any length are
worked on whole. An empty table stays empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recallframe.llm import jaccard, mixing, packing, passages, severity
from recallframe.llm.common import stage_table
from recallframe.llm.queries import tokenizer_file


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go. A text without a word stays; rows that repeat go or stay together.
    Without labels of both kinds every row stays."""
    return severity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id. Of rows that repeat an id and its
    text one stays; texts that share an id are documents of their own. Texts without a word are nobody's copies."""
    return jaccard.keep_first_of_class(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document (a smaller id) holds are cut out of later ones; documents of which nothing is left
    go. Rows that repeat an id and its text are cut alike, and not because of each other."""
    return passages.cut_passages(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated or thinned to their target weights and shuffled. A null source is a source of its own; rows
    that repeat an id get equal counts."""
    return mixing.mix_sources(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 2048 tokens. A null or empty text is its end id; every row is packed,
    and row_id tells rows apart that share an id."""
    return packing.pack(docs, tokenizer_file(), digest=packing.ids_crc32, digest_field="ids_crc32 long")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixture", source_mixture),
    ("packed_sequences", packed_sequences),
]

#: The severity model and the chained passages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage_table(docs, f"stage-{name}")
    return docs
