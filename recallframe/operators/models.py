"""Boundaries to models: Arrow-batched embedders and chat clients; deterministic stand-ins serve tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], list[list[float]]]
Chat = Callable[[list[str]], list[str]]


def stub_embed(texts: list[str], dim: int = 8) -> list[list[float]]:
    """Vectors from digests of the texts."""
    return [[b / 255 for b in hashlib.sha256((t or "").encode()).digest()[:dim]] for t in texts]


def embedder(embed: Embed = stub_embed) -> Callable[[Column | str], Column]:
    """A column function that embeds texts in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(embed(batch.fillna("").tolist()))

    return run


def answered(prompts: DataFrame, chat: Chat, key: str = "key", prompt: str = "prompt") -> DataFrame:
    """(key, value): one response for each prompt, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "value": chat(batch[prompt].tolist())})

    return prompts.select(key, prompt).mapInPandas(run, f"{key} string, value string")


def extracted_facts(turns: DataFrame, extract: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Facts of each sample by a stateful extractor that reads its turns in order."""
    return turns.groupBy("sample_id").applyInPandas(lambda g: extract(g.sort_values("ord")), schema)


def character_tokens(text: Column | str) -> Column:
    """Deterministic stand-in for a tokenizer: code points."""
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.ascii(c))
