"""Tokens of texts by byte-pair merging from a vocabulary file, in Arrow batches, without a tokenizer library.

A vocabulary is a JSON document: tokens with their ids, pairs to merge by rank, how texts are normalised and cut into words, and
what ends a word. It is read once and travels with the function (its size is the vocabulary's, not the data's). A word is a linked
list of symbols; the pair of the lowest rank that stands first is merged, pairs wait in a heap, and those whose symbols have
changed are skipped when they come up. Words are remembered, ``REMEMBERED`` of them and short ones alone.

A null text has no tokens (null), an empty one an empty list. Symbols that the vocabulary lacks are left out.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from typing import Any

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .guards import require

REMEMBERED, REMEMBERED_LENGTH = 1 << 16, 64
#: Texts of an Arrow batch whose tokens are Python lists at a time.
PART = 256
# Fixed value: the pattern by which byte-level vocabularies cut texts that name no other.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(1)
def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _pattern(text: str) -> str:
    """White space as Unicode has it: a class of its own, also within classes."""
    return text.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


@dataclass
class Vocabulary:
    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    steps: list[tuple[str, ...]]  # how a text is normalised
    pattern: str
    word_end: str
    _words: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_words": {}}

    def normalised(self, text: str) -> str:
        for kind, *more in self.steps:
            if kind == "Lowercase":  # letter by letter: no letter's form follows from its neighbours
                text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
            elif kind == "Replace":
                text = regex.sub(more[0], lambda _: more[1], text)  # noqa: B023
            else:
                text = unicodedata.normalize(kind, text)
        return text

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in regex.findall(self.pattern, self.normalised(text)):
            known = self._words.get(word)
            if known is None:
                known = tuple(self.word_ids(word))
                if len(word) <= REMEMBERED_LENGTH:
                    if len(self._words) >= REMEMBERED:
                        self._words.clear()
                    self._words[word] = known
            out.extend(known)
        return out

    def word_ids(self, word: str) -> list[int]:
        letters = byte_letters()
        return [self.ids[s] for s in self.merged([letters[b] for b in word.encode("utf-8", "surrogatepass")]) if s in self.ids]

    def merged(self, symbols: list[str]) -> list[str]:
        """Symbols after all merges, the one of the lowest rank first, of equals the first in the word."""
        if not symbols:
            return symbols
        symbols = [*symbols[:-1], symbols[-1] + self.word_end]
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, str, str]] = []

        def wait(i: int) -> None:
            j = after[i]
            if j >= 0 and (rank := self.ranks.get((symbols[i], symbols[j]))) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[j]))

        for i in range(n - 1):
            wait(i)
        alive = [True] * n
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i] = left + right
            alive[j] = False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            wait(i)
            if before[i] >= 0:
                wait(before[i])
        return [s for s, keep in zip(symbols, alive, strict=True) if keep]

    def decode(self, ids: list[int], tokens: dict[int, str]) -> str:
        """The text of ids; a word's end is a space, the last one aside."""
        back = {c: b for b, c in enumerate(byte_letters())}
        said = "".join(tokens[i] for i in ids)
        parts = said.split(self.word_end) if self.word_end else [said]
        parts = parts[:-1] if self.word_end and parts and not parts[-1] else parts
        return " ".join(bytes(back[c] for c in p).decode("utf-8", "replace") for p in parts)


def _steps(told: dict | None) -> list[tuple[str, ...]]:
    if told is None:
        return []
    if told["type"] == "Sequence":
        return [s for x in told["normalizers"] for s in _steps(x)]
    if told["type"] == "Replace":
        return [("Replace", _pattern(told["pattern"]["Regex"]) if "Regex" in told["pattern"] else regex.escape(told["pattern"]["String"]), told["content"])]
    if told["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase"):
        return [(told["type"],)]
    raise ValueError(f"unknown normaliser: {told['type']}")


def _cuts(told: dict | None) -> str:
    found = [told] if told and told["type"] != "Sequence" else (told or {}).get("pretokenizers", [])
    split = [x["pattern"]["Regex"] for x in found if x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"]]
    level = [x for x in found if x["type"] == "ByteLevel" and not x["add_prefix_space"]]
    if len(level) != 1 or len(split) + bool(level[0].get("use_regex", True)) != 1 or len(found) != len(split) + 1:
        raise ValueError("texts must be cut by one pattern and read as bytes")
    return _pattern(split[0] if split else BYTE_LEVEL_PATTERN)


def load_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    """A byte-pair vocabulary from its JSON document in any file system that Spark reads."""
    told = json.loads(spark.read.text(path if "://" in path or path.startswith("/") else path, wholetext=True).first().value)  # one document
    model = told["model"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        raise ValueError("not a plain byte-pair vocabulary")
    pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return Vocabulary(dict(model["vocab"]), {p: i for i, p in enumerate(pairs)}, _steps(told.get("normalizer")), _cuts(told.get("pre_tokenizer")), model.get("end_of_word_suffix") or "")


def vocabulary_table(spark: SparkSession, path: str) -> DataFrame:
    """token, id."""
    found = load_vocabulary(spark, path)
    return spark.createDataFrame(list(found.ids.items()), "token string, id int")


def _in_parts(batch: pa.Array, each: Callable[[Any], Any], kind: pa.DataType) -> pa.Array:
    """What ``each`` makes of the values that aren't null; of ``PART`` values alone there are Python objects at a time."""
    parts = [pa.array([None if x is None else each(x) for x in batch.slice(at, PART).to_pylist()], kind) for at in range(0, len(batch), PART)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def token_ids(vocabulary: Vocabulary) -> Callable[[Column | str], Column]:
    """A column function: ids of texts."""

    @F.arrow_udf("array<int>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield _in_parts(batch, vocabulary.encode, pa.list_(pa.int32()))

    return run


def token_texts(vocabulary: Vocabulary) -> Callable[[Column | str], Column]:
    """A column function: texts of ids."""
    bare = replace(vocabulary, ranks={})

    @F.arrow_udf("string")
    def run(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = {i: t for t, i in bare.ids.items()}
        for batch in ids:
            yield _in_parts(batch, lambda x: bare.decode(x, tokens), pa.string())

    return run


def checked_parity(rows: DataFrame, first: Column, second: Column, name: str = "ids") -> DataFrame:
    """Rows with ids that two tokenizers agree on; a row on which they differ raises."""
    both = rows.withColumns({name: first, "__other": second})
    return require(both, F.col(name).eqNullSafe(F.col("__other")), F.lit("tokenizers differ")).drop("__other")
