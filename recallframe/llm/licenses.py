"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases; a shunting-yard parser
evaluates the and/or/with expressions of the tags.

A null or empty text has no words, no labels and score 0; an empty table has no rows. Rows that repeat give the same
values, and of phrases that overlap each counts. Texts of any length are scanned whole in time that grows with them.
Columns other than id and text are not looked at; an id column that is called like a result keeps its name with
underscores behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ALNUM_WORDS, bound_batches, fresh, lower_ascii_table, released

#: Fixed by the contract: phrase words and their label.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: The method's own notice phrases (as words) and labels.
NOTICE_PHRASES = {
    "cc by": "cc-by", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd", "cc0": "cc0", "creative commons": "creative-commons", "public domain": "public-domain",
    "bsd license": "bsd", "3 clause bsd": "bsd", "2 clause bsd": "bsd", "mozilla public license": "mpl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "isc license": "isc",
    "eclipse public license": "epl", "all rights reserved": "proprietary", "the unlicense": "unlicense",
}

#: How freely a text under each label may be reused, from 0 (not at all) to 1.
OPENNESS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "zlib": 1.0, "cc-by": 0.9,
    "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "creative-commons": 0.5, "gpl": 0.5, "agpl": 0.4, "cc-by-nd": 0.3,
    "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "proprietary": 0.0,
}

UNKNOWN_OPENNESS = 0.3
#: A with-exception loosens its licence by this share of what is missing to 1.
EXCEPTION_SHARE = 0.5
TAG = "spdx license identifier"
_BINDS = {"or": 1, "and": 2, "with": 3}
#: The last kind ends a line, as for str.splitlines.
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+-]+|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]")


def label_of(identifier: str) -> str:
    """Family label of an identifier such as ``apache-2.0`` or ``gpl-3.0-or-later``."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    name = re.sub(r"-v?\d+(\.\d+)*(?=-|$)", "", name)
    name = re.sub(r"-(clause|universal)$|^0", "", name)
    if name.startswith("bsd"):
        return "bsd"
    return name or identifier.lower()


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: infix licence expression to postfix; WITH binds before AND, AND before OR.

    A stray operator or parenthesis is dropped, so that every input has a result.
    """
    out: list[str] = []
    held: list[str] = []
    for t in tokens:
        if t == "(":
            held.append(t)
        elif t == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if held:
                held.pop()
        elif t in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[t]:
                out.append(held.pop())
            held.append(t)
        else:
            out.append(t)
    out.extend(t for t in reversed(held) if t != "(")
    return out


def evaluate(text: str, start: int = 0) -> tuple[set[str], float | None]:
    """Labels and openness of the licence expression at ``start``: OR takes the freer side, AND the stricter.

    It begins on the tag's line and ends with a line that neither awaits an operand nor leaves a parenthesis open."""
    tokens, awaited, depth = [], True, 0
    for m in _TOKEN.finditer(text, start):  # lazily: what follows the expression isn't read
        t = m[0].lower()
        if t.isspace():
            if not tokens or not (awaited or depth > 0):
                break
            continue
        operand = t not in _BINDS and t not in "()"
        if (operand or t == "(") and not awaited:
            break  # two operands without an operator: prose follows the expression
        if t in _BINDS and awaited:
            break
        tokens.append(t)
        depth += (t == "(") - (t == ")")
        awaited = t in _BINDS or t == "("
    labels: set[str] = set()
    stack: list[float] = []
    names: list[str] = []
    for t in to_postfix(tokens):
        if t in _BINDS:
            if len(stack) < 2:
                continue
            b, a = stack.pop(), stack.pop()
            right = names.pop()
            if t == "with":
                labels.discard(right)
                stack.append(a + (1 - a) * EXCEPTION_SHARE)
            else:
                names.pop()
                names.append("")
                stack.append(max(a, b) if t == "or" else min(a, b))
        else:
            label = label_of(t)
            labels.add(label)
            names.append(label)
            stack.append(OPENNESS.get(label, UNKNOWN_OPENNESS))
    return labels, min(stack) if stack else None


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**NOTICE_PHRASES, **BASE_PHRASES, TAG: ""}.items():
        found.add_word(f" {phrase} ", (len(phrase.split()), len(phrase) + 2, label, phrase in BASE_PHRASES))
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def _translation() -> bytes:
    table = lower_ascii_table().copy()
    table[~ALNUM_WORDS & (table < 0x80)] = 0x20
    table[[i for i in range(128) if not ALNUM_WORDS[i] and not ord("A") <= i <= ord("Z")]] = 0x20
    return table.astype(np.uint8).tobytes()


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, list[str], list[str], float, list[tuple[str, int, int]]]:
    """Words, places of base phrases, first and last of their words, base labels, all labels, score, all places."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_translation()).split()
    line = b" " + b" ".join(words) + b" "
    joined = line.decode("utf-8", "surrogatepass")
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    scores: list[float] = []
    places: list[tuple[str, int, int]] = []
    tags = 0
    spaces: np.ndarray | None = None
    for end, (n, length, label, is_base) in automaton().iter(joined):
        if not label:
            tags += 1
            continue
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) == 0x20)
        seen = int(np.searchsorted(spaces, end - length + 1))
        places.append((label, seen, n))
        labels.add(label)
        scores.append(OPENNESS[label])
        if is_base:
            base.append(seen)
            base_labels.add(label)
    if tags:
        for m in re.finditer(r"(?i)spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier\s*:?", text or ""):
            own, score = evaluate(text, m.end())
            labels |= own
            if score is not None:
                scores.append(score)
    return len(words), len(base), min(base, default=None), max(base, default=None), sorted(base_labels), sorted(labels), min(scores, default=0.0), places


SCAN_FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,word:long,n_words:long>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, base phrases, labels, score (openness of the strictest statement, 0
    without any) and every place where a phrase stands. One pass, no shuffle."""
    bound_batches(docs.sparkSession)
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    found = T._parse_datatype_string(SCAN_FIELDS).fields
    schema = T.StructType([T.StructField(fresh([f.name for f in found], id_col), docs.schema[id_col].dataType), *found])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64())]))]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, places, first, last, base, labels, score, spots = scan_text(text.as_py())
                rows.append((n, places, first, last, ",".join(base), ",".join(labels), score, [{"label": x, "word": w, "n_words": k} for x, w, k in spots]))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[f.name for f in schema])

    return own.mapInArrow(released(scan), schema)
