"""Operators and stages on tables that have every internal and output name as a further column, and texts that share ids."""

import corpus_pipeline
import pytest
from recallframe.llm import audio, capfilters, decontaminate, jaccard, licenses, mixing, packing, passages, repair, spelling
from recallframe.llm.queries import tokenizer_file

NAMES = (
    "node", "node_id", "node_h", "node_hash", "text_hash", "h", "doc", "id", "doc_id_", "own", "src", "n", "tokens", "token", "df", "rep", "component", "component_id", "n_shingles", "level", "l", "comp",
    "major", "cuts", "cut_doc", "cuts_doc", "start_byte", "end_byte", "n_words", "src_doc_id", "identity", "chain", "other", "spans", "mix_key", "mix_count", "mix_copy", "rate", "parts", "start", "length",
    "sequence_id", "offset", "row_id", "media", "tensors", "loud", "feature", "word", "form", "root", "key", "depth", "kind", "b", "at", "gram", "known", "w", "x", "labels", "score", "places", "severity",
    "grade", "toxic", "value", "bit", "raw", "hit_doc", "hit_runs", "runs", "conv", "fate", "copies", "ord", "turns", "roles", "texts", "state", "cell", "block", "tile", "filter", "v", "q",
)
LONG = " ".join(f"w{i}" for i in range(70))


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(1, LONG, "en", "a", 9), (1, "another text of the same id with some more words", "en", "a", 5), (2, LONG + " end", "en", "b", 9), (3, None, None, None, None), (3, "", "en", "a", 0), (None, "no id", "en", "a", 5), (4, LONG, "en", "a", 9), (4, LONG, "en", "a", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.selectExpr("*", *[f"'{x}' as `{x}`" for x in NAMES])


OPERATORS = {
    "op1": lambda d: licenses.scan_licenses(d), "op2": lambda d: passages.repeated_passages(d), "op4": lambda d: jaccard.jaccard_classes(d), "op6": lambda d: mixing.replicate(d),
    "op9": lambda d: packing.pack(d, tokenizer_file()), "op10": lambda d: audio.audio_columns(d), "op11": lambda d: repair.repair_conversations(d, "doc_id", "n_chars", "lang", "text"),
    "op12": lambda d: spelling.spelling_variants(d), "op13": lambda d: decontaminate.contamination(d, d.withColumnRenamed("doc_id", "item_id")),
    "op13 spans": lambda d: decontaminate.decontaminate(d, d.where("doc_id = 1").selectExpr("doc_id as item_id", "text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, crowded, name):
    assert OPERATORS[name](crowded).collect() is not None


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, crowded, small, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, crowded, small)
    assert out.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == crowded.columns


def test_vectors(spark):
    rows = [(i, [1.0, 0.1 * (i % 3)], 1) for i in range(8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", *[f"'{x}' as `{x}`" for x in NAMES])
    assert capfilters.near_duplicate_vectors(frame).count() == 8


@pytest.mark.parametrize("name", ["n_words", "start_byte", "identity", "n_shingles", "component_id"])
def test_an_id_named_like_an_output(spark, name):
    frame = spark.createDataFrame([(1, LONG), (2, LONG), (2, "other words")], "doc_id long, text string").withColumnRenamed("doc_id", name)
    for got in (passages.repeated_passages(frame, name), jaccard.jaccard_classes(frame, name)):
        assert len({c.lower() for c in got.columns}) == len(got.columns) and got.count()
