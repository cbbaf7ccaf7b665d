"""Run records, chunk fetches and documents: edges and contracts."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recallframe.operators import guards, runs
from recallframe.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_protocols_and_modes(spark):
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert one(spark, runs.evidence_protocol(yes, no, no)) and one(spark, runs.evidence_protocol(no, yes, yes)) and not one(spark, runs.evidence_protocol(none, none, none))
    with pytest.raises(PySparkException):
        one(spark, runs.evidence_protocol(no, yes, no))
    mode = lambda saved, unit, first: one(spark, runs.run_mode(F.lit(saved).cast("string"), F.lit(unit).cast("string"), F.lit(first).cast("string"), "default", {"inject": "memory-inject"}, "fact"))
    assert [mode("inject", "fact", None), mode("inject", None, "x"), mode(None, None, "x"), mode("", None, None)] == ["memory-inject", "inject", "x", "default"]
    assert one(spark, runs.model_key(F.lit(" LLAMA3 "), {"llama": "org/llama"})) == "org/llama" and one(spark, runs.reasoning_parser(F.lit("mistral"))) is None
    assert one(spark, runs.eligible(F.lit(" 4 "))) and not one(spark, runs.eligible(F.lit("5"))) and not one(spark, runs.eligible(F.lit(None).cast("string")))


def test_chunks(spark):
    asked = spark.createDataFrame([("r", ["b", "a", "b"])], "request_id string, fact_ids array<string>")
    chunks = spark.createDataFrame([("a", 1), ("b", 2)], "fact_id string, tokens int")
    assert [(r.pos, r.tokens) for r in runs.fetch_chunks(asked, chunks).orderBy("pos").collect()] == [(0, 2), (1, 1), (2, 2)]
    for bad in (lambda: runs.fetch_chunks(asked, chunks.where("fact_id = 'a'")), lambda: runs.fetch_chunks(asked, chunks, 2)):
        with pytest.raises(PySparkException):
            bad().collect()
    rows = spark.createDataFrame([(0, "x")], "ordinal long, payload string")
    with pytest.raises(PySparkException):
        runs.by_payload_ordinal(spark.createDataFrame([(1, 0, 5)], "query_id int, place int, ordinal long"), rows).collect()


def test_facts_from_hits_raise(spark):
    schema = "id string, payload map<string,string>, metadata map<string,string>, rank int"
    good = ("f", {"memory": " m ", "source_session_index": "2", "source_turn_id": "s:x:4"}, None, 1)
    r = runs.fact_from_hit(spark.createDataFrame([good], schema)).first()
    assert (r.text, r.session_index, r.session_id, r.turn_index) == ("m", 2, "session_2", 4)
    for i, payload in ((" ", good[1]), ("f", {"memory": " "}), ("f", {**good[1], "source_session_index": "-1"}), ("f", {**good[1], "source_session_index": "x"})):
        with pytest.raises(PySparkException):
            runs.fact_from_hit(spark.createDataFrame([(i, payload, None, 1)], schema)).collect()


def test_sets_and_texts(spark):
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    gap = one(spark, runs.missing_counts(ids(10, 20), ids(20, 30)))
    assert (gap.missing, gap.unexpected) == ([10], [30])
    assert one(spark, runs.same_ids(ids("a", "b"), ids("b", "a"))) and not one(spark, runs.same_ids(ids("a", "a"), ids("a", "b")))
    assert one(spark, runs.texts_of_results(F.array(F.create_map(F.lit("memory"), F.lit(" a ")), F.create_map(F.lit("text"), F.lit("b")), F.create_map(F.lit("x"), F.lit("c"))))) == ["a", "b"]
    good, bad = runs.quarantine(spark.createDataFrame([("{}",), ("[]",)], "response string"), guards.extraction_problem())
    assert good.count() == 0 and {r.problem for r in bad.collect()} == {"keys", "not an object"}
    assert one(spark, runs.host_projection(F.lit(89), F.lit(100))) and not one(spark, runs.host_projection(F.lit(91), F.lit(100)))


def test_documents(spark, tmp_path):
    path = str(tmp_path / "d" / "x.json")
    assert sinks.read_document(spark, path, {"a": 1}) == {"a": 1}
    sinks.write_document(spark, path, {"b": [1, "ü"]})
    sinks.write_document(spark, path, {"c": 2, "b": "ü"}, canonical=True)
    assert (tmp_path / "d" / "x.json").read_text() == '{"b":"ü","c":2}' and sinks.read_document(spark, path, {}) == {"b": "ü", "c": 2}
    with pytest.raises(ValueError):
        sinks.write_document(spark, path, float("nan"), canonical=True)
    rows = spark.createDataFrame([("kv", 1.5, [1])], "condition string, throughput_qps double, ids array<int>")
    sinks.write_throughput_reports(rows.drop("ids"), str(tmp_path / "t"), {"rows": 1}, ["# Report"])
    assert sinks.read_document(spark, str(tmp_path / "t/summary.json"), {}) == {"rows": 1}
    sinks.write_query_reports(rows, rows.select("throughput_qps"), str(tmp_path / "q"))
    assert spark.read.csv(str(tmp_path / "q/query_metrics"), header=True).first().ids == "[1]"
