import re

import duckdb
from helpers import LOWER, awkward
from recallframe.llm import licenses as L


def test_expressions():
    assert L.to_postfix("a or b and c with d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    assert L.to_postfix("( a or b ) and c".split()) == ["a", "b", "or", "c", "and"]
    labels, score = L.evaluate("(MIT OR GPL-3.0-only) AND LGPL-2.1+ this is prose")
    assert labels == {"mit", "gpl", "lgpl"} and score == 0.6
    assert L.evaluate("GPL-2.0 WITH Classpath-exception-2.0")[1] == 0.75
    assert L.evaluate("") == (set(), None)
    assert L.evaluate("AND OR )(")[1] is None
    assert L.evaluate("MIT OR (GPL-3.0 AND")[1] is not None


def test_places_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in L.scan_licenses(docs).collect()}
    for d in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", d.text.translate(LOWER))
        base = sorted(i for p in L.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(base), base[0] if base else None, base[-1] if base else None)


def test_awkward(spark):
    got = {r.doc_id: r for r in L.scan_licenses(awkward(spark)).collect()}
    assert len(got) == 11
    assert (got[0].n_words, got[0].labels, got[0].score) == (0, "", 0.0)
    assert got[8].n_base == 50 and got[8].base_labels == "mit" and got[8].first_word == 0 and got[8].last_word == 98
    n = L.scan_text("x SPDX-License-Identifier: Apache-2.0 OR MIT\nmore")
    assert n[5] == ["apache", "mit"] and n[6] == 1.0


def test_empty(spark):
    assert L.scan_licenses(awkward(spark).where("false")).count() == 0


def test_long_expressions_are_read_to_their_end():
    long = "SPDX-License-Identifier: " + " AND ".join(["MIT", "Apache-2.0", "BSD-3-Clause"] * 30)
    n = L.scan_text(f"{long} AND (CC0-1.0 OR ISC) AND AGPL-3.0 which is prose\nAND GPL-3.0-only")
    assert n[5] == ["agpl", "apache", "bsd", "cc0", "isc", "mit"] and n[6] == 0.4
    assert L.scan_text("SPDX-License-Identifier: " + "(" * 395 + "MIT OR Zlib" + ")" * 395)[5] == ["mit", "zlib"]
    assert L.scan_text("SPDX-License-Identifier:\nMIT")[5] == []


def test_expressions_go_on_over_lines_while_something_is_open():
    many = "SPDX-License-Identifier: (" + " OR\n ".join(f"Apache-{i}.0" for i in range(200)) + " OR ISC)\nAGPL-3.0"
    assert len(many) > 2000 and L.scan_text(many)[5] == ["apache", "isc"]
    assert L.scan_text("SPDX-License-Identifier: MIT\nOR GPL-3.0")[5] == ["mit"]  # the line neither awaits nor leaves open


def test_base_columns_in_sql(spark, small):
    want = duckdb.sql(f"""
        with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from '{small}/documents.parquet'),
        p as (select doc_id, w, list_filter(range(1, len(w) + 1), lambda i: array_to_string(w[i:i+1], ' ') in ('mit license', 'apache license') or array_to_string(w[i:i+2], ' ') = 'general public license') as hits from w)
        select doc_id, len(w), len(hits), list_min(hits) - 1, list_max(hits) - 1 from p""").fetchall()
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) for r in L.scan_licenses(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert got == set(want)


def test_long_texts_and_names(spark):
    n = L.scan_text("no license here, " * 100_000 + "MIT License " * 3)
    assert n[:4] == (300_006, 3, 300_000, 300_004)
    odd = awkward(spark).withColumnRenamed("doc_id", "labels")
    assert {r.labels_ for r in L.scan_licenses(odd, id_col="labels").collect()} == {r.labels for r in odd.collect()}
