from collections import Counter, defaultdict

import corpus_pipeline as C
from helpers import awkward, components, jaccard_links
from recallframe.llm import packing
from recallframe.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeated_passages", "source_mixture", "packed_sequences"]
    seen = [docs]
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, seen[-1], SF)
        assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/t{len(seen)}")
        seen.append(spark.read.parquet(path))
    counts = [d.count() for d in seen]
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    texts = {r.doc_id: r.text for r in seen[1].collect()}
    links, _ = jaccard_links(texts)
    assert {r.doc_id for r in seen[2].collect()} == {k for k, c in components(texts, links).items() if k == c}
    assert seen[3].selectExpr("sum(length(text))").first()[0] < seen[2].selectExpr("sum(length(text))").first()[0]
    rows = C.packed_sequences(spark, seen[4], SF).collect()
    code = packing.RunEncoder(tokenizer_file())
    assert sum(r.length for r in rows) == sum(len(code.encode(r.text or "")) for r in seen[4].collect())


def whole(rows):
    """Every sequence is gapless and short enough, every row's pieces cover its ids once: (doc_id, tokens) of the rows."""
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.row_id].append((r.start, r.length, r.doc_id, r.doc_tokens))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= packing.LENGTH
    for p in pieces.values():
        p.sort()
        assert [s for s, *_ in p] == [sum(x[1] for x in p[:i]) for i in range(len(p))] and sum(x[1] for x in p) == p[0][3]
    return Counter(p[0][2:] for p in pieces.values())


def test_run(spark):
    """The run's rows are those of the stages one after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/r-{name}")
        docs = spark.read.parquet(path)
    code = packing.RunEncoder(tokenizer_file())
    want = Counter((r.doc_id, len(code.encode(r.text or ""))) for r in docs.collect())
    got = whole(C.run(spark, SF).collect())
    assert got == want and len(got) > 100 and C.ORACLE_SQL is None


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and long texts, copies: each stage has its defined result, and so have empty tables."""
    docs = awkward(spark)
    stages = dict(C.STAGES)
    ids = lambda d: sorted((r.doc_id is None, r.doc_id or 0) for r in d.collect())
    assert ids(stages["toxicity"](spark, docs, SF)) == ids(docs)
    once = stages["near_duplicates"](spark, docs, SF)
    assert ids(once) == ids(docs.where("doc_id is null or doc_id <> 4"))  # 4 repeats 3
    cut = stages["repeated_passages"](spark, docs, SF)
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, docs.collect()))
    mixed = stages["source_mixture"](spark, docs, SF)
    assert set(ids(mixed)) <= set(ids(docs)) and mixed.columns == docs.columns
    code = packing.RunEncoder(tokenizer_file())
    assert whole(stages["packed_sequences"](spark, docs, SF).collect()) == Counter((r.doc_id, len(code.encode(r.text or ""))) for r in docs.collect())
    for name, stage in C.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0, name


def test_texts_that_share_an_id_pass_each_stage(spark):
    """Copies that the mixture made share an id; later stages and pieces tell rows apart."""
    docs = awkward(spark)
    both = docs.unionByName(docs).unionByName(docs.where("doc_id = 3").selectExpr("doc_id", "'another text' as text", "lang", "source", "n_chars"))
    kept = C.near_duplicates(spark, both, SF).where("doc_id = 3").collect()
    assert sorted(r.text for r in kept) == ["another text", "word"]
    assert sum(whole(C.packed_sequences(spark, both, SF).collect()).values()) == both.count()
