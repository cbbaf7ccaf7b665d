import hashlib
import math
from collections import Counter

from helpers import awkward
from recallframe.llm import mixing as X


def poisson_count(doc_id, rate, seed=X.SEED):
    parts = max(1, math.ceil(rate / X.PART_MEAN))
    total = 0
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}:{j}".encode()).hexdigest()[: X.DIGITS], 16) / 16**X.DIGITS
        m, c, k = rate / parts, 0.0, 0
        while k < X.TERMS:
            c += math.exp(k * math.log(m) - m - math.lgamma(k + 1))
            if c > u:
                break
            k += 1
        total += k
    return total


def test_counts_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    weights = {"src0": 0.5, "src1": 0.3, "src2": 0.2}
    sizes = Counter(r.source for r in docs.collect())
    got = Counter(r.doc_id for r in X.mix_sources(docs, weights).collect())
    for r in docs.collect():
        w = weights.get(r.source, 0)
        assert got[r.doc_id] == (poisson_count(r.doc_id, w * docs.count() / sizes[r.source]) if w else 0)


def test_shares_reach_their_targets(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "'x' as text", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then 'rare' else null end as source")
    got = Counter(r.source for r in X.replicate(docs, {"hot": 0.2, "rare": 0.8}).select("source").collect())
    assert abs(got["rare"] / 20000 - 0.8) < 0.05 and abs(got["hot"] / 20000 - 0.2) < 0.02 and None not in got
    rates = {r.mix_source: r.mix_rate for r in X.repetition_rates(docs).collect()}
    assert rates["rare"] > rates["hot"] and None in rates


def test_awkward_and_order(spark):
    docs = awkward(spark)
    a, b = X.mix_sources(docs).collect(), X.mix_sources(docs.repartition(3)).collect()
    assert Counter(r.doc_id for r in a) == Counter(r.doc_id for r in b)
    clash = docs.withColumnRenamed("lang", "mix_key")
    assert X.mix_sources(clash).columns == clash.columns
    assert X.mix_sources(docs.where("false")).count() == 0


def test_every_added_name_may_clash(spark):
    docs = awkward(spark)
    plain = Counter(r.doc_id for r in X.mix_sources(docs).collect())
    for name in ("mix_rate", "mix_count", "mix_copy", "shuffle_key", "mix_key", "mix_id", "mix_salt", "mix_source", "mix_docs", "mix_cdf", "mix_parts", "mix_share", "mix_mean", "MIX_COUNT", "j", "u", "c", "k", "terms", "a.b"):
        clash = docs.withColumnRenamed("lang", name)
        out = X.mix_sources(clash)
        assert out.columns == clash.columns, name
        rows = out.collect()
        assert Counter(r.doc_id for r in rows) == plain, name
        want = {r.doc_id: r.lang for r in docs.collect()}
        assert all(r[2] == want[r.doc_id] for r in rows), name


def test_many_sources_meet_in_parts(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('long text ', 2000) as text", "case when id % 3 = 0 then null else concat('s', id % 50) end as source")
    few = Counter((r.doc_id, r.mix_copy) for r in X.replicate(docs).select("doc_id", "mix_copy").collect())
    monkeypatch.setattr(X, "BROADCAST_SOURCES", 2)
    assert Counter((r.doc_id, r.mix_copy) for r in X.replicate(docs).select("doc_id", "mix_copy").collect()) == few


def test_repeated_rows_and_one_source(spark):
    docs = awkward(spark).where("doc_id = 3")
    both = docs.unionByName(docs)
    assert X.mix_sources(both).count() % 2 == 0
    assert X.repetition_rates(both).first().mix_rate == 1.0
