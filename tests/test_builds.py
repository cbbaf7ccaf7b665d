"""Cache files, observed builds and jobs side by side."""

import threading
import time

import pytest
from pyspark.sql import functions as F
from recallframe.operators import builds
from recallframe.sources import cache_files as C


def scan_rows(df):
    """Rows that the scans of an executed plan handed out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()

    def walk(node):
        if "QueryStage" in node.nodeName():
            node = node.plan()
        own = node.metrics().get("numOutputRows").get().value() if node.nodeName().startswith("Scan parquet") else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(plan)


def test_few_keys_read_few_files(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").cast("string").alias("value"))
    C.write_entries(rows.repartition(20, "key"), path, 1)
    asked = rows.where("value in ('3', '77')").select("key").union(spark.createDataFrame([("absent",), (None,)], "key string"))
    got = C.looked_up(asked, path, 1)
    assert sorted(r.value for r in got.collect()) == ["3", "77"]
    assert 2 <= scan_rows(got) <= 4 * 1100  # two files of twenty, and few that only might have held a key
    many = C.looked_up(rows, path, 1)
    assert many.count() == 20_000 and C.looked_up(rows, path, 2).count() == 0 and C.looked_up(rows.limit(0), path, 1).count() == 0


def test_broken_entries(spark, tmp_path):
    path = str(tmp_path / "c")
    make = lambda *rows: spark.createDataFrame(list(rows), "key string, value string")
    C.write_entries(make(("a", "1"), ("b", "2"), ("n", None)), path, 1)
    C.write_entries(make(("a", "3"), ("old", "4")), path, 1)
    C.write_entries(make(("old", "5"),), path, 0)
    bad = C.read_entries(spark, path).where("key = 'b'").select("key", "version", F.lit("changed").alias("value"), (F.col("written") + 10**12).alias("written"), "digest")
    bad.write.mode("append").parquet(path)
    asked = make(("a", ""), ("b", ""), ("n", ""), ("old", ""), ("new", ""))
    with pytest.raises(Exception, match="broken cache entry: b"):
        C.looked_up(asked, path, 1).collect()
    assert {tuple(r) for r in C.looked_up(asked, path, 1, True).collect()} == {("a", "3"), ("b", "2"), ("n", None), ("old", "4")}
    with pytest.raises(Exception, match="not cached: new"):
        C.memoised_in_files(make(("new", "")), path, 1, None).collect()
    with pytest.raises(Exception, match="without a key"):
        C.write_entries(make((None, "x")), path, 1)
    (tmp_path / "c" / "part-zzz.parquet").write_bytes(b"PAR1 no parquet at all PAR1")
    with pytest.raises(Exception):  # noqa: B017  (as Spark says it)
        C.looked_up(make(("a", "")), path, 1).collect()
    calls = []

    def compute(missing):
        calls.append(sorted(r.key for r in missing.collect()))
        return missing.select("key", F.upper("key").alias("value"))

    inputs = spark.createDataFrame([("a", 1), ("new", 2), ("new", 3), ("n", 4)], "key string, seq int")
    got = C.memoised_in_files(inputs, path, 1, compute)
    assert sorted(tuple(r) for r in got.select("key", "seq", F.coalesce("value", F.lit("-")), "hit").collect()) == [("a", 1, "3", True), ("n", 4, "-", True), ("new", 2, "NEW", False), ("new", 3, "NEW", False)]
    assert C.memoised_in_files(inputs, path, 1, compute).where("hit").count() == 4 and calls == [["new"], []]


def test_metrics_come_from_the_writing_job(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ab", [1.0, 2.0], None), (2, "é", None, None), (3, None, [1.0], 5)], "id int, text string, vector array<float>, n int")
    sc = spark.sparkContext
    sc.setJobGroup("observed", "")
    got, step = builds.written_step(rows, str(tmp_path / "t"), "store", {"most": F.max("id")})
    jobs = sc.statusTracker().getJobIdsForGroup("observed")
    sc._jsc.clearJobGroup()
    assert len(jobs) == 1 and got.count() == 3 and step.seconds > 0
    assert step.metrics == {"rows": 3, "bytes": 2 + 2 + 12, "null_id": 0, "null_text": 1, "null_vector": 1, "null_n": 2, "most": 3}
    assert {(r.metric, r.value) for r in builds.build_metrics(spark, [step]).where("step = 'store'").collect()} == set(step.metrics.items())


def test_jobs_side_by_side(spark, tmp_path):
    assert builds.side_by_side(spark, [lambda i=i: spark.range(10 * i).count() for i in range(6)], 3) == [10 * i for i in range(6)]
    assert builds.side_by_side(spark, [], 3) == []
    begun, lock = [], threading.Lock()

    def slow(i):
        with lock:
            begun.append(i)
        slowly = F.udf(lambda x: time.sleep(0.2) or x, "long")
        return spark.range(400).select(slowly("id").alias("id"))

    def work(i):
        if i == 1:
            time.sleep(2)
            raise ValueError("conversation 1 failed")
        return slow(i)

    target = str(tmp_path / "t")
    before = time.time()
    with pytest.raises(ValueError, match="conversation 1 failed"):
        builds.mapped_parts(spark, range(9), work, target, 2)
    assert time.time() - before < 30 and not (tmp_path / "t").exists() and len(begun) < 5
    done = builds.mapped_parts(spark, range(3), lambda i: spark.range(i + 1), target, 2)
    assert sorted((r.part, r.id) for r in done.collect()) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    with pytest.raises(ValueError, match="conversation 1 failed"):
        builds.mapped_parts(spark, [1], work, target, 2)
    assert builds.mapped_parts(spark, [5], lambda i: spark.range(i), target, 2).count() == 5
