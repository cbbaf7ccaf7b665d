"""Registries over streams, judged records that survive kills, and tokens by byte-pair merging."""

import json
import random
from datetime import datetime, timedelta

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from recallframe.operators import tokens
from recallframe.streaming import registry
from recallframe.streaming.judged import JudgedRecords
from tokenizers import Tokenizer

OPERATIONS = "namespace string, ts timestamp, seq long, op string, name string, backend string, value string"


# --- registry -------------------------------------------------------------------------------------------------


def plain_answers(ops):
    out, spaces = [], {}
    for space, _, seq, op, name, _backend, value in sorted(ops, key=lambda o: (o[1], o[2])):
        entries = spaces.setdefault(space, {})
        if op == registry.REGISTER:
            entries[name] = value
        elif op == registry.CLEAR:
            entries.clear()
        else:
            out.append((space, seq, name, entries.get(name)))
    return sorted(out, key=str)


def random_operations(seed, n=120):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    kinds = [registry.REGISTER] * 4 + [registry.LOOK_UP] * 5 + [registry.CLEAR]
    return [(rng.choice("ab"), start + timedelta(seconds=rng.randint(0, 40)), i, rng.choice(kinds), rng.choice("xyz"), "graph", rng.choice([str(i), None])) for i in range(n)]


def streamed(spark, parts, base):
    """The answers after one run for each list of parts; every part is a file that comes alone."""
    end = ("end", datetime(2030, 1, 1), -1, registry.LOOK_UP, None, None, None)
    for run, files in enumerate([*parts, [[end]]]):
        for rows in files:
            spark.createDataFrame(rows, OPERATIONS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = registry.streamed_answers(registry.operations_stream(spark, f"{base}/in", spark.createDataFrame([], OPERATIONS).schema), "30 days")
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(registry.ANSWERS).parquet(f"{base}/out").where("namespace <> 'end'")
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_any_order_of_arrival_and_a_restart(spark, tmp_path):
    ops = random_operations(1)
    want = plain_answers(ops)
    table = spark.createDataFrame(ops, OPERATIONS)
    assert sorted((tuple(r) for r in registry.batch_answers(table).collect()), key=str) == want and len(want) > 30
    mixed = random.Random(2).sample(ops, len(ops))
    assert streamed(spark, [[mixed[:50], mixed[50:80]], [mixed[80:]]], str(tmp_path)) == want
    assert registry.one_backend(table).count() == sum(o[3] == registry.REGISTER for o in ops)


def test_waiting_operations_are_merged_from_pages(monkeypatch):
    """Runs and pages of a few operations, entries that leave memory, and a state that is never read whole."""
    from collections import Counter
    from types import SimpleNamespace

    class Map(dict):
        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

        def getValue(self, key):  # noqa: N802
            return self[key]

        containsKey, removeKey, iterator = dict.__contains__, dict.__delitem__, lambda self: iter(list(self.items()))  # noqa: N815

    class Value:
        now = None
        get, exists = lambda self: self.now, lambda self: self.now is not None
        update, clear = lambda self, now: setattr(self, "now", now), lambda self: setattr(self, "now", None)

    kept, timers = Counter(), set()
    handle = SimpleNamespace(getMapState=lambda *_: Map(), getValueState=lambda *_: Value(), registerTimer=timers.add, deleteTimer=timers.discard)
    monkeypatch.setattr(registry, "RUN", 20)
    monkeypatch.setattr(registry, "PAGE", 3)
    monkeypatch.setattr(registry, "KNOWN", 2)
    one, got = registry._Registry(), []
    one.init(handle)
    ops = [("a", *o[1:]) for o in random_operations(5, 300)]
    fields = ("namespace", "ts", "seq", "op", "name", "backend", "value")
    mixed = random.Random(6).sample(ops, len(ops))
    for part in (mixed[:130], mixed[130:]):
        list(one.handleInputRows(("a",), (SimpleNamespace(**dict(zip(fields, o, strict=True))) for o in part), None))
    assert max(len(json.loads(v[0])) for v in one.pages.values()) == 3 and len(one.runs) == 16
    for late in (10, 25, 100):
        mark = int((datetime(2024, 1, 1) + timedelta(seconds=late)).timestamp() * 1000)
        timers.clear()
        got += [(r.namespace, r.seq, r.name, r.value) for r in one.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark), None)]
        kept[late] = len(one.runs)
    assert sorted(got, key=str) == plain_answers(ops) and not one.pages and not one.runs and not timers and kept[10]


def test_another_backend_raises(spark, tmp_path):
    at = datetime(2024, 1, 1)
    ops = [("a", at, 1, registry.REGISTER, "x", "graph", "1"), ("a", at, 2, registry.REGISTER, "y", "exact", "2")]
    cleared = [ops[0], ("a", at, 2, registry.CLEAR, None, None, None), ("a", at, 3, registry.REGISTER, "y", "exact", "2"), ("a", at, 4, registry.LOOK_UP, "y", None, None), ("a", at, 5, registry.LOOK_UP, "x", None, None)]
    with pytest.raises(Exception, match="another backend"):
        registry.one_backend(spark.createDataFrame(ops, OPERATIONS)).collect()
    with pytest.raises(Exception, match="holds entries of graph, not exact"):
        streamed(spark, [[ops]], str(tmp_path / "a"))
    assert registry.one_backend(spark.createDataFrame(cleared, OPERATIONS)).count() == 2
    assert streamed(spark, [[cleared]], str(tmp_path / "b")) == plain_answers(cleared) == [("a", 4, "y", "2"), ("a", 5, "x", None)]


# --- judged records -------------------------------------------------------------------------------------------


def judge_that_dies(after=None, calls=None, error=True):
    calls = [] if calls is None else calls

    def judge(rows):
        calls.append(1)
        if after is not None and len(calls) > after:
            raise RuntimeError("killed")
        failed = F.when((F.col("id") % 5 == 0) & F.lit(error), "no connection")
        return rows.withColumns({"response": F.when(F.col("id") % 3 == 0, "what?").otherwise((F.col("id") % 2 == 0).cast("string")), "error": failed, "skipped": F.col("id") % 7 == 0})

    return judge


def expected(i, error=True):
    if i % 7 == 0:
        return (None, "", None, "skipped")
    if i % 5 == 0 and error:
        return (None, "no connection", None, "error")
    return (None, "what?", "what?", "unparsed") if i % 3 == 0 else (i % 2 == 0, "", str(i % 2 == 0).lower(), "ok")


def test_records_stand_once_after_kills(spark, tmp_path):
    rows = spark.range(60).select("id", F.concat(F.lit("q"), "id").alias("text"))
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    out = JudgedRecords(spark, str(tmp_path / "out"), "id long, text string")
    assert out.read().count() == 0
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for after in (1, 2):
        with pytest.raises(Exception, match="killed"):
            out.start(stream(), judge_that_dies(after), str(tmp_path / "c")).awaitTermination()
    assert len(out.batches(0)) == 3
    # a batch that was written, but not noted as done, comes again
    commits = sorted((int(p.name) for p in (tmp_path / "c/commits").iterdir() if p.name.isdigit()), reverse=True)
    for p in (tmp_path / "c/commits").glob(f"*{commits[0]}*"):
        p.unlink()
    out.start(stream(), judge_that_dies(), str(tmp_path / "c")).awaitTermination()
    got = {r.id: (r.text, tuple(r.judge)) for r in out.read().collect()}
    assert out.read().count() == 60 and got == {i: (f"q{i}", expected(i)) for i in range(60)}

    # a rewrite that is cut off leaves the old records in place and goes on where it stopped
    with pytest.raises(RuntimeError, match="killed"):
        out.rejudge(judge_that_dies(2, error=False))
    assert out.generation() == 0 and out.read().count() == 60 and out.batches(1) == out.batches(0)[:2]
    calls = []
    assert out.rejudge(judge_that_dies(None, calls, error=False)) == 4 and len(calls) == 4
    assert out.generation() == 1 and {r.id: tuple(r.judge) for r in out.read().collect()} == {i: expected(i, False) for i in range(60)}
    with pytest.raises(ValueError, match="rewritten"):
        out.start(stream(), judge_that_dies(), str(tmp_path / "c"))


# --- tokens ---------------------------------------------------------------------------------------------------

ODD = ["", " ", "ΑΣ ΣΑΣ É İstanbul 日本 😀 \x1c a b\u0085c don't I'LL 'S 123 4ⅷ ½ ::!!--", "a  b\t\n c", "ﬁ Å Å ퟿", "x" * 3000, "<|endoftext|> <|startoftext|>", "  wide　"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_public_vocabulary(spark, small, name):
    path = public_tokenizers.path(name)
    theirs = Tokenizer.from_file(path)
    theirs.encode_special_tokens = True
    known = tokens.load_vocabulary(spark, path)
    texts = [r.text for r in spark.read.parquet(f"{small}/conversations.parquet").collect()] + ODD + [None]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = frame.select("n", tokens.token_ids(known)("text").alias("ids")).orderBy("n").collect()
    assert [r.ids for r in got] == [None if t is None else theirs.encode(t, add_special_tokens=False).ids for t in texts]
    assert tokens.vocabulary_table(spark, path).count() == len(known.ids)


def test_merging_against_plain_merging():
    rng = random.Random(3)
    for _ in range(300):
        ranks, pieces = {}, ["a", "b", "c", "a$", "b$", "c$"]
        for rank in range(rng.randint(1, 12)):
            pair = (rng.choice([p for p in pieces if not p.endswith("$")]), rng.choice(pieces))
            if pair not in ranks:
                ranks[pair] = rank
                pieces.append("".join(pair))
        vocabulary = tokens.Vocabulary({}, ranks, [], "", "$")
        word = [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        plain = [*word[:-1], word[-1] + "$"]
        while pairs := [(ranks[p], i) for i, p in enumerate(zip(plain, plain[1:], strict=False)) if p in ranks]:
            i = min(pairs)[1]
            plain[i : i + 2] = ["".join(plain[i : i + 2])]
        assert vocabulary.merged(word) == plain


def test_parity_and_round_trip(spark):
    known = tokens.load_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    frame = spark.createDataFrame([(t,) for t in [*ODD, None]], "text string")
    same = tokens.checked_parity(frame, tokens.token_ids(known)("text"), tokens.token_ids(known)("text"))
    assert {r.text for r in same.select(tokens.token_texts(known)("ids").alias("text")).collect()} == {*ODD, None}
    with pytest.raises(Exception, match="tokenizers differ"):
        tokens.checked_parity(frame, tokens.token_ids(known)("text"), F.array(F.lit(1))).collect()


def test_other_vocabularies_are_refused(spark, tmp_path):
    for text in ('{"model": {"type": "WordPiece", "vocab": {}}}', '{"model": {"type": "BPE", "unk_token": "?", "vocab": {}, "merges": []}}', '{"normalizer": {"type": "Strip"}, "model": {"type": "BPE", "vocab": {}, "merges": []}}', '{"pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "BPE", "vocab": {}, "merges": []}}'):
        (tmp_path / "v.json").write_text(text)
        with pytest.raises(ValueError):
            tokens.load_vocabulary(spark, str(tmp_path / "v.json"))


def test_tokens_of_a_batch_are_not_python_lists_at_once():
    import tracemalloc

    import pyarrow as pa

    batch = pa.array([None if i % 100 == 7 else str(i) for i in range(5000)])
    tracemalloc.start()
    got = tokens._in_parts(batch, lambda t: [*range(int(t) + 1000, int(t) + 1300)], pa.list_(pa.int32()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # all lists of the batch take 50 MB
    assert len(got) == 5000 and got.null_count == 50 and got[4999].as_py() == [*range(5999, 6299)] and got[7].as_py() is None
    assert len(tokens._in_parts(batch[:0], int, pa.list_(pa.int32()))) == 0
