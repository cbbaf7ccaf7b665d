"""Entries of one large JSON document, read by several tasks.

Spark's text reader cuts a file into byte ranges and hands out what stands between closing braces, so a range begins right
behind a brace, wherever a document can be read. What a range can't know is whether it begins within a string, and how deep. So
each range is summed up for both cases (one row), the sums are chained from the file's beginning, and the ranges are read again
with the state that they begin in. An entry that a border cuts comes in pieces, which meet by their place in the file.

The root is a list, or an object whose values may be lists; anything else raises, as does a document that doesn't end where its
brackets do. Entries keep their text, byte for byte but for blanks around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.guards import require
from .written import written

#: Ranges of all files at most: their states are broadcast, a slim row each.
RANGES = 1 << 20
_STRING_END = re.compile(rb'(?:[^"\\]|\\.)*+"', re.DOTALL)
_MARKS = re.compile(rb'"(?:[^"\\]|\\.)*+"|["\[\]{},]', re.DOTALL)
_BOM = b"\xef\xbb\xbf"


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """What stands before each closing brace, with the file, its size and the byte at which the range begins."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Consecutive rows of each range."""
    rows = ((tuple(batch.column(i)[k].as_py() for i in range(batch.num_columns - 1)), batch.column(batch.num_columns - 1)[k].as_py()) for batch in batches for k in range(batch.num_rows))
    row = next(rows, None)
    while row is not None:
        own = row[0]

        def pieces(own: tuple = own) -> Iterator[bytes]:
            nonlocal row
            while row is not None and row[0] == own:
                yield row[1]
                row = next(rows, None)

        yield own, pieces()


def _marks(chunk: bytes, inside: bool) -> Iterator[tuple[bytes, int, int]]:
    """Brackets, commas and strings outside of strings with their place; last the state (b"in" or b"out")."""
    at = 0
    if inside:
        end = _STRING_END.match(chunk)
        if end is None:
            yield b"in", len(chunk), len(chunk)
            return
        at = end.end()
    for m in _MARKS.finditer(chunk, at):
        if m[0] == b'"':  # a string that goes on behind this chunk
            yield b"in", len(chunk), len(chunk)
            return
        yield m[0], m.start(), m.end()
    yield b"out", len(chunk), len(chunk)


_SUMS = "file string, at long, size long, bytes long, root string, inside0 boolean, deeper0 long, inside1 boolean, deeper1 long"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range's bytes, the root's first character (of a file's first range) and, for a range that begins outside of a string
    and one that begins within, whether it ends within one and how much deeper."""
    out = []
    for (file, at, size), pieces in _by_range(batches):
        inside, deeper, total, root = [False, True], [0, 0], 0, None
        for piece in pieces:
            if total == 0 and at == 0:
                root = (piece.removeprefix(_BOM).lstrip()[:1] or b"}").decode("latin-1")
            total += len(piece) + 1
            chunk = piece + b"}"
            for k in (0, 1):
                for mark, _, _ in _marks(chunk, inside[k]):
                    if mark in (b"{", b"["):
                        deeper[k] += 1
                    elif mark in (b"}", b"]"):
                        deeper[k] -= 1
                    elif mark in (b"in", b"out"):
                        inside[k] = mark == b"in"
        out.append((file, at, size, total, root, inside[0], deeper[0], inside[1], deeper[1]))
    names = [x.split()[0] for x in _SUMS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def _states(sums: DataFrame) -> DataFrame:
    """file, at, root, inside, depth (when the range begins) and last (whether the file's last piece has no brace behind it)."""
    listed = F.array_sort(F.collect_list(F.struct("at", "size", "bytes", "root", "inside0", "deeper0", "inside1", "deeper1")))  # a slim row for each range of a file
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("depth"), F.array().cast("array<struct<at:bigint,inside:boolean,depth:bigint>>").alias("all"))
    chained = F.aggregate(
        "ranges", start,
        lambda now, r: F.struct(
            F.when(now["inside"], r["inside1"]).otherwise(r["inside0"]).alias("inside"), (now["depth"] + F.when(now["inside"], r["deeper1"]).otherwise(r["deeper0"])).alias("depth"),
            F.concat(now["all"], F.array(F.struct(r["at"].alias("at"), now["inside"].alias("inside"), now["depth"].alias("depth")))).alias("all"),
        ),
    )
    per = sums.groupBy("file").agg(listed.alias("ranges")).withColumn("end", chained)
    total = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["bytes"])
    root = F.element_at("ranges", 1)["root"]
    # the last piece was taken to have a brace behind it; where the bytes say that it has none, the file ends one level deeper
    bare = F.pmod(total - F.element_at("ranges", 1)["size"], F.lit(3)) == 1  # the reader may have left out a byte order mark of 3 bytes
    per = per.select("file", root.alias("root"), "end", bare.alias("bare"))
    per = require(per, F.col("root").isin("[", "{"), F.concat(F.lit("unsupported root in "), F.col("file")))
    per = require(per, ~F.col("end.inside") & (F.col("end.depth") + F.col("bare").cast("long") == 0), F.concat(F.lit("not one JSON document: "), F.col("file")))
    rows = per.select("file", "root", "bare", F.element_at("end.all", -1)["at"].alias("final"), F.explode("end.all").alias("r"))
    return rows.select("file", F.col("r.at").alias("at"), "root", F.col("r.inside").alias("inside"), F.col("r.depth").alias("depth"), (F.col("bare") & (F.col("r.at") == F.col("final"))).alias("bare"))


_PIECES = "file string, at long, run int, idx int, nth long, nth_object long, key string, listed boolean, text binary, begins boolean, ends boolean"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of entries (text) and marks of new lists (key, listed) of each range, in order. run counts a range's lists from 0, which
    is the one that it begins in; nth counts the entries that began in a run."""
    names = [x.split()[0] for x in _PIECES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.bool_(), pa.bool_()]

    def flushed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    for (file, at, size, root, inside, depth, bare), pieces in _by_range(batches):
        out: list[tuple] = []
        level = 1 if root == "[" else 2
        run, idx, nth, nth_object = 0, 0, 0, 0
        begins, held, wants_key, key = depth < level, [], False, None
        weight = 0
        first = at == 0

        def ended(text: bytes, ends: bool) -> None:
            nonlocal idx, nth, nth_object, held, begins, weight
            whole = b"".join([*held, text])
            held = []
            whole = whole.lstrip() if begins else whole
            whole = whole.rstrip() if ends else whole
            if whole or not begins:
                out.append((file, at, run, idx, nth, nth_object, None, None, whole, begins, ends))
                weight += len(whole)
                idx += 1
                if begins:
                    nth += 1
                    nth_object += whole[:1] == b"{"
            begins = True

        last = None
        while True:
            piece = next(pieces, None)
            if last is not None:
                chunk = last + b"}" if piece is not None or not bare else last
                if first:
                    chunk, first = chunk.removeprefix(_BOM), False
                start = 0
                for mark, a, b in _marks(chunk, inside):
                    if mark in (b"in", b"out"):
                        inside = mark == b"in"
                    elif mark in (b"{", b"["):
                        depth += 1
                        wants_key = mark == b"{" and depth == 1
                        if depth == level:
                            run, nth, nth_object, start, held, begins = run + 1, 0, 0, b, [], True
                            out.append((file, at, run, idx, 0, 0, key, mark == b"[", None, False, False))
                            idx += 1
                    elif mark in (b"}", b"]"):
                        if depth == level:
                            ended(chunk[start:a], True)
                            start = b
                        depth -= 1
                    elif mark == b",":
                        if depth == level:
                            ended(chunk[start:a], True)
                            start = b
                        wants_key = depth == 1
                    elif wants_key:
                        key, wants_key = mark[1:-1].decode("utf-8", "replace"), False
                if depth >= level:
                    held.append(chunk[start:])
            if piece is None:
                break
            last = piece
            if weight > 4 << 20 or len(out) > 5000:
                yield flushed(out)
                out, weight = [], 0
        if depth >= level:
            ended(b"", False)
        yield flushed(out)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the lists in the documents at ``path``: file, list (number of the list in its file, from 1), key (its name in an
    object, else null), pos (from 0), nth_object (objects before it) and record (text)."""
    sums = written(_ranges(spark, path).mapInArrow(_summed, _SUMS), "json-ranges")
    if sums.count() > RANGES:
        raise ValueError(f"more than {RANGES} ranges: raise spark.sql.files.maxPartitionBytes")
    rows = _ranges(spark, path).join(F.broadcast(written(_states(sums), "json-states")), ["file", "at"])
    rows = rows.select("file", "at", "size", "root", "inside", "depth", "bare", "value")
    got = written(rows.mapInArrow(_entries, _PIECES), "json-pieces")

    # lists: a slim row for each list and range that it stands in
    mark = F.col("listed").isNotNull()
    runs = got.groupBy("file", "at", "run").agg(F.max("key").alias("key"), F.max("listed").alias("listed"), F.count_if("begins").alias("n"), F.count_if(F.col("begins") & (F.hex(F.substring("text", 1, 1)) == "7B")).alias("objects"))
    order = Window.partitionBy("file").orderBy("at", "run")
    runs = runs.withColumn("list", F.count("listed").over(order))
    of = Window.partitionBy("file", "list").orderBy("at", "run")
    before = of.rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "file", "at", "run", "list", F.first("key").over(of).alias("key"), F.first("listed").over(of).alias("listed"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("objects").over(before), F.lit(0)).alias("objects_before"),
    ).where("listed")
    placed = got.where(~mark).drop("key", "listed").join(runs, ["file", "at", "run"])
    placed = placed.select("file", "list", "key", "at", "idx", (F.col("nth") + F.col("n_before")).alias("pos"), (F.col("nth_object") + F.col("objects_before")).alias("nth_object"), "text", "begins", "ends")
    whole = placed.where("begins and ends").select("file", "list", "key", "pos", "nth_object", F.col("text").cast("string").alias("record"))
    # what borders cut: two pieces at most in each range
    cut = placed.where("not (begins and ends)")
    which = cut.select("file", "at", "idx", F.sum(F.col("begins").cast("int")).over(Window.partitionBy("file").orderBy("at", "idx")).alias("which"))
    joined = cut.join(which, ["file", "at", "idx"]).groupBy("file", "which").agg(
        F.max(F.when(F.col("begins"), F.struct("list", "key", "pos", "nth_object"))).alias("first"), F.array_sort(F.collect_list(F.struct("at", "idx", F.hex("text").alias("text")))).alias("pieces")
    )
    text = F.unhex(F.array_join(F.transform("pieces", lambda p: p["text"]), "")).cast("string")
    return whole.union(joined.select("file", "first.list", "first.key", "first.pos", "first.nth_object", text.alias("record")))
