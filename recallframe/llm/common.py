"""Shared pieces of the training-data operators: durable stage tables and vectorised text hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Bytes of text that one vectorised step holds at a time (a longer document is taken alone).
CHUNK_BYTES = 1 << 19
_PATHS: list[tuple[SparkSession, str]] = []


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) that hold within the block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage_table(df: DataFrame, name: str, parts: int | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there. ``parts`` bounds the number
    of files where the number of rows is known. The shuffle files of the write go as soon as it is done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/recallframe-{name}-{uuid.uuid4().hex}"
    _PATHS.append((spark, path))
    writer = (df.coalesce(parts) if parts else df).write
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        (writer.option("compression", codec) if codec else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage_table(*tables: DataFrame) -> None:
    """Delete stage tables that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, table._stage_path
        _delete(spark, path)
        _PATHS[:] = [x for x in _PATHS if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_stage_tables() -> None:
    """Delete the stage tables of this process (those that a lazy result reads last until then)."""
    while _PATHS:
        spark, path = _PATHS.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit
            return


atexit.register(drop_stage_tables)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, so that long texts don't pile up in a Python worker. The bounds hold when
    a lazy result runs, so they stay in the session; narrower ones that are set already are kept."""
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 4 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        have = spark.conf.get(key).rstrip("b")
        if not (have.isdigit() and 0 < int(have) <= most):
            spark.conf.set(key, str(most))


def release_memory() -> None:
    """Hand free memory of this Python worker back to the system: reused workers else keep what their largest partition
    took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


#: What operators remember in a Python worker from one partition to the next, by owner; another operator's work ends it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow, which frees the worker's memory when a partition ends, and what other owners remembered
    before it begins."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [k for k in REMEMBERED if k != owner]
        for k in others:
            REMEMBERED.pop(k)()
        if others:
            release_memory()
        try:
            yield from work(batches)
        finally:
            release_memory()

    return run


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores until no column is called so (Spark's names know no case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_slices(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``texts`` with about ``limit`` bytes each, one row at least."""
    if len(texts) == 0:
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(off, off[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last
        first = last


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of consecutive rows and each row's offsets in them (null: empty)."""
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1]
    off = off.astype(np.int64)
    if off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=int(off[-1]))[off[0] :]
    return data, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def word_table(separators: Callable[[int], bool]) -> np.ndarray:
    return np.array([not separators(b) for b in range(256)], dtype=bool)


#: Words are runs of bytes other than space and \t\n\v\f\r; UTF-8 trail bytes are never separators.
SPACE_WORDS = word_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
#: Words are runs of digits, letters a-z (after lower-casing A-Z) and non-ASCII bytes.
ALNUM_WORDS = word_table(lambda b: b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F)


class WordHasher:
    """Hashes of all words of a run of documents at once, by prefix sums of a polynomial hash.

    A word's hash is the difference of two prefix sums times an inverse power, so no loop over words or
    bytes runs in Python. A-Z and a-z hash alike.
    """

    def __init__(self, is_word: np.ndarray, seed: int = 20):
        rng = np.random.default_rng(seed)
        table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.table = table[lower_ascii_table()]
        self.is_word = is_word
        self.base = int(rng.integers(2**40, 2**62)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.power = np.full(n, self.base, np.uint64)
        self.back = np.full(n, self.inverse, np.uint64)
        self.power[0] = self.back[0] = 1
        np.cumprod(self.power, out=self.power)
        np.cumprod(self.back, out=self.back)

    def spans(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word and the row it stands in."""
        word = self.is_word[data]
        if not len(word):
            z = np.zeros(0, np.int64)
            return z, z, z
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        edges = off[1:-1]
        edges = edges[edges < len(word)]
        before[edges] = False
        starts = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        after[-1] = False
        after[:-1] = word[1:]
        edges = edges[edges > 0]
        after[edges - 1] = False
        ends = np.flatnonzero(word & ~after) + 1
        rows = np.searchsorted(off, starts, side="right") - 1
        return starts, ends, rows

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each span of bytes; spans come in order of their starts."""
        return self.prefix_hashes(data, starts, ends, [None])[0]

    def prefix_hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: list[int | None]) -> list[np.ndarray]:
        """For each length, the hash of each span's first so many bytes (the whole span if shorter, or for None)."""
        out = [np.empty(len(starts), np.uint64) for _ in lengths]
        step = 1 << 18
        first = 0
        while first < len(starts):
            base = int(starts[first])
            last = max(first + 1, int(np.searchsorted(starts, base + step)))
            stop = int(ends[first:last].max())
            if stop - base + 1 > len(self.power):
                self._grow(1 << int(stop - base + 1).bit_length())
            sums = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(self.table[data[base:stop]] * self.power[: stop - base], out=sums[1:])
            s, e = starts[first:last] - base, ends[first:last] - base
            low, back = sums[s], self.back[s]
            for values, length in zip(out, lengths, strict=True):
                cut = e if length is None else np.minimum(e, s + length)
                values[first:last] = (sums[cut] - low) * back + (cut - s).astype(np.uint64)
            first = last
        if len(self.power) > 1 << 20:  # a very long word came by
            self._grow(1 << 16)
        return [mix64(values) for values in out]


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive words from each position (len - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            factor = np.uint64((int(factor) * int(step) + 2 * j + 1) % 2**64)
            acc += words[j : j + n] * (factor | np.uint64(1))
    return mix64(acc)


#: Bits of the bounded filter that thins documents before they are joined (2 MB, whatever the input).
FILTER_BITS = 24


def filter_bits(ids: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of the ids in column doc: FILTER_BITS fix its size, whatever the number of ids."""
    words = ids.select(F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS)).alias("bit")).selectExpr("cast(bit div 64 as int) as word", "shiftleft(1L, cast(bit % 64 as int)) as mask")
    got = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    bits[got["word"].to_numpy()] = got["mask"].to_numpy()
    return bits


def thinned(own: DataFrame, bits: np.ndarray) -> DataFrame:
    """Rows (doc, text) whose id may be among those of the filter; an exact join follows."""
    packed = bits.tobytes()
    hashed = own.select("doc", "text", F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS)).alias("bit"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(packed, np.uint64)
        for batch in batches:
            at = batch.column(2).to_numpy().astype(np.uint64)
            hit = known[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool))).select(["doc", "text"])

    return hashed.mapInArrow(released(pick), own.schema)


def repeated_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[bool, bool]:
    """Whether rows repeat an id, and whether such rows have different texts. Ids and hashes alone are shuffled."""
    h = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    ids = docs.where(docs[id_col].isNotNull()).groupBy(docs[id_col]).agg(F.count(F.lit(1)).alias("n"), F.min(h).alias("lo"), F.max(h).alias("hi"))
    got = ids.agg(F.max("n").alias("n"), F.max((F.col("lo") != F.col("hi")).cast("int")).alias("apart")).first()
    return (got.n or 0) > 1, bool(got.apart)


def text_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, str]:
    """For tables whose rows repeat ids with different texts: the rows with an id and a number (in the column whose name
    comes third) that equal ids with equal texts share and that rises with the id; and the table (node, id)."""
    h = fresh(docs.columns, "text_hash")
    node = fresh([*docs.columns, h], "node")
    rows = docs.where(docs[id_col].isNotNull()).withColumn(h, F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    keys = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(h).alias("h")).distinct().repartitionByRange("id", "h").sortWithinPartitions("id", "h")
    keys = stage_table(keys.select("id", "h", F.monotonically_increasing_id().alias("node")), "nodes")
    key_id, key_h = (fresh([*docs.columns, h, node], f"{node}_{x}") for x in ("id", "hash"))
    named = keys.select(F.col("id").alias(key_id), F.col("h").alias(key_h), F.col("node").alias(node))
    out = rows.join(named, (rows[id_col] == F.col(key_id)) & (F.col(h) == F.col(key_h)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], node), keys.select("node", "id"), node


#: Rows of a key from which a join deals them into parts, and keys that may have so many: their list is broadcast.
PART_ROWS, HOT_KEYS = 1 << 14, 10_000


def dealt_join(many: DataFrame, one: DataFrame, counts: DataFrame, key: str, total: int, by: str) -> DataFrame:
    """Join of many rows to the one row of their key, in which no task gets a hot key's rows: a key with more than
    ``max(PART_ROWS, total / HOT_KEYS)`` of the ``total`` rows is dealt by a hash of column ``by`` into parts of about so many, and
    its one row goes to each. ``counts`` (key, n) may leave out keys with few rows; at most HOT_KEYS are hot."""
    part_rows = max(PART_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(counts.where(F.col("n") > part_rows).select(key, F.ceil(F.col("n") / part_rows).alias("dealt_parts")))
    parts = F.coalesce("dealt_parts", F.lit(1).cast("long"))
    left = many.join(hot, key, "left").withColumn("dealt_part", F.pmod(F.xxhash64(by), parts)).drop("dealt_parts")
    right = one.join(hot, key, "left").withColumn("dealt_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("dealt_parts")
    return left.join(right, [key, "dealt_part"]).drop("dealt_part")


def id_text(id_col: str) -> str:
    """SQL for crc32 of an id's text (a null id counts as the empty text)."""
    return f"crc32(encode(coalesce(cast(`{id_col}` as string), ''), 'UTF-8'))"


def labelled_sample(docs: DataFrame, labels: DataFrame, value: str, where: str, bound: int, bytes_bound: int | None = None, seed: int = 7) -> DataFrame:
    """At most ``bound`` labelled documents, drawn by a hash of their id: columns doc_id, value, text (whole).

    With ``bytes_bound`` the draw ends before the row whose text would pass so many bytes in all (one row at least). The
    sample is drawn from the slim label table and reaches the documents as a broadcast of at most ``bound`` rows, so no
    text is shuffled but theirs. Of rows that repeat an id the smallest label and the smallest text count.
    """
    drawn = F.xxhash64(F.lit(seed), "l_id")
    own = labels.select(F.col("doc_id").alias("l_id"), F.col(value).cast("int").alias("value")).where(f"value is not null and l_id is not null and {where.replace('doc_id', 'l_id')}")
    own = own.groupBy("l_id").agg(F.min("value").alias("value")).orderBy(drawn, "l_id").limit(bound)
    texts = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    if bytes_bound is not None:
        sizes = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(own), F.col("doc_id") == F.col("l_id"))
        sizes = sizes.groupBy("l_id", "value").agg(F.max("size").cast("long").alias("size")).withColumn("drawn", drawn).orderBy("drawn", "l_id").collect()  # ``bound`` rows at most
        kept, total = [], 0
        for r in sizes:
            total += r["size"]
            if kept and total > bytes_bound:
                break
            kept.append((r["l_id"], r["value"]))
        own = docs.sparkSession.createDataFrame(kept, own.schema)
    texts = texts.join(F.broadcast(own), F.col("doc_id") == F.col("l_id"))
    return texts.groupBy("doc_id", "value").agg(F.min("text").alias("text"))
