"""Matrices in ``.npy`` files as a Spark source with filter pushdown, and their writer.

``spark.read.format("npy").load(path)`` gives a row for each matrix row: key (the file's name), row and vector. Filters on key that are
equalities, lists or beginnings choose files; comparisons of row choose ranges of rows, of which files are read in parts of
about ``PART_BYTES``. Those are answered whole by the source; any other filter is left to Spark. Pushdown needs
``spark.sql.python.filterPushdown.enabled`` (``register`` sets it).

Paths may lie in any file system that Arrow opens. Files of one dimension (a vector alone) are one row. Floats of 2, 4 or 8 bytes
are read; whatever else, or a file that ends early, raises.
"""

from __future__ import annotations

import ast
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith,
    WriterCommitMessage,
)

PART_BYTES = 32 << 20
_SCHEMA = "key string, row long, vector array<float>"
_ARROW = pa.schema([("key", pa.string()), ("row", pa.int64()), ("vector", pa.list_(pa.float32()))])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Header:
    """Where a matrix begins in its file, its shape and kind."""

    offset: int
    rows: int
    dim: int
    kind: str


def read_header(file: pa.NativeFile, name: str) -> Header:
    start = file.read(8)
    if start[:6] != b"\x93NUMPY" or len(start) < 8:
        raise ValueError(f"no matrix: {name}")
    wide = 2 if start[6] == 1 else 4
    size = int.from_bytes(file.read(wide), "little")
    told = ast.literal_eval(file.read(size).decode("latin-1"))
    shape, kind = told["shape"], np.dtype(told["descr"])
    if kind.kind != "f" or kind.itemsize not in (2, 4, 8) or told["fortran_order"] and len(shape) > 1 or len(shape) not in (1, 2):
        raise ValueError(f"not rows of floats: {name}")
    rows, dim = (1, shape[0]) if len(shape) == 1 else shape
    return Header(8 + wide + size, rows, dim, kind.str)


def key_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".npy")


@dataclass
class RowRange(InputPartition):
    path: str
    header: Header
    first: int
    last: int

    def __init__(self, path: str, header: Header, first: int, last: int):
        self.path, self.header, self.first, self.last = path, header, first, last


class NpyReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes
        self.keys: set[str] | None = None
        self.beginnings: list[str] = []
        self.first, self.last = 0, math.inf

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Take what chooses files or rows; the rest is Spark's."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("key",) and isinstance(f, (EqualTo, EqualNullSafe, In)):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.keys = wanted if self.keys is None else self.keys & wanted
            elif column == ("key",) and isinstance(f, StringStartsWith):
                self.beginnings.append(f.value)
            elif column == ("row",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, f.value + (not isinstance(f, LessThan)))
            elif column in (("key",), ("row",)) and isinstance(f, IsNotNull):
                pass  # neither ever is null
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Row ranges of the files that the filters leave; of those alone the headers are read."""
        fs, root = opened(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        out: list[InputPartition] = []
        for path in sorted(x.path for x in found if x.is_file and x.path.endswith(".npy") and not key_of(x.path).startswith((".", "_"))):
            key = key_of(path)
            if self.keys is not None and key not in self.keys or not all(key.startswith(b) for b in self.beginnings):
                continue
            with fs.open_input_file(path) as file:
                header = read_header(file, path)
            step = max(1, self.part_bytes // max(1, header.dim * np.dtype(header.kind).itemsize))
            last = min(header.rows, self.last)
            out += [RowRange(path, header, a, int(min(a + step, last))) for a in range(int(self.first), int(last), step)]
        return out or [RowRange("", Header(0, 0, 0, "<f4"), 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:  # type: ignore[override]
        if not partition.path:
            return
        fs, _ = opened(self.path)
        h = partition.header
        width = h.dim * np.dtype(h.kind).itemsize
        with fs.open_input_file(partition.path) as file:
            step = max(1, (1 << 20) // max(1, width))
            for first in range(partition.first, partition.last, step):
                n = min(step, partition.last - first)
                file.seek(h.offset + first * width)
                data = file.read(n * width)
                if len(data) != n * width:
                    raise ValueError(f"ends early: {partition.path}")
                values = np.frombuffer(data, h.kind).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * h.dim, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([key_of(partition.path)] * n), pa.array(np.arange(first, first + n)), vectors], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    drafts: list[tuple[str, str]]


class NpyWriter(DataSourceArrowWriter):
    """Rows (key, row, vector) that come by key and row: a matrix for each key. Files appear when the whole job is done."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        drafts: list[tuple[str, str]] = []
        out, key, rows, dim = None, None, 0, 0

        def finish() -> None:
            if out is not None:
                out.close()
                # the header tells the number of rows, which is known now: it goes in front of a copy of the body
                final = f"{root}/_{uuid.uuid4().hex}.draft"
                with fs.open_output_stream(final) as whole, fs.open_input_stream(drafts[-1][0]) as body:
                    whole.write(matrix_header(rows, dim))
                    while chunk := body.read(1 << 20):
                        whole.write(chunk)
                fs.delete_file(drafts[-1][0])
                drafts[-1] = (final, drafts[-1][1])

        done: set[str] = set()
        for batch in iterator:
            keys, vectors = batch.column(batch.schema.get_field_index("key")).to_pylist(), batch.column(batch.schema.get_field_index("vector"))
            for i, name in enumerate(keys):
                if name != key or out is None:
                    finish()
                    if name in done or not name or "/" in name or name.startswith((".", "_")):
                        raise ValueError(f"keys are names of files, and their rows come together: {name!r}")
                    done.add(name)
                    key, rows, dim = name, 0, len(vectors[i])
                    drafts.append((f"{root}/_{uuid.uuid4().hex}.body", f"{root}/{name}.npy"))
                    out = fs.open_output_stream(drafts[-1][0])
                if len(vectors[i]) != dim:
                    raise ValueError(f"vectors of different dimensions under {name}")
                out.write(np.asarray(vectors[i].values, np.float32).tobytes())
                rows += 1
        finish()
        return Written(drafts)

    def commit(self, messages: list[Written | None]) -> None:  # type: ignore[override]
        fs, _ = opened(self.path)
        for draft, final in (x for m in messages if m for x in m.drafts):
            fs.move(draft, final)

    def abort(self, messages: list[Written | None]) -> None:  # type: ignore[override]
        fs, _ = opened(self.path)
        for draft, _final in (x for m in messages if m for x in m.drafts):
            if fs.get_file_info(draft).is_file:
                fs.delete_file(draft)


def matrix_header(rows: int, dim: int) -> bytes:
    told = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({rows}, {dim}), }}"
    told += " " * (-(len(told) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + len(told).to_bytes(2, "little") + told.encode()


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> NpyReader:  # noqa: ANN001
        return NpyReader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)))

    def writer(self, schema, overwrite: bool) -> NpyWriter:  # noqa: ANN001
        return NpyWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """key, row, vector of the matrices at a path."""
    register(spark)
    return spark.read.format("npy").load(path)


def write_npy(vectors: DataFrame, path: str, key: str = "key", order: str = "row", vector: str = "vector") -> None:
    """A matrix for each key, rows in order; files of other keys stay, those of the same keys are replaced."""
    register(vectors.sparkSession)
    own = vectors.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("row"), F.col(vector).cast("array<float>").alias("vector"))
    own.repartition("key").sortWithinPartitions("key", "row").write.format("npy").mode("append").save(path)
