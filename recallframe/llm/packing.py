"""Packing by bounded-space online best fit: every partition keeps a fixed number of open windows, places each
piece in the window that it fills best, emits the fullest where none fits, and finally merges what is left.

A document is its token ids and one end id; a null or empty text is the end id alone. Long documents are cut at
the window length; a piece that fits nowhere tops the fullest window up if that would leave too much padding.
Rows that repeat are packed as often as they come, and ``row_id`` tells them apart. Ties go to the window opened first.
An empty table has no pieces; columns other than id and text are not looked at. Leftover windows of all partitions meet in groups of
``MERGE_PARTITIONS`` partitions, so that no task's share grows with the input.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import REMEMBERED, bound_batches, fresh, released, stage_table

LENGTH = 2048
OPEN_WINDOWS = 32
#: Most padding that an emitted window keeps if the next piece can be cut to fill it.
MAX_PAD = 16
MERGE_PARTITIONS = 4
END_ID = 1
#: Bytes of token ids and runs that each of a worker's two generations of memory holds at most.
CACHE_BYTES = 20 << 20
#: Letters of Latin-1 after lower-casing; between them and anything else lies a pre-token boundary.
_RUNS = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+")
_BEYOND = re.compile(r"[^\x00-\xff]|['\x1c-\x1f\x85]|<\|")
_SEPARATORS = re.compile(r"[\x1c-\x1f\x85]")


def byte_letters() -> dict[int, str]:
    """Latin-1 characters as the byte-level alphabet spells their UTF-8 bytes (printable Latin-1 stands for itself,
    other bytes count on from 256)."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in kept}
    for i, b in enumerate(x for x in range(256) if x not in names):
        names[b] = chr(256 + i)
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(256)}


class RunEncoder(dict):
    """Token ids (as bytes) of runs of text, encoded once and remembered in two generations.

    Pre-tokens never cross white space, nor the border of letters and other characters where no apostrophe, special
    token or character beyond Latin-1 is about; so a text's ids are those of its runs one after the other. A run of
    letters goes to the vocabulary's merge model, every other run through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.spell = byte_letters()
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1)]
        probes = ["hello", "straße", "été", "a", "zz", "niño", "ÿß", "thereof"]
        self.direct = all(self.letters(p) == self.whole(p) for p in probes)
        # runs are encoded apart only if the tokenizer lower-cases and parts words as this class does
        mixed = ["Straße Ends.", "a1 B2, (été)!", "x-Y_z  NIÑO\n\tÄb.c", "3.5% & A/B"]
        self.parted = self.direct and all(b"".join(map(self.whole, _RUNS.findall(p.lower()))) == b"".join(map(self.whole, p.split())) == self.whole(p) for p in mixed)

    def whole(self, run: str) -> bytes:
        return np.asarray(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, run: str) -> bytes:
        four = self.four
        return b"".join([four[t.id] for t in self.merge(run if run.isascii() else run.translate(self.spell))])

    def __missing__(self, run: str) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            ids = self.letters(run) if self.direct and run.isalpha() and max(run) <= "\xff" and run == run.lower() else self.whole(run)
        if len(run) < 64:
            size = 160 + len(run) + len(ids)  # with the objects' own
            if self.held + size > CACHE_BYTES:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[run] = ids
            self.held += size
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, with the end id last."""
        if not self.parted:
            parts = [self.whole(text)]
        elif not _BEYOND.search(text):
            parts = [*map(self.__getitem__, _RUNS.findall(text.lower()))]
        elif not _SEPARATORS.search(text):
            parts = [*map(self.__getitem__, text.split())]
        else:
            parts = [self.whole(text)]
        parts.append(END_ID.to_bytes(4, "little"))
        return np.frombuffer(b"".join(parts), "<u4")


_ENCODERS: dict[str, RunEncoder] = {}


def encoder(path: str) -> RunEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = RunEncoder(path)
        REMEMBERED["packing"] = _ENCODERS.clear
    return _ENCODERS[path]


class Windows:
    """A fixed number of open windows, filled best fit. Pieces are (key, start, ids)."""

    def __init__(self, length: int = LENGTH, count: int = OPEN_WINDOWS, max_pad: int = MAX_PAD):
        self.length, self.count, self.max_pad = length, count, max_pad
        self.open: list[tuple[int, list[tuple[Any, int, np.ndarray]]]] = []  # free space, pieces

    def add(self, key: Any, start: int, ids: np.ndarray) -> Iterator[list[tuple[Any, int, np.ndarray]]]:
        """Place a piece; yields the windows that are emitted meanwhile."""
        while len(ids) >= self.length:
            yield [(key, start, ids[: self.length])]
            ids, start = ids[self.length :], start + self.length
        if not len(ids):
            return
        best = min((i for i, w in enumerate(self.open) if w[0] >= len(ids)), key=lambda i: self.open[i][0], default=None)
        if best is None and len(self.open) >= self.count:
            full = min(range(len(self.open)), key=lambda i: self.open[i][0])
            free, pieces = self.open.pop(full)
            if free > self.max_pad:  # the piece is longer than the free space, as it fits nowhere
                pieces.append((key, start, ids[:free]))
                ids, start = ids[free:], start + free
            yield pieces
        if best is None:
            self.open.append((self.length - len(ids), [(key, start, ids)]))
            return
        free, pieces = self.open[best]
        pieces.append((key, start, ids))
        if free == len(ids):
            self.open.pop(best)
            yield pieces
        else:
            self.open[best] = (free - len(ids), pieces)

    def rest(self) -> list[list[tuple[Any, int, np.ndarray]]]:
        out, self.open = [w[1] for w in self.open], []
        return out


def ids_list(ids: np.ndarray) -> list[int]:
    return ids.tolist()


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, open_windows: int = OPEN_WINDOWS, digest: Callable[[np.ndarray], Any] = ids_list, digest_field: str = "ids array<int>") -> DataFrame:
    """One row per piece: its document, place in it, length, ids (or what ``digest`` makes of them), the document's
    token count, sequence and offset, and the row that it comes from. Sequences hold at most ``length`` tokens without
    gaps. An ``id_col`` that is called like one of the other columns comes back with underscores behind its name."""
    spark = docs.sparkSession
    digest_type = T._parse_datatype_string(digest_field).fields[0]
    taken = ["start", "length", digest_type.name, "doc_tokens", "sequence_id", "offset", "row_id", "left_ids", "part"]
    bound_batches(spark)
    id_type = docs.schema[id_col].dataType
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    id_col = fresh(taken, id_col)
    out_schema = T.StructType([T.StructField(id_col, id_type), *T._parse_datatype_string("start long, length long").fields, digest_type, *T._parse_datatype_string("doc_tokens long, sequence_id long, offset long, row_id long").fields])
    first_schema = T.StructType([*out_schema.fields, T.StructField("left_ids", T.BinaryType()), T.StructField("part", T.LongType())])
    arrow_id = pa.null()

    def to_batch(rows: list[tuple], id_kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [id_kind, pa.int64(), pa.int64(), to_arrow_type(digest_type.dataType), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[: len(names)])], names=names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        code, windows, seq = encoder(tokenizer_path), Windows(length, open_windows), part << 33
        names = first_schema.fieldNames()
        rows: list[tuple] = []
        kind = arrow_id
        row = part << 33
        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = code.encode(text.as_py() or "")
                row += 1
                for done in windows.add((doc.as_py(), len(ids), row), 0, ids):
                    at = 0
                    for (key, n, r), start, piece in done:
                        rows.append((key, start, len(piece), digest(piece), n, seq, at, r, None, None))
                        at += len(piece)
                    seq += 1
            if len(rows) > 4000:
                yield to_batch(rows, kind, names)
                rows = []
        for pieces in windows.rest():
            rows += [(key, start, len(piece), None, n, None, None, r, piece.tobytes(), part) for (key, n, r), start, piece in pieces]
        if rows:
            yield to_batch(rows, kind, names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        windows, seq = Windows(length, 1, 0), (1 << 62) + (TaskContext.get().partitionId() << 33)
        names = out_schema.fieldNames()
        kind = arrow_id
        for batch in batches:
            rows: list[tuple] = []
            kind = batch.column(0).type
            for doc, start, n, raw, r in zip(*(batch.column(i) for i in range(5)), strict=True):
                for done in windows.add((doc.as_py(), n.as_py(), r.as_py()), start.as_py(), np.frombuffer(raw.as_py(), np.uint32)):
                    at = 0
                    for (key, tokens, row), begin, piece in done:
                        rows.append((key, begin, len(piece), digest(piece), tokens, seq, at, row))
                        at += len(piece)
                    seq += 1
            if rows:
                yield to_batch(rows, kind, names)
        rows = []
        for pieces in windows.rest():
            at = 0
            for (key, tokens, row), begin, piece in pieces:
                rows.append((key, begin, len(piece), digest(piece), tokens, seq, at, row))
                at += len(piece)
            seq += 1
        if rows:
            yield to_batch(rows, kind, names)

    packed = stage_table(own.mapInArrow(released(local, "packing"), first_schema), "packed")
    left = packed.where("left_ids is not null")
    parts = packed.agg(F.max("part")).first()[0]
    groups = 1 if parts is None else -(-(parts + 1) // MERGE_PARTITIONS)
    left = left.select(id_col, "start", "doc_tokens", "left_ids", "row_id", F.expr(f"cast(part div {MERGE_PARTITIONS} as int)").alias("grp"), "part", F.col("length").alias("n"))
    left = left.repartitionByRange(groups, "grp").sortWithinPartitions("grp", F.desc("n"), "part", id_col, "start").select(id_col, "start", "doc_tokens", "left_ids", "row_id")
    merged = left.mapInArrow(released(merge, "packing"), out_schema)
    return packed.where("left_ids is null").select(*out_schema.fieldNames()).unionByName(merged)
