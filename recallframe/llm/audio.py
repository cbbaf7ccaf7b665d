"""Media columns: a byte payload is stored as 8-bit audio and described by polyphase resampling, overlapped
log-mel filterbanks and hysteresis energy segmentation.

Features come as fixed-shape tensors (``PATCH_FRAMES`` x ``MELS`` float32) with their time spans. They are the same bits on any
machine: tables are rounded to ``TABLE_QUANTUM``, sums run in double precision in a fixed order without BLAS, the logarithm is made
of single additions, products and quotients, and levels are rounded to ``LEVEL_QUANTUM``. A null or empty text is a
payload of zero bytes alone; texts of any length are taken whole, in blocks. Equal texts, repeated rows among them, give
equal values; a silent or even payload has no loud segment. An empty table has no rows. Columns other than id and text are
not looked at; an id column that is called like a result keeps its name with underscores behind.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, drop_stage_table, fresh, released, stage_table

RATE = 16_000
UP, DOWN = 1, 2
OUT_RATE = RATE * UP // DOWN
TAPS = 8
FRAME, HOP, MELS = 512, 256, 32
PATCH_FRAMES = 16
#: Segments start above the higher and end below the lower mark, both as shares of the loudness range.
ENTER, LEAVE = 0.6, 0.4
BLOCK = 1 << 18
TABLE_QUANTUM, LEVEL_QUANTUM = 2.0**-30, 2.0**-12
#: Added to a power before its logarithm is taken, and the level of silence.
FLOOR = 1e-6


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as a mono 8-bit PCM WAV file (a pad byte follows an odd number of samples)."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def wav_payload(media: bytes) -> bytes:
    """Read the samples of a WAV file back, chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


def rounded(x: np.ndarray, quantum: float) -> np.ndarray:
    return np.rint(x / quantum) * quantum


def natural_log(x: np.ndarray) -> np.ndarray:
    """Logarithm of positive doubles, to about 1e-13: x is m * 2**e with m near 1, and log m is 2 atanh((m - 1) / (m + 1)).
    Library logarithms differ in their last bits from one processor to another."""
    m, e = np.frexp(x)
    low = m < 0.7071067811865476
    m, e = np.where(low, 2 * m, m), e - low
    s = (m - 1) / (m + 1)
    z = s * s
    series = np.full_like(z, 1 / 19)
    for k in range(17, 0, -2):
        series = series * z + 1 / k
    return 2 * s * series + e * 0.6931471805599453


def level(power: np.ndarray) -> np.ndarray:
    """Rounded log of a power."""
    return rounded(natural_log(power + FLOOR), LEVEL_QUANTUM).astype(np.float32)


SILENCE = level(np.zeros(1))[0]


@lru_cache(maxsize=4)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """A Hamming-windowed sinc low-pass, dealt into one filter for each of the ``up`` phases."""
    half = taps * max(up, down) // 2
    t = np.arange(-half, half + 1)
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hamming(len(t)) * up
    h = np.pad(h, (0, -len(h) % up))
    return rounded(h, TABLE_QUANTUM).reshape(-1, up).T.astype(np.float32).copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling by up/down: each output sample runs one phase's filter over the input, in blocks."""
    phases = _phases(up, down, taps)
    length = phases.shape[1]
    total = -(-len(x) * up // down)
    delay = (taps * max(up, down)) // 2
    out = np.empty(total, np.float32)
    padded = np.concatenate([np.zeros(length, np.float32), x.astype(np.float32), np.zeros(length + delay // up + 2, np.float32)])
    for q in range(up):  # outputs n with (n * down + delay) % up == phase share one filter and a constant stride
        n0 = np.arange(q, total, up)
        if not len(n0):
            continue
        m = n0 * down + delay
        phase, first = int(m[0] % up), int(m[0] // up)
        stride = down
        filt = phases[phase]
        acc = np.zeros(len(n0), np.float32)
        for k in range(length):
            start = first - k + length
            acc += filt[k] * padded[start : start + stride * (len(n0) - 1) + 1 : stride]
        out[n0] = acc
    return out


@lru_cache(maxsize=2)
def mel_filters(rate: int = OUT_RATE, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Weight of each bin (row) in each band (column): triangles between neighbouring points of the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), mels + 2) / 2595) - 1)
    freq = np.linspace(0, rate / 2, frame // 2 + 1)
    rise = (freq[:, None] - points[:-2]) / (points[1:-1] - points[:-2])
    fall = (points[2:] - freq[:, None]) / (points[2:] - points[1:-1])
    return rounded(np.maximum(0, np.minimum(rise, fall)), TABLE_QUANTUM)


@lru_cache(maxsize=2)
def _band_runs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bins of each band, one band after the other, their weights, and where each band begins among them."""
    bins = [np.flatnonzero(column) for column in mel_filters().T]
    bins = [x if len(x) else np.zeros(1, np.int64) for x in bins]  # a band without a bin sums one weight of 0
    first = np.concatenate([[0], np.cumsum([len(x) for x in bins])[:-1]])
    return np.concatenate(bins), np.concatenate([mel_filters()[x, i] for i, x in enumerate(bins)]), first


def log_mel(x: np.ndarray, block_frames: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel bands and log energy of overlapped Hann frames; the last frame is padded with silence."""
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, max(0, (n - 1) * HOP + FRAME - len(x))))
    window = rounded(np.hanning(FRAME), TABLE_QUANTUM)
    bins, weights, first = _band_runs()
    bands, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for i in range(0, n, block_frames):
        spectrum = np.fft.rfft(frames[i : i + block_frames] * window)
        power = spectrum.real * spectrum.real + spectrum.imag * spectrum.imag
        bands[i : i + block_frames] = level(np.add.reduceat(power[:, bins] * weights, first, axis=1))
        energy[i : i + block_frames] = level(np.add.reduceat(power, [0], axis=1)[:, 0])
    return bands, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Loud runs of frames: entered above the higher mark, left below the lower one."""
    low, high = float(energy.min()), float(energy.max())
    if high <= low:
        return []
    on = energy >= low + ENTER * (high - low)
    off = energy < low + LEAVE * (high - low)
    mark = np.where(on, 1, np.where(off, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    state = np.concatenate([[0], np.where(at >= 0, mark[at], -1) > 0, [0]]).astype(np.int8)
    step = np.diff(state)
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def features(payload: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[float, float]], np.ndarray]:
    """Patches (n x PATCH_FRAMES x MELS, silence-padded), their spans in seconds, loud segments in seconds, energy."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    parts, edge = [], TAPS * DOWN * 4
    for i in range(0, len(x), BLOCK):  # blocks overlap by the filter's reach, so cuts leave no trace
        lead = min(i, edge)
        y = resample(x[i - lead : i + BLOCK + edge])
        parts.append(y[lead * UP // DOWN : (lead + min(BLOCK, len(x) - i)) * UP // DOWN])
    y = np.concatenate(parts) if parts else np.zeros(0, np.float32)
    bands, energy = log_mel(y)
    n = -(-len(bands) // PATCH_FRAMES)
    padded = np.full((n * PATCH_FRAMES, MELS), SILENCE, np.float32)
    padded[: len(bands)] = bands
    begin = np.arange(n) * PATCH_FRAMES * HOP / OUT_RATE
    finish = np.minimum(((np.arange(n) + 1) * PATCH_FRAMES - 1) * HOP + FRAME, max(len(y), 1)) / OUT_RATE
    loud = [(a * HOP / OUT_RATE, ((b - 1) * HOP + FRAME) / OUT_RATE) for a, b in segments(energy)]
    return padded.reshape(n, PATCH_FRAMES, MELS), np.stack([begin, finish], 1), loud, energy


def tensor_array(patches: np.ndarray) -> pa.FixedShapeTensorArray:
    """Patches as Arrow's fixed-shape tensor type."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(patches))


def frames_of(n: int) -> np.ndarray:
    """Frames in each patch of n frames."""
    return np.minimum(PATCH_FRAMES, n - np.arange(0, n, PATCH_FRAMES))


def tensor_ipc(patches: np.ndarray, spans: np.ndarray, frames: np.ndarray) -> bytes:
    """An Arrow IPC stream of the tensors with the time span of each and its number of frames (the rest is silence)."""
    table = pa.table({"start_s": spans[:, 0], "end_s": spans[:, 1], "frames": pa.array(frames, pa.int32()), "log_mel": tensor_array(patches)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def read_tensor_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zero bytes up to a positive multiple of 64, and the length without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % 64 if raw else 64), len(raw)


def stored_features(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patches, spans and numbers of frames as ``tensor_ipc`` stored them."""
    table = read_tensor_ipc(data).combine_chunks()
    patches = table["log_mel"].chunk(0).to_numpy_ndarray()
    return patches, np.stack([table["start_s"].to_numpy(), table["end_s"].to_numpy()], 1), table["frames"].to_numpy()


def feature_string(patches: np.ndarray, spans: np.ndarray, frames: np.ndarray, loud: list[tuple[float, float]]) -> str:
    """Frames, patches, last time, loud segments and the mean of each band."""
    own = np.concatenate([p[:n] for p, n in zip(patches, frames.tolist(), strict=True)])
    return f"frames={len(own)};patches={len(spans)};end={spans[-1, 1]:.4f};loud={len(loud)}:{sum(b - a for a, b in loud):.3f};mel=" + ",".join(f"{v:.2f}" for v in own.mean(0))


LOUD = "loud array<struct<start_s:double,end_s:double>>"
#: Rows of a written Arrow batch: a batch holds media or tensors of so many texts.
ROWS = 64


def _mapped(table: DataFrame, schema: T.StructType, describe: Callable[[dict[str, Any]], tuple]) -> DataFrame:
    """One row of values for each row of ``table``; the first column, the id, is passed through."""
    from pyspark.sql.pandas.types import to_arrow_type

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                part = batch.slice(first, ROWS)
                rows = [describe(r) for r in part.select(range(1, part.num_columns)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=schema.fieldNames())

    return table.mapInArrow(released(work), schema)


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (of the text) and media: each text's payload as a WAV file. One pass, no shuffle."""
    bound_batches(docs.sparkSession)
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def store(row: dict[str, Any]) -> tuple:
        payload, n = payload_of(row["text"])
        return n, wav_bytes(payload)

    return _mapped(own, T.StructType([own.schema["id"], *T._parse_datatype_string("n_bytes long, media binary").fields]), store)


MEDIA_FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def tensor_table(media: DataFrame, keep_media: bool = False) -> DataFrame:
    """For a table of ``media_table``: digests of the media and of the payload read from it, its features as an Arrow stream
    of fixed-shape tensors with time spans, its loud segments and, with ``keep_media``, the media. One pass, no shuffle."""
    bound_batches(media.sparkSession)

    def describe(row: dict[str, Any]) -> tuple:
        back = wav_payload(row["media"])
        patches, spans, loud, energy = features(back)
        tensors = tensor_ipc(patches, spans, frames_of(len(energy)))
        segments = [{"start_s": a, "end_s": b} for a, b in loud]
        return row["n_bytes"], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(row["media"]), hashlib.sha256(row["media"]).hexdigest(), tensors, segments, *((row["media"],) if keep_media else ())

    return _mapped(media, T.StructType([media.schema["id"], *T._parse_datatype_string(f"{MEDIA_FIELDS}, tensors binary, {LOUD}{', media binary' if keep_media else ''}").fields]), describe)


def audio_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """One row per document: n_bytes, digests of the stored WAV and of the payload read back, the feature digest of the
    stored tensors and, with ``keep_media``, the WAV, the Arrow tensor stream and the loud segments.

    Media are written, features are computed from what is read back and written as tensors, and the digest comes from the
    tensors as read back. Three passes, no shuffle; the first table is deleted as soon as the second is written.
    """
    media = stage_table(media_table(docs, id_col, text_col), "media", codec="zstd")
    table = stage_table(tensor_table(media, keep_media), "tensors", codec="zstd")
    drop_stage_table(media)
    fields = [c for c in table.columns if c not in ("id", "media", "tensors", "loud")]

    def digest(row: dict[str, Any]) -> tuple:
        loud = [(x["start_s"], x["end_s"]) for x in row["loud"]]
        more = (row["media"], row["tensors"], row["loud"]) if keep_media else ()
        return *(row[c] for c in fields), feature_string(*stored_features(row["tensors"]), loud), *more

    out = T._parse_datatype_string(f"{MEDIA_FIELDS}, feature string" + (f", media binary, tensors binary, {LOUD}" if keep_media else "")).fields
    name = fresh([f.name for f in out], id_col)
    return _mapped(table, T.StructType([T.StructField(name, docs.schema[id_col].dataType), *out]), digest)
