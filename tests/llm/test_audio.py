import hashlib
import os
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from helpers import awkward
from pyspark.sql import functions as F
from recallframe.llm import audio as A


def test_round_trip_and_spans():
    rng = np.random.default_rng(0)
    for n in (64, 6400, 64 * 9000):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert A.wav_payload(A.wav_bytes(payload)) == payload
        patches, spans, loud, energy = A.features(payload)
        assert patches.shape[1:] == (A.PATCH_FRAMES, A.MELS) and len(spans) == len(patches)
        assert (spans[:, 1] > spans[:, 0]).all() and all(b > a for a, b in loud) and len(energy) <= len(patches) * A.PATCH_FRAMES
        table = A.read_tensor_ipc(A.tensor_ipc(patches, spans, A.frames_of(len(energy))))
        assert np.array_equal(table["log_mel"].combine_chunks().to_numpy_ndarray(), patches)


def test_resampling_keeps_a_tone_and_blocks_leave_no_trace(monkeypatch):
    x = np.sin(2 * np.pi * 0.01 * np.arange(4000))
    for up, down in ((1, 2), (3, 2), (2, 3)):
        y = A.resample(x, up, down)
        want = np.sin(2 * np.pi * 0.01 * np.arange(len(y)) * down / up)
        assert np.abs(y - want)[100:-100].max() < 0.02
    data = np.random.default_rng(1).integers(0, 256, 600_000, dtype=np.uint8).tobytes()
    a = A.features(data)[0]
    monkeypatch.setattr(A, "BLOCK", 1 << 22)
    assert np.array_equal(a, A.features(data)[0])


def test_hysteresis():
    assert A.segments(np.array([0, 1, 0.5, 0.5, 0.3, 0.5, 1, 1], np.float32)) == [(1, 4), (6, 8)]
    assert A.segments(np.zeros(3, np.float32)) == []


def test_columns(spark):
    docs = awkward(spark)
    got = {r.doc_id: r for r in A.audio_columns(docs).collect()}
    for d in docs.collect():
        raw = (d.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(r.media) and A.wav_payload(bytes(r.media)) == payload
    assert got[3].feature == got[4].feature
    assert A.audio_columns(docs.where("false")).count() == 0


def test_feature_comes_from_the_stored_tensors(spark):
    docs = awkward(spark)
    got = {r.doc_id: r for r in A.audio_columns(docs).collect()}
    short = {r.doc_id: r for r in A.audio_columns(docs, keep_media=False).collect()}
    for d in docs.collect():
        patches, spans, frames = A.stored_features(bytes(got[d.doc_id].tensors))
        want, at, loud, energy = A.features(A.payload_of(d.text)[0])
        assert np.array_equal(patches, want) and np.array_equal(spans, at) and frames.sum() == len(energy)
        assert [tuple(x) for x in got[d.doc_id].loud] == loud
        assert got[d.doc_id].feature == short[d.doc_id].feature == A.feature_string(want, at, frames, loud)
    # whatever the tables hold is what counts: other media or tensors give other digests
    media = A.media_table(docs.where("doc_id = 3"))
    other = A.tensor_table(media.withColumn("media", F.lit(bytearray(A.wav_bytes(b"x" * 64))))).first()
    assert other.payload_sha256 == hashlib.sha256(b"x" * 64).hexdigest() != got[3].payload_sha256
    kinds = A.read_tensor_ipc(bytes(got[6].tensors)).schema
    assert isinstance(kinds.field("log_mel").type, pa.FixedShapeTensorType) and kinds.field("log_mel").type.shape == [A.PATCH_FRAMES, A.MELS] and {"start_s", "end_s"} <= set(kinds.names)


def test_clashing_names_and_digests_in_sql(spark, tmp_path):
    docs = awkward(spark)
    odd = docs.withColumnRenamed("doc_id", "feature").withColumnRenamed("lang", "media").withColumnRenamed("source", "id")
    rows = A.audio_columns(odd, id_col="feature").collect()
    assert len(rows) == 11 and {r.feature_ for r in rows} == {r.doc_id for r in docs.collect()}
    docs.write.parquet(f"{tmp_path}/docs")
    want = duckdb.sql(f"""select doc_id, n, n + pad, sha256(concat(text, repeat(chr(0), pad::int))) from (select *, case when n > 0 and n % 64 = 0 then 0 else 64 - n % 64 end as pad
        from (select doc_id, coalesce(text, '') as text, strlen(coalesce(text, '')) as n from '{tmp_path}/docs/*.parquet'))""").fetchall()
    got = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) for r in A.audio_columns(docs, keep_media=False).collect()}
    assert got == set(want)


def test_logarithm():
    x = np.concatenate([10.0 ** np.linspace(-12, 12, 5001), [1.0, 0.5, 0.7071067811865476, 2.0]])
    assert np.abs(A.natural_log(x) - np.log(x)).max() < 1e-13


def test_bands_against_plain_sums():
    """Log-mel bands of a frame as plain sums over bins, and the energy, up to the quantum."""
    x = np.sin(np.arange(3000) * 0.3).astype(np.float32)
    bands, energy = A.log_mel(x)
    window, weights = np.hanning(A.FRAME), A.mel_filters()
    for i in (0, 3, len(bands) - 1):
        frame = np.pad(x[i * A.HOP : i * A.HOP + A.FRAME], (0, max(0, A.FRAME - len(x[i * A.HOP : i * A.HOP + A.FRAME]))))
        power = np.abs(np.fft.rfft(frame * window)) ** 2
        want = [np.log(sum(power[j] * weights[j, m] for j in range(len(power))) + 1e-6) for m in range(A.MELS)]
        assert np.abs(bands[i] - want).max() < 1e-3 and abs(energy[i] - np.log(power.sum() + 1e-6)) < 1e-3


def test_tensors_are_the_same_bits_on_other_machines():
    """Other BLAS kernels, threads and vector instructions give the same tensors."""
    code = """
import hashlib, numpy as np
from recallframe.llm import audio as A
h = hashlib.sha256()
rng = np.random.default_rng(3)
for n in (64, 640, 5000, 72000, 600000):
    patches, spans, loud, energy = A.features(rng.integers(0, 256, n, dtype=np.uint8).tobytes())
    h.update(A.tensor_ipc(patches, spans, A.frames_of(len(energy))) + energy.tobytes() + repr(loud).encode())
print(h.hexdigest())
"""
    kinds = [{}, {"OPENBLAS_CORETYPE": "Haswell", "OPENBLAS_NUM_THREADS": "1"}, {"OPENBLAS_CORETYPE": "Nehalem", "OPENBLAS_NUM_THREADS": "4"}, {"NPY_DISABLE_CPU_FEATURES": "AVX512F AVX512CD AVX512_SKX AVX2 FMA3"}]
    got = {subprocess.run([sys.executable, "-W", "ignore", "-c", code], env=os.environ | kind, capture_output=True, text=True, check=True).stdout for kind in kinds}
    assert len(got) == 1
