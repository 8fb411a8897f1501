"""Media columns: WAV bytes, short-time Fourier transforms, spectral-peak pair fingerprints.

A text's UTF-8 bytes, padded with blanks to a positive multiple of 192, become the samples of an 8-bit mono WAV, byte
for sample. Frames of 128 samples, 64 apart, are transformed under a Hann window. In each frame the strongest bin of each of
three bands is a peak (if it has any energy); each peak is paired with the peaks of the next two frames in the same or the next
band. A pair is one integer: the time of the first peak (in frames) in the high 32 bits, then both bins and their distance in
time. A table of documents with their WAV (binary) and their pairs (array of long, by time) is written; all digests are then
reckoned from what is read back from that table, the WAV through the wave module.

Defined results: null and empty texts are 192 blanks; silence (all samples equal) still has peaks only where
there is energy, so it may have none; equal texts give equal values. Added columns take the place of columns of their
names; all other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import stored, table

UNIT, RATE = 192, 8000
FRAME, HOP = 128, 64
#: First bins of the bands, and the bin after the last.
BANDS = (1, 10, 24, 65)
#: Frames that are transformed at once.
CHUNK = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def padded(data: bytes) -> bytes:
    return data + b" " * ((-len(data) % UNIT) or (0 if data else UNIT))


def peaks(samples: bytes) -> np.ndarray:
    """(frame, band) -> bin of the strongest peak; 0 where a band has no energy."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = []
    for at in range(0, len(frames), CHUNK):
        part = frames[at : at + CHUNK]
        power = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * _WINDOW, axis=1))
        best = np.stack([power[:, lo:hi].argmax(axis=1) + lo for lo, hi in zip(BANDS, BANDS[1:], strict=False)], axis=1)
        out.append(np.where(np.take_along_axis(power, best, axis=1) > 1e-3, best, 0))
    return np.concatenate(out)


def fingerprint(samples: bytes) -> np.ndarray:
    """Sorted time-coded pairs of peaks."""
    found, parts = peaks(samples), []
    time = np.arange(len(found), dtype=np.int64)
    for gap in (1, 2):
        for band in range(found.shape[1]):
            for other in (band, band + 1):
                if other < found.shape[1] and len(found) > gap:
                    a, b = found[:-gap, band], found[gap:, other]
                    both = (a > 0) & (b > 0)
                    parts.append((time[:-gap][both] << 32) | (a[both] << 16) | (b[both] << 4) | gap)
    return np.sort(np.concatenate(parts)).astype(np.int64) if parts else np.empty(0, np.int64)


def _mapped(rows: DataFrame, added: list[StructField], kinds: list[pa.DataType], one) -> DataFrame:
    """rows with the columns that `one` gives for each row, from a dict of its columns that are named in one.reads."""
    rows = rows.drop(*(f.name for f in added if f.name not in one.reads))
    schema, at = StructType([*rows.schema.fields, *added]), [rows.columns.index(c) for c in one.reads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                columns = zip(*(one(*values) for values in zip(*(batch.column(k) for k in at), strict=True)), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def media_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `_n_bytes`, `_media` (WAV) and `_pairs` (array<long>). One pass, row by row."""

    def one(value: pa.StringScalar) -> tuple:
        data = (value.as_py() or "").encode("utf-8", "replace")
        payload = padded(data)
        return len(data), to_wav(payload), fingerprint(payload)

    one.reads = (text,)
    added = [StructField("_n_bytes", LongType()), StructField("_media", BinaryType()), StructField("_pairs", ArrayType(LongType()))]
    return _mapped(docs, added, [pa.int64(), pa.binary(), pa.list_(pa.int64())], one)


def media_digests(media: DataFrame) -> DataFrame:
    """A table with `_media` and `_pairs`, and what its stored bytes and pairs say: `_payload_bytes`, `_payload_sha256`, `_tail_crc32` (of
    the last 16 bytes), `_media_bytes`, `_media_sha256` and `_feature` (number and digest of the pairs)."""

    def one(stored_media: pa.BinaryScalar, stored_pairs: pa.ListScalar) -> tuple:
        data, pairs = stored_media.as_py(), stored_pairs.values.to_numpy(zero_copy_only=False)
        payload = from_wav(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{len(pairs)}:{hashlib.sha256(pairs.astype('<i8').tobytes()).hexdigest()[:32]}"

    one.reads = ("_media", "_pairs")
    kinds = {"_payload_bytes": LongType(), "_payload_sha256": StringType(), "_tail_crc32": LongType(), "_media_bytes": LongType(), "_media_sha256": StringType(), "_feature": StringType()}
    return _mapped(media, [StructField(n, t) for n, t in kinds.items()], [pa.int64() if t == LongType() else pa.string() for t in kinds.values()], one)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(media_columns(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "media")
    found = media_digests(media).drop("_media", "_pairs")
    return found.toDF(*(c.removeprefix("_") for c in found.columns))
