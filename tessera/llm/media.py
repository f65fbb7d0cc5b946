"""Media columns: texts as WAV samples, and spectral-peak pair fingerprints of WAV columns.

The bytes of a text are the samples of an 8-bit mono file. A fingerprint is an array of (t, code):
the frames of the short-time Fourier transform, their strongest bins, and pairs of peaks of nearby
frames whose two bins and distance in time make up the code.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import replaced, utf8, without

#: Payloads are padded to a multiple of it.
UNIT = 576
PAD = b"\xff"
RATE = 8_000
#: Samples from one frame to the next, a quarter of UNIT, so that every payload has frames to pair.
FRAME = UNIT // 4
#: Samples that a frame's window covers: half of each neighbour's too.
WINDOW = 2 * FRAME
#: Peaks of a frame, and later frames that each peak is paired with.
PEAKS, AHEAD = 2, 2
#: Frames transformed at once: bounds the memory that a long file takes.
_FRAMES_AT_ONCE = 4096


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """The strongest bins of every frame, the strongest first: frames x PEAKS. The lowest bin of equally strong ones counts.

    Windows overlap by half and are centred on their frames; beyond both ends the samples are
    mirrored. Bins are whole cycles in FRAME samples: the two halves of a window are added up.
    """
    window = np.hanning(WINDOW + 1)[:-1]
    raw = np.frombuffer(samples, np.uint8)
    n = raw.size // FRAME
    raw = np.pad(raw, (WINDOW - FRAME) // 2, mode="symmetric") if n else raw
    out = []
    for first in range(0, n, _FRAMES_AT_ONCE):
        last = min(n, first + _FRAMES_AT_ONCE)
        frames = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[first * FRAME : (last - 1) * FRAME + 1 : FRAME].astype(np.float32)
        frames = (frames - frames.mean(axis=1, keepdims=True)) * window
        power = np.abs(np.fft.rfft(frames.reshape(len(frames), -1, FRAME).sum(axis=1), axis=1))
        power = np.round(power[:, 1:], 2)
        found = []
        for _ in range(PEAKS):
            at = power.argmax(axis=1)
            found.append(at + 1)
            power[np.arange(len(at)), at] = -1
        out.append(np.stack(found, axis=1))
    return np.concatenate(out) if out else np.zeros((0, PEAKS), dtype=np.int64)


def pairs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(t, code) of each pair of a frame's peak and one of the AHEAD frames after it, by t."""
    times, codes = [], []
    for step in range(1, AHEAD + 1):
        if len(found) > step:
            a, b = found[:-step, :, None], found[step:, None, :]
            code = ((a << 12 | b) << 4 | step).reshape(len(found) - step, -1)
            codes.append(code)
            times.append(np.repeat(np.arange(len(code))[:, None], code.shape[1], axis=1))
    if not codes:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, c = np.concatenate([x.ravel() for x in times]), np.concatenate([x.ravel() for x in codes])
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def text_to_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with the text replaced by a WAV column and n_bytes, the length of its UTF-8.

    The payload is that UTF-8 with bytes 255 up to a positive multiple of UNIT; null counts as
    empty; very long texts make one file each, whole. Repeated rows are kept, equal texts give equal
    files, an empty table gives an empty one, and input columns that are named as results are
    replaced.
    """
    docs = without(docs, *{media, "n_bytes"} - {text})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            values = [v.as_py() for v in batch.column(place)]
            files = [to_wav(v + PAD * (UNIT - len(v) % UNIT if len(v) % UNIT or not v else 0)) for v in values]
            rest = batch.select([n for n in batch.schema.names if n != text]) if batch.num_columns > 1 else None
            arrays = [pa.array([len(v) for v in values], pa.int64()), pa.array(files, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(rest.columns if rest else []), *arrays], names=[*(rest.schema.names if rest else []), "n_bytes", media])

    fields = [f for f in docs.schema.fields if f.name != text]
    return docs.withColumn(text, utf8(text)).mapInArrow(write, T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())]))


def fingerprint(table: DataFrame, media: str = "media") -> DataFrame:
    """table with payload (the samples read back) and fingerprint, an array of (t, code) by t and then code. Of bins of equal power, rounded, the lower is the peak. Null media give null; input columns of those names are replaced."""
    table = without(table, *{"payload", "fingerprint"} - {media})
    entry = T.ArrayType(T.StructType([T.StructField("t", T.IntegerType()), T.StructField("code", T.IntegerType())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, times, codes, ends = [], [], [], [0]
            nulls = []
            for value in batch.column(batch.schema.get_field_index(media)):
                payload = from_wav(value.as_py()) if value.is_valid else None
                t, c = pairs(peaks(payload or b""))
                payloads.append(payload)
                nulls.append(payload is None)
                times.append(t)
                codes.append(c)
                ends.append(ends[-1] + len(t))
            flat = lambda x: pa.array(np.concatenate([*x, np.zeros(0, np.int32)]).astype(np.int32))
            entries = pa.StructArray.from_arrays([flat(times), flat(codes)], names=["t", "code"])
            yield replaced(batch, payload=pa.array(payloads, pa.binary()), fingerprint=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries, mask=pa.array(nulls, pa.bool_())))

    return table.mapInArrow(read, T.StructType([*table.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("fingerprint", entry)]))
