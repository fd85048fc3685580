"""Texts stored as sound: WAV files of 8-bit samples, short-time Fourier transforms, and fingerprints of spectral-peak pairs.

A payload is the text's UTF-8 (null: empty) with zero bytes up to a positive multiple of 64. Each byte is one sample of a mono
WAV file, so storage is lossless. Features are computed from the bytes read back: frames of FRAME samples every HOP samples, the loudest
PEAKS bins of each (ties: the lower bin), and pairs of each peak with the peaks of the next SPAN frames. A pair is one long, its time code first:
frame << 24 | bin << 16 | later bin << 8 | frames between. Equal texts give equal values. Silence (an empty text) has no peaks
and no pairs. Very long texts are transformed in pieces. Rows that repeat each come back.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FRAME = 128
HOP = FRAME // 2  # payloads are multiples of it
RATE = 8000
PEAKS = 2
SPAN = 3
PIECE = 4096  # frames transformed at once
WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("a mono file of 8-bit samples is needed")
        return w.readframes(w.getnframes())


def peaks(payload: bytes) -> np.ndarray:
    """(frames, PEAKS) bins of the loudest peaks of each frame, loudest first, -1 for none."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, HOP)
    if len(x) == 1:
        x = np.concatenate([x, np.full((1, HOP), 0, np.uint8)])
    n = len(x) - 1
    out = np.full((n, PEAKS), -1, np.int64)
    for s in range(0, n, PIECE):
        hops = x[s : s + PIECE + 1].astype(np.float32)
        part = np.concatenate([hops[:-1], hops[1:]], 1)
        part = (part - part.mean(1, keepdims=True)) * WINDOW
        power = np.abs(np.fft.rfft(part, axis=1)[:, 1 : FRAME // 2])
        power = np.round(power, 2)
        inner = np.zeros_like(power)
        inner[:, 1:-1] = np.where((power[:, 1:-1] > power[:, :-2]) & (power[:, 1:-1] >= power[:, 2:]), power[:, 1:-1], 0)
        for k in range(PEAKS):
            best = inner.argmax(1)
            rows = np.arange(len(inner))
            out[s : s + len(inner), k] = np.where(inner[rows, best] > 0, best + 1, -1)
            inner[rows, best] = 0
    return out


def pairs(p: np.ndarray) -> np.ndarray:
    """Time-coded pairs, ascending."""
    found = []
    frames = np.arange(len(p))
    for d in range(1, SPAN + 1):
        for i in range(PEAKS):
            for j in range(PEAKS):
                a, b = p[:-d, i], p[d:, j]
                ok = (a >= 0) & (b >= 0)
                found.append((frames[:-d][ok] << 24) | (a[ok] << 16) | (b[ok] << 8) | d)
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def media_columns(docs: DataFrame, digest: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) to the stored sound and its features, a row for each of docs.

    (doc_id, n_bytes, media, payload, fingerprints); with digest, what is stored stays in the task and its digests come out:
    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, n_frames, n_pairs, feature).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                rows = []
                for t in part.column("text").to_pylist():
                    media = to_wav(payload_of(t))
                    payload = from_wav(media)
                    p = peaks(payload)
                    f = pairs(p)
                    n = len((t or "").encode())
                    if digest:
                        mean = f"{len(p)}:{len(f)}:{hashlib.sha256(f.astype('<i8').tobytes()).hexdigest()}"
                        rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), len(p), len(f), mean))
                    else:
                        rows.append((n, media, payload, f))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    i, st, by = pa.int64(), pa.string(), pa.binary()
    fields = {"n_bytes": i, "payload_bytes": i, "payload_sha256": st, "tail_crc32": i, "media_bytes": i, "media_sha256": st, "n_frames": i, "n_pairs": i, "feature": st} if digest else {"n_bytes": i, "media": by, "payload": by, "fingerprints": pa.list_(i)}
    names, types = ["doc_id", *fields], list(fields.values())
    sql = {i: "long", st: "string", by: "binary"}
    schema = ", ".join(["doc_id long", *(f"{k} {sql.get(v, 'array<long>')}" for k, v in fields.items())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
