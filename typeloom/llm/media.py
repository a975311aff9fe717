"""Media columns: texts' bytes as lossless WebP images, read back and described.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of UNIT, are the
RGBA samples of images that are UNIT bytes (144 pixels) wide; a text of more than ROWS rows
takes several files, one after the other, so that files are alike in size and many are
decoded in lockstep. Every stored file is decoded again, and digests and features come from
the decoded pixels. One pass over the rows: no shuffle.

Null and empty texts are one row of bytes 255. Equal texts give equal values. Memory: a few
times 4 CHUNK_BYTES of text, or the longest text. Empty tables give none; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm import webp
from typeloom.llm.common import CHUNK_BYTES, chunks

UNIT = 576
#: Rows of pixels in one file at most.
ROWS = 24


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text + b"\xff" * ((-len(text)) % UNIT or (0 if text else UNIT))


def store(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT // 4, 4)
    return b"".join(webp.encode(rows[k : k + ROWS]) for k in range(0, len(rows), ROWS))


def files_of(media: bytes) -> list[bytes]:
    """The files that stand after each other in media."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append(media[at : at + size])
        at += size
    return out


def load_many(media: list[bytes]) -> list[np.ndarray]:
    """For each value of a media column the pixels of all its files, below each other."""
    files = [files_of(m) for m in media]
    images = iter(webp.decode_many([f for some in files for f in some]))
    out = []
    for some in files:
        parts = [next(images) for _ in some]
        out.append(np.concatenate(parts) if len(parts) > 1 else parts[0])
    return out


def load(media: bytes) -> np.ndarray:
    return load_many([media])[0]


def feature(pixels: np.ndarray) -> str:
    """Size, mean sample and the shares (in thousandths) of eight ranges of sample values."""
    flat = pixels.reshape(-1)
    bins = np.bincount(flat >> 5, minlength=8)
    return f"{pixels.shape[1]}x{pixels.shape[0]};{int(flat.sum(dtype=np.int64)) * 1000 // flat.size};" + "-".join(map(str, (bins * 1000 // flat.size).tolist()))


def _described(batches):
    for b in batches:
        texts, out = [t.as_py() or b"" for t in b.column(1)], []
        for lo, hi in chunks(texts, 4 * CHUNK_BYTES):
            stored = [store(payload_of(t)) for t in texts[lo:hi]]
            for raw, media, pixels in zip(texts[lo:hi], stored, load_many(stored)):
                back = pixels.tobytes()
                out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)))
        cols = list(zip(*out)) if out else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *names])


def _stored(batches):
    for b in batches:
        media = [store(payload_of(t.as_py())) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.as_py() or b"") for t in b.column(1)], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stored files) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t")).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def describe(docs: DataFrame) -> DataFrame:
    """Digests and features of each row's media, read back from its stored form."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(_described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
