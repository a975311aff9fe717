"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy pass handles at once; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one where none is set (tests on one machine)."""
    sc = spark.sparkContext
    where = sc._jsc.sc().getCheckpointDir()
    if not where.isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
        where = sc._jsc.sc().getCheckpointDir()
    return where.get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage.

    The folder is the cluster's spark.checkpoint.dir. The shuffles behind df are given up at once,
    so a job's disk holds the files of one step, not of all.
    """
    sc = df.sparkSession.sparkContext
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df  # or its plan would keep the shuffles
    # Shuffle files go once the JVM has collected what refers to them; without this they stay until it happens to.
    gc.collect()
    sc._jvm.System.gc()
    return out


def stash(df: DataFrame, **options) -> tuple[DataFrame, Callable[[], None]]:
    """df written as a table (smaller than checkpoint's rows) to the shared folder, with the writer's options, and what deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stash-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()

    return spark.read.parquet(path), lambda: remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, start: str) -> str:
    """A column name that df hasn't, whatever the case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (start, *(f"{start}{k}" for k in range(len(taken) + 1))) if n.lower() not in taken)


def beside(df: DataFrame, value) -> DataFrame:
    """df with one more column, the last, of a name that it hasn't."""
    return df.withColumn(free_name(df, "beside"), value)


def crc_mod(col, m: int):
    return F.crc32(col.cast("string").cast("binary")) % m


# ---------------------------------------------------------------- words as numpy arrays

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which byte values separate words."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Separators of runs of letters and digits; of runs without white space.
SPLIT_ALNUM = byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
SPLIT_SPACE = byte_table([(0x09, 0x0D), (0x20, 0x20)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """Slices (start, end) of a list of byte strings that hold about limit bytes each."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def join_texts(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text followed by a space; and where each text starts (and the end)."""
    buf = np.frombuffer(b" ".join([*(t or b"" for t in texts), b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=starts[1:])
    return buf, starts


def word_spans(buf: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that sep doesn't hold."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~sep[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


#: Two odd bases of polynomial hashes modulo 2**64, and the first one's inverse.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands."""
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    val = mix64(np.arange(256, dtype=np.uint64) + _ODD)[buf]
    val *= powers(n, BASE)
    np.cumsum(val, out=total[1:])
    h = (total[ends] - total[starts]) * powers(n, INVERSE)[starts] if len(starts) else np.zeros(0, np.uint64)
    return mix64(h + (ends - starts).astype(np.uint64) * _ODD)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words (of the whole array, over text ends too)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * np.uint64(BASE) + words[j : j + n]
    return mix64(h)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return first + np.arange(total)
