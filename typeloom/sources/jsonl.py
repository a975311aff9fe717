"""JSON-lines files as DataFrames, in file and line order."""

from __future__ import annotations

import functools
import gzip
import os
import re
import sys
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions.formats import utf16_key
from typeloom.sources.records import TRIM, parse

WILD = re.compile(r"[*?\[{]")
#: Columns of a frame of lines: the file's place in the input, the split, the line in it.
LINES = "file_ord int, block long, id long, line string"


def _braces(pattern: str) -> list[str]:
    """a{b,c} as ab and ac."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [x for part in m[1].split(",") for x in _braces(pattern[: m.start()] + part + pattern[m.end() :])]


def expand(patterns: Iterable[str]) -> list[str]:
    """Files of the patterns, each pattern's sorted; those without wild cards as they are; ~/ is the home folder."""
    out: list[str] = []
    for pattern in patterns:
        full = os.environ.get("HOME", "~") + pattern[1:] if pattern.startswith("~/") else pattern
        if not WILD.search(full):
            out.append(full)
            continue
        parts = full.split("/")
        fixed = next(i for i, p in enumerate(parts) if WILD.search(p))
        base = Path("/".join(parts[:fixed]) or ("/" if full.startswith("/") else "."))
        found: set[str] = set()
        if base.is_dir():
            for tail in _braces("/".join(parts[fixed:])):
                found |= {str(p) for p in base.glob(tail) if p.is_file()}
        if not found:
            print(f"warning: no files matched {pattern}", file=sys.stderr)
        out += sorted(found, key=utf16_key)
    return out


def read_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """All lines of the files. .gz is read by Spark; .gzip is inflated here."""
    parts: list[DataFrame] = []
    names = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "file_ord int, file string")
    plain = list(dict.fromkeys(f for f in files if not f.endswith(".gzip")))
    zipped = list(dict.fromkeys(f for f in files if f.endswith(".gzip")))
    path = F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), "^file:/*", "/")
    known = names.withColumn("file", F.regexp_replace("file", "^file:/*", "/"))
    if plain:
        raw = spark.read.text(plain, lineSep="\n")
        rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
        parts.append(rows.withColumn("file", path))
    if zipped:
        raw = spark.read.format("binaryFile").load(zipped).select("path", "content")
        rows = raw.mapInArrow(_inflate, "path string, block long, id long, line string")
        parts.append(rows.withColumn("file", path))
    if not parts:
        return spark.createDataFrame([], LINES)
    absolute = known.withColumn("file", _absolute(F.col("file")))
    return functools.reduce(DataFrame.unionByName, parts).join(F.broadcast(absolute), "file").select("file_ord", "block", "id", "line")


def _absolute(c):
    here = os.getcwd()
    return F.when(F.startswith(c, F.lit("/")) | c.rlike("^[a-z0-9]+:/"), c).otherwise(F.concat(F.lit(here + "/"), F.regexp_replace(c, r"^\./", "")))


def _inflate(batches):
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            lines = gzip.decompress(content).decode("utf-8", "replace").split("\n")
            n = len(lines) - (lines[-1] == "")
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([0] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(lines[:n], pa.string())], ["path", "block", "id", "line"])


def lines_of_frame(df: DataFrame) -> DataFrame:
    """Rows of any DataFrame as lines of one file; null columns are left out."""
    return df.select(F.lit(0).alias("file_ord"), F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("id"), F.to_json(F.struct("*")).alias("line"))


def validity(line: str | None) -> bool | None:
    """Whether a line is JSON; None if it is blank."""
    text = (line or "").strip(TRIM)
    if not text:
        return None
    try:
        parse(text)
    except (ValueError, RecursionError):
        return False
    return True


def _valid(batches):
    for b in batches:
        ok = pa.array(map(validity, b.column(3).to_pylist()), pa.bool_())
        yield pa.RecordBatch.from_arrays([*b.columns, ok], ["file_ord", "block", "id", "line", "valid"])


def with_validity(lines: DataFrame) -> DataFrame:
    """lines with valid: true, false (rejected), or null (blank)."""
    return lines.select("file_ord", "block", "id", "line").mapInArrow(_valid, LINES + ", valid boolean")
