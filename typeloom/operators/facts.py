"""Relational views of JSON records: one row per node, aggregated.

These algebraic parts of inference (kinds, presence, literals, formats) are plain
group-bys. They answer profile questions; the exact type comes from the ordered fold.
"""

from __future__ import annotations

import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from typeloom.operators.infer import parsed
from typeloom.plans.nodes import MOST_LITERALS
from typeloom.plans.validate import kind_of
from typeloom.sources.records import PatchLog

MOST_PATHS = 50_000


def walk(value, path: str = ""):
    """(path, kind) of a value and all that it holds; items of lists share the path with []."""
    yield path, kind_of(value)
    if isinstance(value, list):
        for x in value:
            yield from walk(x, f"{path}[]")
    elif isinstance(value, dict):
        for k, x in value.items():
            yield from walk(x, f"{path}.{k}" if path else k)


def _profiled(batches):
    counts: Counter = Counter()

    def out():
        rows = list(counts.items())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([p for (p, _), _ in rows], pa.string()), pa.array([k for (_, k), _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["path", "kind", "n"])

    for b in batches:
        for line in b.column(0).to_pylist():
            ok, record = parsed(line)
            if ok:
                counts.update(walk(record))
        if len(counts) > MOST_PATHS:
            yield out()
    yield out()


def profile(lines: DataFrame) -> DataFrame:
    """path, kind, n over all records of a frame of lines; each task adds up before the shuffle."""
    return lines.select("line").mapInArrow(_profiled, "path string, kind string, n long").groupBy("path", "kind").agg(F.sum("n").alias("n"))


def presence(lines: DataFrame) -> DataFrame:
    """path, present, total of each property of the records."""
    kinds = profile(lines)
    total = kinds.where("path = ''").agg(F.sum("n").alias("total"))
    return kinds.where("path != ''").groupBy("path").agg(F.sum("n").alias("present")).join(F.broadcast(total))


class JsonPaths:
    """A table function: json_paths(text) gives (path, kind) of each node of a JSON text."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType().add("path", "string").add("kind", "string"))

    def eval(self, text: str):
        ok, record = parsed(text)
        if ok:
            yield from walk(record)


def register(spark) -> None:
    """Make json_paths callable from SQL."""
    spark.udtf.register("json_paths", F.udtf(JsonPaths))


def literal_set(c: Column) -> Column:
    """An aggregate: the sorted distinct values joined by commas, or null if there are too many."""
    # Two more than the limit are enough to know; the count is exact and needs no list.
    return F.when(F.count_distinct(c) <= MOST_LITERALS, F.array_join(F.array_sort(F.collect_set(c)), ","))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def subset(a: Column, b: Column) -> Column:
    small, large = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    return F.size(F.array_except(small, large)) == 0


# ---------------------------------------------------------------- patch logs, file by file


def _replayed(batches):
    """Sorted (file, record as JSON) rows: each file's final state as JSON."""
    now, log = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([json.dumps(log.state, ensure_ascii=False)], pa.string())], ["file", "state"])

    for b in batches:
        for file, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if file != now:
                if log is not None and log.records():
                    yield out()
                now, log = file, PatchLog()
            ok, record = parsed(line)
            if ok:
                log.add(record)
    if log is not None and log.records():
        yield out()


def replay(patches: DataFrame) -> DataFrame:
    """file, state of patch rows (file long, ord, line), replayed in the order of ord."""
    n = max(2, int(patches.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = patches.repartition(n, "file").sortWithinPartitions("file", "ord")
    return dealt.select("file", "line").mapInArrow(_replayed, "file long, state string")

