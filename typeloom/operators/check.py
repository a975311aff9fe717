"""Validation of JSON lines against declarations, with counts of types and fields.

Records are checked by a map; each task adds up its counts before it emits them, and one
aggregation adds up the tasks'. Files that are patch logs are dealt out by file and
replayed first; whether a file is one shows in its first objects.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.functions.formats import utf16_key
from typeloom.operators.infer import parsed
from typeloom.operators.shared import kept
from typeloom.plans.declarations import root_of
from typeloom.plans.nodes import Node, encode
from typeloom.plans.nodes import decode as decoded
from typeloom.plans.validate import Checker, Tally
from typeloom.sources.jsonl import expand, read_lines
from typeloom.sources.records import ADAPTERS, PatchLog, is_patch

#: what: 'label' (name), 'field' (name, kind), 'total', 'failed', 'failure' (name is the reason).
COUNTS = "what string, file_ord int, block long, id long, name string, kind string, n long"
MOST_COUNTS = 50_000


class _Counts:
    """Counts of one task, as rows."""

    def __init__(self, root: Node, cap: int):
        self.checker, self.cap = Checker(root), cap
        self.tally, self.totals, self.rows, self.failures = Tally(), {}, [], {}

    def add(self, file_ord: int, block: int, id_: int, record) -> None:
        reason = self.checker.check(record, self.tally)
        own = self.totals.setdefault(file_ord, [0, 0])
        own[0] += 1
        if reason is not None:
            own[1] += 1
            # The first failures of a file within a task are enough for the first of all.
            if own[1] <= self.cap:
                self.rows.append(("failure", file_ord, block, id_, reason, None, 1))

    def full(self) -> bool:
        return len(self.tally.labels) + len(self.tally.fields) > MOST_COUNTS

    def drain(self) -> pa.RecordBatch:
        rows = self.rows
        rows += [("label", None, None, None, k, None, n) for k, n in self.tally.labels.items()]
        rows += [("field", None, None, None, k, kind, n) for (k, kind), n in self.tally.fields.items()]
        for f, (total, failed) in self.totals.items():
            rows += [("total", f, None, None, None, None, total), ("failed", f, None, None, None, None, failed)]
        # Failures go on being counted against the cap after a drain.
        self.tally, self.rows = Tally(), []
        self.totals = {f: [0, 0] for f in self.totals}
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        columns = list(zip(*rows)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in COUNTS.split(", ")])


def _checked(node: str, cap: int):
    def run(batches):
        counts = _Counts(decoded(node), cap)
        for b in batches:
            for file_ord, block, id_, line in zip(*(b.column(k).to_pylist() for k in range(4))):
                ok, record = parsed(line)
                if ok:
                    counts.add(file_ord, block, id_, record)
                if counts.full():
                    yield counts.drain()
        yield counts.drain()

    return run


def _replayed(node: str, cap: int):
    """Sorted lines of patch logs, each file one record: its final state."""

    def run(batches):
        counts, now, log = _Counts(decoded(node), cap), None, None

        def close():
            for state in log.records() if log else ():
                counts.add(now, 0, 0, state)

        for b in batches:
            for file_ord, line in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if file_ord != now:
                    close()
                    now, log = file_ord, PatchLog()
                ok, record = parsed(line)
                if ok:
                    log.add(record)
        close()
        yield counts.drain()

    return run


def _heads(batches):
    """Of each line that is an object: whether it is a patch, and whether it sets the state."""
    for b in batches:
        rows = []
        for file_ord, block, id_, line in zip(*(b.column(k).to_pylist() for k in range(4))):
            ok, record = parsed(line)
            if ok and isinstance(record, dict):
                good = is_patch(record)
                rows.append((file_ord, block, id_, good, good and record["kind"] == 0))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file_ord", "block", "id", "good", "start"])


def patch_files(lines: DataFrame, sample: int = PatchLog.SAMPLE) -> DataFrame:
    """file_ord of the files whose first objects look like a patch log's."""
    heads = lines.select("file_ord", "block", "id", "line").mapInArrow(_heads, "file_ord int, block long, id long, good boolean, start boolean")
    # The rank has a small limit, so each task keeps only the first rows of a file before the shuffle.
    first = heads.withColumn("rank", F.row_number().over(Window.partitionBy("file_ord").orderBy("block", "id"))).where(F.col("rank") <= sample)
    told = first.groupBy("file_ord").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.bool_or("start").alias("start"))
    return told.where("n >= 2 AND good >= 2 AND good >= 0.8 * n AND start").select("file_ord")


@dataclass
class Report:
    """Totals, type counts and field counts (most first), and the first failures."""

    total: int = 0
    failed: int = 0
    types: dict[str, int] = field(default_factory=dict)
    fields: dict[str, tuple[int, list[str]]] = field(default_factory=dict)
    failures: list[tuple[int, int, str]] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return not self.failed

    def text(self, detail: bool = False) -> str:
        out = [f"{'OK' if self.passed else 'FAIL'} {self.total - self.failed}/{self.total} records"]
        if self.types:
            out.append("types: " + ", ".join(f"{k}={n}" for k, n in self.types.items()))
        if detail and self.fields:
            out.append("fields:")
            out += [f"  {k}  count={n}  types={{{','.join(kinds)}}}" for k, (n, kinds) in self.fields.items()]
        if self.failures:
            out.append(f"failures (showing {len(self.failures)}):")
            out += [f"  #{index} <root>: {reason}" for _, index, reason in self.failures]
        return "\n".join(out) + "\n"


@dataclass
class Checked:
    """Results of a check as frames."""

    counts: DataFrame
    lines: DataFrame
    cap: int

    def totals(self) -> DataFrame:
        """file_ord, total, failed."""
        n = lambda what: F.sum(F.when(F.col("what") == what, F.col("n")).otherwise(0)).alias(what)
        return self.counts.where("what IN ('total', 'failed')").groupBy("file_ord").agg(n("total"), n("failed"))

    def types(self) -> DataFrame:
        return self.counts.where("what = 'label'").groupBy(F.col("name").alias("label")).agg(F.sum("n").alias("n"))

    def fields(self) -> DataFrame:
        return self.counts.where("what = 'field'").groupBy(F.col("name").alias("path")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("kind")).alias("types"))

    def failures(self) -> DataFrame:
        """file_ord, block, id, reason of the first failures."""
        return self.counts.where("what = 'failure'").orderBy("file_ord", "block", "id").limit(self.cap).select("file_ord", "block", "id", F.col("name").alias("reason"))

    def report(self) -> Report:
        sums = self.totals().agg(F.sum("total").alias("t"), F.sum("failed").alias("f")).first()
        out = Report(int(sums.t or 0), int(sums.f or 0))
        out.types = {r.label: r.n for r in self.types().orderBy(F.desc("n"), "label").toLocalIterator()}
        out.fields = {r.path: (r.n, sorted(r.types, key=utf16_key)) for r in self.fields().orderBy(F.desc("n"), "path").toLocalIterator()}
        first = self.failures().collect()
        if first:
            # A failure's index counts the records before it in its file.
            some = self.lines.sparkSession.createDataFrame([(r.file_ord, r.block, r.id) for r in first], "file_ord int, fb long, fi long")
            before = self.lines.join(F.broadcast(some), "file_ord").where((F.col("block") < F.col("fb")) | ((F.col("block") == F.col("fb")) & (F.col("id") < F.col("fi"))))
            index = {(r.file_ord, r.fb, r.fi): r.n for r in before.mapInArrow(_records_before, "file_ord int, fb long, fi long, n long").groupBy("file_ord", "fb", "fi").agg(F.sum("n").alias("n")).collect()}
            out.failures = [(r.file_ord, index.get((r.file_ord, r.block, r.id), 0), r.reason) for r in first]
        return out


def _records_before(batches):
    for b in batches:
        at = {n: k for k, n in enumerate(b.schema.names)}
        rows = [(f, x, y) for f, x, y, line in zip(*(b.column(at[c]).to_pylist() for c in ("file_ord", "fb", "fi", "line"))) if parsed(line)[0]]
        columns = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array([1] * len(rows), pa.int64())], ["file_ord", "fb", "fi", "n"])


def check_lines(lines: DataFrame, root: Node, cap: int = 20, adapters=ADAPTERS) -> Checked:
    """Check all records of a frame of lines."""
    lines = lines.select("file_ord", "block", "id", "line")
    node = encode(root)
    if PatchLog in adapters:
        logs = kept(patch_files(lines))
        plain = lines.join(logs, "file_ord", "left_anti").select(*lines.columns)
        n = max(2, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        sorted_ = lines.join(logs, "file_ord", "left_semi").select(*lines.columns).repartition(n, "file_ord").sortWithinPartitions("file_ord", "block", "id")
        counts = plain.mapInArrow(_checked(node, cap), COUNTS).unionByName(sorted_.mapInArrow(_replayed(node, cap), COUNTS))
    else:
        plain = lines
        counts = lines.mapInArrow(_checked(node, cap), COUNTS)
    return Checked(kept(counts), plain, cap)


def check_files(spark: SparkSession, patterns: Iterable[str], schema: str, root: str | None = None, cap: int = 20, adapters=ADAPTERS) -> Report:
    """Check JSON-lines files against the text of declarations."""
    node = root_of(schema, root)[1]
    files = expand(patterns)
    if not files:
        raise ValueError("check: no input files matched")
    return check_lines(read_lines(spark, files), node, cap, adapters).report()
