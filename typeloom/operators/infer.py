"""Inference of types from frames of JSON lines.

The fold is ordered and not associative, so partial aggregates would give other types.
Three exact ways to distribute it:

- fold_files: files are the parallel unit. Lines are dealt out by file and sorted, each
  task folds its files record by record, and the driver folds one type per file.
- fold_stream: one long source of many partitions. A map turns every record into its
  structure (a small text; equal for most records) and a key. The driver holds the
  distinct structures and walks: only the first record, in order, whose structure changes
  the type so far matters; all before it leave the type as it is. The next one is found
  from the structures' first places, which one aggregation over (place, key) gives, and
  asked for again only if a structure that was passed begins to matter. So the number of
  jobs follows the type's changes, not the records.
- fold_table: the same walk for rows of plain columns. A row's structure follows from a few
  numbers for each column (whether it is null, which formats its text has), so the JVM groups
  rows by them, combined in each task, and Python sees one row for each group only.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.api import finish
from typeloom.functions.formats import BLOB_OVER, FORMATS
from typeloom.operators.shared import kept
from typeloom.plans.emit import Document
from typeloom.plans.fold import Folder
from typeloom.plans.nodes import NEVER, Context, Node, decode, encode, structure
from typeloom.plans.settings import Options, Settings, settle
from typeloom.plans.simplify import Simplifier
from typeloom.sources.jsonl import expand, lines_of_frame, read_lines
from typeloom.sources.records import ADAPTERS, TRIM, parse

#: Distinct structures that the driver holds; sources with more are folded in one ordered pass.
MOST_STRUCTURES = 100_000
#: Aggregations of one walk; a type that needs more is folded in one ordered pass too.
MOST_JOBS = 200
DECLARATIONS = "ord int, name string, body string, docs array<string>"


def parsed(line: str | None):
    """(whether a line holds a record, the record)."""
    text = (line or "").strip(TRIM)
    if text:
        try:
            return True, parse(text)
        except (ValueError, RecursionError):
            pass
    return False, None


# ---------------------------------------------------------------- one type per file


class _FileFold:
    """Folds one file's records as they come; holds its first objects only until its kind is known."""

    def __init__(self, context: Context, adapters, sample: int = 20):
        self.folder, self.adapters, self.sample = Folder(context), adapters, sample
        self.head: list = []
        self.objects = self.records = 0
        self.log, self.node, self.known = None, NEVER, False

    def add(self, record) -> None:
        self.records += 1
        if self.known:
            self._take(record)
            return
        self.head.append(record)
        self.objects += isinstance(record, dict)
        if self.objects >= self.sample:
            self._decide()

    def _decide(self) -> None:
        self.known = True
        adapter = next((a for a in self.adapters if a.recognises(self.head)), None)
        self.log = adapter(self.folder) if adapter else None
        for record in self.head:
            self._take(record)
        self.head = []

    def _take(self, record) -> None:
        if self.log is not None:
            self.log.add(record)
        else:
            self.node = self.folder.join(self.node, self.folder.of(record))

    def result(self) -> Node:
        if not self.known:
            self._decide()
        found = self.log.node() if self.log is not None else None
        return self.node if found is None else found


def _fold_sorted(context: Context, adapters):
    def run(batches):
        now, fold = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([fold.records], pa.int64()), pa.array([encode(fold.result())])], ["file_ord", "records", "node"])

        for b in batches:
            for ord_, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ord_ != now:
                    if fold is not None:
                        yield row()
                    now, fold = ord_, _FileFold(context, adapters)
                ok, record = parsed(line)
                if ok:
                    fold.add(record)
        if fold is not None:
            yield row()

    return run


def fold_files(lines: DataFrame, context: Context, adapters=ADAPTERS) -> DataFrame:
    """file_ord, records, node (encoded) of each file."""
    n = max(2, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = lines.repartition(n, "file_ord").sortWithinPartitions("file_ord", "block", "id")
    return dealt.select("file_ord", "line").mapInArrow(_fold_sorted(context, adapters), "file_ord int, records long, node string")


# ---------------------------------------------------------------- one long source


def _structures(context: Context):
    """place, key of each record, and its structure where a task meets it first."""

    def run(batches):
        folder, met = Folder(context), {}
        for b in batches:
            rows = ([], [], [], [])
            for block, id_, line in zip(*(b.column(k).to_pylist() for k in range(3))):
                ok, record = parsed(line)
                if not ok:
                    continue
                node = folder.of(record)
                text = structure(node)
                key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
                first = key not in met
                if first:
                    met[key] = None
                for column, value in zip(rows, (block, id_, key, encode(node) if first else None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())], ["block", "id", "key", "node"])

    return run


class _Restless(Exception):
    """The type changes with too many records to look for each."""


class _Walk:
    """The driver's side of fold_stream. firsts(place) gives each key's first place behind it."""

    def __init__(self, folder: Folder, nodes: dict[str, Node], firsts):
        self.folder, self.nodes, self.firsts = folder, nodes, firsts
        self.jobs = self.changes = 0

    def _joined(self, state: Node, key: str) -> Node:
        return self.folder.join(state, self.nodes[key])

    def run(self, state: Node = NEVER) -> Node:
        here = None
        ahead = self._ask(None)
        passed: set[str] = set()  # keys whose next place isn't known
        while ahead or passed:
            look = structure(state)
            # A passed structure that matters now: its next place has to be looked up.
            if passed and any(structure(self._joined(state, k)) != look for k in passed):
                ahead, passed = self._ask(here), set()
                continue
            if not ahead:
                break
            for place, key in sorted((p, k) for k, p in ahead.items()):
                del ahead[key]
                passed.add(key)
                new = self._joined(state, key)
                if structure(new) != look:
                    state, here = new, place
                    self.changes += 1
                    break
        return state

    def _ask(self, place) -> dict[str, tuple]:
        self.jobs += 1
        if self.jobs > MOST_JOBS:
            raise _Restless
        return self.firsts(place)


def fold_stream(lines: DataFrame, context: Context, start: Node = NEVER) -> Node:
    """The type of all records of one source, in order, added to what was before them."""
    table = kept(lines.select("block", "id", "line").mapInArrow(_structures(context), "block long, id long, key string, node string"))
    distinct = table.where("node IS NOT NULL").groupBy("key").agg(F.first("node").alias("node"))
    folder = Folder(context)
    some = distinct.limit(MOST_STRUCTURES + 1).toArrow()
    if some.num_rows > MOST_STRUCTURES:
        return _in_order(table, distinct, folder, start)
    nodes = {k: decode(n) for k, n in zip(some.column("key").to_pylist(), some.column("node").to_pylist())}

    def firsts(place):
        rest = table if place is None else table.where((F.col("block") > place[0]) | ((F.col("block") == place[0]) & (F.col("id") > place[1])))
        rows = rest.groupBy("key").agg(F.min(F.struct("block", "id")).alias("p")).toArrow().to_pylist()
        return {r["key"]: (r["p"]["block"], r["p"]["id"]) for r in rows}

    try:
        return _Walk(folder, nodes, firsts).run(start)
    except _Restless:
        return _in_order(table, distinct, folder, start)


# ---------------------------------------------------------------- rows of plain columns

_PLAIN = ("boolean", "tinyint", "smallint", "int", "bigint")
_TIMES = ("date", "timestamp", "timestamp_ntz")


def _text_code(c: Column, context: Context) -> Column:
    """A number that holds what folding sees of a text: the formats that it has, and whether it is long."""
    bits = [f.column(c) for f in context.formats] + [f.evidence_column(c) for f in context.formats if f.evidence]
    long = F.octet_length(F.encode(c, "UTF-16BE")) / 2 > BLOB_OVER
    told = sum((F.when(b, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, b in enumerate([*bits, long])), F.lit(1).cast("long") * (1 << len(bits) + 1))
    # Single letters and digits have none of the formats, nor are they long.
    plain = F.length(c).isin(1) & F.ascii(c).between(48, 122) & ~F.ascii(c).between(58, 64) & ~F.ascii(c).between(91, 96)
    return F.when(plain, F.lit(1).cast("long")).otherwise(told) if context.formats == FORMATS else told


def column_codes(df: DataFrame, context: Context) -> list[Column] | None:
    """For each column of df a value that decides its part of a row's structure; None if a column's type is nested or a format has no column form."""
    if any(f.column is None or f.evidence and f.evidence_column is None for f in context.formats):
        return None
    out = []
    for k, field in enumerate(df.schema.fields):
        c, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if kind in _TIMES:  # the text that JSON has for it
            shown = F.to_json(F.struct(c.alias("v")))
            # Years of four digits all have the same shape of text.
            usual = F.year(c).between(1000, 9999)
            text = F.when(c.isNotNull() & ~usual, F.substring(shown, 7, F.length(shown) - 8))
        elif kind in ("float", "double"):  # without a number, JSON has their names
            text = F.when(F.isnan(c) | (F.abs(c) == float("inf")), c.cast("string"))
        elif kind == "string":
            text = c
        elif kind in _PLAIN or kind.startswith("decimal"):
            text = None
        else:
            return None
        if context.is_tag(field.name):
            code = F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
        elif text is None:
            code = c.isNotNull().cast("long")
        else:
            code = F.when(text.isNotNull(), _text_code(text, context)).otherwise(c.isNotNull().cast("long") * 3)
        out.append(code.alias(f"c{k}"))
    return out


def _spread(df: DataFrame) -> DataFrame:
    """Rows of few partitions dealt out to all cores; large inputs stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fold_table(df: DataFrame, context: Context) -> Node | None:
    """The type of all rows in order, by their columns' codes; None where that can't be told or has too many groups."""
    codes = column_codes(df, context)
    if codes is None:
        return None
    names = [f"c{k}" for k in range(len(codes))]
    place = next(n for n in (f"place{k}" for k in range(len(codes) + 1)) if n not in map(str.lower, df.columns))
    rows = df.withColumn(place, F.monotonically_increasing_id())
    coded = _spread(rows).select(F.col(place).alias("id"), *codes)

    def groups(after=None) -> DataFrame:
        some = coded if after is None else coded.where(F.col("id") > after)
        return some.groupBy(*names).agg(F.min("id").alias("id"))

    first = groups().limit(MOST_STRUCTURES + 1).toArrow()
    if first.num_rows > MOST_STRUCTURES:
        return None
    spark, folder = df.sparkSession, Folder(context)
    ids = first.column("id").to_pylist()
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], f"{place} long"))
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("line")
    shown = {r.id: r for r in rows.join(wanted, place, "left_semi").select(F.col(place).alias("id"), line, *codes).collect()}
    key_of, nodes = {}, {}
    for row in first.to_pylist():
        code = tuple(row[n] for n in names)
        found = shown.get(row["id"])
        if found is None or tuple(found[n] for n in names) != code:  # the rows don't come in the same order each time
            return None
        node = folder.of(parse(found.line))
        key = structure(node)
        key_of[code] = key
        nodes.setdefault(key, node)

    def firsts(after):
        out: dict[str, int] = {}
        for row in (first if after is None else groups(after).toArrow()).to_pylist():
            key = key_of[tuple(row[n] for n in names)]
            out[key] = min(out.get(key, row["id"]), row["id"])
        return out

    try:
        return _Walk(folder, nodes, firsts).run()
    except _Restless:
        return None


def _in_order(table: DataFrame, distinct: DataFrame, folder: Folder, state: Node) -> Node:
    """The plain fold over sorted structures, a partition at a time."""
    ordered = table.select("block", "id", "key").join(distinct, "key").orderBy("block", "id").select("node")
    for row in ordered.toLocalIterator(prefetchPartitions=True):
        state = folder.join(state, decode(row.node))
    return state


# ---------------------------------------------------------------- entry points


def declarations(spark: SparkSession, doc: Document) -> DataFrame:
    return spark.createDataFrame(doc.rows(), DECLARATIONS)


def infer_frame(df: DataFrame, options: Options | None = None) -> Document:
    """Declarations of a DataFrame's rows as JSON objects; no adapters."""
    settings = settle(options)
    root = fold_table(df, settings.context)
    return finish(fold_stream(_spread(lines_of_frame(df)), settings.context) if root is None else root, settings)[0]


def infer_lines(lines: DataFrame, options: Options | None = None) -> tuple[Document, Simplifier, Counter]:
    """Declarations of a frame of lines (several files), and the records of each file."""
    settings = settle(options)
    adapters = ADAPTERS if settings.options.adapters is None else settings.options.adapters
    folder, root, counts = Folder(settings.context), NEVER, Counter()
    for row in fold_files(lines, settings.context, adapters).orderBy("file_ord").toLocalIterator():
        root = folder.join(root, decode(row.node))
        counts[row.file_ord] = row.records
    return *finish(root, settings), counts


def infer_files(spark: SparkSession, patterns: Iterable[str], options: Options | None = None, on_file=None) -> Document:
    """Declarations of JSON-lines files."""
    files = expand(patterns)
    if not files:
        raise ValueError("no input files matched")
    doc, _, counts = infer_lines(read_lines(spark, files), options)
    for i, f in enumerate(files):
        if on_file:
            on_file(f, counts[i])
    return doc


def simplify_text(source: str, options: Options | None = None) -> str:
    """Declarations, simplified and written again."""
    from dataclasses import replace

    from typeloom.plans.declarations import root_of

    options = options or Options()
    name, root = root_of(source, options.root_name if options.root_name != Options.root_name else None, strict=False)
    settings: Settings = settle(replace(options, root_name=name, user_tag=None))
    return finish(root, settings)[0].text()
