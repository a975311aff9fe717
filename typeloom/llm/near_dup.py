"""Near-duplicate documents by fast similarity sketching.

A document's set holds the hashes of its distinct WORDS-word shingles (of its whole word
sequence if that is shorter; nothing without words). Documents are linked if
100 * |intersection| >= percent * |union|.

1. Documents of equal sets are one class (a partial aggregation; copies are never paired).
2. Each class has a sketch of SIZE coordinates. In round i < SIZE every element is thrown
   into a bin and offers the value (i, hash); a bin keeps its smallest. Later rounds
   i >= SIZE fill bin i - SIZE. A set stops after the first round that leaves no bin empty;
   so every coordinate is filled, and two coordinates agree with the sets' similarity.
3. BANDS bands of ROWS coordinates are bucket keys. A pair at the threshold misses all
   buckets with probability 3e-6.
4. In each bucket of several classes all members are compared with one pivot, which makes
   one component of most copies. Buckets that still hold several components are dealt out
   to cells of at most about CELL x CELL members; a cell compares members of different
   components and emits only links that join components of its members. No connection is
   lost, and no pair is written before it is known to be a link.
5. Candidates whose sketches agree in less than LEAST coordinates (over six standard
   deviations below the threshold) go; the rest are confirmed on the full sets.
6. Components by alternating star contraction, each step cut by a checkpoint.

Null and empty texts, and texts of white space, have empty sets and are components of
their own. Equal rows, and rows that share a doc_id, share its label; a null doc_id stands
after all others. Empty tables give empty results. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import LOWER, SPLIT_SPACE, chunks, cut, gram_hashes, join_texts, mix64, ranges, span_hashes, word_spans

WORDS, PERCENT = 5, 80
BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
LEAST = 95
CELL = 512


def shingle_sets(texts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets, sorted within each text, and where each starts (and the end)."""
    buf, starts = join_texts(texts)
    buf = LOWER[buf]
    a, b = word_spans(buf, SPLIT_SPACE)
    words = span_hashes(buf, a, b)
    at = np.searchsorted(a, starts)
    sizes = np.diff(at)
    grams = gram_hashes(words, k)
    counts = np.maximum(sizes - k + 1, 0)
    sets = grams[ranges(at[:-1], counts)] if len(grams) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    few = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(few):
        whole = []
        for i in few:
            h = np.uint64(sizes[i])
            for w in words[at[i] : at[i + 1]]:
                h = np.uint64((int(h) * 0x5851F42D4C957F2D + int(w)) & 0xFFFFFFFFFFFFFFFF)
            whole.append(h)
        sets, doc = np.concatenate([sets, mix64(np.array(whole, np.uint64))]), np.concatenate([doc, few])
    order = np.lexsort((sets, doc))
    sets, doc = sets[order], doc[order]
    new = np.ones(len(sets), bool)
    new[1:] = (sets[1:] != sets[:-1]) | (doc[1:] != doc[:-1])
    sets, doc = sets[new], doc[new]
    return sets, np.searchsorted(doc, np.arange(len(texts) + 1))


def sketches(sets: np.ndarray, starts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The sketch of each set, one row each; sets without elements have the largest values."""
    n = len(starts) - 1
    out = np.full(n * size, np.uint64(2**64 - 1), np.uint64)
    doc = np.repeat(np.arange(n), np.diff(starts))
    live = sets
    for i in range(2 * size):
        if not len(live):
            break
        h = mix64(live + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = np.uint64(i) << np.uint64(54) | h >> np.uint64(10)
        place = (h & np.uint64(0xFFFFFFFF)) % np.uint64(size) if i < size else np.full(len(live), i - size, np.uint64)
        np.minimum.at(out, doc * size + place.astype(np.int64), value)
        if i >= 2:
            open_ = (out.reshape(n, size) == np.uint64(2**64 - 1)).any(1)
            mine = open_[doc]
            live, doc = live[mine], doc[mine]
    return out.reshape(n, size)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _signatures(k: int):
    def run(batches):
        for b in batches:
            texts = [t.as_py() for t in b.column(2)]
            for lo, hi in chunks(texts):
                sets, starts = shingle_sets(texts[lo:hi], k)
                n = np.diff(starts)
                total = np.concatenate(([np.uint64(0)], np.cumsum(mix64(sets))))
                other = np.concatenate(([np.uint64(0)], np.cumsum(mix64(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)))))
                ids = np.column_stack([total[starts[1:]] - total[starts[:-1]], other[starts[1:]] - other[starts[:-1]]])
                s = sketches(sets, starts)
                bands = s.reshape(len(n), BANDS, ROWS)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(n), BANDS)).copy()
                for j in range(ROWS):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j])
                low = np.ascontiguousarray((mix64(s) & np.uint64(0xFF)).astype(np.uint8))
                raw = np.ascontiguousarray(ids).view(np.uint8).reshape(len(n), 16)
                fixed = lambda m, size: pa.array([r.tobytes() for r in m], pa.binary())
                band_list = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(_signed(key.reshape(-1))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), fixed(raw, 16), band_list, fixed(low, SIZE)], ["doc_id", "th", "n", "c", "bands", "sketch"])

    return run


def _agree(batches):
    """Keep candidate pairs whose sketches agree often enough."""
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(t.as_py() for t in b.column(k)), np.uint8).reshape(-1, SIZE) for k in (2, 3))
        ok = (x == y).sum(1) >= LEAST
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))


def _confirm(k: int, percent: int):
    def run(batches):
        last, mine = None, None
        for b in batches:
            a, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            texts = b.column(3).to_pylist()
            pivots = b.column(2)
            ok = np.zeros(len(a), bool)
            for lo, hi in chunks(texts):
                sets, starts = shingle_sets(texts[lo:hi], k)
                for i in range(lo, hi):
                    if a[i] != last:  # rows of one pivot stand together
                        last, mine = a[i], shingle_sets([pivots[i].as_py()], k)[0]
                    other = sets[starts[i - lo] : starts[i - lo + 1]]
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    ok[i] = both > 0 and 100 * both >= percent * (len(mine) + len(other) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(c, pa.binary())], ["a", "b"]).filter(pa.array(ok))

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node that it reaches) of all nodes of edges (a, b) but the smallest ones.

    Each step hangs larger neighbours, then a node and its smaller neighbours, on the smallest
    one near; it ends when all edges are stars.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        pairs = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
        now = cut(small.select(pairs.alias("e")).select("e.a", "e.b").where("a != b").distinct())
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def _pairs_verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links."""
    side = lambda name: reps.select(F.col("c").alias(name), F.col("sketch").alias("s" + name))
    drawn = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb").mapInArrow(_agree, "a binary, b binary")
    full = drawn.join(texts.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a")
    return full.select("a", "b", "ta", "tb").mapInArrow(_confirm(k, percent), "a binary, b binary")


def classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, class_id and component_id (smallest doc_id of the class, of all that it reaches)."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    told = cut(rows.mapInArrow(_signatures(k), f"doc_id {kind}, th long, n long, c binary, bands array<long>, sketch binary"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th"))
    reps = cut(told.where("n > 0").groupBy("c").agg(first.alias("r"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    spots = reps.select(F.explode("bands").alias("key"), "c")
    crowded = spots.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    members = cut(spots.join(crowded, "key"))
    needed = members.select("c").distinct().join(reps.select("c", "r"), "c").select("c", F.col("r.doc_id").alias("i"), F.col("r.th").alias("t"))
    texts = cut(rows.join(needed, rows.doc_id.eqNullSafe(F.col("i")) & (rows.th == F.col("t"))).select("c", "text").dropDuplicates(["c"]))
    # The first pivot of each bucket is its smallest class.
    pivot = members.groupBy("key").agg(F.min("c").alias("p"))
    pairs = members.join(pivot, "key").where("c > p").select(F.col("p").alias("a"), F.col("c").alias("b")).distinct()
    labels = components(_pairs_verified(pairs, reps, texts, k, percent))
    # What isn't decided: buckets that hold several components.
    here = members.join(labels, members.c == labels.node, "left").select("key", "c", F.coalesce("comp", "c").alias("comp"))
    parts = here.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = cut(parts.groupBy("key").agg(F.sum("n").alias("m"), F.count("*").alias("comps")).where("comps > 1").select("key", "m"))
    new = _cells(here.join(mixed, "key"), texts.join(reps.select("c", "sketch", "bands"), "c"), k, percent)
    labels = components(new.unionByName(labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
    out = reps.select("c", F.col("r.doc_id").alias("class_id"))
    joined = out.join(labels, out.c == labels.node, "left").select("c", "class_id", F.coalesce("comp", "c").alias("comp"))
    low = joined.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    out = joined.join(low, "comp").select("c", "class_id", "component_id")
    told = told.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c")).alias("c"))
    known = told.where("c IS NOT NULL").join(out, "c", "left").select("doc_id", "th", "n_shingles", "class_id", "component_id")
    bare = told.where("c IS NULL").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return known.unionByName(bare)


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id."""
    found = classes(docs.select("doc_id", "text"), k, percent)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("i"), F.col("th").alias("h"), F.col("n_shingles").alias("n")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_th"))
    both = rows.join(kept, F.col("own_id").eqNullSafe(F.col("i")) & (F.col("own_th") == F.col("h")))
    # Rows of an empty set are linked with nothing, not even with their copies.
    empty, others = both.where("n = 0"), both.where("n > 0").dropDuplicates(["i", "h"])
    return others.unionByName(empty).select("row.*")


def _compared(k: int, percent: int):
    """Links (a, b) between members of different components in cells: by sketch first, then on the full sets, each pair once.

    A cell emits links that span its members' components only: a pair that its earlier links
    connect already isn't compared. So a cell emits fewer links than it has members.
    """

    def links(cell):
        left = [m for m in cell["members"] if m["own"] == cell["x"]]
        right = left if cell["x"] == cell["y"] else [m for m in cell["members"] if m["own"] == cell["y"]]
        if not left or not right:
            return
        table = lambda ms: np.frombuffer(b"".join(m["sketch"] for m in ms), np.uint8).reshape(-1, SIZE)
        of = {}
        names = lambda ms: np.array([of.setdefault(m["comp"], len(of)) for m in ms])
        l_sketch, r_sketch, l_comp, r_comp = table(left), table(right), names(left), names(right)
        bands = lambda ms: np.array([m["bands"] for m in ms], np.int64)
        l_bands, r_bands = bands(left), bands(right)
        own = int(np.flatnonzero(l_bands[0] == cell["key"])[0])
        sets: dict[bytes, np.ndarray] = {}
        up = list(range(len(of)))

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def full(m):
            if m["c"] not in sets:
                sets[m["c"]] = shingle_sets([m["text"]], k)[0]
            return sets[m["c"]]

        for lo in range(0, len(left), 32):
            close = (l_sketch[lo : lo + 32, None] == r_sketch[None]).sum(2) >= LEAST
            close &= l_comp[lo : lo + 32, None] != r_comp[None]
            # A pair that shares an earlier band is compared there.
            for band in range(own):
                close &= l_bands[lo : lo + 32, None, band] != r_bands[None, :, band]
            for i, j in zip(*np.nonzero(close)):
                p, q = left[lo + i], right[j]
                s, t = top(l_comp[lo + i]), top(r_comp[j])
                if s != t and (right is not left or lo + i < j):
                    x, y = full(p), full(q)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and 100 * both >= percent * (len(x) + len(y) - both):
                        up[s] = t
                        yield p["c"], q["c"]

    def run(batches):
        for b in batches:
            for cell in b.to_pylist():
                found = list(links(cell))
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.binary()) for n in (0, 1)], ["a", "b"])

    return run


def _cells(rest: DataFrame, known: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between the components that a bucket holds. Its members are dealt out to cells of about CELL x CELL.

    rest: key, c, comp, m (the bucket's members). known: c, text, sketch, bands.
    """
    groups = F.greatest(F.lit(1), F.ceil(F.col("m") / CELL)).cast("int")
    mine = rest.select("key", "c", "comp", groups.alias("g")).withColumn("own", F.pmod(F.xxhash64("c"), F.col("g")).cast("int"))
    spread = mine.withColumn("o", F.explode(F.expr("sequence(0, g - 1)"))).select("key", "c", "comp", "own", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"))
    cells = spread.join(known, "c").groupBy("key", "x", "y").agg(F.collect_list(F.struct("own", "c", "comp", "sketch", "bands", "text")).alias("members"))
    return cells.mapInArrow(_compared(k, percent), "a binary, b binary").distinct()


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")
