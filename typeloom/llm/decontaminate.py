"""Benchmark decontamination by winnowing.

Words are runs of bytes outside a fixed set, after lower-casing A-Z. A window is
WINDOW consecutive words of an item, or all words of a shorter one. Every text is
fingerprinted by winnowing: of each WINDOW - K + 1 consecutive K-gram hashes the smallest
is kept, so any shared window holds a fingerprint that both texts kept. Documents'
fingerprints are joined with the items'; each hit is extended to both sides, and hits that
grow to a whole window mark their words. Short items are fingerprinted at their full
length, every place kept.

The items go to the executors in blocks of at most BLOCK_WORDS words (the bound on what is
broadcast); one block is one map over the documents, without a shuffle. With several
blocks the covered words are united by document. Contexts of a fingerprint that are equal
are kept once, so repetitive items and copies of items cost nothing more.

Null and empty texts have no words, are never contaminated and have no windows. Repeated
documents count each for itself; items of one item_id are one item, items without are left out. Empty tables: no documents give no rows, no
items leave every document clean. Other columns aren't read. Memory: about CHUNK_BYTES of
text at a time, or the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import LOWER, SPLIT_ALNUM, beside, chunks, gram_hashes, join_texts, ranges, span_hashes, word_spans

WINDOW = 10
K = 5
#: Words of items in one broadcast block.
BLOCK_WORDS = 1_000_000


def words_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and where each text's words start (and the end)."""
    buf, starts = join_texts(texts)
    buf = LOWER[buf]
    a, b = word_spans(buf, SPLIT_ALNUM)
    return span_hashes(buf, a, b), np.searchsorted(a, starts)


def winnow(grams: np.ndarray, doc: np.ndarray, gram: int, width: int) -> np.ndarray:
    """Places of the smallest hash (the last of equal ones) of every width consecutive grams within one document."""
    n = len(doc) - gram - width + 2
    if n <= 0:
        return np.zeros(0, np.int64)
    best, low = np.arange(n), grams[:n].copy()
    for j in range(1, width):
        better = np.flatnonzero(grams[j : j + n] <= low)
        best[better] = better + j
        low[better] = grams[better + j]
    keep = np.zeros(len(grams), bool)
    keep[best[doc[:n] == doc[gram + width - 2 :]]] = True
    return np.flatnonzero(keep)


class Index:
    """Fingerprints of a block of items.

    For each K (with its reach to both sides): sorted fingerprints, the range of contexts of
    each, the contexts' words (0 outside the item), and the items of each context.
    """

    def __init__(self, ids: list[str], texts: list[bytes], window: int = WINDOW, k: int = K):
        self.ids, self.window = ids, window
        words, starts = words_of(texts)
        sizes = np.diff(starts)
        self.parts = []
        for n in sorted({min(int(s), window) for s in sizes if s}):
            gram, reach = (k, window - k) if n == window else (n, 0)
            mine = np.flatnonzero(sizes >= window if n == window else sizes == n)
            rows = []
            for i in mine:
                w = np.zeros(sizes[i] + 2 * reach, np.uint64)
                w[reach : reach + sizes[i]] = words[starts[i] : starts[i + 1]]
                g = gram_hashes(w[reach : reach + sizes[i]], gram)
                p = winnow(g, np.zeros(sizes[i], np.int8), gram, reach + 1)
                ctx = np.lib.stride_tricks.sliding_window_view(w, gram + 2 * reach)[p]
                rows.append(np.column_stack([g[p], ctx, np.full(len(p), i, np.uint64)]))
            rows = np.unique(np.concatenate(rows), axis=0)
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :-1] != rows[:-1, :-1]).any(1)
            first = np.flatnonzero(new)
            keys, at = np.unique(rows[first, 0], return_index=True)
            self.parts.append((gram, reach, keys, np.append(at, len(first)), rows[first, 1:-1], np.append(first, len(rows)), rows[:, -1].astype(np.int64)))

    def hits(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are hit, and (document, item) pairs, of documents whose words start at starts."""
        doc = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
        edge = np.zeros(len(words) + 1, np.int32)
        found = []
        for gram, reach, keys, at, contexts, ctx_items, items in self.parts:
            g = gram_hashes(words, gram)
            if not len(g):
                continue
            spots = winnow(g, doc, gram, reach + 1)
            k = np.searchsorted(keys, g[spots])
            ok = keys[np.minimum(k, len(keys) - 1)] == g[spots]
            spots, k = spots[ok], k[ok]
            # Few fingerprints are hits; each is compared with all contexts of its fingerprint, a bounded number at a time.
            counts = at[k + 1] - at[k]
            for lo, hi in _slices(counts, 1 << 16):
                p = np.repeat(spots[lo:hi], counts[lo:hi])
                c = ranges(at[k[lo:hi]], counts[lo:hi])
                d = doc[p]
                left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
                same = np.ones(len(p), bool)
                for j in range(gram):
                    same &= words[p + j] == contexts[c, reach + j]
                for out, sign in ((left, -1), (right, 1)):
                    on = same.copy()
                    for j in range(1, reach + 1):
                        q = p - j if sign < 0 else p + gram - 1 + j
                        inside = (q >= 0) & (q < len(words))
                        q = np.where(inside, q, 0)
                        on &= inside & (doc[q] == d) & (words[q] == contexts[c, reach - j if sign < 0 else reach + gram - 1 + j])
                        out += on
                full = same & (left + right + gram >= min(self.window, gram + reach))
                p, c, left, right, d = p[full], c[full], left[full], right[full], d[full]
                np.add.at(edge, p - left, 1)
                np.add.at(edge, p + gram + right, -1)
                n = ctx_items[c + 1] - ctx_items[c]
                pair = np.unique(np.column_stack([np.repeat(d, n), items[ranges(ctx_items[c], n)]]), axis=0)
                found.append(pair.astype(np.int64))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return np.cumsum(edge[:-1]) > 0, pairs


def _slices(counts: np.ndarray, most: int):
    """Slices whose counts add up to most or are one entry."""
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def _blocks(items: DataFrame, most: int):
    ids, texts, size = [], [], 0
    for row in items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).toLocalIterator():
        n = len(row.t or b"") // 2 + 1  # words at most
        if ids and size + n > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        if row.i is not None:
            ids.append(row.i)
            texts.append(bytes(row.t or b""))
            size += n
    yield ids, texts


def _scan(index: "Index", spans: bool):
    def run(batches):
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            out = []
            for lo, hi in chunks(texts):
                words, starts = words_of(texts[lo:hi])
                hit, pairs = index.hits(words, starts)
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit = total[starts[1:]] - total[starts[:-1]]
                which = np.searchsorted(pairs[:, 0], np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    mine = sorted({index.ids[k] for k in pairs[which[i] : which[i + 1], 1]}) if n_hit[i] else []
                    step = np.flatnonzero(np.diff(np.concatenate(([0], hit[starts[i] : starts[i + 1]].astype(np.int8), [0])))).tolist() if spans and n_hit[i] else []
                    out.append((int(starts[i + 1] - starts[i]), int(n_hit[i]), len(mine), mine, step))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["row", "n_words", "n_hit", "n_items", "items", "edges"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS, spans: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), edges (starts and ends of the hit runs of words)."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row {kind}, n_words long, n_hit long, n_items long, items array<string>, edges array<long>"
    blocks = list(_indexes(items, window, k, block_words))
    rows = docs.select(F.col("doc_id").alias("row"), F.col("text").cast("binary").alias("t"))
    if len(blocks) == 1:
        return rows.mapInArrow(_scan(blocks[0], spans), schema).withColumnRenamed("row", "doc_id")
    # Several blocks: unite each document's runs and items. Rows are told apart by doc_id and text.
    kind = f"struct<id:{kind},h:bigint>"
    schema = schema.replace(schema.split(",")[0], f"row {kind}")
    keyed = docs.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias("row"), F.col("text").cast("binary").alias("t"))
    parts = None
    for index in blocks:
        one = keyed.mapInArrow(_scan(index, True), schema)
        parts = one if parts is None else parts.unionByName(one)
    grouped = parts.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("edges")).alias("e"), (F.count("*") / len(blocks)).cast("int").alias("times"))
    merged = grouped.withColumn("edges", _union_runs(F.col("e"))).withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times"))))
    length = F.aggregate("edges", F.lit(0).cast("long"), lambda a, x: x - a)  # alternating sum
    return merged.select(F.col("row.id").alias("doc_id"), "n_words", F.when(F.size("edges") > 0, length).otherwise(F.lit(0)).alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "edges")


def _union_runs(edges):
    """Merged runs from a flat array of start, end, start, end."""
    runs = F.array_sort(F.transform(F.filter(F.transform(edges, lambda x, i: F.struct(i.alias("i"), x.alias("a"), F.get(edges, i + 1).alias("b"))), lambda s: s["i"] % 2 == 0), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))))
    empty = F.array().cast("array<bigint>")

    def add(acc, r):
        last = F.element_at(acc, -1)
        return F.when(F.size(acc) == 0, F.array(r["a"], r["b"])).when(r["a"] <= last, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(last, r["b"])))).otherwise(F.concat(acc, F.array(r["a"], r["b"])))

    return F.aggregate(runs, empty, add)


def _indexes(items: DataFrame, window: int, k: int, most: int):
    for ids, texts in _blocks(items, most):
        yield Index(ids, texts, window, k)


def _clean(index: "Index"):
    def run(batches):
        for b in batches:
            texts = [t.as_py() for t in b.column(b.num_columns - 1)]
            ok = np.ones(len(texts), bool)
            for lo, hi in chunks(texts):
                hit, pairs = index.hits(*words_of(texts[lo:hi]))
                ok[lo + np.unique(pairs[:, 0])] = False
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(ok))

    return run


def reject(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows that hold a window of any item; one pass for each block of items."""
    for index in _indexes(items, window, k, block_words):
        docs = beside(docs, F.col("text").cast("binary")).mapInArrow(_clean(index), docs.schema)
    return docs


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

