"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its hashed byte n-grams (with the blanks
around it), so words that were never seen share the vectors of their parts. The vectors of
WINDOW consecutive words are averaged and go into a softmax over two labels; a text's
score is that of its worst window, so a long text doesn't dilute a few words. Embeddings
and softmax are trained jointly in numpy, each step on every text's worst window so far.

Learning takes labelled rows of which crc32(doc_id as text) mod 3 isn't 1, at most
MOST_TOXIC and MOST_CLEAN of them in the order of a hash of their ids, and none of over
MOST_BYTES (the bounds on what the one task that fits the model holds). Scoring is one map over all rows; each n-gram's share of the
logit is one number in a table of fixed size.

Null and empty texts, and texts without words, get the softmax's bias alone. Without labelled
rows of both kinds every score is 0. Several labels of a doc_id: the highest counts. Null
doc_ids are not held out and never learnt from. Repeated rows get equal scores; empty
tables give empty results; other columns aren't read. Memory: about CHUNK_BYTES of text at
a time, or the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import LOWER, SPLIT_ALNUM, beside, chunks, crc_mod, ranges, span_hashes, word_spans

BUCKETS = 1 << 18
SIZES = (3, 4, 5, 6)
DIM = 8
WINDOW = 6
#: Learning takes at most so many rows of each label, and none whose text is longer.
MOST_TOXIC, MOST_CLEAN, MOST_BYTES = 3000, 6000, 1 << 16
THRESHOLD = 0.7


class Bag:
    """Words of some texts and their n-grams' buckets."""

    def __init__(self, texts: list):
        buf = np.frombuffer(b" " + b" ".join([*(t or b"" for t in texts), b""]), np.uint8)
        first = 1 + np.concatenate(([0], np.cumsum([len(t or b"") + 1 for t in texts])))
        low = LOWER[buf]
        self.a, self.b = word_spans(low, SPLIT_ALNUM)
        self.starts = np.searchsorted(self.a, first)
        clean = np.where(SPLIT_ALNUM[low], np.uint8(0x20), low).astype(np.uint32)
        self.buckets, h = {}, clean.copy()
        for n in range(2, max(SIZES) + 1):
            h = h[: len(clean) - n + 1] * np.uint32(0x01000193) + clean[n - 1 :] + np.uint32(n)
            if n in SIZES:
                x = h ^ h >> np.uint32(15)
                x = x * np.uint32(0x85EBCA6B)
                self.buckets[n] = (x ^ x >> np.uint32(13)) & np.uint32(BUCKETS - 1)
        self.grams = sum(np.maximum(self.b - self.a + 3 - n, 0) for n in SIZES)
        self.clean = clean.astype(np.uint8)

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of some words' n-grams, one word after the other, and how many each word has."""
        a, b = self.a[words], self.b[words]
        parts = []
        for n, k in self.buckets.items():
            many = np.maximum(b - a + 3 - n, 0)
            parts.append((np.repeat(np.arange(len(words)), many), k[ranges(a - 1, many)]))
        word, bucket = (np.concatenate(x) for x in zip(*parts))
        return bucket[np.argsort(word, kind="stable")].astype(np.int32), self.grams[words]

    def word_scores(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.a))
        for n, k in self.buckets.items():
            total = np.zeros(len(k) + 1)
            np.cumsum(table[k], out=total[1:])
            has = self.b - self.a + 3 - n > 0
            out[has] += total[self.b[has] - n + 2] - total[self.a[has] - 1]
        return out / np.maximum(self.grams, 1)

    def worst(self, scores: np.ndarray, window: int = WINDOW) -> np.ndarray:
        return worst_windows(self.starts, scores, window)[0]


def worst_windows(starts: np.ndarray, scores: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's highest window mean (0 without words), where that window starts, and its words."""
    n = np.diff(starts)
    size = np.minimum(n, window)
    total = np.concatenate(([0.0], np.cumsum(scores)))
    many = np.maximum(n - window, 0) + 1
    many[n == 0] = 0
    doc = np.repeat(np.arange(len(n)), many)
    at = ranges(starts[:-1], many)
    mean = (total[at + size[doc]] - total[at]) / np.maximum(size[doc], 1)
    best, where = np.zeros(len(n)), starts[:-1].copy()
    full = np.flatnonzero(many)
    if len(full):
        cut = np.concatenate(([0], np.cumsum(many[full])[:-1]))
        best[full] = np.maximum.reduceat(mean, cut)
        hit = np.flatnonzero(mean == best[doc])
        d, first = np.unique(doc[hit], return_index=True)
        where[d] = at[hit[first]]
    return best, where, size


class Sample:
    """Texts to learn from, as numbers of distinct words; each distinct word's n-gram buckets are kept once."""

    def __init__(self, texts: list):
        known: dict[int, int] = {}
        words, starts, buckets, sizes, done = [], [np.zeros(1, np.int64)], [], [], 0
        for lo, hi in chunks(texts):
            bag = Bag(texts[lo:hi])
            h = span_hashes(bag.clean, bag.a, bag.b)
            keys, first, back = np.unique(h, return_index=True, return_inverse=True)
            number = np.array([known.setdefault(k, len(known)) for k in keys.tolist()], np.int32)
            new = first[np.argsort(number)][np.sort(number) >= sum(map(len, sizes))]
            grams, many = bag.grams_of(new)
            buckets.append(grams), sizes.append(many)
            words.append(number[back])
            starts.append(bag.starts[1:] + done)
            done += len(h)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        self.words, self.starts = join(words, np.int32), np.concatenate(starts)
        self.buckets, self.many = join(buckets, np.int32), join(sizes, np.int64)
        self.first = np.cumsum(self.many) - self.many

    def slices(self, most: int = 1 << 18):
        """Slices of the texts that hold about so many words."""
        lo, n = 0, len(self.starts) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + most, "right")) - 1)
            yield lo, min(hi, n)
            lo = min(hi, n)

    def word_scores(self, flat: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flat[self.buckets], self.first) / self.many if len(self.many) else np.zeros(0)

    def worst(self, flat: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = self.word_scores(flat)
        parts = []
        for lo, hi in self.slices():
            begin = self.starts[lo]
            best, where, size = worst_windows(self.starts[lo : hi + 1] - begin, scores[self.words[begin : self.starts[hi]]], window)
            parts.append((best, where + begin, size))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def features(self, where: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, bucket and weight of each n-gram of the given windows; the weights of a window add up to 1."""
        w = self.words[ranges(where, size)]
        row = np.repeat(np.arange(len(where)), size)
        many = self.many[w]
        return np.repeat(row, many), self.buckets[ranges(self.first[w], many)], np.repeat(1 / (many * np.maximum(size[row], 1)), many).astype(np.float32)


def fit(texts: list, labels: np.ndarray, folds: int = 3) -> tuple[np.ndarray, float]:
    """Each bucket's share of the logit, and the bias.

    The logits are brought in line with texts that weren't learnt from: models of all folds
    but one score that one, and a slope and a bias are fitted to these scores.
    """
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(BUCKETS, np.float32), -np.inf if not labels.any() else np.inf
    sample = Sample(texts)
    table, bias = _learnt(sample, labels, np.arange(len(labels)))
    part = np.zeros(len(labels), np.int64)
    for y in (0, 1):
        mine = np.flatnonzero(labels == y)
        part[mine] = np.arange(len(mine)) % folds
    z = np.zeros(len(labels))
    for k in range(folds):
        rest = np.flatnonzero(part != k)
        if labels[rest].min() == labels[rest].max():
            return table, bias
        t, b = _learnt(sample, labels, rest)
        z[part == k] = (sample.worst(t)[0] + b)[part == k]
    slope, shift = _calibrated(z, labels)
    return (table * slope).astype(np.float32), bias * slope + shift


def _calibrated(z: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope of a logistic regression of y on z (drawn a little to 1), and the bias that puts THRESHOLD where F1 is highest."""
    w = np.array([1.0, 0.0])
    x = np.column_stack([z, np.ones(len(z))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * (w - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
    slope = max(float(w[0]), 0.05)
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    best = int(np.argmax(2 * hits / (np.arange(1, len(z) + 1) + y.sum())))
    spot = z[order[best : best + 2]].mean()
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * spot)


def _learnt(sample: Sample, every: np.ndarray, rows: np.ndarray, steps: int = 350, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """A model of the sample's texts with the given numbers."""
    labels = every[rows]
    share = labels.mean()
    # A first guess: how much more often an n-gram's texts are toxic than others are, drawn to 0 by 20 texts.
    seen, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i, y in zip(rows, labels):
        w = np.unique(sample.words[sample.starts[i] : sample.starts[i + 1]])
        one = np.unique(sample.buckets[ranges(sample.first[w], sample.many[w])])
        seen[one] += 1
        bad[one] += y
    guess = np.log((bad + 20 * share) / (seen * share + 20 * share))
    rng = np.random.default_rng(seed)
    way = rng.normal(0, 1, DIM)
    way /= np.linalg.norm(way)
    soft = np.array([-way, way])
    table = (guess[:, None] * way[None] * 2 + rng.normal(0, 0.01, (BUCKETS, DIM))).astype(np.float32)
    bias = np.array([0.0, -4.0])
    sq_table, sq_soft, sq_bias = np.full(BUCKETS, 1e-8), np.full((2, DIM), 1e-4), np.full(2, 1e-4)
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    for _ in range(max(3, -(-steps * 128 // len(labels)))):
        _, where, size = sample.worst((table @ (soft[1] - soft[0])).astype(np.float32))
        for some in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 128)):
            row, k, w = sample.features(where[rows[some]], size[rows[some]])
            of = table[k]
            mean = np.column_stack([np.bincount(row, of[:, j] * w, len(some)) for j in range(DIM)])
            z = mean @ soft.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), labels[some].astype(int)] -= 1
            p *= weight[some, None]
            back = (p @ soft).astype(np.float32)
            g_soft, g_bias = p.T @ mean / len(some), p.mean(0)
            g = w[:, None] * back[row]
            sq_table += np.bincount(k, (g**2).mean(1), BUCKETS)
            g *= np.float32(-0.2 * rate) / np.sqrt(sq_table[k]).astype(np.float32)[:, None]
            np.add.at(table, k, g)
            sq_soft += g_soft**2
            sq_bias += g_bias**2
            soft -= rate * 0.1 * g_soft / np.sqrt(sq_soft)
            bias -= rate * 0.1 * g_bias / np.sqrt(sq_bias)
    return (table @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0])


def score_texts(texts: list, table: np.ndarray, bias: float) -> np.ndarray:
    bag = Bag(texts)
    z = bag.worst(bag.word_scores(table)) + bias
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """A model of a bounded sample of the labelled rows that aren't held out."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    some = None
    for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        one = marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        some = one if some is None else some.unionByName(one)
    # Rows that share a doc_id count once (the smallest text's hash), and texts of over MOST_BYTES aren't learnt from.
    text = F.col("text").cast("binary")
    rows = docs.select("doc_id", text.alias("t"), F.xxhash64("text").alias("h")).join(F.broadcast(some), "doc_id").where(F.length("t") <= MOST_BYTES)
    found = rows.groupBy("doc_id").agg(F.min(F.struct("h", "t")).alias("x"), F.max("y").cast("int").alias("y")).select("doc_id", "x.t", "y")
    # One task fits the bounded sample, so that no text comes to the driver.
    model = found.repartition(1).sortWithinPartitions("doc_id").select("t", "y").mapInArrow(_fitted, "weights binary, bias double").first()
    return (np.frombuffer(model.weights, np.float32), model.bias) if model else fit([], np.zeros(0))


def _fitted(batches):
    texts, marks = [], []
    for b in batches:
        texts += b.column(0).to_pylist()
        marks += b.column(1).to_pylist()
    table, bias = fit(texts, np.array(marks))
    yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["weights", "bias"])


def _scored(model):
    def run(batches):
        table, bias = model.value
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            parts = [score_texts(texts[lo:hi], table, bias) for lo, hi in chunks(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    return run


def _marked(model, keep: float):
    """Rows (whole) whose text scores below keep."""

    def run(batches):
        table, bias = model.value
        for b in batches:
            texts = [t.as_py() for t in b.column(b.num_columns - 1)]
            parts = [score_texts(texts[lo:hi], table, bias) for lo, hi in chunks(texts)]
            ok = np.concatenate(parts) < keep if parts else np.zeros(0, bool)
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(ok))

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(_scored(model), f"doc_id {kind}, score double")
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text is toxic."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    return beside(docs, F.col("text").cast("binary")).mapInArrow(_marked(model, threshold), docs.schema)
