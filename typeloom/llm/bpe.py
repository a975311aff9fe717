"""Byte-level BPE encoding and decoding with a global distinct-word shuffle.

1. Each task deals its texts out to blocks of about BLOCK_BYTES. A block's texts are split
   into pre-tokens by the public pattern; its distinct ones (the words) are numbered, the most
   frequent first, and the texts become sequences of positions' word numbers.
2. A block's words go by a hash to buckets, one packed row for each block and bucket. A
   bucket meets all blocks' rows of the same words and encodes each distinct word once, by
   merging its bytes in the order of the ranks.
3. The ids go back to the words' blocks, joined on (block, bucket, place), and meet the
   sequences there: each position takes its word's ids, in order. Texts are never moved.
4. Decoding joins each id with the table of tokens' bytes (as large as the vocabulary, so
   broadcast as one array) and puts the bytes in the positions' order. What comes out is
   compared with the text's own checksum, so words that share a hash can't pass unnoticed.

A word occurs once in a block's rows, however frequent it is, so no key is hot. Null and
empty texts have no ids and decode to nothing; repeated rows are rows of their own; empty
tables give empty results. Other columns aren't read. Memory: a block's positions and words
(a few times BLOCK_BYTES), or the longest text; a bucket's distinct words.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm import pretokens
from typeloom.llm.common import chunks, cut, ranges, span_hashes

BLOCK_BYTES = 24 << 20
_NONE = 1 << 62


def read_ranks(path: str) -> bytes:
    """A vocabulary file's lines: a token in base64, a blank, and its rank."""
    with open(path, "rb") as f:
        return f.read()


def ranks_of(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


def encoder(lines: bytes) -> Callable[[bytes], list[int]]:
    """A function from a pre-token's bytes to its ids: the pair of the lowest rank (the first of equal ones) is merged until none is left."""
    ranks = ranks_of(lines)
    rank = ranks.get

    def encode(piece: bytes) -> list[int]:
        whole = rank(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 100:
            return _merged_long(piece, ranks)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) != _NONE:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], _NONE)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], _NONE)
        return [ranks[p] for p in parts]

    return encode


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long pieces, with a heap of pairs: its cost follows n log n, not the square of n."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:  # a part of the pair has changed since
            continue
        end[i], after[i], alive[j] = stop, after[j], False
        if after[j] < n:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n and (r := ranks.get(piece[left : end[after[left]]])) is not None:
                heapq.heappush(heap, (r, left, end[after[left]]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


# ---------------------------------------------------------------- packed rows


def _press(*parts: np.ndarray) -> bytes:
    """Arrays of whole numbers as one compressed byte string: each with its size and width."""
    out = []
    for x in parts:
        top = int(x.max()) if len(x) else 0
        kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
        out += [len(x).to_bytes(8, "little"), bytes([np.dtype(kind).itemsize]), x.astype(kind).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _open(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n, width = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8]
        out.append(np.frombuffer(raw, f"u{width}", n, at + 9))
        at += 9 + n * width
    return out


def _press_numbers(x: np.ndarray) -> bytes:
    """Numbers of which most are small: a byte each, and the larger ones beside, by bytes, each compressed by itself."""
    big = x[x >= 255] - 255
    planes = [np.minimum(x, 255), *(big >> k & 255 for k in (0, 8, 16, 24))]
    press = zstandard.ZstdCompressor(level=1)
    return b"".join(len(z).to_bytes(8, "little") + z for z in (press.compress(p.astype(np.uint8).tobytes()) for p in planes))


def _open_numbers(data: bytes) -> np.ndarray:
    open_, at, planes = zstandard.ZstdDecompressor(), 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        planes.append(np.frombuffer(open_.decompress(data[at + 8 : at + 8 + n]), np.uint8))
        at += 8 + n
    out = planes[0].astype(np.int64)
    out[planes[0] == 255] += sum(p.astype(np.int64) << 8 * k for k, p in enumerate(planes[1:]))
    return out


#: A byte that no text holds, as UTF-8 hasn't got it.
_GAP = b"\xff"


def _press_words(sizes: np.ndarray, flat: np.ndarray) -> bytes:
    """Words, each followed by a gap."""
    out = np.full(len(flat) + len(sizes), _GAP[0], np.uint8)
    out[ranges(np.cumsum(sizes + 1) - sizes - 1, sizes)] = flat
    return zstandard.ZstdCompressor(level=9).compress(out.tobytes())


def _open_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(_GAP)[:-1]


# ---------------------------------------------------------------- texts to blocks

#: block, kind, part, then by kind: 0 a bucket's words (later their ids), 1 each word's bucket, 2 some texts' sequences.
_ROW = "block long, kind int, part int, data binary, ids array<{kind}>, sizes binary"


class _Block:
    """Texts of a task, their words numbered together."""

    def __init__(self):
        self.size, self.name, self.parts = 0, hashlib.blake2b(digest_size=8), []

    def add(self, ids: pa.Array, texts: list[bytes]) -> None:
        buf, tokens, at = pretokens.split(texts)
        sizes = np.diff(tokens)
        keys, first, back, n = np.unique(span_hashes(buf, tokens[:-1], tokens[1:]), return_index=True, return_inverse=True, return_counts=True)
        words = buf[ranges(tokens[first], sizes[first])]
        self.parts.append((ids, np.diff(at), [zlib.crc32(t) for t in texts], keys, words, sizes[first], n, back.astype(np.int32)))
        self.size += len(buf)
        for t in texts:
            self.name.update(len(t).to_bytes(8, "little"))
            self.name.update(t)

    def rows(self, buckets: int):
        """(kind, part, data, ids, sizes) of all rows."""
        each = list(zip(*self.parts))
        keys, words, sizes, n = (np.concatenate(x) for x in each[3:7])
        keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        count = np.bincount(back, n, len(keys))
        order = np.argsort(-count, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        bucket, first = (keys[order] % np.uint64(buckets)).astype(np.int64), first[order]
        start = np.cumsum(sizes) - sizes
        yield 1, 0, _press(bucket), None, None
        by = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)):
            mine = first[by[edges[k] : edges[k + 1]]]
            yield 0, int(k), _press_words(sizes[mine], words[ranges(start[mine], sizes[mine])]), None, None
        done = 0
        for part, (ids, texts, sums, own, _, _, _, places) in enumerate(self.parts):
            spots = number[back[done : done + len(own)]][places]
            done += len(own)
            yield 2, part, _press_numbers(spots), ids, _press(texts, np.array(sums, np.int64))


def _blocks(buckets: int, kind: pa.DataType, most: int):
    def told(block: _Block):
        name = int.from_bytes(block.name.digest(), "little", signed=True)
        for k, part, data, ids, sizes in block.rows(buckets):
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids) if ids is not None else pa.nulls(1, pa.list_(kind))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary()), lists, pa.array([sizes], pa.binary())], ["block", "kind", "part", "data", "ids", "sizes"])

    def run(batches):
        block = _Block()
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(1)]
            for lo, hi in chunks(texts):
                block.add(b.column(0).slice(lo, hi - lo), texts[lo:hi])
                if block.size >= most:
                    yield from told(block)
                    block = _Block()
        if block.parts:
            yield from told(block)

    return run


# ---------------------------------------------------------------- words to ids, and back


def _encoded(lines, kind: pa.DataType):
    """Rows of words become rows of ids; each distinct word of the task's buckets is encoded once."""

    def run(batches):
        encode, known = encoder(lines.value), {}
        for b in batches:
            out = []
            for data in b.column(3).to_pylist():
                ids = []
                for word in _open_words(data):
                    mine = known.get(word)
                    if mine is None:
                        mine = known[word] = encode(word)
                    ids.append(mine)
                out.append(_press(np.array([len(x) for x in ids]), np.array([k for x in ids for k in x])))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(out, pa.binary()), pa.nulls(b.num_rows, pa.list_(kind)), pa.nulls(b.num_rows, pa.binary())], ["block", "kind", "part", "data", "ids", "sizes"])

    return run


class Decoder:
    """The table of tokens' bytes, joined with ids by their place in it."""

    def __init__(self, lines: bytes):
        ranks = ranks_of(lines)
        self.sizes = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, k in ranks.items():
            self.sizes[k] = len(token)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids' bytes, and where each id's end."""
        n = self.sizes[ids]
        return self.flat[ranges(self.at[ids], n)], np.cumsum(n)


class _Dictionary:
    """A block's ids by word number, from the rows of its buckets and the buckets of its words."""

    def __init__(self, buckets: np.ndarray, rows: dict[int, bytes]):
        counts, parts = [], []
        for k in sorted(rows):
            n, ids = _open(rows[k])
            counts.append(n.astype(np.int64))
            parts.append(ids.astype(np.int64))
        n, flat = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (counts, parts))
        if len(n) != len(buckets):
            raise ValueError("a block's words and its ids don't meet: docs must give the same rows each time")
        order = np.argsort(buckets, kind="stable")  # the words as the buckets list them
        start = np.cumsum(n) - n
        self.n, self.start, self.flat = np.empty_like(n), np.empty_like(n), flat
        self.n[order], self.start[order] = n, start

    def ids(self, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions' ids, and where each position's end."""
        n = self.n[spots]
        return self.flat[ranges(self.start[spots], n)], np.cumsum(n)


def _assembled(lines, digests: bool):
    def run(batches):
        decode = Decoder(lines.value)
        names = [str(k) for k in range(len(decode.sizes))]
        here, rows, words = None, {}, None
        for b in batches:
            for i in range(b.num_rows):
                block, kind, part, data = (b.column(k)[i].as_py() for k in range(4))
                if block != here:
                    here, rows, words = block, {}, None
                if kind == 0:
                    rows[part] = data
                elif kind == 1:
                    words = words or _Dictionary(_open(data)[0], rows)
                else:
                    yield texts(b.column(4)[i].values, _open(b.column(5)[i].as_py()), words.ids(_open_numbers(data)), decode, names)

    def texts(docs, sizes, found, decode, names):
        (ids, ends), (n_words, sums) = found, sizes
        spots = np.concatenate(([0], np.cumsum(n_words.astype(np.int64))))
        at = np.concatenate(([0], ends))[spots]
        flat, stops = decode(ids)
        cuts = np.concatenate(([0], stops))[at].tolist()
        raw, at, out = flat.tobytes(), at.tolist(), []
        for i, check in enumerate(sums.tolist()):
            text = raw[cuts[i] : cuts[i + 1]]
            if zlib.crc32(text) != check:
                raise ValueError("a text's ids don't decode to it: two words share a hash")
            mine = ids[at[i] : at[i + 1]]
            if digests:
                listed = " ".join([names[k] for k in mine.tolist()])
                out.append((len(mine), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            else:
                out.append((len(mine), mine.astype(np.int32), text))
        n, a, c = zip(*out)
        lists = pa.array(a, pa.string()) if digests else pa.array([x.tolist() for x in a], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([docs, pa.array(n, pa.int64()), lists, pa.array(c, pa.string() if digests else pa.binary())], ["doc_id", "n_tokens", "a", "b"])

    return run


def _coded(docs: DataFrame, path: str, pattern: str, digests: bool, block_bytes: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    if pattern != pretokens.PATTERN:
        raise ValueError("texts are split by pretokens.PATTERN only")
    spark = docs.sparkSession
    lines = spark.sparkContext.broadcast(read_ranks(path))
    kind, arrow = dict(docs.dtypes)["doc_id"], to_arrow_type(docs.schema["doc_id"].dataType)
    # As many buckets as the shuffle has partitions, so that a bucket's words grow no faster than a partition.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = _ROW.format(kind=kind)
    rows = cut(docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(_blocks(buckets, arrow, block_bytes), row))
    ids = rows.where("kind = 0").repartition("part").mapInArrow(_encoded(lines, arrow), row)
    met = rows.where("kind > 0").unionByName(ids).repartition("block").sortWithinPartitions("block", "kind", "part")
    return met.mapInArrow(_assembled(lines, digests), f"doc_id {kind}, n_tokens long, a {'string' if digests else 'array<int>'}, b {'string' if digests else 'binary'}")


def encode(docs: DataFrame, path: str, pattern: str = pretokens.PATTERN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids, decoded (the text that the ids stand for) of each row."""
    return _coded(docs, path, pattern, False, block_bytes).select("doc_id", "n_tokens", F.col("a").alias("ids"), F.decode("b", "utf-8").alias("decoded"))


def digest(docs: DataFrame, path: str, pattern: str = pretokens.PATTERN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, by the same way as encode."""
    return _coded(docs, path, pattern, True, block_bytes).withColumnsRenamed({"a": "ids_sha256", "b": "decoded_sha256"})
