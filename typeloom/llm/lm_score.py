"""Language-model scoring: word counts of the corpus, and a causal self-attention model.

Base score. Tokens are the runs of non-blanks of the lower-cased text and one end. Their
counts over all training rows come from one aggregation, combined in each partition first.
The HEAD most frequent tokens go to all executors (a bound on what is broadcast); every
other token of a document is a row that is joined with its count, and none of those is
frequent enough to make a hot key.

Model score. A text's subword ids (byte-level BPE) and an end are predicted one after the
other. One causal self-attention layer reads the ids before, each by an embedding of its
own; its output goes down a Huffman tree of all ids, each inner node of which has a vector
and a bias, so each id's probability follows the context. The tree's shape and its first
biases are the training corpus's counts, over all its rows. Windows of SPAN ids overlap:
each scores its last STRIDE ids with at least SPAN - STRIDE ids of context before the first
(as far as the text has them), so each id is scored once. Windows of many texts are one
masked batch.

Each text is split once: its bytes and subword ids are stored in the shared folder until all
rows are scored, and counts, learning and scores read them there. In learning, the nodes near
the tree's root are in blocks whose products with a batch's places are products of matrices;
scoring goes node by node, so that equal texts get equal scores.

Learning takes the rows of which crc32(doc_id as text) mod 5 isn't 1 (null ids too), and
all places of all of them, in the same windows as scoring, however short the text. The
driver's numpy finds common first weights on the whole texts of at most SAMPLE of them, in
the order of a hash of their ids. From these on every row is learnt from once, in the
executors: in each of the ROUNDS each task's rows move a copy of the model by Adagrad, and
the tasks' moves are averaged, each row of weights by the places that met it. Scores thus
depend a little on how the rows lie in partitions.

Null and empty texts have the end only. Repeated rows get equal scores and count each in
learning; empty tables give empty results; other columns aren't read. Memory: about
CHUNK_BYTES of text at a time, or the longest text.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm import bpe, pretokens
from typeloom.llm.common import LOWER, SPLIT_SPACE, chunks, crc_mod, cut, join_texts, ranges, span_hashes, stash, word_spans

HEAD = 1 << 19
SAMPLE = 800
DIM = 16
SPAN, STRIDE = 40, 32
#: A row of weights is at most WIDE values; moves are multiples of GRAIN, so that their sums don't depend on the order.
WIDE, GRAIN = DIM + 1, np.float32(2**-16)
#: Nodes of the tree in the block at its root and in each below it: their products with many places are one matrix product.
ROOT, BLOCK = 16, 32
#: Writer's options that keep executors' memory small: groups of rows of 16 MB, no tables of distinct texts.
SMALL = {"parquet.block.size": 16 << 20, "parquet.enable.dictionary": "false"}
#: Sixteenths of the training rows at which the rounds of learning end.
ROUNDS = (1, 4, 16)


def held_out(doc_id):
    return F.coalesce(crc_mod(doc_id, 5) == 1, F.lit(False))


def tokens_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, and where each text's words start (and the end)."""
    buf, starts = join_texts(texts)
    a, b = word_spans(buf, SPLIT_SPACE)
    return span_hashes(LOWER[buf], a, b), np.searchsorted(a, starts)


# ---------------------------------------------------------------- the model


class Subwords:
    """Subword ids of texts; each distinct pre-token is encoded once in a task (or again after most others)."""

    def __init__(self, lines: bytes, pattern: str, most: int = 300_000):
        import tiktoken

        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks_of(lines), special_tokens={})
        self.encode = lambda piece: library.encode_ordinary(piece.decode("utf-8", "replace"))
        self.most = most
        self._forget()

    def _forget(self) -> None:
        """Known pre-tokens by their hashes, in order: where each one's ids start in the pool, and how many they are."""
        self.keys, self.begin, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start (and the end)."""
        buf, tokens, at = pretokens.split(texts)
        keys, first, back = np.unique(span_hashes(buf, tokens[:-1], tokens[1:]), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys.take(place, mode="clip") != keys
        if new.any():
            data, encode = buf.tobytes(), self.encode
            parts = [encode(data[a:b]) for a, b in zip(tokens[first[new]].tolist(), tokens[first[new] + 1].tolist())]
            size = np.array([len(p) for p in parts], np.int64)
            begin = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(parts), np.int32, int(size.sum()))))
            self.keys, self.begin, self.size = (np.insert(x, place[new], y) for x, y in ((self.keys, keys[new]), (self.begin, begin), (self.size, size)))
            place += np.cumsum(new) - new
        n = self.size[place][back]
        return self.pool[ranges(self.begin[place][back], n)].astype(np.int64), np.concatenate(([0], np.cumsum(n)))[at]


def windows(starts: np.ndarray, span: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts whose places start at starts (and the end): each window's first scored place, its text's first place, its end."""
    n = np.diff(starts)
    many = -(-n // stride)
    text = np.repeat(np.arange(len(n)), many)
    first = ranges(np.zeros(len(n), np.int64), many) * stride + starts[:-1][text]
    return first, starts[:-1][text], np.minimum(first + stride, starts[1:][text])


def _mask(span: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """0 where the query at window place span - stride + s may see key t, else -inf; and their distance."""
    gap = (span - stride + np.arange(stride))[:, None] - np.arange(span)[None]
    return np.where(gap >= 0, 0, -np.inf).astype(np.float32), np.clip(gap, 0, span - 1)


HIDE, GAP = _mask(SPAN, STRIDE)
#: Up to this size no weight of a key, nor a sum of them, is too large or small for a float.
SAFE = 60
BACK, ONES = np.arange(STRIDE - SPAN, STRIDE), np.ones((SPAN, 1), np.float32)


def _attend(z: np.ndarray, far: np.ndarray, keys: np.ndarray, first: np.ndarray, low: np.ndarray, large: bool) -> None:
    """Makes scores z of keys their weights, not yet divided by their sums: far is added, keys before low are left out; large: some may be beyond SAFE."""
    z += far
    near = np.flatnonzero(first - low < SPAN - STRIDE)
    z[near] += np.where(keys[near] >= low[near, None], np.float32(0), np.float32(-np.inf))[:, None, :]
    if large:
        z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)


def _slope(sides: np.ndarray, z: np.ndarray) -> np.ndarray:
    """By z, of -log of the probability of taking these sides."""
    z *= sides
    np.clip(z, -30, 30, out=z)
    np.exp(z, out=z)
    z += 1
    return np.divide(-sides, z, out=z)


class Tree:
    """A Huffman tree of the ids: each id's inner nodes from its leaf upwards, and on which side of them it is (1 or -1)."""

    def __init__(self, mass: np.ndarray):
        n = len(mass)
        order = np.argsort(mass, kind="stable")
        weight = np.concatenate((mass[order], np.zeros(n - 1))).tolist()
        up, side = np.zeros(2 * n - 1, np.int64), np.ones(2 * n - 1, np.int8)
        self.bias = np.zeros(n - 1, np.float32)
        leaf, inner = 0, n
        for new in range(n, 2 * n - 1):
            pair = []
            for _ in range(2):
                if leaf < n and (inner == new or weight[leaf] <= weight[inner]):
                    pair.append(leaf)
                    leaf += 1
                else:
                    pair.append(inner)
                    inner += 1
            x, y = pair
            up[x] = up[y] = new
            side[y] = -1
            weight[new] = weight[x] + weight[y]
            self.bias[new - n] = np.log(weight[x] / weight[y])
        who, here, parts = np.arange(n), np.arange(n), []
        while n > 1 and len(who):
            parts.append((order[who], up[here] - n, side[here]))
            here = up[here]
            live = here < 2 * n - 2
            who, here = who[live], here[live]
        ids, nodes, sides = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        by = np.argsort(ids, kind="stable")
        self.depth = np.bincount(ids, minlength=n)
        self.at = np.cumsum(self.depth) - self.depth
        self._block(up[n:] - n if n > 1 else np.zeros(0, np.int64))
        self.nodes, self.sides = self.number[nodes[by]], sides[by].astype(np.float32)
        self.bias = self.bias[np.argsort(self.number)]
        self.column = self.columns[self.nodes] if len(nodes) else self.nodes
        self.lower = np.bincount(ids[by], self.nodes >= self.blocks[-1], n).astype(np.int64)
        self.block = np.zeros(n, np.uint8 if len(self.blocks) < 257 else np.uint16)
        np.maximum.at(self.block, ids[by], self.member[self.nodes])

    def _block(self, up: np.ndarray) -> None:
        """Numbers the nodes: the ROOT heaviest, then of each tree below them the BLOCK heaviest, then all others.

        Each block of nodes hangs together, so a way goes through the first block, at most one more, and then others.
        """
        n = len(up)
        block, count = [0] * n, [0]
        for i, above in zip(range(n - 1, -1, -1), up[::-1].tolist()):
            if count[0] < ROOT:
                b = 0
            elif block[above] == 0:
                b = len(count)
                count.append(0)
            else:
                b = block[above]
                if b < 0 or count[b] == BLOCK:
                    block[i] = -1
                    continue
            block[i] = b
            count[b] += 1
        block = np.array(block, np.int64)
        block[block < 0] = len(count)
        order = np.lexsort((-np.arange(n), block))
        self.number = np.empty(n, np.int64)
        self.number[order] = np.arange(n)
        #: Where each block starts, and the end; each node's block (0 of those in none) and its column among a way's.
        self.blocks = np.concatenate(([0], np.cumsum(count)))
        self.member = np.where(block[order] < len(count), block[order], 0)
        self.columns = np.arange(n) - np.concatenate((self.blocks, [0]))[block[order]] + ROOT * (self.member > 0)

    def paths(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and sides of all ids one after the other, how many each id has, and where each id's start."""
        spots, m, begin = self.spots(ids)
        return self.nodes.take(spots), self.sides.take(spots), m, begin

    def spots(self, ids: np.ndarray, part: str = "all") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in nodes, sides and column of all ids one after the other, how many each id has, and where each id's start; of nodes in blocks, or the others."""
        at, depth = self.at, self.depth
        if part != "all":
            at, depth = (at, self.lower) if part == "others" else (at + self.lower, depth - self.lower)
        m = depth.take(ids)
        ends = np.cumsum(m)
        begin = ends - m
        spots = np.repeat(at.take(ids) - begin, m)
        spots += np.arange(len(spots))
        return spots, m, begin


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sum of each one's rows."""
    order = np.argsort(keys.astype(np.uint16) if len(keys) and keys.max() < 1 << 16 else keys, kind="stable")
    sorted_keys = keys.take(order)
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return sorted_keys.take(first), np.add.reduceat(rows.take(order, 0), first, axis=0)


def _cells(tree: Tree, y: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """For targets in the order of their blocks: where their ways' nodes in blocks stand in a table of ROOT + BLOCK columns a place, the ways' places in the tree, and each block's nodes, places and columns."""
    spots, m, _ = tree.spots(y, "blocks")
    cells = np.repeat(np.arange(0, len(y) * (ROOT + BLOCK), ROOT + BLOCK), m)
    cells += tree.column.take(spots)
    starts = tree.blocks.tolist()
    ends = np.cumsum(np.bincount(blocks, minlength=len(starts) - 1)).tolist()
    slices = [(slice(0, starts[1]), slice(0, len(y)), slice(0, starts[1]))]
    slices += [(slice(a, b), slice(lo, hi), slice(ROOT, ROOT + b - a)) for a, b, lo, hi in zip(starts[1:], starts[2:], ends, ends[1:]) if lo < hi]
    return cells, spots, slices


def _lined(tree: Tree, h: np.ndarray, live: np.ndarray, targets: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, ...]:
    """Live places in the order of their targets' blocks, so that each block of nodes is a product with consecutive places; their targets, the blocks, and rows of h with a one."""
    y = targets.take(spots.reshape(-1).take(live))
    blocks = tree.block.take(y)
    order = np.argsort(blocks, kind="stable")
    live = live.take(order)
    hr = np.ones((len(live), DIM + 1), np.float32)
    hr[:, :DIM] = h.reshape(-1, DIM).take(live, 0)
    return live, y.take(order), blocks, hr


def _products(w: np.ndarray, hr: np.ndarray, slices: list) -> np.ndarray:
    out = np.empty((len(hr), ROOT + BLOCK), np.float32)
    for nodes, some, columns in slices:
        np.matmul(hr[some], w[nodes].T, out=out[some, columns])
    return out


class Attention:
    """An embedding of each id, queries, keys, values, a bias by distance, and a vector and bias of each node of the ids' tree.

    Before any learning the tree's biases give each id its share of counts.
    """

    def __init__(self, n_ids: int, counts: np.ndarray, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s, a=0.3: r.normal(0, a, s).astype(np.float32)
        self.n_ids = n_ids
        self.tree = Tree(counts + 0.5)
        self.w = {"emb": f(n_ids + 1, DIM, a=0.5), "q": f(DIM, DIM), "k": f(DIM, DIM), "v": f(DIM, DIM), "far": np.zeros((SPAN, 1), np.float32), "own": np.eye(DIM, dtype=np.float32), "node": np.zeros((n_ids - 1, DIM + 1), np.float32)}
        self.w["node"][:, DIM] = self.tree.bias
        self.s = {k: np.ones_like(v) for k, v in self.w.items()}
        self.met = {k: np.zeros(len(v)) for k, v in self.w.items()}

    def train(self, ids: np.ndarray, starts: np.ndarray, steps: int | None = 700, batch: int = 64, rate: float = 0.1, seed: int = 5) -> None:
        """Adagrad on windows as scoring has them, so every place of every text is a target: steps random batches, or all windows once."""
        inputs, targets, at = places(ids, starts, self.n_ids)
        first, low, high = windows(at, SPAN, STRIDE)
        if not len(first):
            return
        r = np.random.default_rng(seed)
        if steps is None:
            turns = np.array_split(r.permutation(len(first)), -(-len(first) // batch))
        else:
            turns = [r.choice(len(first), batch) for _ in range(steps)]
        for i in turns:
            self._step(inputs, targets, first[i], low[i], high[i], np.float32(rate))
        self._meet(inputs, targets, first, low, high, np.bincount(np.concatenate(turns), minlength=len(first)))

    def _meet(self, inputs, targets, first, low, high, times) -> None:
        """Counts the places that met each row of weights when windows were learnt from so many times."""
        place = np.repeat(times, high - first)
        for name in ("q", "k", "v", "far", "own"):
            self.met[name] += place.sum()
        counts = np.bincount(targets, place, self.n_ids).astype(np.int64)
        some = np.flatnonzero(counts)
        spots, m, _ = self.tree.spots(some)
        self.met["node"] += np.bincount(self.tree.nodes.take(spots), np.repeat(counts[some], m), self.n_ids - 1)
        seen = np.bincount(np.maximum(low, first + STRIDE - SPAN), times, len(inputs) + 1) - np.bincount(high, times, len(inputs) + 1)
        self.met["emb"] += np.bincount(inputs, np.cumsum(seen)[:-1], self.n_ids + 1)

    def _step(self, inputs, targets, first, low, high, rate) -> None:
        w, hide, gap = self.w, HIDE, GAP
        keys = first[:, None] + BACK
        x = inputs.take(keys, mode="clip")
        e = w["emb"].take(x, 0)
        flat = lambda t: t.reshape(-1, t.shape[-1])
        # All four products of an embedding are one.
        scale = np.float32(DIM**-0.5)
        four = np.concatenate((w["q"] * scale, w["k"], w["v"], w["own"]), 1)
        made = (flat(e) @ four).reshape(*x.shape, 4 * DIM)
        q, k, v, own = (made[..., i : i + DIM] for i in range(0, 4 * DIM, DIM))
        q, own = q[:, SPAN - STRIDE :], own[:, SPAN - STRIDE :]
        a = np.matmul(q, k.transpose(0, 2, 1))
        large = max(a.max(), -a.min()) + np.abs(w["far"]).max() > SAFE
        _attend(a, w["far"][gap, 0] + hide, keys, first, low, large)
        a /= a @ ONES
        h = np.matmul(a, v)
        pure = h + own
        np.tanh(pure, out=pure)
        h, pure = pure, h
        spots = first[:, None] + np.arange(STRIDE)
        live, y, blocks, hr = _lined(self.tree, h, np.flatnonzero(spots < high[:, None]), targets, spots)
        dh = np.zeros_like(h)
        flat(dh)[live] = self._down(y, blocks, hr, rate)[:, :DIM]
        h *= h
        dh *= np.subtract(1, h, out=h)
        dz = np.matmul(dh, v.transpose(0, 2, 1))
        dz -= np.einsum("bij,bij->bi", dh, pure)[:, :, None]
        dz *= a
        back = np.zeros_like(made)
        np.matmul(dz, k, out=back[:, SPAN - STRIDE :, :DIM])
        np.matmul(dz.transpose(0, 2, 1), q, out=back[..., DIM : 2 * DIM])
        np.matmul(a.transpose(0, 2, 1), dh, out=back[..., 2 * DIM : 3 * DIM])
        back[:, SPAN - STRIDE :, 3 * DIM :] = dh
        de = flat(back) @ four.T
        grads = flat(e).T @ flat(back)
        grads[:, :DIM] *= scale
        for i, name in enumerate(("q", "k", "v", "own")):
            self._move(name, slice(None), grads[:, i * DIM : (i + 1) * DIM], rate)
        far = np.bincount(gap.reshape(-1), dz.sum(0).reshape(-1), SPAN).astype(np.float32)[:, None]
        self._move("far", slice(None), far, rate)
        seen = np.flatnonzero((keys >= low[:, None]) & (keys < high[:, None]))
        self._move("emb", *_summed(x.reshape(-1)[seen], de.take(seen, 0)), rate)

    def _down(self, y, blocks, hr, rate) -> np.ndarray:
        """Learns the targets y's ways down the tree from the rows hr, both in the order of blocks; the rows' gradients."""
        tree, w = self.tree, self.w["node"]
        cells, spots, slices = _cells(tree, y, blocks)
        z = _products(w, hr, slices).reshape(-1).take(cells)
        d = np.zeros((len(y), ROOT + BLOCK), np.float32)
        d.reshape(-1)[cells] = _slope(tree.sides.take(spots), z)
        back, up = np.empty_like(hr), np.zeros((tree.blocks[-1], DIM + 1), np.float32)
        for nodes, some, columns in slices:
            x = d[some, columns]
            np.matmul(x.T, hr[some], out=up[nodes])
            if columns.start:
                back[some] += x @ w[nodes]
            else:
                np.matmul(x, w[nodes], out=back)
        spots, m, begin = tree.spots(y, "others")
        if len(spots):
            nodes, some = tree.nodes.take(spots), np.flatnonzero(m)
            u, hw = w.take(nodes, 0), hr.take(np.repeat(np.arange(len(y)), m), 0)
            d = _slope(tree.sides.take(spots), np.einsum("ij,ij->i", u, hw))[:, None]
            hw *= d
            u *= d
            back[some] += np.add.reduceat(u, begin[some], axis=0)
            self._move("node", *_summed(nodes, hw), rate)
        self._move("node", slice(0, len(up)), up, rate)
        return back

    def _move(self, name, rows, grad, rate) -> None:
        w, s = self.w[name], self.s[name]
        total = grad * grad
        total += s[rows] if isinstance(rows, slice) else s.take(rows, 0)
        s[rows] = total
        np.sqrt(total, out=total)
        np.divide(grad, total, out=total)
        total *= rate
        w[rows] -= total

    def copy(self) -> Attention:
        """The same weights, with no places met yet; the tree is shared."""
        new = object.__new__(Attention)
        new.n_ids, new.tree = self.n_ids, self.tree
        new.w, new.s = ({k: v.copy() for k, v in x.items()} for x in (self.w, self.s))
        new.met = {k: np.zeros(len(v)) for k, v in self.met.items()}
        return new

    def moved(self, old: Attention) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of weights that learning met since old, how many places met each, and their moves (WIDE values, in steps of GRAIN)."""
        rows, n, moves, base = [], [], [], 0
        for name, w in self.w.items():
            some = np.flatnonzero(self.met[name])
            move = np.zeros((len(some), WIDE), np.float32)
            move[:, : w.shape[1]] = np.round((w[some] - old.w[name][some]) / GRAIN) * GRAIN
            rows.append(some + base)
            n.append(self.met[name][some])
            moves.append(move)
            base += len(w)
        return np.concatenate(rows), np.concatenate(n), np.concatenate(moves)

    def add(self, rows: np.ndarray, moves: np.ndarray) -> None:
        base = 0
        for w in self.w.values():
            mine = (rows >= base) & (rows < base + len(w))
            w[rows[mine] - base] += moves[mine, : w.shape[1]].astype(np.float32)
            base += len(w)

    def tables(self) -> dict:
        """What scoring needs: queries, keys, values of each id and the start, and the tree."""
        w = self.w
        e = w["emb"]
        q = e @ w["q"] * np.float32(DIM**-0.5)
        return {"q": q, "k": e @ w["k"], "v": e @ w["v"], "own": e @ w["own"], "far": w["far"][:, 0], "node": w["node"], "tree": self.tree}


def places(ids: np.ndarray, starts: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (a start, then the ids), targets (the ids, then an end), and where each text's places start."""
    n = len(starts) - 1
    at = starts + np.arange(n + 1)
    total = len(ids) + n
    inner = np.ones(total, bool)
    inner[at[:-1]] = False
    inputs = np.full(total, n_ids, np.int64)
    inputs[inner] = ids
    last = np.ones(total, bool)
    last[at[1:] - 1] = False
    targets = np.full(total, n_ids - 1, np.int64)
    targets[last] = ids
    return inputs, targets, at


def score_ids(t: dict, ids: np.ndarray, starts: np.ndarray, batch: int = 64) -> np.ndarray:
    """log10 probability of each text's ids and end."""
    inputs, targets, at = places(ids, starts, len(t["q"]) - 1)
    first, low, high = windows(at, SPAN, STRIDE)
    far = t["far"][GAP] + HIDE
    # By the model alone, so that equal texts are scored alike.
    large = np.linalg.norm(t["q"], axis=1).max() * np.linalg.norm(t["k"], axis=1).max() + np.abs(t["far"]).max() > SAFE
    place, tree = np.zeros(len(inputs)), t["tree"]
    for lo in range(0, len(first), batch):
        f = first[lo : lo + batch]
        keys = f[:, None] + BACK
        kc = inputs.take(keys, mode="clip")
        qc = kc[:, SPAN - STRIDE :]
        z = np.matmul(t["q"].take(qc, 0), t["k"].take(kc, 0).transpose(0, 2, 1))
        _attend(z, far, keys, f, low[lo : lo + batch], large)
        h = np.matmul(z, t["v"].take(kc, 0))
        h /= z @ ONES
        h += t["own"].take(qc, 0)
        np.tanh(h, out=h)
        spots = f[:, None] + np.arange(STRIDE)
        live = np.flatnonzero(spots < high[lo : lo + batch, None])
        spots = spots.reshape(-1).take(live)
        hr = np.ones((len(spots), DIM + 1), np.float32)
        hr[:, :DIM] = h.reshape(-1, DIM).take(live, 0)
        # Node by node: products of matrices could round equal texts differently.
        nodes, sides, m, begin = tree.paths(targets.take(spots))
        z = np.einsum("ij,ij->i", t["node"].take(nodes, 0), np.repeat(hr, m, 0))
        z *= sides
        place[spots] = _logs(z, begin)
    return np.add.reduceat(place, at[:-1]) / np.log(10) if len(at) > 1 else np.zeros(0)


def _logs(z: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Log of the probability of each way whose nodes start at begin; z are the log odds of the ways' sides."""
    total = np.add.reduceat(np.minimum(z, 0).astype(float), begin)
    # Each factor is between 1 and 2, so no product of a way's (far fewer than 1000) is too large.
    np.exp(np.negative(np.abs(z, out=z), out=z), out=z)
    z += 1
    return total - np.log(np.multiply.reduceat(z.astype(float), begin))


# ---------------------------------------------------------------- the job


def _word_counts(batches):
    for b in batches:
        texts = [x.as_py() for x in b.column(0)]
        for lo, hi in chunks(texts, 4 << 20):
            h, n = np.unique(tokens_of(texts[lo:hi])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "c"])


def _parts(column: pa.Array):
    """Slices of a column of bytes as chunks() has them; only their lengths are read."""
    return chunks([range(n or 0) for n in pc.binary_length(column).to_pylist()])


def _bytes(column: pa.Array, lo: int, hi: int) -> list[bytes]:
    return [x or b"" for x in column.slice(lo, hi - lo).to_pylist()]


def _split(lines, pattern: str, kind):
    """Rows (doc_id, t) with their subword ids as bytes: each text is split once for the whole job."""

    def run(batches):
        subwords = Subwords(lines.value, pattern)
        for b in batches:
            for lo, hi in _parts(b.column(1)):
                ids, at = subwords(_bytes(b.column(1), lo, hi))
                data = ids.astype(kind).tobytes()
                at = (at * np.dtype(kind).itemsize).tolist()
                packed = pa.array([data[x:y] for x, y in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), packed], ["doc_id", "t", "ids"])

    return run


def _unpacked(packed: list[bytes], kind) -> tuple[np.ndarray, np.ndarray]:
    """All ids of texts, and where each text's ids start (and the end)."""
    sizes = [len(x) // np.dtype(kind).itemsize for x in packed]
    return np.frombuffer(b"".join(packed), kind).astype(np.int64), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _id_counts(kind):
    def run(batches):
        total, ends = np.zeros(0, np.int64), 0
        for b in batches:
            ends += b.num_rows
            for lo, hi in _parts(b.column(0)):
                c = np.bincount(_unpacked(_bytes(b.column(0), lo, hi), kind)[0], minlength=len(total))
                c[: len(total)] += total
                total = c
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], ends))], ["id", "c"])

    return run


def _learned(model, kind):
    """A task's rows, all of them, move its own copy of the model; yields the moves."""

    def run(batches):
        old = model.value
        new, part = old.copy(), 0
        for b in batches:
            for lo, hi in _parts(b.column(0)):
                new.train(*_unpacked(_bytes(b.column(0), lo, hi), kind), steps=None, batch=64, seed=part)
                part += 1
        rows, n, moves = new.moved(old)
        for lo in range(0, len(rows), 8192):
            some = slice(lo, lo + 8192)
            yield pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array(n[some]), _lists(moves[some])], ["row", "n", "moves"])

    return run


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * WIDE), pa.array(values.reshape(-1)))


def _averaged(batches):
    """The mean move of each row, weighted by the places that met it."""
    total = {}
    for b in batches:
        n = b.column(1).to_numpy()
        values = b.column(2).flatten().to_numpy().reshape(-1, WIDE)
        sums = np.concatenate((values * n[:, None], n[:, None]), 1)
        for row, x in zip(b.column(0).to_pylist(), sums):
            if row in total:
                total[row] += x
            else:
                total[row] = x.copy()
    rows = sorted(total)
    for lo in range(0, len(rows), 8192):
        x = np.array([total[r] for r in rows[lo : lo + 8192]])
        yield pa.RecordBatch.from_arrays([pa.array(rows[lo : lo + 8192]), _lists(x[:, :WIDE] / x[:, WIDE:])], ["row", "moves"])


def _learn(model: Attention, train: DataFrame, kind) -> None:
    """Every row of train (doc_id, ids) is learnt from once: by round, in the executors, and the rounds' moves are averaged."""
    sc = train.sparkSession.sparkContext
    tasks = 4 * sc.defaultParallelism
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS[-1]))
    for low, high in zip((0, *ROUNDS), ROUNDS):
        start = sc.broadcast(model)
        some = train.where((bucket >= low) & (bucket < high)).select("ids").coalesce(tasks)
        moves = some.mapInArrow(_learned(start, kind), "row long, n double, moves array<float>")
        mean = moves.repartition("row").mapInArrow(_averaged, "row long, moves array<double>").toArrow()
        if mean.num_rows:
            model.add(mean.column("row").to_numpy(), mean.column("moves").combine_chunks().flatten().to_numpy().reshape(-1, WIDE))
        start.unpersist()


def _scored(tables, head, kind):
    def run(batches):
        t = tables.value
        known, logs = head.value
        for b in batches:
            for lo, hi in _parts(b.column(1)):
                h, at = tokens_of(_bytes(b.column(1), lo, hi))
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                found = known[k] == h
                doc = np.repeat(np.arange(hi - lo), np.diff(at))
                part = np.bincount(doc[found], logs[k[found]], hi - lo).astype(float)
                n_found = np.bincount(doc[found], minlength=hi - lo)
                rare = np.flatnonzero(~found)
                rare_at = np.searchsorted(rare, at)
                model = score_ids(t, *_unpacked(_bytes(b.column(2), lo, hi), kind))
                lists = pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(h[rare].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(at) + 1), pa.array(n_found), pa.array(part), pa.array(model), lists], ["doc_id", "n_tokens", "n_known", "base", "score", "rare"])

    return run


def score(docs: DataFrame, path: str, pattern: str, head_size: int = HEAD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    sc = docs.sparkSession.sparkContext
    raw = bpe.read_ranks(path)
    lines = sc.broadcast(raw)
    n_ids = max(bpe.ranks_of(raw).values()) + 2  # and the end
    kind = np.uint16 if n_ids <= 1 << 16 else np.uint32
    type_of_id = dict(docs.dtypes)["doc_id"]
    text = F.col("text").cast("binary").alias("t")
    split, done = stash(docs.select("doc_id", text).mapInArrow(_split(lines, pattern, kind), f"doc_id {type_of_id}, t binary, ids binary"), **SMALL)
    train = split.where(~held_out(F.col("doc_id")))
    counts = cut(train.select("t").mapInArrow(_word_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    ids = train.select("ids").mapInArrow(_id_counts(kind), "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()
    by_id = np.zeros(n_ids)
    at = ids.column("id").to_numpy()
    by_id[np.where(at < 0, n_ids - 1, at)] = ids.column("c").to_numpy()
    docs_in = int(by_id[-1])
    some = train.select("doc_id", "ids").where(F.length("ids") > 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow()
    model = Attention(n_ids, by_id)
    if some.num_rows:
        model.train(*_unpacked(some.column("ids").to_pylist(), kind))
    _learn(model, train.select("doc_id", "ids"), kind)
    tables = sc.broadcast(model.tables())
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_train = int(total.n or 0) + docs_in
    floor = n_train + 0.5 * (int(total.v) + (docs_in > 0) + 1)
    top = counts.orderBy(F.desc("c"), "h").limit(head_size).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(h)
    head = sc.broadcast((h[order], np.log10((c[order] + 0.5) / floor)) if len(h) else (np.zeros(1, np.uint64), np.zeros(1)))
    rows = split.select("doc_id", "t", "ids").mapInArrow(_scored(tables, head, kind), f"doc_id {type_of_id}, n_tokens long, n_known long, base double, score double, rare array<long>")
    rows = cut(rows)
    done()
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rare = rows.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("m"))
    met = rare.join(counts, "h", "left")
    log = lambda c: F.log10((c + 0.5) / F.lit(float(floor)))
    sums = met.groupBy("row").agg(F.sum(F.col("m") * log(F.coalesce("c", F.lit(0)))).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0)).alias("found"))
    end = float(np.log10((docs_in + 0.5) / floor))
    return rows.join(sums, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0)) + int(docs_in > 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end)).alias("base_score"), "score",
    )
