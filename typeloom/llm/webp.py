"""Lossless WebP (VP8L) files to pixel arrays and back, in numpy.

decode_many() reads the whole format: simple and normal prefix codes, meta prefix codes,
back-references, the colour cache, and the predictor, cross-colour, subtract-green and
palette transforms. The main pixels of many files are read in lockstep, one pixel of each
file at a step: every file has its own bit position, tables, cache and copy in progress, and
numpy takes a step for all of them. Files with meta prefix codes (and codes too long for one
read) and the small images of the transforms are read pixel by pixel.

encode() takes the transform that a sample of rows makes smallest (none, palette, subtract
green, a predictor, cross-colour), refers back to repeated pixels, uses a colour cache
where it pays, and writes prefix codes made from the symbols' counts.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

MAX_SIDE = 16384

# Fixed values of the format: offsets (x, y) of the 120 short distance codes.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
# Fixed values of the format: the order in which the lengths of the length code are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
CACHE_FACTOR = 0x1E35A7BD
_NEAR_XY = np.array(NEAR)


class Bits:
    """Reads a byte string's bits, the lowest of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if not n:
            return 0
        byte, shift = self.at >> 3, self.at & 7
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image data end early")
        return int.from_bytes(self.data[byte : byte + (shift + n + 7) // 8], "little") >> shift & (1 << n) - 1


class Code:
    """A canonical prefix code. only: the symbol that takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n] or [0]
        self.lengths, self.only = lengths, used[0] if len(used) == 1 else None
        self.symbol: dict[tuple[int, int], int] = {}
        if self.only is None and sum([1 << 15 - lengths[s] for s in used]) != 1 << 15:
            raise ValueError("a prefix code isn't complete")

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if not self.symbol:
            code = before = 0
            for n, s in sorted((n, s) for s, n in enumerate(self.lengths) if n):
                code <<= n - before
                self.symbol[n, code] = s
                code, before = code + 1, n
        code = n = 0
        while True:
            code, n = code << 1 | bits.read(1), n + 1
            if (s := self.symbol.get((n, code))) is not None:
                return s

    def table(self) -> np.ndarray:
        """symbol | length << 16 for each value of the next bits; as long as the longest code needs."""
        if self.only is not None:
            return np.array([self.only], np.int64)
        lengths = np.array(self.lengths, np.int64)
        used = np.flatnonzero(lengths)
        used = used[np.argsort(lengths[used], kind="stable")]
        n = lengths[used]
        top = int(n[-1])
        return np.repeat(used | n << 16, 1 << top - n)[_turned(top)]


_TURNED: dict[int, np.ndarray] = {}


def _turned(n: int) -> np.ndarray:
    """All numbers of n bits with their bits in reverse order."""
    if n not in _TURNED:
        x = np.arange(1 << n)
        _TURNED[n] = sum((x >> k & 1) << n - 1 - k for k in range(n))
    return _TURNED[n]


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        marks = [bits.read(8 if wide else 1)]
        if two:
            marks.append(bits.read(8))
        lengths = [0] * max(size, 256)
        for s in marks:
            lengths[s] = 1
        return Code(lengths)
    of_lengths = [0] * 19
    stored = LENGTH_ORDER[: 4 + bits.read(4)]
    sizes = bits.read(3 * len(stored))
    for i, k in enumerate(stored):
        of_lengths[k] = sizes >> 3 * i & 7
    code = Code(of_lengths)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, last = [], 8
    # The lengths' own codes have up to 7 bits: a table, and one number that holds what can follow.
    entries = (code.table()).tolist()
    mask = len(entries) - 1
    byte = bits.at >> 3
    ahead = int.from_bytes(bits.data[byte : byte + size * 14 // 8 + 8], "little") >> (bits.at & 7)
    at = 0
    n = 0
    while n < size and most:
        most -= 1
        entry = entries[ahead >> at & mask]
        at += entry >> 16
        s = entry & 0xFFFF
        if s < 16:
            lengths.append(s)
            n += 1
            last = s or last
            continue
        if s == 16:
            value, run, width = last, 3 + (ahead >> at & 3), 2
        elif s == 17:
            value, run, width = 0, 3 + (ahead >> at & 7), 3
        else:
            value, run, width = 0, 11 + (ahead >> at & 127), 7
        lengths += [value] * run
        n += run
        at += width
    bits.at += at
    if len(lengths) > size:
        raise ValueError("a prefix code has too many symbols")
    return Code(lengths + [0] * (size - len(lengths)))


def _read_codes(bits: Bits, sizes: tuple[int, ...]) -> list[Code]:
    """A group's codes. A code whose bits repeat those of the one before, for as many symbols, is that one."""
    out, before = [], (0, 0, 0)
    for size in sizes:
        start = bits.at
        n, width, value = before
        if n == size and start + width <= 8 * len(bits.data):
            if bits.read(width) == value:
                out.append(out[-1])
                continue
            bits.at = start
        out.append(_read_code(bits, size))
        width, bits.at = bits.at - start, start
        before = size, width, bits.read(width)
    return out


def _number(symbol: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = symbol - 2 >> 1
    return (2 + (symbol & 1) << extra) + bits.read(extra) + 1


def _blocks(n: int, bits: int) -> int:
    return n + (1 << bits) - 1 >> bits


class _Pixels:
    """What stands before entropy-coded pixels: the cache's size, the groups of codes, and which group a block has."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.width, self.total = width, width * height
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        if self.cache_bits > 11:
            raise ValueError("the colour cache is too large")
        self.group_bits, self.group_of, n_groups = 0, None, 1
        if main and bits.read(1):
            self.group_bits = bits.read(3) + 2
            self.group_of = _read_pixels(bits, _blocks(width, self.group_bits), _blocks(height, self.group_bits)) >> 8 & 0xFFFF
            n_groups = int(self.group_of.max()) + 1
        sizes = (280 + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, 40)
        self.groups = [_read_codes(bits, sizes) for _ in range(n_groups)]

    def read(self, bits: Bits) -> np.ndarray:
        """The pixels as ARGB numbers, one after the other."""
        width, total, cache_bits = self.width, self.total, self.cache_bits
        cache = [0] * (1 << cache_bits)
        pixels: list[int] = []
        known = 0  # pixels that the cache has seen
        across = _blocks(width, self.group_bits)
        while len(pixels) < total:
            at = len(pixels)
            group = self.groups[int(self.group_of[(at // width >> self.group_bits) * across + (at % width >> self.group_bits)])] if self.group_of is not None else self.groups[0]
            s = group[0].read(bits)
            if s < 256:
                red, blue, alpha = (c.read(bits) for c in group[1:4])
                pixels.append(alpha << 24 | red << 16 | s << 8 | blue)
            elif s < 280:
                length = _number(s - 256, bits)
                back = _distance(_number(group[4].read(bits), bits), width)
                if back > at or at + length > total:
                    raise ValueError("a back-reference leaves the image")
                for _ in range(length):
                    pixels.append(pixels[-back])
            else:
                for p in pixels[known:]:
                    cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> 32 - cache_bits] = p
                known = len(pixels)
                pixels.append(cache[s - 280])
        return np.array(pixels, np.uint32)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_pixels(bits: Bits, width: int, height: int) -> np.ndarray:
    return _Pixels(bits, width, height, False).read(bits)


def _in_lockstep(jobs: list[tuple[_Pixels, Bits]]) -> list[np.ndarray]:
    """The pixels of many images with one group of codes each, a pixel of every image at a step."""
    order = sorted(range(len(jobs)), key=lambda i: -jobs[i][0].total)
    heads = [jobs[i][0] for i in order]
    n = len(heads)
    total = np.array([h.total for h in heads])
    # All bits, and 64 of them from each byte on.
    data = [jobs[i][1].data[jobs[i][1].at >> 3 :] for i in order]
    size = np.array([len(d) for d in data], np.int64)
    first = np.cumsum(size) - size
    flat = np.frombuffer(b"".join([*data, bytes(16)]), np.uint8)
    ahead = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, 8)).view("<u8")[:, 0]
    pos = first * 8 + np.array([jobs[i][1].at & 7 for i in order])
    # Tables of all codes; equal ones of an image are one.
    tables, done, offset, mask = [], 0, np.zeros((5, n), np.int64), np.zeros((5, n), np.uint64)
    for i, h in enumerate(heads):
        own: dict[int, tuple[int, int]] = {}
        for j, code in enumerate(h.groups[0]):
            if id(code) not in own:
                tables.append(code.table())
                own[id(code)] = done, len(tables[-1]) - 1
                done += len(tables[-1])
            offset[j, i], mask[j, i] = own[id(code)]
    table = np.concatenate(tables).astype(np.int32)
    cached = any(h.cache_bits for h in heads)
    cache_size = np.array([1 << h.cache_bits if h.cache_bits else 1 for h in heads], np.int64)
    cache_at = np.cumsum(cache_size) - cache_size
    cache = np.zeros(int(cache_size.sum()), np.uint32)
    shift = np.array([32 - h.cache_bits if h.cache_bits else 32 for h in heads], np.uint64)
    wide = np.array([h.width for h in heads])
    start = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint32)
    rest, back = np.zeros(n, np.int64), np.ones(n, np.int64)
    live = n - np.searchsorted(total[::-1], np.arange(int(total[0])), "right")

    def peek(p):
        return ahead.take(p >> 3) >> (p & 7).view(np.uint64)

    def number(symbol, p):
        """_number of several symbols, whose extra bits stand at p."""
        extra = np.maximum(symbol - 2 >> 1, 0)
        base = np.where(symbol < 4, symbol, 2 + (symbol & 1) << extra)
        extra[symbol < 4] = 0
        return base + (peek(p) & ((1 << extra) - 1).astype(np.uint64)).astype(np.int64) + 1, p + extra

    eight, low = np.uint64(8), np.int64(0xFFFF)
    for t, k in enumerate(live.tolist()):
        p = pos[:k]
        w = peek(p)
        e = table.take(offset[0, :k] + (w & mask[0, :k]).view(np.int64)).astype(np.int64)
        green = e & low
        used = e >> 16
        value = green << 8
        w = w >> used.view(np.uint64)
        for j, place in ((1, 16), (2, 0), (3, 24)):
            e = table.take(offset[j, :k] + (w & mask[j, :k]).view(np.int64)).astype(np.int64)
            value |= (e & low) << place
            n_bits = e >> 16
            used += n_bits
            w >>= n_bits.view(np.uint64)
        other = np.flatnonzero((green >= 256) | (rest[:k] > 0))
        if len(other):
            going = rest[other] > 0
            used[other[going]] = 0
            new = other[~going]
            if len(new):
                e = table[offset[0, new] + (peek(pos[new]) & mask[0, new]).view(np.int64)].astype(np.int64)
                symbol, q = e & low, pos[new] + (e >> 16)
                hit = symbol >= 280
                here = new[hit]
                value[here] = cache[cache_at[here] + symbol[hit] - 280]
                ref, q_ref = new[~hit], q[~hit]
                if len(ref):
                    length, q_ref = number(symbol[~hit] - 256, q_ref)
                    e = table[offset[4, ref] + (peek(q_ref) & mask[4, ref]).view(np.int64)].astype(np.int64)
                    code, q_ref = number(e & low, q_ref + (e >> 16))
                    near = code <= 120
                    xy = _NEAR_XY[np.where(near, code - 1, 0)]
                    back[ref] = np.where(near, np.maximum(1, xy[:, 0] + xy[:, 1] * wide[ref]), code - 120)
                    rest[ref] = length
                    if (back[ref] > t).any() or (t + length > total[ref]).any():
                        raise ValueError("a back-reference leaves the image")
                    q[~hit] = q_ref
                used[new] = q - pos[new]
            copy = other[rest[other] > 0]
            value[copy] = out[start[copy] + t - back[copy]]
            rest[copy] -= 1
        pos[:k] += used
        out[start[:k] + t] = value
        if cached:
            cache[cache_at[:k] + ((value * CACHE_FACTOR & 0xFFFFFFFF).view(np.uint64) >> shift[:k]).view(np.int64)] = value
    if (pos > (first + size) * 8).any():
        raise ValueError("the image data end early")
    result: list = [None] * n
    for i, a, m in zip(order, start.tolist(), total.tolist()):
        result[i] = out[a : a + m]
    return result


def _halves(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b >> 1


def _predicted(mode: int, left, top, top_left, top_right) -> np.ndarray:
    """Each of the 14 predictors, on int arrays of the four channels."""
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _halves(_halves(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return _halves(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _halves(_halves(left, top_left), _halves(top, top_right))
    if mode == 11:
        return left if abs(top - top_left).sum() < abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = _halves(left, top)
        return np.clip(mean + ((mean - top_left) / 2).astype(np.int64), 0, 255)
    return np.array([255, 0, 0, 0])


def _channels(pixels: np.ndarray) -> np.ndarray:
    return np.stack([pixels >> k & 0xFF for k in (24, 16, 8, 0)], -1).astype(np.int64)


def _joined(channels: np.ndarray) -> np.ndarray:
    """ARGB numbers of channels from 0 to 255."""
    return np.ascontiguousarray(channels.astype(np.uint8)[..., ::-1]).view("<u4")[..., 0]


def _undo_predictor(pixels: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    px = _channels(pixels).reshape(-1, 4)
    across = _blocks(width, bits)
    px[0] = px[0] + [255, 0, 0, 0] & 0xFF
    px[:width] = np.cumsum(px[:width], 0) & 0xFF
    for row in range(width, len(px), width):
        px[row] = px[row] + px[row - width] & 0xFF
        for tile in range(across):
            lo, hi = row + max(1, tile << bits), row + min(width, tile + 1 << bits)
            if lo >= hi:
                continue
            mode = int(modes[(row // width >> bits) * across + tile] >> 8 & 0xF)
            over = px[lo - width : hi - width]
            if mode == 1:
                px[lo:hi] = np.cumsum(px[lo - 1 : hi], 0)[1:] & 0xFF
            elif mode in (0, 2, 3, 4, 8, 9, 14, 15):  # what is above is known for the whole run
                px[lo:hi] = px[lo:hi] + _predicted(mode, None, over, px[lo - width - 1 : hi - width - 1], px[lo - width + 1 : hi - width + 1]) & 0xFF
            else:
                for i in range(lo, hi):
                    px[i] = px[i] + _predicted(mode, px[i - 1], px[i - width], px[i - width - 1], px[i - width + 1]) & 0xFF
    return _joined(px)


def _signed(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) + 128 & 0xFF) - 128


def _undo_cross_colour(pixels: np.ndarray, width: int, factors: np.ndarray, bits: int) -> np.ndarray:
    c = _channels(pixels)
    i = np.arange(len(pixels))
    f = _channels(factors)[(i // width >> bits) * _blocks(width, bits) + (i % width >> bits)]
    delta = lambda t, v: _signed(t) * _signed(v) >> 5
    c[:, 1] = c[:, 1] + delta(f[:, 3], c[:, 2]) & 0xFF
    c[:, 3] = c[:, 3] + delta(f[:, 2], c[:, 2]) + delta(f[:, 1], c[:, 1]) & 0xFF
    return _joined(c)


def _undo_palette(pixels: np.ndarray, width: int, packed: int, height: int, colours: np.ndarray, bits: int) -> np.ndarray:
    green = (pixels >> 8 & 0xFF).reshape(height, packed)
    if bits:
        depth = 8 >> bits
        green = np.stack([green >> depth * k & (1 << depth) - 1 for k in range(1 << bits)], -1).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[green.reshape(-1)]


class _File:
    """A file's size, the transforms to undo, and its main pixels' head."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
            raise ValueError("this isn't a lossless WebP file")
        bits = self.bits = Bits(bytes(data[21 : 20 + struct.unpack("<I", data[16:20])[0]]))
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        self.has_alpha, version = bits.read(1), bits.read(3)
        if version:
            raise ValueError(f"unknown version {version}")
        self.undo, now = [], self.width
        while bits.read(1):
            kind = bits.read(2)
            if kind in (0, 1):
                n = bits.read(3) + 2
                self.undo.append((kind, now, _read_pixels(bits, _blocks(now, n), _blocks(self.height, n)), n))
            elif kind == 2:
                self.undo.append((2, now, None, 0))
            else:
                size = bits.read(8) + 1
                colours = _joined(np.cumsum(_channels(_read_pixels(bits, size, 1)), 0) & 0xFF)
                n = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
                self.undo.append((3, now, colours, n))
                now = _blocks(now, n)
        self.head = _Pixels(bits, now, self.height, True)

    def in_lockstep(self) -> bool:
        """Whether one read of 57 bits holds all codes of a pixel."""
        return len(self.head.groups) == 1 and sum(max(c.lengths) for c in self.head.groups[0][:4]) <= 56

    def finish(self, pixels: np.ndarray) -> np.ndarray:
        for kind, wide, values, n in reversed(self.undo):
            if kind == 0:
                pixels = _undo_predictor(pixels, wide, values, n)
            elif kind == 1:
                pixels = _undo_cross_colour(pixels, wide, values, n)
            elif kind == 2:
                c = _channels(pixels)
                c[:, 1], c[:, 3] = c[:, 1] + c[:, 2] & 0xFF, c[:, 3] + c[:, 2] & 0xFF
                pixels = _joined(c)
            else:
                pixels = _undo_palette(pixels, wide, _blocks(wide, n), self.height, values, n)
        out = pixels.astype("<u4").view(np.uint8).reshape(self.height, self.width, 4)[:, :, [2, 1, 0, 3]]
        if not self.has_alpha:
            out[:, :, 3] = 255
        return out


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of each lossless file as an array of height x width x RGBA bytes."""
    read = [_File(f) for f in files]
    together = [f for f in read if f.in_lockstep()]
    pixels = {id(f): p for f, p in zip(together, _in_lockstep([(f.head, f.bits) for f in together]) if together else [])}
    return [f.finish(pixels[id(f)] if id(f) in pixels else f.head.read(f.bits)) for f in read]


def decode(data: bytes) -> np.ndarray:
    return decode_many([data])[0]


# ---------------------------------------------------------------- writing

#: Code lengths that are written at most (the format allows 15), and of the code of lengths.
LONGEST, LONGEST_OF_LENGTHS = 9, 7
CACHE_BITS = 7
MATCH = 4
#: The cache is used where it holds at least this share of the literal pixels.
HIT_SHARE = 0.25
#: Rows that are looked at to choose a transform.
LOOKED_AT = 8


class BitWriter:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Huffman code lengths of at most longest bits; one used symbol has length 1."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights, least = counts[used], 1
    while True:
        heap = [(w, i) for i, w in enumerate(np.maximum(weights, least).tolist())]
        heapq.heapify(heap)
        up = [0] * (2 * len(used) - 1)
        for new in range(len(used), 2 * len(used) - 1):
            w, i = heapq.heappop(heap)
            v, j = heap[0]
            up[i] = up[j] = new
            heapq.heapreplace(heap, (w + v, new))
        depth = [0] * len(up)
        for i in range(len(up) - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[: len(used)]) <= longest:
            lengths[used] = depth[: len(used)]
            return lengths
        least = max(2 * least, int(weights.sum()) >> longest)


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's code as it is written, the first bit lowest. A single symbol takes no bits."""
    used = np.flatnonzero(lengths)
    out = np.zeros(len(lengths), np.int64)
    if len(used) < 2:
        return out
    by = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[by]
    top = int(n[-1])
    first = np.cumsum(1 << top - n) - (1 << top - n)
    out[by] = _turned(top)[first]
    return out


def _put_code(w: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        marks = used or [0]
        w.put(1 | len(marks) - 1 << 1 | 1 << 2, 3)
        for s in marks:
            w.put(s, 8)
        return
    tokens = []  # (symbol, extra bits, how many)
    edges = np.flatnonzero(np.diff(lengths)) + 1
    edges = [0, *edges.tolist(), len(lengths)]
    last = 8
    for v, run in zip(lengths[edges[:-1]].tolist(), [y - x for x, y in zip(edges, edges[1:])]):
        if v:
            if v != last:
                tokens.append((v, 0, 0))
                run, last = run - 1, v
            while run >= 3:
                k = min(run, 6)
                tokens.append((16, k - 3, 2))
                run -= k
            tokens += [(v, 0, 0)] * run
        else:
            while run >= 11:
                k = min(run, 138)
                tokens.append((18, k - 11, 7))
                run -= k
            if run >= 3:
                tokens.append((17, run - 3, 3))
                run = 0
            tokens += [(0, 0, 0)] * run
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), LONGEST_OF_LENGTHS)
    codes, sizes = codes_of(own).tolist(), own.tolist()
    alone = np.count_nonzero(own) == 1
    w.put(0, 1)
    last = max(k for k, s in enumerate(LENGTH_ORDER) if sizes[s])
    w.put(max(last - 3, 0), 4)
    for s in LENGTH_ORDER[: max(last + 1, 4)]:
        w.put(sizes[s], 3)
    w.put(0, 1)
    value = at = 0
    for s, extra, n in tokens:
        if not alone:
            value |= codes[s] << at
            at += sizes[s]
        value |= extra << at
        at += n
    w.put(value, at)


def _entropy(pixels: np.ndarray) -> float:
    """Bits that the values of the four channels of n x 4 values take with a perfect code for each."""
    return float(_entropies(pixels[None])[0])


def _entropies(several: np.ndarray) -> np.ndarray:
    """_entropy of each of k x n x 4 values."""
    k, n, _ = several.shape
    counts = np.bincount((several + np.arange(0, 1024 * k, 256, dtype=np.int32).reshape(k, 1, 4)).reshape(-1), minlength=1024 * k)
    spots = np.flatnonzero(counts)
    many = counts[spots]
    return 4 * n * np.log2(max(n, 1)) - np.bincount(spots >> 10, many * np.log2(many), k)


def _residuals(c: np.ndarray, mode: int) -> np.ndarray:
    """What predictor 1 (left) or 2 (top) leaves of a height x width x ARGB image."""
    out = c.copy()
    if mode == 1:
        out[:, 1:] -= c[:, :-1]
    else:
        out[1:, 1:] -= c[:-1, 1:]
        out[0, 1:] -= c[0, :-1]
    out[1:, 0] -= c[:-1, 0]
    out[0, 0] -= [255, 0, 0, 0]
    return out & 0xFF


def _crossed(c: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Red and blue without what green (and red) tell of them, and the factors."""
    signed = (c.reshape(-1, 4) + 128 & 0xFF) - 128
    green, red, blue = signed[:, 2], signed[:, 1], signed[:, 3]
    slope = lambda x, y: int(np.clip(np.rint(32 * (x * y).sum() / max((x * x).sum(), 1)), -128, 127))
    a = slope(green, red)
    b = slope(green, blue)
    r = slope(red, blue - (b * green >> 5))
    out = c.reshape(-1, 4).copy()
    out[:, 1] = out[:, 1] - (a * green >> 5) & 0xFF
    out[:, 3] = out[:, 3] - (b * green >> 5) - (r * red >> 5) & 0xFF
    return out.reshape(c.shape), (a, b, r)


def _without_green(c: np.ndarray) -> np.ndarray:
    out = c.copy()
    out[..., 1] -= c[..., 2]
    out[..., 3] -= c[..., 2]
    return out & 0xFF


def _chosen(c: np.ndarray) -> tuple[int, str]:
    """A predictor's mode (0 for none) and 'green', 'cross' or '', whichever leave a sample of rows smallest."""
    rows = np.arange(0, len(c), -(-len(c) // LOOKED_AT))
    some = c[rows]
    left = _residuals(some, 1)
    over = np.where((rows > 0)[:, None, None], some - c[rows - 1] & 0xFF, left)
    tried = [(0, ""), (1, ""), (2, ""), (0, "green"), (0, "cross")]
    bits = _entropies(np.stack([some, left, over, _without_green(some), _crossed(some)[0]]).reshape(5, -1, 4))
    best = int(np.argmin(bits + [0, 64, 64, 8, 64]))  # a transform has to pay for its own bits
    if best not in (1, 2):
        return tried[best]
    base = _residuals(c, best)[rows]
    bits = _entropies(np.stack([base, _without_green(base), _crossed(base)[0]]).reshape(3, -1, 4))
    return best, ("", "green", "cross")[int(np.argmin(bits + [0, 8, 64]))]


def _references(p: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place, length, distance) of pixels that are written as copies of earlier ones."""
    n = len(p) - least + 1
    if n < 2:
        return []
    h = p[:n].astype(np.uint64)
    for j in range(1, least):
        h = h * np.uint64(0x9E3779B97F4A7C15) + p[j : j + n]
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return []
    before = np.full(n, -1)
    before[order[same + 1]] = order[same]
    out, done = [], 0
    for at in np.flatnonzero(before >= 0).tolist():
        if at < done:
            continue
        back = at - int(before[at])
        stop = min(len(p), at + 4096)
        unlike = p[at:stop] != p[at - back : stop - back]
        k = int(unlike.argmax())
        length = k if unlike[k] else stop - at
        if length >= least:
            out.append((at, length, back))
            done = at + length
    return out


def _prefixed(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and how many of them of a length or distance code."""
    value -= 1
    if value < 4:
        return value, 0, 0
    top = value.bit_length() - 1
    second = value >> top - 1 & 1
    return 2 * top + second, value & (1 << top - 1) - 1, top - 1


def _put_pixels(w: BitWriter, p: np.ndarray, width: int, main: bool) -> bytes:
    """The bits of w and of the pixels, as bytes, if main; else the pixels' bits are added to w."""
    refs = _references(p, MATCH) if main else []
    place = np.ones(len(p), bool)
    for at, length, _ in refs:
        place[at + 1 : at + length] = False
    items = np.flatnonzero(place)
    fields = np.ascontiguousarray(p[items]).view(np.uint8).reshape(-1, 4)[:, [1, 2, 0, 3]]  # green, red, blue, alpha
    symbol = fields[:, 0].astype(np.int32)
    literal = np.ones(len(items), bool)
    spots = np.searchsorted(items, np.array([r[0] for r in refs], np.int64))
    literal[spots] = False
    cache_bits = 0
    if main and len(p) > 64:
        slot = (p * np.uint32(CACHE_FACTOR) >> np.uint32(32 - CACHE_BITS)).astype(np.uint8)
        order = np.argsort(slot, kind="stable")
        in_order = p[order]  # equal pixels have equal slots
        hit = np.zeros(len(p), bool)
        hit[order[1:][in_order[1:] == in_order[:-1]]] = True
        hit = hit[items] & literal
        if np.count_nonzero(hit) >= HIT_SHARE * np.count_nonzero(literal):
            cache_bits = CACHE_BITS
            symbol = np.where(hit, 280 + slot[items].astype(np.int32), symbol)
            literal &= ~hit
    far = np.zeros((len(refs), 4), np.int64)  # the length's extra bits and their number, the distance's
    if refs:
        far_symbol = []
        for k, (at, length, back) in enumerate(refs):
            s, extra, n = _prefixed(length)
            symbol[spots[k]] = 256 + s
            d, more, m = _prefixed(_distance_code(back, width))
            far[k] = extra, n, more, m
            far_symbol.append(d)
        far_symbol = np.array(far_symbol)
    greens = code_lengths(np.bincount(symbol, minlength=280 + (1 << cache_bits if cache_bits else 0)), LONGEST)
    others = code_lengths(np.bincount(fields[literal, 1:].reshape(-1), minlength=256), LONGEST)
    fars = code_lengths(np.bincount(far_symbol, minlength=40) if refs else np.zeros(40, np.int64), LONGEST)
    w.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        w.put(0, 1)
    _put_code(w, greens)
    one = BitWriter()
    _put_code(one, others)
    for _ in range(3):
        w.put(one.value, one.n)
    _put_code(w, fars)
    pairs = lambda lengths: codes_of(lengths) | lengths << 16 if np.count_nonzero(lengths) > 1 else np.zeros(len(lengths), np.int64)
    both = np.zeros((len(items), 4), np.int64)  # each item's codes and extra bits, and their sizes
    both[:, 0] = pairs(greens)[symbol]
    both[literal, 1:] = pairs(others)[fields[literal, 1:]]
    if refs:
        both[spots, 1] = far[:, 0] | far[:, 1] << 16
        both[spots, 2] = pairs(fars)[far_symbol]
        both[spots, 3] = far[:, 2] | far[:, 3] << 16
    both = both.reshape(-1)
    size, value = both >> 16, both & 0xFFFF
    if not main:
        for x, n in zip(value.tolist(), size.tolist()):
            w.put(x, n)
        return b""
    ends = np.cumsum(size)
    at = ends - size + w.n % 32
    whole = w.n // 32
    cell, value = at >> 5, value << (at & 31)
    n_cells = int(ends[-1] + w.n % 32 >> 5) + 2
    words = np.bincount(cell, value & 0xFFFFFFFF, n_cells)
    words[1:] += np.bincount(cell, value >> 32, n_cells)[:-1]
    words[0] += w.value >> 32 * whole
    bits = int(ends[-1]) + w.n % 32
    return (w.value & (1 << 32 * whole) - 1).to_bytes(4 * whole, "little") + words.astype("<u4").tobytes()[: (bits + 7) // 8]


def _distance_code(back: int, width: int) -> int:
    y, x = divmod(back, width)
    for code in _NEAR_CODES.get((x, y), ()), _NEAR_CODES.get((x - width, y + 1), ()):
        if code:
            return code
    return back + 120


_NEAR_CODES = {xy: k + 1 for k, xy in enumerate(NEAR)}


def _put_transforms(w: BitWriter, c: np.ndarray) -> tuple[np.ndarray, int]:
    """Writes the transforms that pay and returns the pixels that are left, and their width."""
    height, width, _ = c.shape
    p = _joined(c.reshape(-1, 4))
    colours = np.unique(p) if len(p) < 64 or len(np.unique(p[:: len(p) // 64])) < 48 else p
    if len(colours) <= 256 and len(colours) * 4 <= len(p):
        w.put(1 | 3 << 1 | len(colours) - 1 << 3, 11)
        steps = _channels(colours)
        steps[1:] -= steps[:-1].copy()
        _put_pixels(w, _joined(steps & 0xFF), len(colours), False)
        n = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        index, packed = np.searchsorted(colours, p).reshape(height, width), _blocks(width, n)
        index = np.pad(index, ((0, 0), (0, (packed << n) - width))).reshape(height, packed, 1 << n)
        green = sum(index[:, :, k] << (8 >> n) * k for k in range(1 << n))
        w.put(0, 1)
        return (255 << 24 | green.reshape(-1) << 8).astype(np.uint32), packed
    mode, more = _chosen(c)
    tiles = lambda value: _put_pixels(w, np.full(_blocks(width, 9) * _blocks(height, 9), value, np.uint32), _blocks(width, 9), False)
    if mode:
        w.put(1 | 0 << 1 | 7 << 3, 6)
        tiles(255 << 24 | mode << 8)
        c = _residuals(c, mode)
    if more == "green":
        w.put(1 | 2 << 1, 3)
        c = _without_green(c)
    elif more == "cross":
        w.put(1 | 1 << 1 | 7 << 3, 6)
        c, (a, b, r) = _crossed(c)
        tiles(255 << 24 | (r & 0xFF) << 16 | (b & 0xFF) << 8 | a & 0xFF)
    w.put(0, 1)
    return (_joined(c.reshape(-1, 4)) if mode or more else p), width


def encode(pixels: np.ndarray) -> bytes:
    """A lossless file of height x width x RGBA bytes."""
    height, width, _ = pixels.shape
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError(f"a side must have 1 to {MAX_SIDE} pixels")
    w = BitWriter()
    w.put(width - 1 | height - 1 << 14 | 1 << 28, 32)  # with alpha, version 0
    left, wide = _put_transforms(w, pixels[:, :, [3, 0, 1, 2]].astype(np.int32))
    body = b"\x2f" + _put_pixels(w, left, wide, True)
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
