"""Splitting texts into the pre-tokens of byte-level BPE, as numpy arrays.

The rule is the public pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
applied to the characters' classes of many texts at once instead of one match at a time.
"""

from __future__ import annotations

import numpy as np
import regex

#: Fixed value: the public pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_TABLE: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """The class of every code point."""
    if not _TABLE:
        t = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                t[a : b + 1] = kind
        t[0xD800:0xE000] = OTHER
        _TABLE.append(t)
    return _TABLE[0]


def _code_points(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that start at the given bytes."""
    cp = buf[at].astype(np.int32)
    wide = np.flatnonzero(cp >= 0x80)
    if len(wide):
        lead = cp[wide]
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        value = lead & (0x7F >> size)
        for k in (1, 2, 3):
            more = size > k
            value[more] = value[more] << 6 | buf[at[wide[more]] + k] & 0x3F
        cp[wide] = value
    return cp


def split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes; where each pre-token starts, and the end; and where each text's pre-tokens start, and the end."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    first_byte = np.concatenate(([0], np.cumsum(sizes)))
    if not len(buf):
        return buf, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = _code_points(buf, at)
    kind = class_table()[cp]
    n = len(kind)
    new_text = np.zeros(n + 1, bool)
    new_text[np.searchsorted(at, first_byte[:-1][sizes > 0])] = True
    new_text[n] = True
    run = np.ones(n + 1, bool)
    run[1:n] = (kind[1:] != kind[:-1]) | new_text[1:n]
    start = run.copy()
    # A single blank before a run of one of the other classes belongs to it.
    blank = cp == 0x20
    start[1:n] &= ~(run[1:n] & ~new_text[1:n] & blank[:-1] & (kind[1:] != SPACE))
    # White space of two or more before something else leaves its last character.
    edge = np.flatnonzero(run[1:n] & ~new_text[1:n] & (kind[:-1] == SPACE))  # last characters of such runs
    start[edge] = True
    # Contractions.
    quote = np.flatnonzero((cp[:-1] == 0x27) & start[: n - 1] & run[: n - 1] & (kind[1:] == LETTER) & ~new_text[1:n])
    if len(quote):
        one = cp[quote + 1]
        two = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
        two[(quote + 2 < n) & new_text[np.minimum(quote + 2, n)]] = 0
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for mask, k in ((short, 1), (long & ~short, 2)):
            q = quote[mask]
            start[q + 1] = False
            rest = q + 1 + k
            rest = rest[rest < n]
            start[rest[(kind[rest] == LETTER) & ~new_text[rest] & ~run[rest]]] = True
    places = np.flatnonzero(start[:n])
    tokens = np.append(at[places], len(buf))
    return buf, tokens, np.searchsorted(tokens[:-1], first_byte)
