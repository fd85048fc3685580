"""Whole texts to word hashes in numpy, many documents at a time.

A word is a maximal run of bytes other than \\x20 and \\x09-\\x0D; A-Z are lower-cased. Words are known by a 64-bit
polynomial hash of their bytes, mixed; two different words share one with a probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII signs but letters and digits: what is left between them are terms.
SIGNS = np.zeros(256, bool)
SIGNS[[b for b in range(0x80) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads its input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """The words of some documents: hash, byte range and document of each; documents are first .. first + n - 1."""

    first: int
    n: int
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    data: np.ndarray

    def bounds(self) -> np.ndarray:
        """Where each document's words begin, and the end."""
        return np.searchsorted(self.doc, np.arange(self.first, self.first + self.n + 1))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off


def _segment(data: np.ndarray, s: int, e: int, breaks: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = LOWER[data[s:e]]
    word = ~gaps[b]
    edge = np.empty(e - s, bool)
    edge[:1] = word[:1]
    edge[1:] = word[1:] & ~word[:-1]
    inner = breaks - s
    edge[inner] = word[inner]
    starts = np.flatnonzero(edge)
    last = np.empty(e - s, bool)
    last[-1:] = word[-1:]
    last[:-1] = word[:-1] & ~word[1:]
    before = inner[inner > 0] - 1
    last[before] = word[before]
    ends = np.flatnonzero(last) + 1
    up, down = powers(e - s)
    total = np.empty(e - s + 1, np.uint64)
    total[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: e - s], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts + s, ends + s


def word_batches(column: pa.Array, size: int = SEGMENT, gaps: np.ndarray = SPACE) -> Iterator[Words]:
    """All words of a text column (parted by the bytes of gaps), in runs of whole documents of about size bytes (a longer document is a run of its own)."""
    data, off = text_buffer(column)
    n, d = len(column), 0
    while d < n:
        e = max(d + 1, int(np.searchsorted(off, off[d] + size, "right")) - 1)
        e = min(e, n)
        parts, s, end = [], int(off[d]), int(off[e])
        while s < end:
            stop = min(end, s + SEGMENT)
            while stop < end and not gaps[data[stop]]:  # a word is never cut
                stop += 1
            marks = off[d:e]
            parts.append(_segment(data, s, stop, marks[(marks >= s) & (marks < stop)].astype(np.int64), gaps))
            s = stop
        cat = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        doc = np.searchsorted(off[d : e + 1], cat[1], "right") - 1 + d
        yield Words(d, e - d, cat[0], cat[1], cat[2], doc, data)
        d = e
