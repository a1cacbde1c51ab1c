"""Words of many texts at once.

The texts of an Arrow batch are joined, lower-cased and scanned as one byte
array, so a word costs a few vector instructions instead of a Python object.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x100000001B3
_SPACE = re.compile(r"\s+")
_TABLE = np.zeros(256, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _TABLE[_c] = 1

U64 = np.uint64


def slices(batch: pa.RecordBatch, *columns: int, size: int = 1 << 20):
    """Parts of a batch whose texts add up to about ``size`` bytes, one row at least: what a worker holds hangs on the longest text and not on how many come at once."""
    if batch.num_rows == 0:
        return
    total = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    part = np.cumsum(total) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def collapse(text: str | None) -> str:
    """White-space runs as one blank, none at the ends; an empty string for null."""
    return _SPACE.sub(" ", text).strip() if text else ""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, extended on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                    steps = np.full(m, factor, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by prefix sums of a polynomial."""
    up, down = _POWERS.get(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + U64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start] ^ (end - start).astype(np.uint64))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of ``[a-z0-9]`` in the lower-cased text), and the number of words of each text."""
    parts = [(t.lower() if t else "").encode() for t in texts]
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    inside = _TABLE[data]
    edge = np.diff(np.concatenate([[0], inside]).astype(np.int8))
    start = np.flatnonzero(edge == 1)
    stop = np.flatnonzero(edge == -1)  # the last byte is never inside a word
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    return span_hashes(data, start, stop), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of ``width`` words: (text number of each, hash of each, texts that have any), for texts of at least ``least`` words, sorted by text and hash."""
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            h = mix(h * U64(3) + hashes[j : j + n] + U64(j + 1))
    o = owner[:n]
    good = (o == owner[width - 1 :]) & (counts[o] >= least)
    o, h = o[good], h[good]
    order = np.lexsort((h, o))
    o, h = o[order], h[order]
    first = np.ones(len(o), bool)
    first[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    o, h = o[first], h[first]
    return o, h, o[np.concatenate([[True], o[1:] != o[:-1]])] if len(o) else o
