"""Words and their 64-bit hashes, whole texts at a time, in numpy.

Words are runs of bytes other than ASCII white space. A word's hash is a
polynomial of its bytes modulo 2**64, taken from running sums, then mixed; it
does not depend on where the word stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 4096, 2 * len(_pow) if n < 1 << 21 else n)
        with np.errstate(over="ignore"):
            _pow, _inv = (np.full(size, b, np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
            _pow[0] = _inv[0] = 1
            _pow, _inv = np.cumprod(_pow), np.cumprod(_inv)
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text's bytes."""
    sep = np.ones(len(buf) + 2, bool)
    sep[1:-1] = SEPARATOR[buf]
    edges = np.flatnonzero(sep[1:] != sep[:-1])
    return edges[::2], edges[1::2]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # parts of about 1 MB, cut between words
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + (1 << 20), "right")))
        part = buf[base : int(ends[to - 1])]
        power, inverse = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        a, b = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[b] - sums[a]) * inverse[a]
        at = to
    return mix(out + (ends - starts).astype(np.uint64))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, in order."""
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out + np.uint64(k)) + h[k : len(h) - n + 1 + k]
    return mix(out)


def shingles(buf: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word runs, A-Z lowered; fewer words make one run; no words none."""
    buf = LOWER[buf]
    starts, ends = bounds(buf)
    if not len(starts):
        return np.empty(0, np.uint64)
    h = hashes(buf, starts, ends)
    return np.unique(windows(h, min(n, len(h))) + np.uint64(0 if len(h) >= n else len(h)))


def as_array(b: memoryview | bytes | None) -> np.ndarray:
    return np.frombuffer(b, np.uint8) if b else np.empty(0, np.uint8)


def grouped_sum(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first) if len(first) else values
