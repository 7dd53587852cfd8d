"""Word shingles and minima of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes worked on at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _stream(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)


_BYTE = _stream(1, 256)
_STEP = _stream(2, 64) | np.uint64(1)
_SHORT = _stream(3, 64)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Index of the first text, bytes, and offsets of the texts, some SLICE bytes at a time."""
    text = text.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its n-word shingles."""
    docs = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * docs
    word = ~_SPACE[data]
    before = np.r_[False, word[:-1]]
    starts_text = np.zeros(len(data), bool)
    starts_text[offsets[:-1][offsets[:-1] < len(data)]] = True
    first = np.flatnonzero(word & (~before | starts_text))
    after = np.r_[word[1:], False]
    ends_text = np.r_[starts_text[1:], True]
    last = np.flatnonzero(word & (~after | ends_text)) + 1
    up, down = _powers(max(16, int(len(data)).bit_length()))
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], dtype=np.uint64)]
    words = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    # words of text i: bounds[i] to bounds[i + 1]
    bounds = np.searchsorted(first, offsets)
    runs = max(0, len(words) - n + 1)
    hashes = np.zeros(runs, np.uint64)
    for j in range(n):
        hashes += words[j : j + runs] * _STEP[j]
    hashes = mix(hashes)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(hashes[a : b - n + 1]))
        elif b > a:
            short = (words[a:b] * _STEP[: b - a]).sum(dtype=np.uint64) ^ _SHORT[b - a]
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """One row per set: the least value under each of ``count`` universal hashes (0 if empty)."""
    out = np.zeros((len(sets), count), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    values = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    a, b = _stream(4, count) | np.uint64(1), _stream(5, count)
    buffer = np.empty_like(values)
    for k in range(count):
        np.multiply(values, a[k], out=buffer)
        np.add(buffer, b[k], out=buffer)
        np.right_shift(buffer, np.uint64(32), out=buffer)
        out[full, k] = np.minimum.reduceat(buffer, starts)
    return out
