"""Simple-8b: whole numbers in 64-bit words, and files of coded documents.

A word holds a selector in its upper four bits and, below, as many numbers of one width as
the selector says. A number of over 60 bits is an escape: selector 0, whose payload is the
number's place in a table of raw 64-bit words behind the packed ones. Words never hold numbers
of two documents, so coded documents can be strung together without coding them again.

A file holds, little-endian: magic; eight counts; identifiers, their null marks and the first
number of each document; per block of ``BLOCK_WORDS`` words the first number in it, so that
any block can be decoded by itself; the words; the escapes; a CRC-32 of all that.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

# Numbers per word and their bits, by selector. Selector 0 is the escape, 1 is unused.
PACKS = {
    2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7),
    9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60),
}
ESCAPE = 0
COUNTS = np.array([PACKS.get(s, (1 if s == ESCAPE else 0, 0))[0] for s in range(16)], np.int64)
BLOCK_WORDS = 1024
MAGIC = b"S8BDOCS1"
HEAD = struct.Struct("<8s8q")
_U = np.uint64


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits each number needs, 1 at least."""
    bits = np.ones(len(values), np.uint8)
    top = int(values.max(initial=0))
    for step in (32, 16, 8, 4, 2, 1):
        if top < 1 << step:  # nothing is as wide, now or after the shifts below
            continue
        wide = values >= (_U(1) << _U(step))
        bits += wide * np.uint8(step)
        values = np.where(wide, values >> _U(step), values)
    return bits


def _widest(bits: np.ndarray, memo: dict[int, np.ndarray], count: int) -> np.ndarray:
    """The most bits among each number and the ``count`` - 1 after it, from windows half as long."""
    if count not in memo:
        a, b = _widest(bits, memo, count - count // 2), _widest(bits, memo, count // 2)
        memo[count] = np.maximum(a[: len(bits) - count + 1], b[count - count // 2 :])
    return memo[count]


def pack(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes runs of numbers; run i ends before ``ends[i]``.

    Returns the words, the words up to the end of each run, the escapes, and the escapes up
    to the end of each run. Places of escapes count from the start of their run.
    """
    values = np.asarray(values, _U)
    n = len(values)
    if not n:
        return np.zeros(0, _U), np.zeros(len(ends), np.int64), np.zeros(0, _U), np.zeros(len(ends), np.int64)
    bits = _bits(values)
    left = np.minimum(np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n), 255).astype(np.uint8)
    selector, windows = np.zeros(n, np.uint8), {1: bits}
    for s in sorted(PACKS, reverse=True):  # from few wide numbers to many narrow ones
        count, width = PACKS[s]
        if count <= n:
            fits = (_widest(bits, windows, count) <= width) & (left[: n - count + 1] >= count)
            selector[: n - count + 1][fits] = s
    step = COUNTS[selector].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    words = chosen.astype(_U) << _U(60)
    for s, (count, width) in PACKS.items():
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            parts = values[starts[rows][:, None] + np.arange(count)] << (np.arange(count, dtype=_U) * _U(width))
            words[rows] |= np.bitwise_or.reduce(parts, axis=1)
    rows = np.flatnonzero(chosen == ESCAPE)
    escapes = values[starts[rows]]
    to_end = np.searchsorted(starts[rows], ends)
    run = np.searchsorted(ends, starts[rows], "right")
    words[rows] |= (np.arange(len(rows)) - np.concatenate([[0], to_end])[run]).astype(_U)
    return words, np.searchsorted(starts, ends), escapes, to_end


def moved(words: np.ndarray, by: int) -> np.ndarray:
    """The words with places of escapes counted ``by`` further on."""
    rows = np.flatnonzero(words >> _U(60) == ESCAPE)
    if by and len(rows):
        words = words.copy()
        words[rows] += _U(by)
    return words


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The numbers in the words, selector by selector."""
    selector = (words >> _U(60)).astype(np.int8)
    counts = COUNTS[selector]
    first = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), _U)
    for s, (count, width) in PACKS.items():
        rows = np.flatnonzero(selector == s)
        if len(rows):
            shifts = np.arange(count, dtype=_U) * _U(width)
            out[first[rows][:, None] + np.arange(count)] = (words[rows][:, None] >> shifts) & _U((1 << width) - 1)
    rows = np.flatnonzero(selector == ESCAPE)
    out[first[rows]] = escapes[(words[rows] & _U((1 << 60) - 1)).astype(np.int64)]
    return out


@dataclass
class Coded:
    """A file's content, words still packed."""

    part: int  # range of documents the file belongs to
    first: int  # numbers of that range before this file
    doc_id: list  # None where null
    starts: np.ndarray  # first number of each document, and the total
    block_first: np.ndarray  # first number of each block of words
    words: np.ndarray
    escapes: np.ndarray

    def numbers(self) -> np.ndarray:
        return unpack(self.words, self.escapes)

    def between(self, a: int, b: int) -> np.ndarray:
        """Numbers a to b - 1, read from the blocks that hold them."""
        if a >= b:
            return np.zeros(0, _U)
        low = int(np.searchsorted(self.block_first, a, "right")) - 1
        high = int(np.searchsorted(self.block_first, b, "left"))
        got = unpack(self.words[low * BLOCK_WORDS : high * BLOCK_WORDS], self.escapes)
        return got[a - int(self.block_first[low]) : b - int(self.block_first[low])]


def to_file(part: int, first: int, doc_id: list, lengths: np.ndarray, words: np.ndarray, escapes: np.ndarray) -> bytes:
    counts = COUNTS[(words >> _U(60)).astype(np.int8)]
    blocks = (np.cumsum(counts) - counts)[::BLOCK_WORDS]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    head = HEAD.pack(MAGIC, part, first, len(doc_id), int(starts[-1]), len(words), len(escapes), len(blocks), BLOCK_WORDS)
    body = [
        head,
        np.array([0 if d is None else d for d in doc_id], "<i8").tobytes(),
        np.array([d is None for d in doc_id], "<u8").tobytes(),
        starts.astype("<i8").tobytes(),
        blocks.astype("<i8").tobytes(),
        words.astype("<u8").tobytes(),
        escapes.astype("<u8").tobytes(),
    ]
    plain = b"".join(body)
    return plain + struct.pack("<I", zlib.crc32(plain))


def from_file(content: bytes) -> Coded:
    """Raises ValueError if the content is cut short or changed."""
    if len(content) < HEAD.size + 4 or zlib.crc32(memoryview(content)[:-4]) != struct.unpack("<I", content[-4:])[0]:
        raise ValueError("not a whole file of coded documents")
    magic, part, first, docs, _, words, escapes, blocks, size = HEAD.unpack_from(content)
    if magic != MAGIC or size != BLOCK_WORDS:
        raise ValueError("another file format")
    at, columns = HEAD.size, []
    for kind, n in (("<i8", docs), ("<u8", docs), ("<i8", docs + 1), ("<i8", blocks), ("<u8", words), ("<u8", escapes)):
        columns.append(np.frombuffer(content, kind, n, at))
        at += 8 * n
    ids, null, starts, block_first, packed, raw = columns
    named = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
    return Coded(part, first, named, starts, block_first, packed, raw)
