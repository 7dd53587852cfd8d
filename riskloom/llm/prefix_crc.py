"""CRC-32 of word n-grams from running CRCs, in numpy.

A text is scanned once; the CRC of everything up to each word's end is kept. With Z the linear
map over GF(2) that appends a zero byte, crc(A + B) = Z^len(B) crc(A) xor crc(B), so the CRC
of any run of words is that of the prefix which ends with it, xor the shifted one of the
prefix before it. Z^n is applied by four lookups, bytes of the CRC into a table for n.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np

POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, reflected
NEAR = 128  # shifts below this have a table each
PIECE = 1 << 20  # bytes scanned at a time
NO_BUCKET = 0xFFFF
# Bytes of words: digits, letters and all above ASCII, with A-Z lower-cased; others separate.
_WORD = {b: b for b in (*b"0123456789", *range(0x80, 0x100), *string.ascii_lowercase.encode())}
_WORD |= {b: b + 32 for b in string.ascii_uppercase.encode()}
_NORMAL = bytes(_WORD.get(b, 0x20) for b in range(256))


@cache
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


def _apply(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A linear map given by its values on each byte at each of the four places."""
    return tables[0][v & 255] ^ tables[1][(v >> 8) & 255] ^ tables[2][(v >> 16) & 255] ^ tables[3][v >> 24]


@cache
def _near() -> np.ndarray:
    """Z^n for n below ``NEAR``: n, place, byte."""
    t, step = np.empty((NEAR, 4, 256), np.uint32), _byte_table()
    t[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, NEAR):
        t[n] = step[t[n - 1] & 255] ^ (t[n - 1] >> 8)
    return t


@cache
def _far(j: int) -> np.ndarray:
    """Z^(NEAR * 2^j)."""
    first, second = (_near()[1], _near()[NEAR - 1]) if j == 0 else (_far(j - 1), _far(j - 1))
    return _apply(first, second.ravel()).reshape(4, 256)


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Z^by of each CRC."""
    t, near, far = _near(), by % NEAR, by // NEAR
    out = t[near, 0, crc & 255] ^ t[near, 1, (crc >> 8) & 255] ^ t[near, 2, (crc >> 16) & 255] ^ t[near, 3, crc >> 24]
    for j in range(int(far.max(initial=0)).bit_length()):
        rows = np.flatnonzero((far >> j) & 1)
        out[rows] = _apply(_far(j), out[rows])
    return out


def _running(words: list[bytes]) -> np.ndarray:
    """CRC of the words, joined by single blanks, up to the end of each."""
    out, crc = [], 0
    for word in words:
        end = crc32(word, crc)
        out.append(end)
        crc = crc32(b" ", end)
    return np.array(out, np.uint32)


def gram_crcs(words: list[bytes], longest: int) -> list[np.ndarray]:
    """For n = 1 to ``longest``: the CRC of the n words that end with each word, from the n-th on."""
    ends = _running(words)
    bare = ~ends
    after = ~(_byte_table()[(bare ^ 0x20) & 255] ^ (bare >> 8))  # with a blank behind
    before = np.concatenate([np.zeros(1, np.uint32), after])[:-1]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(sizes + 1) - 1
    start = stop - sizes
    out = []
    for n in range(1, longest + 1):
        m = max(0, len(words) - n + 1)
        out.append(ends[n - 1 :] ^ shifted(before[:m], stop[n - 1 :] - start[:m]) if m else ends[:0])
    return out


def _pieces(text: bytes) -> Iterator[bytes]:
    """Normalised text in parts of about ``PIECE`` bytes, cut between words."""
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + PIECE)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut


def _flat(words: list[bytes], owner: np.ndarray, seen: int, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams that end after the first ``seen`` words, and the owner of each."""
    grid = np.full((len(words), longest), NO_BUCKET, np.uint16)
    for n, crc in enumerate(gram_crcs(words, longest), 1):
        same = owner[n - 1 :] == owner[: len(owner) - n + 1] if len(words) >= n else np.zeros(0, bool)
        grid[n - 1 :, n - 1] = np.where(same, crc % np.uint32(buckets), NO_BUCKET)
    grid = grid[seen:]
    held = grid != NO_BUCKET
    return grid[held], np.repeat(owner[seen:], held.sum(1))


def feature_buckets(texts: list[bytes], buckets: int, longest: int = 3) -> list[np.ndarray]:
    """Per text the bucket of each of its runs of 1 to ``longest`` words."""
    out: list[np.ndarray] = []
    words, counts, size = [], [], 0

    def flush() -> None:
        nonlocal words, counts, size
        if counts:
            owner = np.repeat(np.arange(len(counts)), counts)
            found, of = _flat(words, owner, 0, buckets, longest)
            out.extend(np.split(found, np.searchsorted(of, np.arange(1, len(counts)))))
        words, counts, size = [], [], 0

    for raw in texts:
        text = raw.translate(_NORMAL)
        if len(text) > PIECE:
            flush()
            parts, last = [], []
            for piece in _pieces(text):
                here = last + piece.split()
                parts.append(_flat(here, np.zeros(len(here), np.int64), len(last), buckets, longest)[0])
                last = here[max(0, len(here) - longest + 1) :] if longest > 1 else []
            out.append(np.concatenate(parts))
            continue
        split = text.split()
        words += split
        counts.append(len(split))
        size += len(text)
        if size > PIECE:
            flush()
    flush()
    return out
