"""Burrows-Wheeler transforms of shards of strings, and their merge by interleave refinement.

A shard is a run of strings, joined with a byte that UTF-8 never uses. Its suffixes are
sorted to a given depth once, which gives the transform (the byte before each suffix, in
sorted order), the step from each suffix to the one that starts a byte earlier, and the
classes of suffixes with a common prefix of that depth.

Merging sorts no suffixes again. The interleave of all shards starts with all suffixes in
one block; a round reads the transforms in the present interleave and deals it out stably by
the byte read, which orders the suffixes by one more byte and splits the blocks whose bytes
differ. The round in which two neighbours part is the length of their common prefix. Blocks
whose rows come from one shard are settled by that shard's own order and leave the rounds; rows
with fewer than ``depth`` bytes before them in their string do not enter them; what is left after ``depth`` rounds are the repeated intervals that span shards.
"""

from __future__ import annotations

import numpy as np

END = 0xFF
SHARD = 1 << 19


class Shard:
    """The sorted suffixes of one text, to a depth."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.order, self.first = _sorted_suffixes(text, depth)
        before = (self.order - 1) % n
        self.bytes = text[before]
        row = np.empty(n, np.int32)
        row[self.order] = np.arange(n, dtype=np.int32)
        self.step = row[before]


def _sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix positions in order of their first ``depth`` bytes (cyclic), and which open a class."""
    n = len(text)
    wide = np.resize(text, n + 8) if n else text
    key = np.zeros(n, np.uint64)
    known = min(8, depth)
    for i in range(known):
        key = (key << np.uint64(8)) | wide[i : i + n].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    opens = np.r_[True, key[order][1:] != key[order][:-1]]
    place, small = np.arange(n, dtype=np.uint64), np.uint64(21)
    while known < depth:
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(opens) - 1
        reach = min(known, depth - known)
        ahead = np.roll(rank, -reach)
        known += reach
        if n <= 1 << 21:  # both ranks and the place in one number: sorted at once, and in order of place
            whole = np.sort((rank << np.uint64(42)) | (ahead << small) | place)
            order, key = (whole & np.uint64((1 << 21) - 1)).astype(np.int64), whole >> small
        else:
            key = (rank << np.uint64(32)) | ahead
            order = np.argsort(key, kind="stable")
            key = key[order]
        opens = np.r_[True, key[1:] != key[:-1]]
    return order.astype(np.int32), opens


def repeated(strings: list[bytes], depth: int, shard: int = SHARD) -> list[np.ndarray]:
    """Per string, which of its positions hold ``depth`` bytes that also stand at an earlier one.

    Earlier means in a string before it, or before it in the same string. Positions whose
    bytes do not fit in their string are not told of.
    """
    groups: list[list[int]] = [[]]
    size = 0
    for i, s in enumerate(strings):
        if size and size + len(s) > shard:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += len(s) + 1
    shards, starts, at = [], [], 0
    for g in groups:
        text = np.frombuffer(b"".join(strings[i] + bytes([END]) for i in g), np.uint8)
        if len(text):
            shards.append(Shard(text, depth))
            starts.append(at)
            at += len(text)
    later = np.zeros(at, bool)
    for s, start in zip(shards, starts, strict=True):
        # equal suffixes stand in the order of their positions
        later[start + s.order[~s.first]] = True
    if len(shards) > 1:
        deep = np.concatenate([np.arange(len(s) + 1) >= depth for s in strings])
        rows, blocks, places = merge(shards, starts, depth, deep)
        opens = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else []
        if len(opens):
            where = places[rows]
            least = np.minimum.reduceat(where, opens)
            later[where[where != np.repeat(least, np.diff(np.r_[opens, len(where)]))]] = True
    out, at = [], 0
    for s in strings:
        out.append(later[at : at + max(0, len(s) - depth + 1)])
        at += len(s) + 1
    return out


def merge(shards: list[Shard], starts: list[int], depth: int, deep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The interleave after ``depth`` rounds, where shards still share blocks.

    ``deep`` tells of each place whether ``depth`` bytes of its string stand before it.

    Rows (numbers in the joined transforms) in merged order, the block of each, and the
    place in the joined text of every row.
    """
    text = np.concatenate([s.bytes for s in shards])
    step = np.concatenate([s.step + np.int32(a) for s, a in zip(shards, starts, strict=True)])
    # byte and step in one number, so that a round looks up each row once
    kind, wide = (np.uint32, 24) if len(text) < 1 << 24 else (np.uint64, 32)
    look = (text.astype(kind) << kind(wide)) | step.astype(kind)
    places = np.concatenate([s.order + np.int32(a) for s, a in zip(shards, starts, strict=True)])
    owner = np.repeat(np.arange(len(shards), dtype=np.int16), [len(s.bytes) for s in shards])
    rows = np.flatnonzero(deep[places])
    blocks = np.zeros(len(rows), np.int32)
    known = 1
    for _ in range(depth if len(rows) else 0):
        found = look[rows]
        read = (found >> kind(wide)).astype(np.uint8)
        order = np.argsort(read, kind="stable")
        read, blocks = read[order], blocks[order]
        rows = (found & kind((1 << wide) - 1))[order]
        opens = np.r_[True, (read[1:] != read[:-1]) | (blocks[1:] != blocks[:-1])]
        at = np.flatnonzero(opens)
        if len(at) == known:  # no block was split, so none became one shard's own
            blocks = np.cumsum(opens, dtype=np.int32) - np.int32(1)
            continue
        mine = owner[rows]
        shared = np.minimum.reduceat(mine, at) != np.maximum.reduceat(mine, at)
        counts = np.diff(np.r_[at, len(rows)])
        rows = rows[np.repeat(shared, counts)]
        known = int(shared.sum())
        blocks = np.repeat(np.arange(known, dtype=np.int32), counts[shared])
        if not len(rows):
            break
    return rows, blocks, places
