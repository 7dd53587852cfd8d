"""Content-defined anchors: every string of ``length`` bytes is filed under one number.

The number is the least hash among the string's own grams, so equal strings are filed
together wherever they stand. Neighbouring starts mostly share it and form a run.
"""

from __future__ import annotations

import numpy as np

from riskloom.llm.shingles import _BYTE, _powers, mix

GRAM = 32


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with the same anchor: anchor, text, first start in its text, starts, digest, loops.

    ``digest`` is a hash of the bytes the run's strings cover; ``loops`` tells that the
    anchor's gram occurs more than once there, so the run may repeat itself.
    """
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64, bool))
    if len(data) < length:
        return none
    up, down = _powers(max(16, int(len(data)).bit_length()))
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)]
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
    window = length - GRAM + 1
    least, width = grams, 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(grams) - window + 1], least[window - width :])
    # a start counts if its string ends within its text
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    good = np.arange(len(least)) + length <= offsets[text + 1]
    new = good.copy()
    new[1:] &= ~good[:-1] | (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none
    ends = good.copy()
    ends[:-1] &= ~good[1:] | new[1:]
    last = np.flatnonzero(ends)
    anchor = least[first]
    reach = np.arange(window)
    loops = np.empty(len(first), bool)
    for a in range(0, len(first), 1 << 14):
        part = slice(a, a + (1 << 14))
        left = first[part] + (grams[first[part, None] + reach] == anchor[part, None]).argmax(1)
        right = last[part] + window - 1 - (grams[last[part, None] + reach[::-1]] == anchor[part, None]).argmax(1)
        loops[part] = left != right
    stop = last + length
    digest = mix(mix((total[stop] - total[first]) * down[first]) + (stop - first).astype(np.uint64))
    return anchor, text[first], first - offsets[text[first]], last - first + 1, digest, loops
