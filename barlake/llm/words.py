"""Words of many texts at once, as 64-bit names.

A-Z is lower-cased; a word is a maximal run of 0-9, a-z and characters from U+0080 on.
"""

from __future__ import annotations

import numpy as np

from barlake.llm.names import BYTE_NAMES, mixed
from barlake.llm.shared import blocks

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[65:91] = IN_WORD[128:] = True
LOWERED_NAMES = BYTE_NAMES[LOWERED]
BASE = np.uint64(0x5851F42D4C957F2D)
_powers = np.cumprod(np.full(1 << 10, BASE))


def powers(count: int) -> np.ndarray:
    global _powers
    while len(_powers) < count:
        _powers = np.concatenate([_powers, _powers * _powers[-1]])
    return _powers[:count]


def _block_words(flat: np.ndarray, offsets: np.ndarray):
    """(start, end, name) of the words of one block, and how many each text has."""
    inside = IN_WORD[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True  # a word never goes on in the next text
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    word = inside[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[word], ends[word]
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    step = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    data = flat[inside]
    value = LOWERED_NAMES[data] * powers(int(sizes.max(initial=0)))[step]
    value ^= value >> np.uint64(32)  # else sums of powers would cancel out in words made for that
    names = mixed(np.add.reduceat(value, first)) if len(first) else np.zeros(0, np.uint64)
    return starts, ends, names, np.diff(np.searchsorted(starts, offsets))


def words_of(flat: np.ndarray, offsets: np.ndarray):
    """(start byte, end byte, name) of all words, and the offsets of each text in them."""
    parts, counts = [], []
    for first, last in blocks(offsets):
        low = offsets[first]
        starts, ends, names, count = _block_words(flat[low:offsets[last]], offsets[first:last + 1] - low)
        parts.append((starts + low, ends + low, names))
        counts.append(count)
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(1, np.int64)
    starts, ends, names = (np.concatenate(p) for p in zip(*parts))
    bounds = np.zeros(len(offsets), np.int64)
    np.cumsum(np.concatenate(counts), out=bounds[1:])
    return starts, ends, names, bounds
