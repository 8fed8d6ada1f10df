"""Names of byte strings by prefix doubling, and positions every string of a length must contain.

The name of 2h bytes is made from the pair of names at i and i + h. A name depends on the
bytes alone, so equal strings get equal names in every task and no exchange is needed to rank them.
"""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
HIGH = np.uint64(0xFFFFFFFF00000000)
LOW = np.uint64(0x00000000FFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


#: Names of single bytes, by a rule.
BYTE_NAMES = mixed(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of joined strings from the names of their two parts."""
    x = left * MULTIPLIER
    x += right
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def doubled(names: np.ndarray, length: int, wanted: int) -> np.ndarray:
    """Names of `wanted` bytes from names of `length` bytes; the last pair may overlap."""
    while length < wanted:
        offset = min(length, wanted - length)
        names = paired(names[:-offset], names[offset:]) if len(names) > offset else names[:0]
        length += offset
    return names


def names_of(flat: np.ndarray, length: int) -> np.ndarray:
    """Name of the `length` bytes at every position that has so many."""
    return doubled(BYTE_NAMES[flat], 1, length)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbouring keys, by doubling."""
    have = 1
    while have < width:
        offset = min(have, width - have)
        keys = np.minimum(keys[:-offset], keys[offset:]) if len(keys) > offset else keys[:0]
        have += offset
    return keys


def anchored_runs(flat: np.ndarray, owner: np.ndarray, window: int, gram: int):
    """Runs of neighbouring window starts of one owner with the same anchor.

    The anchor of a window is its gram of least name, the first of equals, so it depends on the
    window's bytes alone. Returns (first start, number of starts, name of the anchor) of each run.
    """
    grams = names_of(flat, gram)
    if len(flat) < window:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    keys = (grams & HIGH) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(keys, window - gram + 1) & LOW).astype(np.int64)
    valid = owner[:len(anchor)] == owner[window - 1:]
    fresh = np.ones(len(anchor) + 1, bool)
    fresh[1:-1] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    edges = np.flatnonzero(fresh)
    starts, counts = edges[:-1], np.diff(edges)
    kept = valid[starts]
    starts, counts = starts[kept], counts[kept]
    return starts, counts, grams[anchor[starts]]


def spans_joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges covered by the given ones, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.ones(len(starts), bool)
    first[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(first)
    return starts[at], reach[np.append(at[1:], len(starts)) - 1]
