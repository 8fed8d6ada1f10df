"""Substring dedup by content-defined chunks.

A gear hash of the last 16 bytes is rolled over each text. A chunk ends where that hash is larger
than at the 24 places before and not smaller than at the 24 places after, so boundaries depend on
the bytes around them alone and an insertion moves no boundary beyond its neighbourhood. Chunks are
25 bytes or longer, 49 on average; one of more than 512 bytes is split every 512.

Chunks with equal digests are equal. A chunk is repeated if a document with a smaller id has it.
Every repeated chunk is removed, whatever its length, repeated neighbours as one range; callers of
`remove_repeats` may ask for a least length of these ranges. Digests are exchanged packed in arrays;
each task first folds its own equal chunks.

Rows: as for suffix-array dedup. A null id counts as later than every id; rows with equal text are
one class, whose later rows repeat it as a whole; null text is empty.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.names import BYTE_NAMES, sliding_least
from barlake.llm.packed import (FOUND, NO_ID, ddl, firsts, found_rows, from_planes, gathered_spans, group_of,
                                keyed_texts, parts_of, planes, removal_report, text_classes, turns, without_spans)
from barlake.llm.shared import blocks, flushes, ints, shuffle_parts, utf8

GEAR = 16
REACH = 24
LONGEST = 512
#: Bytes of the shortest range that is removed: all of them.
LEAST_REMOVED = 1
DIGEST = 12
#: A longer text is hashed in pieces of so many bytes, with the bytes around that their hashes need.
PIECE = 1 << 22


def gear_hashes(flat: np.ndarray) -> np.ndarray:
    """Gear hash of the GEAR bytes that end at each place; 0 where there are fewer."""
    hashes, have = BYTE_NAMES[flat], 1
    while have < GEAR:  # the hash of 2m bytes from two hashes of m
        hashes = hashes[have:] + (hashes[:-have] << np.uint64(have)) if len(hashes) > have else hashes[:0]
        have *= 2
    return np.concatenate([np.zeros(len(flat) - len(hashes), np.uint64), hashes])


def cut_points(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places after which a chunk ends, for neighbouring texts in `flat`."""
    hashes = gear_hashes(flat)
    sizes = np.diff(offsets)
    begins = np.repeat(offsets[:-1], sizes)
    hashes[np.arange(len(flat)) - begins < GEAR - 1] = 0
    # a gap of REACH places around each text keeps its neighbours out of the comparison
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) + (text + 1) * REACH
    spread = np.zeros(len(flat) + (len(sizes) + 1) * REACH, np.uint64)
    spread[place] = hashes
    most = ~sliding_least(~spread, REACH)
    return np.flatnonzero((hashes > most[place - REACH]) & (hashes >= most[place + 1])) + 1


def chunk_ends(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of all chunks of the texts in `flat`, the ends of the texts included."""
    found = [offsets[1:][np.diff(offsets) > 0]]
    for first, last in blocks(offsets):
        low, high = int(offsets[first]), int(offsets[last])
        if high - low <= PIECE:
            found.append(cut_points(flat[low:high], offsets[first:last + 1] - low) + low)
            continue
        for start in range(low, high, PIECE):
            a, b = max(low, start - REACH - GEAR), min(high, start + PIECE + REACH)
            ends = cut_points(flat[a:b], np.array([0, b - a])) + a
            found.append(ends[(ends > start) & (ends <= start + PIECE)])
    ends = np.unique(np.concatenate(found))
    sizes = np.diff(np.concatenate([[0], ends]))
    extra = (sizes - 1) // LONGEST
    if not extra.any():
        return ends
    each = extra + 1
    turn = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    return np.where(turn == np.repeat(extra, each), np.repeat(ends, each),
                    np.repeat(ends - sizes, each) + (turn + 1) * LONGEST)


def chunks_of(flat: np.ndarray, offsets: np.ndarray):
    """(text, start in the text, size, digest) of all chunks."""
    ends = chunk_ends(flat, offsets)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    data = flat.tobytes()
    digests = b"".join(blake2b(data[a:b], digest_size=DIGEST).digest() for a, b in zip(starts.tolist(), ends.tolist()))
    return text, starts - offsets[text], ends - starts, np.frombuffer(digests, f"V{DIGEST}")


def split_digest(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(digests.tobytes(), np.uint32).reshape(-1, 3)
    return raw[:, 0].astype(np.uint64) << np.uint64(32) | raw[:, 1], raw[:, 2]


CHUNKS = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()),
                    ("digests", pa.binary()), ("places", pa.binary()), ("starts", pa.binary()),
                    ("sizes", pa.binary()), ("span_counts", pa.binary()), ("span_starts", pa.binary()),
                    ("span_ends", pa.binary())])


def _emit_chunks(parts: int):
    def task(batches):
        for group in flushes(batches, 2):
            yield from packed(group)

    def packed(batches):
        ids, keys, found, base = [], [], [], 0
        for batch in batches:
            text, *rest = chunks_of(*utf8(batch.column(2)))
            ids.append(ints(batch.column(0), NO_ID))
            keys.append(ints(batch.column(1), 0))
            found.append((text + base, *rest))
            base += batch.num_rows
        ids, keys = np.concatenate(ids), np.concatenate(keys)
        text, start, size, digest = (np.concatenate(x) for x in zip(*found))
        high, low = split_digest(digest)
        # of equal chunks those of the smallest id go on, once for each text with all its places
        order = np.lexsort((start, text, ids[text], low, high))
        fresh = firsts(high[order]) | firsts(low[order])
        group = group_of(fresh)
        later = ids[text[order]] > ids[text[order]][fresh][group]
        covered = order[later]
        order, group = order[~later], group[~later]
        fresh = firsts(group) | firsts(text[order])
        edges = np.append(np.flatnonzero(fresh), len(order))
        entry, place_count = order[fresh], np.diff(edges)
        part = parts_of(high[entry], parts)
        by_part = np.lexsort((text[entry], part))
        bounds = np.searchsorted(part[by_part], np.arange(parts + 1))
        covered = covered[np.lexsort((start[covered], text[covered]))]
        span_part = parts_of(keys[text[covered]].view(np.uint64), parts)
        for p in range(parts):
            own, spans = by_part[bounds[p]:bounds[p + 1]], covered[span_part == p]
            if not len(own) and not len(spans):
                continue
            at = entry[own]
            fresh = firsts(text[spans])  # neighbouring covered chunks are one span
            fresh[1:] |= start[spans[1:]] != (start + size)[spans[:-1]]
            begin = spans[fresh]
            last = spans[np.append(np.flatnonzero(fresh)[1:], len(spans)) - 1] if len(spans) else spans
            used = np.unique(np.concatenate([text[at], text[begin]]))
            which = np.repeat(edges[:-1][own], place_count[own]) + turns(place_count[own])
            yield pa.RecordBatch.from_pylist([{
                "part": p, "ids": ids[used].tobytes(), "keys": keys[used].tobytes(),
                "counts": planes(np.bincount(np.searchsorted(used, text[at]), minlength=len(used)), 4),
                "digests": digest[at].tobytes(), "places": planes(place_count[own], 4),
                "starts": planes(start[order[which]], 4), "sizes": planes(size[at], 2),
                "span_counts": planes(np.bincount(np.searchsorted(used, text[begin]), minlength=len(used)), 4),
                "span_starts": planes(start[begin], 4), "span_ends": planes((start + size)[last], 4)}],
                schema=CHUNKS)
    return task


def _find_repeated(parts: int):
    def task(batches):
        columns = []
        for batch in batches:
            for row in batch.to_pylist():
                ids, keys = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["keys"], np.int64)
                counts = from_planes(row["counts"], 4).astype(np.int64)
                spans = from_planes(row["span_counts"], 4).astype(np.int64)
                columns.append((np.repeat(ids, counts), np.repeat(keys, counts),
                                np.frombuffer(row["digests"], f"V{DIGEST}"),
                                from_planes(row["places"], 4).astype(np.int64),
                                from_planes(row["starts"], 4).astype(np.int64),
                                from_planes(row["sizes"], 2).astype(np.int64),
                                np.repeat(ids, spans), np.repeat(keys, spans),
                                from_planes(row["span_starts"], 4).astype(np.int64),
                                from_planes(row["span_ends"], 4).astype(np.int64)))
        if not columns:
            return
        ids, keys, digest, places, starts, sizes, *spans = (np.concatenate(x) for x in zip(*columns))
        high, low = split_digest(digest)
        order = np.lexsort((ids, low, high))
        fresh = firsts(high[order]) | firsts(low[order])
        later = order[ids[order] > ids[order][fresh][group_of(fresh)]]
        each = places[later]
        which = np.repeat(later, each)
        begin = starts[np.repeat((np.cumsum(places) - places)[later], each) + turns(each)]
        yield from found_rows(parts, np.concatenate([ids[which], spans[0]]), np.concatenate([keys[which], spans[1]]),
                              np.concatenate([begin, spans[2]]), np.concatenate([begin + sizes[which], spans[3]]))
    return task


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(id, key, starts, ends) of the texts with repeated chunks, their byte ranges packed."""
    parts = shuffle_parts(texts.sparkSession)
    chunks = texts.where(F.length("text") > 0).mapInArrow(_emit_chunks(parts), ddl(CHUNKS))
    found = chunks.repartitionById(parts, F.col("part")).mapInArrow(_find_repeated(parts), ddl(FOUND))
    return gathered_spans(found, parts)


def remove_repeats(docs: DataFrame, least: int = LEAST_REMOVED) -> DataFrame:
    """(id, key, text, rest, kept, spans) of every document: `kept` are the bytes of the text that
    are left, `spans` the removed byte ranges, those under `least` bytes left out; `id` is the
    doc_id, `key` a hash of the text."""
    texts = keyed_texts(docs)
    return without_spans(texts, text_classes(texts), repeated_spans(texts), max(1, least))


def digests(docs: DataFrame) -> DataFrame:
    return removal_report(remove_repeats(docs))
