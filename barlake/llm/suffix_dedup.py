"""Suffix-array dedup: long byte strings that also start in an earlier document are removed.

Method: prefix doubling. Equal strings get equal names, the name of 2h bytes comes from the pair of
names at i and i + h (`names.paired`), and positions drop out as soon as their name is unique:

1. Names are doubled to 24 bytes. Every window of 50 bytes has one anchor, its gram of least name;
   neighbouring windows with one anchor form a run. Anchors are grouped by name over all documents;
   a run whose anchor is in one text only has unique windows and drops out.
2. The runs left are grouped by anchor, so that equal windows meet, and names are doubled to the
   threshold of 50 bytes. A window is repeated if an earlier document has its name and its bytes;
   where equal names hide different bytes, they are told apart byte by byte.

Only the anchors of step 1 (one in 14 positions) and the bytes of shared runs are exchanged, packed
in arrays. Equal runs are folded in each task before the exchange; anchors that would fill a
quarter of a partition are spread by the name of each window instead.

Rows: documents are compared by `doc_id`; a null id counts as later than every id. Rows with equal
text are one class, its smallest id stands for it; the other rows repeat it as a whole. Null text is
empty. Rows with the same id and text are equal and get equal results. Equal ids with different
texts are neither earlier nor later than each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.names import anchored_runs, mixed, names_of, paired, spans_joined
from barlake.llm.packed import (FOUND, NO_ID, ddl, firsts, found_rows, from_planes, gathered_spans, group_of,
                                keyed_texts, parts_of, planes, record_batches, removal_report, text_classes,
                                turns, without_spans)
from barlake.llm.shared import BLOCK_BYTES, blocks, cut, flushes, ints, shuffle_parts, small_batches, tidy, utf8

#: A longer text is cut into pieces of so many windows; a byte takes about fifty while it is named.
PIECE = BLOCK_BYTES
NAME_BYTES = 5
#: Texts of about so many bytes are named before what is wanted of them is put aside.
NAMED_BYTES = 1 << 20
#: Windows named at a time; runs of one anchor are named together.
WINDOWS = 1 << 19


def text_runs(flat: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(text, first window start in the text, windows, anchor name) of all runs, in order."""
    found = []
    for first, last in blocks(offsets):
        low, high = int(offsets[first]), int(offsets[last])
        for start in range(low, high, PIECE) if last == first + 1 else [low]:
            end = min(start + PIECE + length - 1, high) if last == first + 1 else high
            owner = np.repeat(np.arange(first, last), np.diff(offsets[first:last + 1]).astype(np.int64)) \
                if last > first + 1 else np.full(end - start, first)
            at, count, name = anchored_runs(flat[start:end], owner[:end - start], length, gram)
            text = owner[at]
            found.append((text, at + start - offsets[text], count, name))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(parts) for parts in zip(*found))


def ordinals_of(text: np.ndarray) -> np.ndarray:
    """Place of each run among those of its text."""
    fresh = np.ones(len(text), bool)
    fresh[1:] = text[1:] != text[:-1]
    first = np.flatnonzero(fresh)
    return np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))


# Step 1: anchors shared by different texts

ANCHORS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()),
                     ("names", pa.binary()), ("ordinals", pa.binary()), ("weights", pa.binary()),
                     ("settled_counts", pa.binary()), ("settled", pa.binary())])
SHARED = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()),
                    ("ordinals", pa.binary()), ("hot", pa.binary())])
WANTED = pa.schema([("key", pa.int64()), ("ordinals", pa.binary()), ("hot", pa.binary())])


def _emit_anchors(parts: int, length: int, gram: int):
    def task(batches):
        for group in flushes(batches, 1):
            yield from packed(group)

    def packed(batches):
        keys, texts, ordinals, names, seen, base = [], [], [], [], np.zeros(0, np.int64), 0
        for batch in small_batches(batches, 1, NAMED_BYTES):
            own = ints(batch.column(0), 0)
            flat, offsets = utf8(batch.column(1))
            text, _, _, name = text_runs(flat, offsets, length, gram)
            new = ~np.isin(own, seen)  # of copies in this task one is enough
            new &= np.isin(np.arange(len(own)), np.unique(own, return_index=True)[1])
            kept = new[text]
            keys.append(own)
            texts.append((text[kept] + base).astype(np.int32))
            ordinals.append(ordinals_of(text)[kept].astype(np.int32))
            names.append(name[kept])
            seen = np.union1d(seen, own)
            base += len(own)
        keys, texts, ordinals, names = map(np.concatenate, (keys, texts, ordinals, names))
        order = np.lexsort((texts, names))
        by_name = names[order]
        fresh_name = firsts(by_name)
        fresh = fresh_name | firsts(texts[order])  # one anchor of each name and text
        order, by_name, fresh_name = order[fresh], by_name[fresh], fresh_name[fresh]
        weight = np.diff(np.append(np.flatnonzero(fresh_name), len(order)))
        sent, shared = order[fresh_name], order[(weight > 1)[group_of(fresh_name)]]
        weights = weight[np.argsort(sent, kind="stable")]
        sent, shared = np.sort(sent), np.sort(shared)
        part, shared_part = parts_of(names[sent], parts), parts_of(names[shared], parts)
        by_part, by_shared = np.argsort(part, kind="stable"), np.argsort(shared_part, kind="stable")
        edges = np.searchsorted(part[by_part], np.arange(parts + 1))
        shared_edges = np.searchsorted(shared_part[by_shared], np.arange(parts + 1))
        for p in range(parts):
            own = by_part[edges[p]:edges[p + 1]]
            if not len(own):
                continue
            at, settled = sent[own], shared[by_shared[shared_edges[p]:shared_edges[p + 1]]]
            used, which = np.unique(np.concatenate([texts[at], texts[settled]]), return_inverse=True)
            counts = np.bincount(which[:len(at)], minlength=len(used))
            settled_counts = np.bincount(which[len(at):], minlength=len(used))
            yield pa.RecordBatch.from_pylist([{
                "part": p, "keys": keys[used].tobytes(), "counts": planes(counts, 4),
                "names": planes(names[at] >> np.uint64(64 - 8 * NAME_BYTES), NAME_BYTES),
                "ordinals": planes(ordinals[at], 4), "weights": planes(weights[own], 4),
                "settled_counts": planes(settled_counts, 4), "settled": planes(ordinals[settled], 4)}],
                schema=ANCHORS)
    return task


def _find_shared(parts: int):
    def task(batches):
        keys, names, ordinals, weights, settled_keys, settled = [], [], [], [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["keys"], np.int64)
                keys.append(np.repeat(own, from_planes(row["counts"], 4).astype(np.int64)))
                names.append(from_planes(row["names"], NAME_BYTES))
                ordinals.append(from_planes(row["ordinals"], 4).astype(np.uint32))
                weights.append(from_planes(row["weights"], 4).astype(np.int64))
                settled_keys.append(np.repeat(own, from_planes(row["settled_counts"], 4).astype(np.int64)))
                settled.append(from_planes(row["settled"], 4).astype(np.uint32))
        if not keys:
            return
        keys, names, ordinals, weights = map(np.concatenate, (keys, names, ordinals, weights))
        order = np.argsort(names, kind="stable")
        names, weights, by_name = names[order], weights[order], keys[order]
        at = np.flatnonzero(firsts(names))
        group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(names))))
        least, most = np.minimum.reduceat(by_name, at), np.maximum.reduceat(by_name, at)
        total = np.add.reduceat(weights, at)
        differ = least != most
        held = differ | (total > np.diff(np.append(at, len(names))))
        heavy = names[at][held & (4 * total > total[held].sum())].tobytes()
        chosen = differ[group]
        found = np.concatenate([by_name[chosen], *settled_keys])
        places = np.concatenate([ordinals[order][chosen], *settled])
        by_key = np.lexsort((places, found))
        found, places = found[by_key], places[by_key]
        fresh = firsts(found)
        own, counts = found[fresh], np.diff(np.append(np.flatnonzero(fresh), len(found)))
        part = parts_of(own.view(np.uint64), parts)
        place_part = np.repeat(part, counts)
        for p in np.unique(part):
            yield pa.RecordBatch.from_pylist([{
                "part": int(p), "keys": own[part == p].tobytes(), "counts": planes(counts[part == p], 4),
                "ordinals": planes(places[place_part == p], 4), "hot": None}], schema=SHARED)
        if heavy:
            yield pa.RecordBatch.from_pylist([{"part": 0, "hot": heavy}], schema=SHARED)
    return task


def _gather_shared(batches):
    keys, ordinals = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for batch in batches:
        for row in batch.to_pylist():
            if row["hot"]:
                yield pa.RecordBatch.from_pylist([{"hot": row["hot"]}], schema=WANTED)
                continue
            keys.append(np.repeat(np.frombuffer(row["keys"], np.int64), from_planes(row["counts"], 4).astype(np.int64)))
            ordinals.append(from_planes(row["ordinals"], 4).astype(np.uint32))
    keys, ordinals = np.concatenate(keys), np.concatenate(ordinals)
    order = np.argsort(keys, kind="stable")
    keys, ordinals = keys[order], ordinals[order]
    at = np.flatnonzero(firsts(keys)) if len(keys) else order
    yield from record_batches([{"key": int(keys[a]), "ordinals": ordinals[a:b].tobytes()}
                               for a, b in zip(at, np.append(at[1:], len(keys)))], WANTED)


# Step 2: windows repeated from earlier documents

RUNS = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()),
                  ("counts", pa.binary()), ("names", pa.binary()), ("windows", pa.binary()),
                  ("places", pa.binary()), ("starts", pa.binary()), ("bytes", pa.binary()),
                  ("span_counts", pa.binary()), ("span_starts", pa.binary()), ("span_ends", pa.binary())])


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes of many ranges, one after another."""
    ends = np.cumsum(sizes)
    found, first = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8), 0
    while first < len(starts):
        done = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, done + BLOCK_BYTES)))
        own = slice(first, last)
        where = np.repeat(starts[own] - (ends[own] - sizes[own]), sizes[own]) + np.arange(done, ends[last - 1])
        found[done:ends[last - 1]] = flat[where]
        first = last
    return found


def exact_runs(data: np.ndarray, at: np.ndarray, sizes: np.ndarray, whole: np.ndarray, name: np.ndarray) -> np.ndarray:
    """`whole`, or places in an order of bytes where runs of different bytes have equal names."""
    order = np.lexsort((whole, name))
    fresh = firsts(name[order]) | firsts(whole[order])
    rest = order[~fresh]
    lead = order[fresh][group_of(fresh)[~fresh]]
    same = sizes[rest] == sizes[lead]
    for low in range(0, len(rest), 1 << 13):
        own, first = rest[low:low + (1 << 13)], lead[low:low + (1 << 13)]
        alike = same[low:low + (1 << 13)]
        own, first = own[alike], first[alike]
        unequal = _gathered(data, at[own], sizes[own]) != _gathered(data, at[first], sizes[own])
        if unequal.any():
            same[low:low + (1 << 13)] = False
    if same.all():
        return whole
    texts = [data[a:a + n].tobytes() for a, n in zip(at, sizes)]
    places = {text: k for k, text in enumerate(sorted(set(texts)))}
    return np.array([places[text] for text in texts], np.uint64)


def _emit_runs(parts: int, length: int, gram: int, hot: np.ndarray):
    def runs_of(batch):
        """Candidate runs of a batch: text, start, windows, anchor, name of all its bytes, bytes."""
        flat, offsets = utf8(batch.column(2))
        text, start, count, name = text_runs(flat, offsets, length, gram)
        ordinal, wanted = ordinals_of(text), np.zeros(len(text), bool)
        first = np.searchsorted(text, np.arange(len(offsets)))
        for k, shared in enumerate(batch.column(3).to_pylist()):
            own = slice(first[k], first[k + 1])
            places = np.frombuffer(shared, np.uint32)
            wanted[own] = np.isin(name[own], name[own][places])
        text, start, count, name = text[wanted], start[wanted], count[wanted], name[wanted]
        if len(hot):  # windows of anchors that fill a partition go on one by one
            split = np.isin(name >> np.uint64(64 - 8 * NAME_BYTES), hot)
            each = np.where(split, count, 1)
            step = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            text, name, split = np.repeat(text, each), np.repeat(name, each), np.repeat(split, each)
            start = np.repeat(start, each) + step
            count = np.where(split, 1, np.repeat(count, each))
        sizes = count + length - 1
        data = _gathered(flat, start + offsets[text], sizes)
        first = np.cumsum(sizes) - sizes
        edges = window_names(data, np.column_stack([first, first + count - 1]).ravel(), length).reshape(-1, 2)
        whole = paired(edges[:, 0], edges[:, 1])  # the first and last window hold all bytes of a run
        if len(hot):
            name = np.where(split, whole, name)
        return text, start, count, name, mixed(whole + count.astype(np.uint64)), data, sizes

    def task(batches):
        for group in flushes(batches, 2):
            yield from packed(group)

    def packed(batches):
        ids, keys, found, base = [], [], [], 0
        for batch in small_batches(batches, 2, NAMED_BYTES):
            text, *rest = runs_of(batch)
            ids.append(ints(batch.column(0), NO_ID))
            keys.append(ints(batch.column(1), 0))
            found.append((text + base, *rest))
            base += batch.num_rows
        ids, keys = np.concatenate(ids), np.concatenate(keys)
        text, start, count, name, whole, data, sizes = (np.concatenate(x) for x in zip(*found))
        del found
        at_byte = np.cumsum(sizes) - sizes
        # of equal runs the one with the smallest id goes on, with all its places in that text
        whole = exact_runs(data, at_byte, sizes, whole, name)
        order = np.lexsort((start, text, ids[text], whole, name))
        fresh = firsts(name[order]) | firsts(whole[order])
        group = group_of(fresh)
        least = ids[text[order]][fresh][group]
        later = ids[text[order]] > least
        covered = order[later]
        order, group = order[~later], group[~later]
        fresh = firsts(group) | firsts(text[order])
        place_count = np.diff(np.append(np.flatnonzero(fresh), len(order)))
        entry, place = order[fresh], np.split(start[order], np.flatnonzero(fresh)[1:])
        part = parts_of(name[entry], parts)
        by_part = np.lexsort((text[entry], part))
        edges = np.searchsorted(part[by_part], np.arange(parts + 1))
        where = np.argsort(text[covered], kind="stable")
        covered = covered[where]
        span_part = parts_of(keys[text[covered]].view(np.uint64), parts)
        for p in range(parts):
            own = by_part[edges[p]:edges[p + 1]]
            spans = covered[span_part == p]
            if not len(own) and not len(spans):
                continue
            at = entry[own]
            span_text = text[spans]
            low, high, span_counts = [], [], {}
            for k in np.unique(span_text):
                mine = spans[span_text == k]
                a, b = spans_joined(start[mine], start[mine] + sizes[mine])
                low.append(a)
                high.append(b)
                span_counts[k] = len(a)
            used = np.unique(np.concatenate([text[at], span_text]))
            yield pa.RecordBatch.from_pylist([{
                "part": p, "ids": ids[used].tobytes(), "keys": keys[used].tobytes(),
                "counts": planes(np.bincount(np.searchsorted(used, text[at]), minlength=len(used)), 4),
                "names": name[at].tobytes(), "windows": planes(count[at], 1),
                "places": planes(place_count[own], 4),
                "starts": planes(np.concatenate([place[k] for k in own]) if len(own) else own, 4),
                "bytes": _gathered(data, at_byte[at], sizes[at]).tobytes(),
                "span_counts": planes(np.array([span_counts.get(k, 0) for k in used]), 4),
                "span_starts": planes(np.concatenate(low) if low else spans, 4),
                "span_ends": planes(np.concatenate(high) if high else spans, 4)}], schema=RUNS)
    return task


def _whole_anchors(anchor: np.ndarray, count: np.ndarray, order: np.ndarray):
    """`order`, sorted by anchor, in pieces of about WINDOWS windows; runs of one anchor stay together."""
    edges = np.append(np.flatnonzero(firsts(anchor[order])), len(order))
    windows = np.concatenate([[0], np.cumsum(count[order])])[edges]
    first = 0
    while first < len(edges) - 1:
        last = max(first + 1, int(np.searchsorted(windows, windows[first] + WINDOWS, "right")) - 1)
        yield order[edges[first]:edges[last]]
        first = last


def _later_windows(ids, anchor, count, data, at_byte, own, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, window in it) of the windows of the runs `own` that a smaller id has too."""
    sizes = count[own] + length - 1
    data = _gathered(data, at_byte[own], sizes)
    entry = np.repeat(np.arange(len(own)), count[own])
    at = (np.cumsum(sizes) - sizes)[entry] + turns(count[own])
    names = paired(anchor[own][entry], window_names(data, at, length))
    order = np.argsort(names, kind="stable")
    fresh = firsts(names[order])
    if len(order):
        fresh = exact_groups(data, at, order, fresh, length)
    by_name = ids[own[entry[order]]]
    starts = np.flatnonzero(fresh)
    least = np.minimum.reduceat(by_name, starts)[group_of(fresh)] if len(starts) else by_name
    order = order[by_name > least]
    return own[entry[order]], at[order] - (np.cumsum(sizes) - sizes)[entry[order]]


def exact_groups(data: np.ndarray, at: np.ndarray, order: np.ndarray, fresh: np.ndarray, length: int) -> np.ndarray:
    """`fresh`, the first of each group of windows with equal names, made exact: windows whose bytes
    differ from their group's first are told apart byte by byte. `order` is sorted anew in such groups."""
    group, lead = group_of(fresh), at[order][fresh]
    differs = np.zeros(len(order), bool)
    width = 8 if length >= 8 else 1
    words = np.ndarray((len(data) - width + 1,), f"<u{width}", np.ascontiguousarray(data), strides=(1,))
    offsets = [*range(0, length - width, width), length - width]
    rest = np.flatnonzero(~fresh)
    for low in range(0, len(rest), BLOCK_BYTES):
        some = rest[low:low + BLOCK_BYTES]
        own, first = at[order[some]], lead[group[some]]
        for offset in offsets:
            differs[some] |= words[own + offset] != words[first + offset]
    if not differs.any():
        return fresh
    fresh = fresh.copy()
    edges = np.append(np.flatnonzero(fresh), len(order))
    for g in np.unique(group[differs]):
        low, high = edges[g], edges[g + 1]
        texts = [data[a:a + length].tobytes() for a in at[order[low:high]]]
        where = sorted(range(len(texts)), key=texts.__getitem__)
        order[low:high] = order[low:high][where]
        fresh[low:high] = [k == 0 or texts[where[k]] != texts[where[k - 1]] for k in range(len(where))]
    return fresh


def _find_repeated(parts: int, length: int):
    def task(batches):
        columns = []
        for batch in batches:
            for row in batch.to_pylist():
                ids, keys = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["keys"], np.int64)
                counts = from_planes(row["counts"], 4).astype(np.int64)
                spans = from_planes(row["span_counts"], 4).astype(np.int64)
                columns.append((np.repeat(ids, counts), np.repeat(keys, counts),
                                np.frombuffer(row["names"], np.uint64),
                                from_planes(row["windows"], 1).astype(np.int64),
                                from_planes(row["places"], 4).astype(np.int64),
                                from_planes(row["starts"], 4).astype(np.int64),
                                np.frombuffer(row["bytes"], np.uint8),
                                np.repeat(ids, spans), np.repeat(keys, spans),
                                from_planes(row["span_starts"], 4).astype(np.int64),
                                from_planes(row["span_ends"], 4).astype(np.int64)))
        if not columns:
            return
        ids, keys, anchor, count, places, starts, data, *spans = (np.concatenate(x) for x in zip(*columns))
        del columns
        sizes = count + length - 1
        at_byte = np.cumsum(sizes) - sizes
        by_anchor = np.argsort(anchor, kind="stable")
        found = [_later_windows(ids, anchor, count, data, at_byte, own, length)
                 for own in _whole_anchors(anchor, count, by_anchor)]
        entry, step = (np.concatenate(x) for x in zip(*found)) if found else (by_anchor, by_anchor)
        order = np.lexsort((step, entry))
        entry, step = entry[order], step[order]
        # neighbouring repeated windows of a run are one span, at each place of the run
        fresh = firsts(entry)
        fresh[1:] |= step[1:] != step[:-1] + 1
        low = np.flatnonzero(fresh)
        size = np.diff(np.append(low, len(entry))) + length - 1
        owner, offset = entry[low], step[low]
        each = places[owner]
        first_place = (np.cumsum(places) - places)[owner]
        which = np.repeat(np.arange(len(owner)), each)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
        begin = starts[first_place[which] + turn] + offset[which]
        yield from found_rows(parts, np.concatenate([ids[owner][which], spans[0]]),
                              np.concatenate([keys[owner][which], spans[1]]),
                              np.concatenate([begin, spans[2]]), np.concatenate([begin + size[which], spans[3]]))
    return task


def window_names(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Names of `length` bytes at the places `at`, in order, doubled block by block."""
    found = np.zeros(len(at), np.uint64)
    for low in range(0, len(data), BLOCK_BYTES):
        first, last = np.searchsorted(at, [low, low + BLOCK_BYTES])
        if last > first:
            found[first:last] = names_of(data[low:low + BLOCK_BYTES + length - 1], length)[at[first:last] - low]
    return found


# The operator

def repeated_spans(texts: DataFrame, classes: DataFrame, length: int = 50) -> DataFrame:
    """(id, key, starts, ends) of the texts with bytes covered by repeated strings of `length` bytes,
    their ranges packed. `texts` are keyed, `classes` are theirs."""
    parts, gram = shuffle_parts(texts.sparkSession), max(1, (length - 2) // 2)
    anchors = texts.select("key", "text").mapInArrow(tidy(_emit_anchors(parts, length, gram)), ddl(ANCHORS))
    shared = anchors.repartitionById(parts, F.col("part")).mapInArrow(tidy(_find_shared(parts)), ddl(SHARED))
    shared = cut(shared.repartitionById(parts, F.col("part")).mapInArrow(tidy(_gather_shared), ddl(WANTED)))
    hot = np.array([n for row in shared.where("hot is not null").select("hot").collect()
                    for n in np.frombuffer(row[0], np.uint64)], np.uint64)  # four of each partition at most
    wanted = shared.where("key is not null").select("key", "ordinals").join(classes, "key")
    # the columns are those that without_spans() needs too, so that Spark uses the exchange again
    runs = (texts.join(wanted, ["id", "key"]).select("id", "key", "text", "ordinals", "rest")
            .mapInArrow(tidy(_emit_runs(parts, length, gram, hot)), ddl(RUNS)))
    found = runs.repartitionById(parts, F.col("part")).mapInArrow(tidy(_find_repeated(parts, length)), ddl(FOUND))
    return gathered_spans(found, parts)


def remove_repeats(docs: DataFrame, length: int = 50, carried: list[str] | None = None, as_text: bool = False
                   ) -> DataFrame:
    """(id, key, text, rest, kept, spans) of every document: `kept` are the bytes of the text that
    are left, or whole characters of them `as_text`; `spans` are the removed byte ranges, `id` is
    the doc_id (NO_ID for null), `key` a hash of the text, `rest` a struct of `carried` columns."""
    texts = keyed_texts(docs, carried)
    classes = text_classes(texts)
    return without_spans(texts, classes, repeated_spans(texts, classes, length), length, as_text)


def digests(docs: DataFrame) -> DataFrame:
    return removal_report(remove_repeats(docs))
