"""Benchmark decontamination by a prefix-filtered join of word windows.

A window is 13 consecutive words of an item, or the whole of a shorter item. Containment must be
full, so one word of a window is a sufficient prefix: the rarest over all documents. Document words
meet windows by that word alone; the window's place follows from the word's position in it, places
that do not fit into the document are dropped, and all words of the rest are compared.

Items are sent to the tasks in slices of at most SLICE_BYTES, each a pass over the documents.

Rows: null or wordless texts have no words and no hits. Items without id or words take no part;
items of the same id count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.names import spans_joined
from barlake.llm.shared import cut, utf8
from barlake.llm.words import words_of

WINDOW = 13
SLICE_BYTES = 32 << 20


def _item_words(batches):
    for batch in batches:
        flat, offsets = utf8(batch.column(1))
        _, _, names, bounds = words_of(flat, offsets)
        words = [names[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], names=["item_id", "words"])


class Lookup:
    """Which of many names are among the wanted ones, and where."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted  # sorted
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[wanted & np.uint64((1 << 18) - 1)] = True

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.maybe[names & np.uint64((1 << 18) - 1)])
        place = np.searchsorted(self.wanted, names[at])
        place[place == len(self.wanted)] = 0
        good = self.wanted[place] == names[at]
        return at[good], place[good]


class Windows:
    """Windows of a slice of items."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.item_ids, words, sizes, owners = [], [], [], []
        for k, (item, packed) in enumerate(items):
            names = np.frombuffer(packed, np.uint64)
            width = min(window, len(names))
            self.item_ids.append(item)
            for start in range(len(names) - width + 1):
                own = np.zeros(window, np.uint64)
                own[:width] = names[start:start + width]
                words.append(own)
                sizes.append(width)
                owners.append(k)
        self.words = np.array(words, np.uint64).reshape(-1, window)
        self.sizes, self.owners = np.array(sizes, np.int64), np.array(owners, np.int64)

    def vocabulary(self) -> np.ndarray:
        used = np.arange(self.words.shape[1]) < self.sizes[:, None]
        return np.unique(self.words[used])

    def choose_prefixes(self, vocabulary: np.ndarray, counts: np.ndarray) -> None:
        """The rarest word of each window, the first of equals."""
        place = np.minimum(np.searchsorted(vocabulary, self.words), max(len(vocabulary) - 1, 0))
        rarity = np.where(np.arange(self.words.shape[1]) < self.sizes[:, None], counts[place], np.iinfo(np.int64).max)
        offset = rarity.argmin(1)
        prefix = self.words[np.arange(len(offset)), offset]
        order = np.argsort(prefix, kind="stable")
        self.words, self.sizes, self.owners = self.words[order], self.sizes[order], self.owners[order]
        self.offsets, prefix = offset[order], prefix[order]
        tokens, self.first, self.count = np.unique(prefix, return_index=True, return_counts=True)
        self.lookup = Lookup(tokens)

    def occurrences(self, names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence of a window within one text."""
        at, token = self.lookup.find(names)
        found = []
        for low in range(0, len(at), 1 << 14):
            own, which = at[low:low + (1 << 14)], token[low:low + (1 << 14)]
            each = self.count[which]
            step = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            window = np.repeat(self.first[which], each) + step
            place = np.repeat(own, each)
            text = np.searchsorted(bounds, place, "right") - 1
            start = place - self.offsets[window]
            fits = (start >= bounds[text]) & (start + self.sizes[window] <= bounds[text + 1])
            start, window = start[fits], window[fits]
            for k in range(self.words.shape[1]):  # all words must agree
                good = (k >= self.sizes[window])
                inside = ~good
                good[inside] = names[start[inside] + k] == self.words[window[inside], k]
                start, window = start[good], window[good]
            found.append((start, window))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(p) for p in zip(*found))


def _count_words(vocabulary: np.ndarray):
    def task(batches):
        lookup, counts = Lookup(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            _, _, names, _ = words_of(*utf8(batch.column(0)))
            counts += np.bincount(lookup.find(names)[1], minlength=len(vocabulary))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary[some].view(np.int64)), pa.array(counts[some])],
                                         names=["word", "n"])
    return task


RANGE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _mark(windows: Windows, at: int, carried: int):
    """Adds the hits of a slice to the columns n_words, hits and items, which follow the carried ones."""
    def task(batches):
        for batch in batches:
            _, _, names, bounds = words_of(*utf8(batch.column(at)))
            start, window = windows.occurrences(names, bounds)
            text = np.searchsorted(bounds, start, "right") - 1
            order = np.argsort(text, kind="stable")
            start, window, text = start[order], window[order], text[order]
            edges = np.searchsorted(text, np.arange(len(bounds)))
            hits, items = batch.column(carried + 1).to_pylist(), batch.column(carried + 2).to_pylist()
            for k in np.unique(text):
                own = slice(edges[k], edges[k + 1])
                low = start[own] - bounds[k]
                high = low + windows.sizes[window[own]]
                before = hits[k]
                low, high = spans_joined(np.concatenate([[h["start"] for h in before], low]).astype(np.int64),
                                         np.concatenate([[h["end"] for h in before], high]).astype(np.int64))
                hits[k] = [{"start": int(a), "end": int(b)} for a, b in zip(low, high)]
                seen = {windows.item_ids[i] for i in np.unique(windows.owners[window[own]])}
                items[k] = sorted(seen.union(items[k]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:carried], pa.array(np.diff(bounds)), pa.array(hits, RANGE),
                 pa.array(items, pa.list_(pa.int64()))],
                names=[*batch.schema.names[:carried], "n_words", "hits", "items"])
    return task


def _slices(items: DataFrame) -> list[tuple[int, bytes]]:
    """Items in slices of bounded size, in order of a running total kept by Spark per chunk of items."""
    parts = items.withColumn("size", F.octet_length("words") * WINDOW + 64)
    total = int(parts.agg(F.sum("size")).first()[0] or 0)
    count = max(1, -(-total // SLICE_BYTES))
    for k in range(count):
        yield [(r[0], bytes(r[1])) for r in
               items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(count)) == k).collect()]


def mark_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with `n_words`, `hits` (maximal ranges of words inside occurrences of windows) and
    `items` (ids of the items with occurring windows). Columns of these names are replaced."""
    docs = docs.drop("n_words", "hits", "items")
    items = cut(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
                .where("item_id is not null and text is not null").distinct()
                .mapInArrow(_item_words, "item_id long, words binary").where(F.octet_length("words") > 0))
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    state = "n_words long, hits array<struct<start:long,end:long>>, items array<long>"
    marked = docs.withColumns({"n_words": F.lit(0).cast("long"),
                               "hits": F.array().cast("array<struct<start:long,end:long>>"),
                               "items": F.array().cast("array<long>")})
    for part in _slices(items):
        windows = Windows(part, window)
        vocabulary = windows.vocabulary()
        counted = (docs.select("text").mapInArrow(_count_words(vocabulary), "word long, n long")
                   .groupBy("word").agg(F.sum("n").alias("n")))
        counts = np.zeros(len(vocabulary), np.int64)
        for word, n in counted.collect() if len(vocabulary) else []:  # one row a word of the slice
            counts[np.searchsorted(vocabulary, np.array([word]).view(np.uint64))[0]] = n
        windows.choose_prefixes(vocabulary, counts) if len(vocabulary) else None
        marked = marked.mapInArrow(
            _mark(windows, docs.columns.index("text"), len(docs.columns)) if len(vocabulary)
            else _no_hits(docs.columns.index("text"), len(docs.columns)), f"{schema}, {state}")
    return marked


def _no_hits(at: int, carried: int):
    def task(batches):
        for batch in batches:
            _, _, _, bounds = words_of(*utf8(batch.column(at)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:carried], pa.array(np.diff(bounds)), *batch.columns[carried + 1:]],
                names=[*batch.schema.names[:carried], "n_words", "hits", "items"])
    return task


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with the counts of `report`; a document is contaminated if a twentieth of its words are hit."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    marked = mark_benchmark(docs, benchmark)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return (marked.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"),
                                "items_sha256": F.sha2(F.array_join(names, ","), 256)})
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
