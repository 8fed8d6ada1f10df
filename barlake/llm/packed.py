"""Packed exchanges over texts, and the removal of byte ranges found by them.

Rows that go through an exchange hold whole arrays: a task sends one row to each partition. Texts
are told apart by (id, key): the smallest id of all rows with that text, and the hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.names import mixed, spans_joined
from barlake.llm.shared import cut, tidy, utf8

#: A null id counts as later than every id.
NO_ID = (1 << 63) - 1
#: Ranges found for texts, packed for the partition that gathers a text's ranges.
FOUND = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary()),
                   ("starts", pa.binary()), ("ends", pa.binary())])
SPANS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])


def planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of whole numbers, byte by byte, so that leading zeros compress."""
    raw = np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8)
    return raw[:, :width].T.tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(width, -1)
    wide = np.zeros((raw.shape[1], 8), np.uint8)
    wide[:, :width] = raw.T
    return wide.reshape(-1).view(np.uint64)


def firsts(values: np.ndarray) -> np.ndarray:
    """Mask of the rows that begin a group of equal neighbours."""
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return fresh


def group_of(fresh: np.ndarray) -> np.ndarray:
    return np.cumsum(fresh) - 1


def record_batches(rows: list[dict], schema: pa.Schema, at_once: int = 20_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), at_once):
        yield pa.RecordBatch.from_pylist(rows[k:k + at_once], schema=schema)


def parts_of(names: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(names) % np.uint64(parts)).astype(np.int64)


def turns(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... anew for each count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def joined_by_text(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(ids, keys) of the texts, how many maximal ranges each has, and those."""
    order = np.lexsort((starts, keys, ids))
    ids, keys = ids[order], keys[order]
    fresh = firsts(ids) | firsts(keys)
    shift = group_of(fresh).astype(np.int64) << 32  # ranges of different texts never touch
    starts, ends = spans_joined(starts[order] + shift, ends[order] + shift)
    low = np.int64((1 << 32) - 1)
    return ids[fresh], keys[fresh], np.bincount(starts >> 32, minlength=int(fresh.sum())), starts & low, ends & low


def found_rows(parts: int, ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray
               ) -> Iterator[pa.RecordBatch]:
    """Ranges of texts, one row for each partition that gathers some."""
    if not len(ids):
        return
    ids, keys, counts, starts, ends = joined_by_text(ids, keys, starts, ends)
    part = parts_of(keys.view(np.uint64), parts)
    span_part = np.repeat(part, counts)
    for p in np.unique(part):
        own, spans = part == p, span_part == p
        yield pa.RecordBatch.from_pylist([{
            "part": int(p), "ids": ids[own].tobytes(), "keys": keys[own].tobytes(), "counts": planes(counts[own], 4),
            "starts": planes(starts[spans], 4), "ends": planes(ends[spans], 4)}], schema=FOUND)


def _gather_spans(batches):
    columns = []
    for batch in batches:
        for row in batch.to_pylist():
            counts = from_planes(row["counts"], 4).astype(np.int64)
            columns.append((np.repeat(np.frombuffer(row["ids"], np.int64), counts),
                            np.repeat(np.frombuffer(row["keys"], np.int64), counts),
                            from_planes(row["starts"], 4).astype(np.int64), from_planes(row["ends"], 4).astype(np.int64)))
    if not columns:
        return
    ids, keys, counts, starts, ends = joined_by_text(*(np.concatenate(x) for x in zip(*columns)))
    edges = np.concatenate([[0], np.cumsum(counts)])
    starts, ends = starts.astype(np.int32), ends.astype(np.int32)
    rows = [{"id": i, "key": k, "starts": starts[a:b].tobytes(), "ends": ends[a:b].tobytes()}
            for i, k, a, b in zip(ids.tolist(), keys.tolist(), edges[:-1], edges[1:])]
    yield from record_batches(rows, SPANS)


def gathered_spans(found: DataFrame, parts: int) -> DataFrame:
    """(id, key, starts, ends) of each text with ranges, as packed 32-bit numbers."""
    return found.repartitionById(parts, F.col("part")).mapInArrow(tidy(_gather_spans), ddl(SPANS))


def ddl(schema: pa.Schema) -> str:
    kinds = {"int32": "int", "int64": "long", "binary": "binary"}
    return ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keyed_texts(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """(id, key, text, rest): `rest` is a struct of the carried columns."""
    rest = F.struct(*carried) if carried else F.lit(None).cast("int")
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text_key().alias("key"),
                       F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest"))


def text_classes(texts: DataFrame) -> DataFrame:
    """(id, key) of each different text of `texts`."""
    classes = texts.groupBy("key", F.sha2("text", 256)).agg(F.min("id").alias("id"))
    return cut(classes.select("id", "key").distinct())


def _cutting(least: int, as_text: bool):
    def task(batches):
        for batch in batches:
            flat, offsets = utf8(batch.column(2))
            *columns, first, starts, ends = batch.columns
            kept, spans = [], []
            for k, (rep, low, high) in enumerate(zip(first.to_pylist(), starts.to_pylist(), ends.to_pylist())):
                own = flat[offsets[k]:offsets[k + 1]]
                if not rep and len(own) >= least:
                    a, b = np.array([0], np.int32), np.array([len(own)], np.int32)
                else:
                    a, b = np.frombuffer(low or b"", np.int32), np.frombuffer(high or b"", np.int32)
                    a, b = a[b - a >= least], b[b - a >= least]
                edges = np.concatenate([[0], np.column_stack([a, b]).ravel(), [len(own)]])
                left = b"".join(own[x:y].tobytes() for x, y in edges.reshape(-1, 2))
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(spans, kind)],
                names=["id", "key", "text", "rest", "kept", "spans"])
    return task


def without_spans(texts: DataFrame, classes: DataFrame, found: DataFrame, least: int, as_text: bool = False
                  ) -> DataFrame:
    """`texts` (id, key, text, rest) with `kept`, the bytes outside the removed ranges, and `spans`,
    those. With `as_text`, `kept` is text, without the characters of which only a part was left.

    `found` has the ranges of the texts of `classes`. The first row of a class loses its ranges of
    at least `least` bytes, every other row all bytes if it has so many. Where `texts` is read and
    shuffled by (id, key) for `found` too, Spark uses that exchange again.
    """
    marks = (classes.join(found, ["id", "key"], "left")
             .select("id", "key", F.lit(True).alias("first"), "starts", "ends"))
    return (texts.join(marks, ["id", "key"], "left")
            .select("id", "key", "text", "rest", F.coalesce("first", F.lit(False)).alias("first"), "starts", "ends")
            .mapInArrow(tidy(_cutting(least, as_text)), f"id long, key long, text string, rest {dict(texts.dtypes)['rest']}, "
                        f"kept {'string' if as_text else 'binary'}, spans array<struct<start:int,end:int>>"))


def removal_report(removed: DataFrame) -> DataFrame:
    """Per document: sizes, removed bytes and ranges, and the digest of what is left."""
    return removed.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
                          F.octet_length("text").cast("long").alias("n_bytes"),
                          (F.octet_length("text") - F.octet_length("kept")).cast("long").alias("n_removed"),
                          F.size("spans").cast("long").alias("n_spans"),
                          F.sha2(F.col("kept"), 256).alias("kept_sha256"))
