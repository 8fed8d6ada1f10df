"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes: principal axes of a bounded sample, rotated so that signs lose least (iterative
quantisation); the sign of each rotated coordinate is a bit, 64 at most. The radius is the Hamming
distance within which the sample's own nearest neighbours lie, but for a share of MISSED.

Index: every different vector is indexed with its k + 1 smallest ids (more copies can't be among k
nearest). Each slice of the index has one table for each 8-bit substring of the codes. A query
probes each table with all values near its own substring: if two codes differ in at most r bits, by
the pigeonhole principle one of their m substrings differs in at most r // m bits, and for those
after the first r - m * (r // m) + 1 even in one bit less. So every code within the radius is
found; farther ones are dropped and the exact distances of the rest decide. A query with fewer than
k others within the radius is asked again with the radius of all bits, which finds everything.

Queries are sent to the tasks in groups of at most QUERY_BYTES, each a pass over the index.

Rows: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows without id or vectors of another length than most. Equal rows count once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.shared import bytes_of, cut

SAMPLE = 4_096
MISSED = 0.01
BITS = 64
SLICE = 4_096
QUERY_BYTES = 8 << 20
ONES = np.array([bin(v).count("1") for v in range(256)], np.uint8)


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vector, size) of the rows that take part."""
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"),
                           F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
            .where(finite & F.exists("vector", lambda x: x != 0)).withColumn("size", F.size("vector")))


def _folded(k: int):
    """Per task: each different vector with its smallest ids."""
    def task(batches):
        found: dict[bytes, list[int]] = {}
        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                key = (np.asarray(vector.values) + 0.0).astype("<f8").tobytes()  # -0.0 is 0.0
                ids = found.setdefault(key, [])
                ids.append(vec_id)
                if len(ids) > 4 * k:
                    found[key] = sorted(set(ids))[:k]
        keys = list(found)
        for low in range(0, len(keys), 10_000):
            own = keys[low:low + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.binary()), pa.array([sorted(set(found[x]))[:k] for x in own], pa.list_(pa.int64()))],
                names=["vector", "ids"])
    return task


def different_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(vector as packed doubles, its k smallest ids) of each different vector."""
    return (vectors.select("vec_id", "vector").mapInArrow(_folded(k), "vector binary, ids array<long>")
            .groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k)
                                   .alias("ids")))


@dataclass
class Codes:
    mean: np.ndarray
    axes: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes; the bits of the last byte that no axis fills are 0."""
        return np.packbits((x - self.mean) @ self.axes > 0, axis=1)


def learn_codes(x: np.ndarray, k: int, seed: int = 3) -> Codes:
    """Axes by iterative quantisation of the sample `x`, and the radius its own neighbours need."""
    mean = x.mean(0)
    centred, bits = x - mean, min(BITS, x.shape[1])
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:bits].T
    bits = axes.shape[1]
    flat = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(40):
        u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (u @ v).T
    codes = Codes(mean, axes @ turn, bits)
    near, own = [], codes.of(x)
    for low in range(0, len(x), 256):
        square = (x[low:low + 256] ** 2).sum(1)[:, None] - 2 * x[low:low + 256] @ x.T + (x ** 2).sum(1)[None]
        square[np.arange(len(square)), np.arange(low, low + len(square))] = np.inf
        closest = np.argsort(square, 1)[:, :min(k, len(x) - 1)]
        near.append(ONES[own[low:low + 256, None, :] ^ own[closest]].sum(2).ravel())
    near = np.concatenate(near) if near else np.zeros(0)
    if len(x) > 10 * k and len(near):
        codes.radius = int(np.quantile(near, 1 - MISSED, method="higher"))
    return codes


def _probes(radius: int) -> np.ndarray:
    return np.flatnonzero(ONES <= radius) if radius >= 0 else np.zeros(0, np.int64)


class Slice:
    """One slice of the index: a table for each byte of the codes."""

    def __init__(self, x: np.ndarray, codes: np.ndarray):
        self.x, self.codes = x, codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.edges = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes at most `radius` bits from `code`."""
        tables = len(code)
        each, rest = divmod(radius, tables)
        found = np.zeros(len(self.codes), bool)
        for j in range(tables):
            values = _probes(min(each - (j > rest), 8)) ^ int(code[j])
            low, high = self.edges[j][values], self.edges[j][values + 1]
            count = high - low
            where = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            found[self.order[j][where]] = True
        places = np.flatnonzero(found)
        return places[ONES[self.codes[places] ^ code].sum(1) <= radius]


def _nearest(found: list[tuple[float, int]], more: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
    return sorted(found + more)[:k]


HITS = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))


def _search(sent, k: int, radius: int | None):
    """Per task: the k nearest ids of every query vector among the task's slices of the index."""
    def task(batches):
        codes, queries = sent.value
        size = len(codes.mean)
        asked = np.frombuffer(b"".join(queries), "<f8").reshape(-1, size)
        asked_codes = codes.of(asked)
        best = [[] for _ in queries]
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                x = np.frombuffer(b"".join(part.column(0).to_pylist()), "<f8").reshape(-1, size)
                ids = part.column(1).to_pylist()
                index = Slice(x, codes.of(x))
                for q in range(len(queries)):
                    places = index.within(asked_codes[q], codes.radius if radius is None else radius)
                    if not len(places):
                        continue
                    score = np.sqrt(((x[places] - asked[q]) ** 2).sum(1))
                    limit = best[q][-1][0] if len(best[q]) == k else np.inf
                    if len(places) > k:
                        limit = min(limit, np.partition(score, k - 1)[k - 1])
                    more = [(float(s), i) for s, p in zip(score, places) if s <= limit for i in ids[p]]
                    best[q] = _nearest(best[q], more, k)
        rows = [(queries[q], [{"score": s, "vec_id": i} for s, i in found]) for q, found in enumerate(best) if found]
        for low in range(0, len(rows), 10_000):
            own = rows[low:low + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], pa.binary()),
                                              pa.array([r[1] for r in own], HITS)], names=["vector", "found"])
    return task


def _ask(index: DataFrame, asked: DataFrame, codes: Codes, k: int, radius: int | None = None) -> DataFrame:
    """(vector, found) with the k nearest of each of the written `asked` vectors, in passes over the index."""
    spark = index.sparkSession
    groups, answers = max(1, -(-bytes_of(asked) // QUERY_BYTES)), None
    for g in range(groups):
        own = [bytes(r[0]) for r in asked.where(F.pmod(F.xxhash64("vector"), F.lit(groups)) == g).collect()]
        sent = spark.sparkContext.broadcast((codes, own))
        part = index.mapInArrow(_search(sent, k, radius), "vector binary, found array<struct<score:double,vec_id:long>>")
        answers = part if answers is None else answers.unionAll(part)
    salted = answers.groupBy("vector", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt"))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k)
    return cut(salted.agg(best.alias("found")).groupBy("vector").agg(best.alias("found")))


ANSWER = "query_id long, rank int, vec_id long, score double"


def search(table: DataFrame, queries: DataFrame | None = None, k: int = 10) -> DataFrame:
    """The k nearest rows of `table` for each row of `queries` (both vec_id, embedding), but for rows
    of the query's own id. `queries` defaults to the rows whose id is divisible by 100."""
    spark = table.sparkSession
    vectors = valid_vectors(table)
    sizes = vectors.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], ANSWER)
    vectors = vectors.where(F.col("size") == sizes[0][0])
    wanted = vectors.where(F.col("vec_id") % 100 == 0) if queries is None else \
        valid_vectors(queries).where(F.col("size") == sizes[0][0])
    index = cut(different_vectors(vectors, k + 1))
    sample = index.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()
    codes = learn_codes(np.frombuffer(b"".join(bytes(r[0]) for r in sample), "<f8").reshape(len(sample), -1), k)
    wanted = cut(wanted.select(F.col("vec_id").alias("query_id"), "vector").distinct()
                 .mapInArrow(_query_keys, "query_id long, vector binary"))
    asked = cut(wanted.select("vector").distinct())
    found = _ask(index, asked, codes, k + 1)
    few = cut(asked.join(found.where(F.size("found") > k), "vector", "left_anti"))
    if not few.isEmpty():
        found = found.where(F.size("found") > k).unionAll(_ask(index, few, codes, k + 1, codes.bits))
    hits = (wanted.join(found, "vector")
            .withColumn("found", F.expr(f"slice(filter(found, f -> f.vec_id != query_id), 1, {k})")))
    return (hits.select("query_id", F.posexplode("found").alias("place", "hit"))
            .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score"))


def _query_keys(batches):
    for batch in batches:
        packed = [(np.asarray(v.values) + 0.0).astype("<f8").tobytes() for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["query_id", "vector"])
