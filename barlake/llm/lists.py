"""Inverted lists whose members are compared across components, in rounds.

A list is never turned into all its pairs. Its members are dealt to a task in blocks with their
sizes, parities and components; the task compares what two members must differ in with what they may,
and makes a row only of pairs that can be similar: for each member the one that may be nearest, or,
when no more links come of that, all.

Parities: bit b of a member tells whether an odd number of its shingles falls into bin b, so each bin
of different parity holds a shingle that the two don't share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.shared import tidy, utf8

#: Least number of common shingles for sums of two sizes.
Wanted = Callable[[np.ndarray], np.ndarray]
PAIRS = "a binary, b binary"
#: Members of a list that meet in one block at most.
BLOCK = 2_048
#: Pairs of members whose lengths and parities are compared at a time.
PAIRS_AT_ONCE = 1 << 16


def _close(sizes: np.ndarray, parities: np.ndarray, i: np.ndarray, j: np.ndarray, wanted: Wanted) -> tuple[np.ndarray, ...]:
    """Those pairs of places (i, j), and how much they differ at least, that lengths and parities don't rule out."""
    total = sizes[i] + sizes[j]
    common = wanted(total)
    some = np.minimum(sizes[i], sizes[j]) >= common
    i, j, most = i[some], j[some], (total - 2 * common)[some]
    differ = np.bitwise_count(parities[i] ^ parities[j]).sum(1).astype(np.int64)
    some = differ <= most
    return i[some], j[some], differ[some]


def near_members(roots: np.ndarray, sizes: np.ndarray, parities: np.ndarray, sides: np.ndarray, every: bool,
                 wanted: Wanted) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of a list's members, of different components (and of different blocks if there
    are two), that may link: all of them, or for each member the one of least difference."""
    count, found = len(sizes), []
    two = sides.any() and not sides.all()
    step = max(1, PAIRS_AT_ONCE // count)
    for low in range(0, count - 1, step):
        i, j = np.nonzero(np.arange(low, min(low + step, count))[:, None] < np.arange(count)[None])
        i += low
        other = (roots[i] != roots[j]).any(1)
        if two:
            other &= sides[i] != sides[j]
        found.append(_close(sizes, parities, i[other], j[other], wanted))
    i, j, differ = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    if not every and len(i):
        member, partner = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.lexsort((np.concatenate([differ, differ]), member))
        first = order[np.r_[True, np.diff(member[order]) != 0]]
        i, j = member[first], partner[first]
    return i, j


def _wide(column: pa.Array) -> np.ndarray:
    """Binaries or arrays of one width as rows of 64-bit words."""
    count = len(column)
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(count, -1)
    return np.frombuffer(utf8(column)[0].tobytes(), np.uint64).reshape(count, -1)


def _candidates(every: bool, wanted: Wanted):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(batch: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
            roots, parities = _wide(batch.column("root")), _wide(batch.column("parity"))
            sizes = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            sides = batch.column("side").to_numpy(zero_copy_only=False)
            pairs = []
            for low, high in zip(edges[:-1], edges[1:]):
                if high - low > 1:
                    own = slice(low, high)
                    i, j = near_members(roots[own], sizes[own], parities[own], sides[own], every, wanted)
                    if len(i):
                        pairs.append((i + low, j + low))
            nodes = batch.column("node")
            ends = [pa.array(np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)])) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([nodes.take(e) for e in ends], names=["a", "b"])

        rest = None  # the last list of a batch may go on in the next
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("list", "low", "high")], 1)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True])
            rest = batch.slice(edges[-2])
            if len(edges) > 2:
                yield found(batch.slice(0, edges[-2]), edges[:-1])
        if rest is not None and rest.num_rows:
            yield found(rest, np.array([0, rest.num_rows]))
    return task


def open_pairs(members: DataFrame, roots: DataFrame, every: bool, wanted: Wanted) -> DataFrame:
    """(a, b) of members of different components that share a list and may be similar.

    `members` are (list long, node binary, n, parity), a row for each list of a node; `roots` (node,
    root) of the nodes that are linked. The sizes n count shingles as the parities do.
    """
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = (placed.groupBy("list").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size"))
               .where("least != most").select("list", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    rows = placed.join(several, "list")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "root", "n",
                       "parity", (F.col("own") > F.col("other")).alias("side"))
    keys = ["list", "low", "high"]
    pairs = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(_candidates(every, wanted)), PAIRS)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
