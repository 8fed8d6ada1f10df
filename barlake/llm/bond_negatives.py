"""Hard negatives by a vertical scan with branch and bound (BOND).

Components are whole numbers, floor(256 x), and a score is the inner product with the anchor. Vectors
are stored by dimension in slices of about SLICE rows. An anchor reads the dimensions of a slice in
order of its own descending magnitude, STEP at a time, and keeps a partial score for each candidate.
What the remaining dimensions can add lies between two sums over their smallest and largest values
in the slice, so after each step candidates leave the bitmap that can no longer matter.

First scan, positives: rows of the anchor's label; a candidate leaves if it can't reach the POSITIVES
best so far. Second scan, negatives: rows of other labels; a candidate leaves if for every positive it
must miss the window [LOW, HIGH] of the positive's score, or can't reach the best NEGATIVES that are
surely inside. The scores of those left are then whole, and the windows are tested on them. Slices
answer for themselves; their few best are ranked again over all slices.

Work and order: every anchor meets every slice (anchors are a share of the rows, so this grows with
the square; nothing else does). Anchors travel in blocks to each slice, next to it, through an
exchange by slice; neither side passes the driver and no two rows are joined.

Rows: those with null label, null vector, or null or non-finite components take no part, nor do rows
without id, vectors of another length than most, and vectors with a component of 2^18 or more (their
scores would not fit). Equal rows count once; other rows of an anchor's own id are never its partners.
Scores of equal size are ordered by id, then by label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.shared import cut

POSITIVES, NEGATIVES = 5, 3
# Fixed values of the task: 50 * positive <= 100 * negative <= 95 * positive; 256 steps of a unit.
LOW, WHOLE, HIGH = 50, 100, 95
SCALE, LARGEST = 256, float(1 << 18)
#: Rows of a slice, on average; dimensions read between two prunings; anchors and slice rows of a packed row.
SLICE, STEP, PACK = 8_192, 8, 1_024


def whole_vectors(table: DataFrame, relabel: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, as whole numbers; rows whose id `relabel`
    divides get the next of `labels` labels."""
    x = F.col("embedding").cast("array<double>")
    label = F.col("label").cast("long")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("vector"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(
        F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)))
    label = F.when(F.pmod("vec_id", F.lit(relabel)) == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"),
                       F.transform("vector", lambda v: F.floor(v * SCALE).cast("int")).alias("vector")).distinct()


PACKED = "slice int, ids binary, labels binary, vectors binary, windows binary"
_PACKED = pa.schema([("slice", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("windows", pa.binary())])


def _matrix(column: pa.Array, size: int, kind=np.int32) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, size)


def _packing(size: int):
    """Rows sorted by slice, packed; vectors by dimension, so that one is read without the others."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slices = batch.column(0).to_numpy(zero_copy_only=False)
            ids, labels = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            vectors = _matrix(batch.column(3), size)
            windows = _matrix(batch.column(4), POSITIVES, np.int64) if batch.num_columns > 4 else None
            edges = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1], True])
            for low, high in zip(edges[:-1], edges[1:]):
                for at in range(low, high, PACK):
                    to = min(at + PACK, high)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([slices[at]], pa.int32()), pa.array([ids[at:to].tobytes()], pa.binary()),
                         pa.array([labels[at:to].tobytes()], pa.binary()),
                         pa.array([np.ascontiguousarray(vectors[at:to].T).tobytes()], pa.binary()),
                         pa.array([None if windows is None else windows[at:to].tobytes()], pa.binary())], schema=_PACKED)
    return task


def _packed(rows: DataFrame, size: int) -> DataFrame:
    return (rows.repartition("slice").sortWithinPartitions("slice", "vec_id").mapInArrow(_packing(size), PACKED))


class Slice:
    """Vectors by dimension, with the smallest and largest value of each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, columns
        self.low, self.high = columns.min(1).astype(np.int64), columns.max(1).astype(np.int64)

    def scan(self, anchor: np.ndarray, chosen: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the candidates `chosen` that stay. `prune(partial, least, most)` tells
        which stay if the rest adds between `least` and `most`."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = anchor * self.low, anchor * self.high
        least, most = np.minimum(*ends)[order], np.maximum(*ends)[order]
        rest_least, rest_most = least[::-1].cumsum()[::-1], most[::-1].cumsum()[::-1]
        partial = np.zeros(len(chosen), np.int64)
        for at in range(0, len(order), STEP):
            if not len(chosen):
                break
            dims = order[at:at + STEP]
            if len(chosen) == self.columns.shape[1]:
                part = self.columns[dims]
            else:
                part = self.columns[dims[:, None], chosen]
            partial = partial + (anchor[dims, None] * part).sum(0)
            if at + STEP < len(order):
                stay = prune(partial, rest_least[at + STEP], rest_most[at + STEP])
                chosen, partial = chosen[stay], partial[stay]
        return chosen, partial


def _kth(values: np.ndarray, k: int) -> int | None:
    """The k-th largest value; None if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def _best(ids: np.ndarray, labels: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first: largest score, then smallest id and label."""
    limit = _kth(scores, k)
    some = np.arange(len(scores)) if limit is None else np.flatnonzero(scores >= limit)
    return some[np.lexsort((labels[some], ids[some], -scores[some]))[:k]]


def positives_in(part: Slice, vec_id: int, label: int, anchor: np.ndarray) -> list[tuple[int, int, int]]:
    """(id, label, score) of the best rows of the anchor's label in the slice."""
    def prune(partial, least, most):
        kth = _kth(partial, POSITIVES)
        return slice(None) if kth is None else partial + most >= kth + least

    chosen, scores = part.scan(anchor, np.flatnonzero((part.labels == label) & (part.ids != vec_id)), prune)
    best = _best(part.ids[chosen], part.labels[chosen], scores, POSITIVES)
    return [(int(part.ids[chosen[k]]), label, int(scores[k])) for k in best]


def negatives_in(part: Slice, vec_id: int, label: int, anchor: np.ndarray, windows: list[int]) -> dict[int, list[tuple[int, int, int]]]:
    """Per positive score the best (id, label, score) of other labels in the slice and its window."""
    # smallest and largest whole score of each window; none if the score is negative
    bounds = [(-(-LOW * w // WHOLE), HIGH * w // WHOLE) for w in windows]

    def prune(partial, least, most):
        stay = np.zeros(len(partial), bool)
        for low, high in bounds:
            may = (partial + most >= low) & (partial + least <= high)
            sure = partial[(partial + least >= low) & (partial + most <= high)]
            kth = _kth(sure, NEGATIVES)
            stay |= may if kth is None else may & (partial + most >= kth + least)
        return stay

    chosen, scores = part.scan(anchor, np.flatnonzero((part.labels != label) & (part.ids != vec_id)), prune)
    found = {}
    for window, (low, high) in zip(windows, bounds):
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        own, score = chosen[inside], scores[inside]
        best = _best(part.ids[own], part.labels[own], score, NEGATIVES)
        found[window] = [(int(part.ids[own[k]]), int(part.labels[own[k]]), int(score[k])) for k in best]
    return found


FOUND = "anchor_id long, anchor_label long, positive_score long, vec_id long, label long, score long"
_FOUND = pa.schema([(part.split()[0], pa.int64()) for part in FOUND.split(", ")])
#: Stands for a positive that is not there.
NONE = -(1 << 62)


def _scan(size: int, negatives: bool):
    """Slices and the anchors sent to them, sorted by slice with the slice first."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, part = None, [], None
        for batch in batches:
            for k in range(batch.num_rows):
                at, is_anchor = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                ids, labels = (np.frombuffer(batch.column(c)[k].as_py(), np.int64) for c in (2, 3))
                columns = np.frombuffer(batch.column(4)[k].as_py(), np.int32).reshape(size, -1)
                if at != own:
                    own, parts, part = at, [], None
                if not is_anchor:
                    parts.append((ids, labels, columns))
                    continue
                if not parts and part is None:
                    continue
                if part is None:
                    part, parts = Slice(*(np.concatenate(x, -1) for x in zip(*parts))), []
                windows = np.frombuffer(batch.column(5)[k].as_py(), np.int64).reshape(-1, POSITIVES) if negatives else None
                rows = []
                for q in range(len(ids)):
                    name, label, anchor = int(ids[q]), int(labels[q]), columns[:, q].astype(np.int64)
                    if negatives:
                        scores = sorted({int(w) for w in windows[q] if w != NONE})
                        for window, found in negatives_in(part, name, label, anchor, scores).items():
                            rows += [(name, label, window, *x) for x in found]
                    else:
                        rows += [(name, label, None, *x) for x in positives_in(part, name, label, anchor)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND)
    return task


def _meet(slices: DataFrame, anchors: DataFrame, count: int, size: int, negatives: bool) -> DataFrame:
    """What the slices answer to the packed anchors, each of which goes to every slice."""
    sent = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    both = slices.withColumn("is_anchor", F.lit(False)).unionByName(sent.withColumn("is_anchor", F.lit(True)))
    return (both.select("slice", "is_anchor", "ids", "labels", "vectors", "windows").repartition("slice")
            .sortWithinPartitions("slice", "is_anchor").mapInArrow(_scan(size, negatives), FOUND))


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "label")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(table: DataFrame, anchors_of: int = 50) -> DataFrame:
    """Hard negatives of the rows whose id `anchors_of` divides: (anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score)."""
    spark = table.sparkSession
    rows = whole_vectors(table)
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes or not sizes[0][0]:
        return spark.createDataFrame([], MINED)
    size, count = sizes[0][0], max(1, -(-sizes[0][1] // SLICE))
    rows = rows.where(F.size("vector") == size)
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias("slice")
    slices = cut(_packed(rows.select(dealt, "vec_id", "label", "vector"), size))
    asked = rows.where(F.pmod("vec_id", F.lit(anchors_of)) == 0)
    blocks = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(max(1, count // 8))).cast("int").alias("slice")
    packed = _packed(asked.select(blocks, "vec_id", "label", "vector"), size).drop("slice")
    own = ["anchor_id", "anchor_label"]
    positives = cut(_first(_meet(slices, packed, count, size, False), own, POSITIVES)
                    .select(*own, F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = positives.groupBy(*own).agg(F.collect_list("positive_score").alias("scores")).select(
        F.col("anchor_id").alias("vec_id"), F.col("anchor_label").alias("label"),
        F.slice(F.concat("scores", F.array_repeat(F.lit(NONE), POSITIVES)), 1, POSITIVES).alias("scores"))
    again = _packed(asked.join(scores, ["vec_id", "label"]).select(blocks, "vec_id", "label", "vector", "scores"), size).drop("slice")
    negatives = _first(_meet(slices, again, count, size, True), [*own, "positive_score"], NEGATIVES)
    return positives.join(negatives, [*own, "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
