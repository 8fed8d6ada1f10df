"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms of a text are its byte trigrams and its runs of four character classes, both hashed or
numbered to 4,096 each, and the class of its compression ratio. Their counts are damped, weighted
by inverse document frequency over all documents and projected by a truncated singular value decomposition. At most
LABELLED documents of each label, those of smallest id hash, are decomposed on the driver; their
vectors are broadcast. Every document's exact cosine with all of them is computed block by block,
and the labels of the NEIGHBOURS nearest count by similarity. A logistic curve through the votes
that the labelled documents give each other, weighted by how frequent the labels are, turns the
share of the vote into a probability.

Rows: labels without id or quality are ignored; a document labelled both ways counts as 0. A text
without terms has no neighbours and gets the share of label 1 among the labels; if nothing can be
learned, every score is 0.5. Of equal cosines at the last neighbour any may vote, the same for equal
texts; repeated rows get equal scores.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.shared import blocks, held_out, tidy, utf8

LABELLED = 1_500
RANK = 64
NEIGHBOURS = 15
SHARPNESS = 8
THRESHOLD = 0.3
GRAMS = 1 << 12
CLASSES = 8
RATIOS = 32
TERMS = GRAMS + CLASSES ** 4 + RATIOS
#: Labelled documents whose neighbours are looked for at a time.
VOTES_AT_ONCE = 256

KIND = np.full(256, 6, np.uint8)  # other marks
KIND[97:123], KIND[65:91], KIND[48:58], KIND[32], KIND[10], KIND[128:] = 0, 1, 2, 3, 4, 5
KIND[[44, 46, 39, 45, 33, 63]] = 7  # , . ' - ! ?


def term_counts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Matrix of the counts of each text's terms."""
    texts = len(offsets) - 1
    counts = np.zeros((texts, TERMS), np.float32)
    text = np.repeat(np.arange(texts), np.diff(offsets))
    if len(flat) >= 3:
        wide = flat.astype(np.uint32)
        gram = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77)
                + wide[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
        within = text[:-2] == text[2:]
        counts[:, :GRAMS] = np.bincount(text[:-2][within] * GRAMS + gram[within],
                                        minlength=texts * GRAMS).reshape(texts, GRAMS)
    if len(flat) >= 4:
        kind = KIND[flat].astype(np.int64)
        gram = ((kind[:-3] * CLASSES + kind[1:-2]) * CLASSES + kind[2:-1]) * CLASSES + kind[3:]
        within = text[:-3] == text[3:]
        counts[:, GRAMS:-RATIOS] = np.bincount(text[:-3][within] * CLASSES ** 4 + gram[within],
                                               minlength=texts * CLASSES ** 4).reshape(texts, -1)
    for k in range(texts):
        data = flat[offsets[k]:offsets[k + 1]].tobytes()
        if data:
            ratio = len(zlib.compress(data, 1)) / len(data)
            counts[k, TERMS - RATIOS + min(RATIOS - 1, int(ratio * RATIOS))] = 1
    return counts


@dataclass
class Model:
    weights: np.ndarray  # of the terms
    axes: np.ndarray
    vectors: np.ndarray  # of the labelled documents, of length 1
    labels: np.ndarray
    prior: float
    curve: tuple[float, float] = (1.0, 0.0)

    def votes(self, cosine: np.ndarray) -> np.ndarray:
        """Log odds of the neighbours' vote for label 1; NaN without neighbours."""
        k = min(NEIGHBOURS, cosine.shape[1])
        nearest = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, nearest, 1), 0).astype(np.float64) ** SHARPNESS
        total = vote.sum(1)
        share = np.divide((vote * self.labels[nearest]).sum(1), total, out=np.full(len(total), np.nan), where=total > 0)
        share = np.clip(share, 0.01, 0.99)
        return np.log(share / (1 - share))

    def scores(self, counts: np.ndarray) -> np.ndarray:
        odds = self.votes(unit(weighted(counts, self.weights) @ self.axes) @ self.vectors.T)
        score = 1 / (1 + np.exp(-(self.curve[0] * odds + self.curve[1])))
        return np.where(np.isnan(score), self.prior, score)

    def calibrate(self) -> None:
        """Logistic curve through the votes of the labelled documents for each other, by Newton steps."""
        cosine = self.vectors @ self.vectors.T
        np.fill_diagonal(cosine, -1)
        odds = np.concatenate([self.votes(cosine[k:k + VOTES_AT_ONCE]) for k in range(0, len(cosine), VOTES_AT_ONCE)])
        one = self.labels == 1
        usable = ~np.isnan(odds)
        if len(set(self.labels[usable])) < 2:
            return
        x = np.column_stack([odds, np.ones(len(odds))])[usable]
        y = self.labels[usable]
        weight = np.where(y == 1, self.prior / one[usable].mean(), (1 - self.prior) / (1 - one[usable].mean()))
        w = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            gradient = x.T @ (weight * (p - y)) + 1e-2 * w
            w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), gradient)
        if np.isfinite(w).all() and w[0] > 0:
            self.curve = (float(w[0]), float(w[1]))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, weights: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Damped and weighted counts, in `out` if given; each kind of term has length 1."""
    x = np.log1p(counts, out=out)
    x *= weights
    edges = [0, GRAMS, TERMS - RATIOS, TERMS]
    for a, b in zip(edges[:-1], edges[1:]):
        own = x[:, a:b]
        own /= np.maximum(np.sqrt(np.einsum("ij,ij->i", own, own)), 1e-12)[:, None]
    return x


def inverse_frequencies(having: np.ndarray, total: int) -> np.ndarray:
    """Weights of terms that so many of `total` documents have."""
    return (np.log((1 + total) / (1 + having)) + 1).astype(np.float32)


def fit(counts: np.ndarray, labels: np.ndarray, prior: float, weights: np.ndarray, seed: int = 11,
        overwrite: bool = False) -> Model:
    """A model of labelled documents; `overwrite` works in `counts`, so that the driver holds one matrix."""
    x = weighted(counts, weights, out=counts if overwrite else None)
    rank = min(RANK, *x.shape)
    basis = np.random.default_rng(seed).normal(size=(x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(4):  # subspace iteration
        basis = np.linalg.qr(x.T @ np.linalg.qr(x @ basis)[0])[0]
    _, _, axes = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ axes.T)[:, :rank].astype(np.float32)
    model = Model(weights, axes, unit(x @ axes).astype(np.float32), labels.astype(np.float64), prior)
    del x, counts
    model.calibrate()
    return model


def _having(batches):
    """How many texts of the task have each term, and at -1 the number of texts."""
    having, total = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        flat, offsets = utf8(batch.column(0))
        total += batch.num_rows
        for first, last in blocks(offsets, most_rows=128):
            low = offsets[first]
            having += (term_counts(flat[low:offsets[last]], offsets[first:last + 1] - low) > 0).sum(0)
    some = np.flatnonzero(having)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(having[some], total))],
                                     names=["term", "n"])


def term_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies of the terms over all `docs`."""
    found = docs.select("text").mapInArrow(tidy(_having), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    having = np.zeros(TERMS + 1, np.int64)
    for term, n in found.collect():  # TERMS + 1 rows at most
        having[term] = n
    return inverse_frequencies(having[:TERMS], int(having[-1]))


def _packed(batches):
    """Per labelled document the terms it has and their counts, as 32-bit pairs."""
    for batch in batches:
        flat, offsets = utf8(batch.column(2))
        packed = []
        for first, last in blocks(offsets, most_rows=64):
            low = offsets[first]
            for row in term_counts(flat[low:offsets[last]], offsets[first:last + 1] - low):
                some = np.flatnonzero(row)
                packed.append(np.column_stack([some, row[some]]).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                                         names=["doc_id", "label", "packed"])


def _unpacked(packed: list[bytes]) -> np.ndarray:
    """The matrix of counts of what `_packed` gives."""
    counts = np.zeros((len(packed), TERMS), np.float32)
    for k, row in enumerate(packed):
        pairs = np.frombuffer(row, np.uint32).reshape(-1, 2)
        counts[k, pairs[:, 0]] = pairs[:, 1]
    return counts


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """A model of at most `labelled` documents of each label that are not held out."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("label")))
    prior = known.agg(F.avg("label")).first()[0]
    chosen = None
    for label in (0, 1):  # at most `labelled` ids each
        some = (known.where(F.col("label") == label).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
        chosen = some if chosen is None else chosen.unionAll(some)
    rows = (docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
            .mapInArrow(tidy(_packed), "doc_id long, label int, packed binary")
            .groupBy("doc_id").agg(F.min(F.struct("packed", "label")).alias("row")).collect())
    rows = sorted((r[0], bytes(r[1][0]), r[1][1]) for r in rows)
    if not rows:
        return None
    weights = term_weights(docs)
    return fit(_unpacked([r[1] for r in rows]), np.array([r[2] for r in rows]), float(prior), weights, overwrite=True)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with `score` and `predicted`; columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    at, schema = docs.columns.index("text"), ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LABELLED, RANK and TERMS

    def task(batches):
        model = sent.value
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            flat, offsets = utf8(batch.column(at))
            for first, last in blocks(offsets, most_rows=128) if model is not None else ():
                low = offsets[first]
                scores[first:last] = model.scores(term_counts(flat[low:offsets[last]], offsets[first:last + 1] - low))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    return (docs.mapInArrow(tidy(task), f"{schema}, score double")
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", "text")
    return score(texts, learn(texts, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
