"""Language identification: averaged hashed subword embeddings with a linear softmax.

Letters are lower-cased (A-Z), all other ASCII bytes become spaces. Each run of 2, 3 and 4 bytes is
hashed to a bucket of its length; a text is the mean of its buckets' embeddings, and a softmax layer
on it gives the languages. Embeddings and layer are trained together by stochastic gradient descent
in numpy on at most SAMPLE labelled documents of each language, those of smallest id hash, so that
rare languages are learned too. On a part of them that is kept back, where each language counts by
its share of the table, a temperature calibrates the probabilities and a limit is set below which a prediction
is marked as not accepted.

For prediction embedding and layer are multiplied once, so a text's logits are means of table rows.

Rows: a text that is null or has no letter is `und` with score 0; so is every text if nothing could
be learned. Rows without lang or id are not learned from. Of rows with one id the first by language
and content is. Repeated rows get equal predictions; of equally probable languages the first by name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.names import BYTE_NAMES, paired
from barlake.llm.shared import blocks, cut, held_out, segment_sums, small_side, utf8

#: Of each language; Spark cuts its windows before the exchange for up to 1,000.
SAMPLE = 500
BUCKETS = 1 << 13
LENGTHS = (2, 3, 4)
WIDTH = 16
EPOCHS = 12
UNKNOWN = "und"

NORMAL = np.full(256, 32, np.uint8)
NORMAL[97:123] = np.arange(97, 123)
NORMAL[65:91] = np.arange(97, 123)
NORMAL[128:] = np.arange(128, 256)


def subwords(flat: np.ndarray, offsets: np.ndarray):
    """(buckets, texts, mask) for each length: the bucket at each place, and which places count."""
    plain = NORMAL[flat]
    one = BYTE_NAMES[plain]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    two = paired(one[:-1], one[1:])
    names = {2: two, 3: paired(two[:-1], one[2:]), 4: paired(two[:-2], two[2:])}
    space = plain == 32
    for k, length in enumerate(LENGTHS):
        size = len(names[length])
        within = (text[:size] == text[length - 1:]) & ~(space[:size] & space[1:size + 1])
        yield (names[length] >> np.uint64(51)).astype(np.int64) + k * BUCKETS, text[:size], within


def counts_of(flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Per text its buckets and their counts, packed as 32-bit pairs."""
    total = len(offsets) - 1
    keys = [np.zeros(0, np.int64)]
    for first, last in blocks(offsets):
        low = offsets[first]
        if offsets[last] - low < max(LENGTHS):
            continue
        for bucket, text, within in subwords(flat[low:offsets[last]], offsets[first:last + 1] - low):
            keys.append(((text[within] + first) * (len(LENGTHS) * BUCKETS)) + bucket[within])
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    text, bucket = np.divmod(found, len(LENGTHS) * BUCKETS)
    edges = np.searchsorted(text, np.arange(total + 1))
    pairs = np.column_stack([bucket, counts]).astype(np.uint32)
    return [pairs[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # logits of each bucket
    bias: np.ndarray
    temperature: float
    limit: float

    def predict(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, probability) of each text."""
        total = len(offsets) - 1
        sums, sizes = np.zeros((total, len(self.languages))), np.zeros(total)
        for first, last in blocks(offsets):
            low = offsets[first]
            if offsets[last] - low < max(LENGTHS):
                continue
            own = offsets[first:last + 1] - low
            for bucket, _, within in subwords(flat[low:offsets[last]], own):
                starts, ends = np.minimum(own[:-1], len(within)), np.minimum(own[1:], len(within))
                sizes[first:last] += segment_sums(within.astype(np.int64), starts, ends)
                for k in range(len(self.languages)):
                    value = self.table[:, k][bucket] * within
                    sums[first:last, k] += segment_sums(value, starts, ends)
        logits = sums / np.maximum(sizes, 1)[:, None] + self.bias
        p = softmax(logits / self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(total), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _dense(rows: list[np.ndarray]) -> np.ndarray:
    x = np.zeros((len(rows), len(LENGTHS) * BUCKETS), np.float32)
    for k, pairs in enumerate(rows):
        x[k, pairs[:, 0]] = pairs[:, 1] / max(int(pairs[:, 1].sum()), 1)
    return x


def train(rows: list[np.ndarray], labels: list[str], counts: dict[str, int] | None = None, seed: int = 7
          ) -> Model | None:
    """Rows are (bucket, count) pairs of a document each; `counts` tells how many the languages have in all."""
    if not rows:
        return None
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    kept_back = order[:len(rows) // 5]
    used = order[len(kept_back):]
    table = random.normal(0, 0.1, (len(LENGTHS) * BUCKETS, WIDTH)).astype(np.float32)
    layer = random.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(EPOCHS):
        rate = 4.0 * (1 - epoch / EPOCHS)
        for low in range(0, len(used), 16):
            own = random.permutation(used)[:16] if low == 0 else used[low:low + 16]
            x = _dense([rows[k] for k in own])
            hidden = x @ table
            error = softmax(hidden @ layer + bias)
            error[np.arange(len(own)), y[own]] -= 1
            error /= len(own)
            step = x.T @ (error @ layer.T)
            layer -= rate * 0.25 * (hidden.T @ error)
            bias -= rate * 0.1 * error.sum(0)
            table -= rate * 25 * step
        used = random.permutation(used)
    check = kept_back if len(kept_back) else used
    logits = np.concatenate([_dense([rows[k] for k in check[a:a + 64]]) @ table @ layer + bias
                             for a in range(0, len(check), 64)]).astype(np.float64)

    drawn = np.bincount(y[check], minlength=len(languages))
    weight = np.array([(counts or {}).get(x, n) / max(n, 1) for x, n in zip(languages, drawn)])[y[check]]

    def loss(t: float) -> float:
        own = -np.log(softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12)
        return float(np.average(own, weights=weight))

    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    p = softmax(logits / temperature)
    sure, right = p.max(1), p.argmax(1) == y[check]
    limits = [t for t in np.linspace(0, 0.99, 100) if (sure >= t).any()
              and np.average(right[sure >= t], weights=weight[sure >= t]) >= 0.99]
    return Model(languages, (table @ layer).astype(np.float32), bias, float(temperature),
                 float(limits[0]) if limits else 1.0)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of at most `sample` documents of each language that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.where(has_letter(F.col("text")))
    ids = cut(known.groupBy("doc_id").agg(F.min("lang").alias("lang")))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = small_side(cut(ids.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= sample)
                            .select("doc_id", "lang")))
    counts = {r[0]: r[1] for r in ids.groupBy("lang").count().collect()}  # one row a language

    def task(batches):
        for batch in batches:
            packed = counts_of(*utf8(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                                             names=["doc_id", "lang", "packed"])

    rows = (known.join(chosen, ["doc_id", "lang"]).select("doc_id", "lang", "text")
            .mapInArrow(task, "doc_id long, lang string, packed binary").where(F.octet_length("packed") > 0)
            .groupBy("doc_id").agg(F.min(F.struct("lang", "packed")).alias("row")).collect())
    rows = sorted((r[0], r[1][0], bytes(r[1][1])) for r in rows)
    return train([np.frombuffer(r[2], np.uint32).reshape(-1, 2) for r in rows], [r[1] for r in rows], counts)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with `lang_pred`, `score` and `accepted`; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "accepted", "__known")
    at, width = docs.columns.index("text"), len(docs.columns)
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def task(batches):
        for batch in batches:
            known = np.array(batch.column(width).to_pylist(), bool)
            if model is None:
                known[:] = False
                best, score = np.zeros(len(known), np.int64), np.zeros(len(known))
                names = np.array([UNKNOWN])
            else:
                best, score = model.predict(*utf8(batch.column(at)))
                names = np.array(model.languages, object)
            languages = [str(names[b]) if k else UNKNOWN for b, k in zip(best, known)]
            score = np.where(known, score, 0.0)
            accepted = known & (score >= (model.limit if model else 1.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(languages), pa.array(score), pa.array(accepted)],
                names=[*batch.schema.names[:width], "lang_pred", "score", "accepted"])

    return docs.withColumn("__known", has_letter(F.col("text"))).mapInArrow(
        task, f"{schema}, lang_pred string, score double, accepted boolean")


def report(docs: DataFrame) -> DataFrame:
    model = learn(docs.select("doc_id", "lang", "text"))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
