"""Token counts of whole texts by a tokenizer file of the tokenizers library.

A huge text is never encoded in one go. It is encoded in overlapping chunks with offsets, and two
chunks are spliced where both begin a word at the same place of the overlap:

* the left chunk is right up to there: it began at a proven boundary, and the place lies so far
  before its end (and before its last word) that cutting it off there changed no earlier word;
* the right chunk is right from there on: the cutting into words only looks ahead, so what follows
  a word boundary depends on the text after it alone.

If the overlap has no such place, it is widened up to the last splice; if there is none even then,
the chunk is made larger. Other texts are cut into words and each word is counted once in a task.

Rows: null and empty texts have no tokens. The tokenizer's special strings inside a text count as
its library does by default.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.pieces import PLAIN, Memory
from barlake.llm.shared import small_batches

LIMIT = 512
#: Texts of more characters are encoded in chunks of CHUNK characters that overlap by OVERLAP.
HUGE = 1 << 16
CHUNK = 1 << 14
OVERLAP = 128


class Counter:
    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What a cut-off end can change: a special string, a contraction and the word before it.
        self.margin = max([4, *map(len, self.special)]) + 4
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.memory = Memory(self._whole)
        self.widened = 0

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str | None]) -> list[int]:
        found = [0] * len(texts)
        plain, other = [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            if len(text) > self.huge:
                found[k] = self.spliced(text)
            elif PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                plain.append(k)
            else:
                other.append(k)
        for k, values in zip(plain, self.memory.values(texts[k] for k in plain)):
            found[k] = sum(values)
        for k in other:
            found[k], = self._whole([texts[k]])
        return found

    def _chunk(self, text: str, start: int, end: int):
        """Starts of the tokens of text[start:end], and which of them begin a word."""
        encoding = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        starts = np.array([o[0] for o in encoding.offsets], np.int64) + start
        words = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
        begins = np.ones(len(words), bool)
        begins[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
        return starts, begins

    def _splice(self, left, right, end: int) -> int | None:
        """Last place where a word begins in both chunks and the left chunk is proven right."""
        words = left[0][left[1]]
        safe = words[:-1][words[:-1] <= end - self.margin]
        common = np.intersect1d(safe, right[0][right[1]][1:])
        return int(common[-1]) if len(common) else None

    def spliced(self, text: str) -> int:
        total, proven, end = 0, 0, min(self.chunk, len(text))
        left = self._chunk(text, 0, end)
        while end < len(text):
            overlap, size = max(self.overlap, 2 * self.margin), self.chunk
            while True:
                start = max(proven, end - overlap)
                next_end = min(start + size + overlap, len(text))
                right = self._chunk(text, start, next_end)
                if start == proven:  # begins at the last splice itself, and is longer than the left chunk
                    place = proven
                    break
                place = self._splice(left, right, end)
                if place is not None:
                    break
                self.widened += 1
                overlap *= 4
            total += int(((left[0] >= proven) & (left[0] < place)).sum())
            left, proven, end = right, place, next_end
        return total + int((left[0] >= proven).sum())


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """`docs` with `n_tokens` and `over_limit`; columns of these names are replaced."""
    docs = docs.drop("n_tokens", "over_limit")
    at, schema = docs.columns.index("text"), ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def task(batches):
        for batch in small_batches(batches, at):
            counts = counter(path).counts(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())],
                                             names=[*batch.schema.names, "n_tokens"])
        counter(path).memory.forget()

    return docs.mapInArrow(task, f"{schema}, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def report(docs: DataFrame, path: str) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text"), path).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", "over_limit")
