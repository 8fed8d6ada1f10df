"""Byte-level BPE: texts to ids by a file of ranks, and ids back to bytes.

The tokenizers library encodes Arrow batches. Its model works on characters, so each of the 256
bytes is shown as one printable character; every way to split a token into two others is a merge of
that token's rank, which is the rule of the ranks file. Byte offsets of the tokens follow from their
lengths. Decoding looks the ids up in the table of bytes; a character split over tokens comes out
whole once all its bytes are there, and a broken one becomes U+FFFD in `text`.

Rows: null and empty texts have no ids. Special strings are ordinary text.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.pieces import PATTERN, PLAIN, Memory
from barlake.llm.shared import small_batches, tidy


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if it has one, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(other)) for b in range(256)]


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Decoder:
    """The table of bytes alone, so that tasks which only decode don't hold a tokenizer."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


class Coder(Decoder):
    def __init__(self, path: str, pattern: str = PATTERN):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = ranks_of(path)
        super().__init__(ranks)
        shown = byte_characters()
        name = {token: "".join(shown[b] for b in token) for token in ranks}
        merges = [(name[token[:k]], name[token[k:]]) for token in sorted(ranks, key=ranks.get)
                  for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.sizes = np.array([len(t) for t in self.table], np.int64)
        self.memory = Memory(self._whole, pattern)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found = [b""] * len(texts)
        plain = [k for k, t in enumerate(texts) if t and PLAIN.fullmatch(t)]
        known = set(plain)
        other = [k for k, t in enumerate(texts) if t and k not in known]
        for k, values in zip(plain, self.memory.values(texts[k] for k in plain)):
            found[k] = b"".join(values)
        for k in other:
            found[k], = self._whole([texts[k]])
        return found

    def ends(self, ids: bytes) -> np.ndarray:
        """Byte offset in the text at which each token ends."""
        return np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])


@cache
def coder(path: str) -> Coder:
    return Coder(path)


@cache
def decoder(path: str) -> Decoder:
    return Decoder(ranks_of(path))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def _encoder(path: str, at: int, offsets: bool = False):
    def task(batches):
        for batch in small_batches(batches, at):
            ids = coder(path).encode(batch.column(at).to_pylist())
            columns, names = [*batch.columns, pa.array(ids, pa.binary())], [*batch.schema.names, "ids"]
            if offsets:
                columns.append(pa.array([coder(path).ends(x) for x in ids], pa.list_(pa.int64())))
                names.append("ends")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        coder(path).memory.forget()
    return task


def _decoder(path: str, at: int, name: str, as_text: bool = False, table=decoder):
    def task(batches):
        for batch in small_batches(batches, at):
            found = [table(path).decode(x) for x in batch.column(at).to_pylist()]
            column = pa.array([x.decode("utf-8", "replace") for x in found]) if as_text else pa.array(found, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])
    return task


def encode(docs: DataFrame, path: str, offsets: bool = False) -> DataFrame:
    """`docs` with `ids` (packed little-endian 32-bit ids) and, if wanted, `ends` (byte offsets at
    which the tokens end). Columns of these names are replaced."""
    docs = docs.drop("ids", "ends")
    task = _encoder(path, docs.columns.index("text"), offsets)
    return docs.mapInArrow(tidy(task), f"{_ddl(docs)}, ids binary" + ", ends array<long>" * offsets)


def decode(encoded: DataFrame, path: str, as_text: bool = False) -> DataFrame:
    """`encoded` with `decoded`, the bytes of its `ids`, or with `text` if `as_text`."""
    name, kind = ("text", "string") if as_text else ("decoded", "binary")
    encoded = encoded.drop(name)
    task = _decoder(path, encoded.columns.index("ids"), name, as_text)
    return encoded.mapInArrow(tidy(task), f"{_ddl(encoded)}, {name} {kind}")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with `ids` and `decoded` in place of `text`: encoded and decoded in one worker with one
    table, where `decode` after `encode` holds a second worker and sends the ids through Spark."""
    docs = docs.drop("ids", "decoded")
    rest = [c for c in docs.columns if c != "text"]
    encoder, decoding = _encoder(path, docs.columns.index("text")), _decoder(path, len(rest), "decoded", table=coder)

    def task(batches):
        yield from decoding(batch.select([*rest, "ids"]) for batch in encoder(batches))

    kinds = _ddl(docs.select(*rest))
    return docs.mapInArrow(tidy(task), f"{kinds}{', ' if kinds else ''}ids binary, decoded binary")


def report(docs: DataFrame, path: str) -> DataFrame:
    return round_trip(docs.select("doc_id", "text"), path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
