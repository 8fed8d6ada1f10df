"""A training corpus from `documents`: five stages, each one of the corpus operators.

Every stage works on all rows the stage before kept, is written as Parquet to the shared folder and
read again. Rows may repeat, hold nulls or be empty; what an operator does with such rows is told
there. Columns other than those of `documents` are left out.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import byte_bpe, decontaminate, neighbour_quality, order_minhash, suffix_dedup
from barlake.llm.packed import NO_ID
from barlake.llm.shared import load, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL can express the classifier, the sketches or the tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    docs = docs.select(*COLUMNS)
    model = neighbour_quality.learn(docs.select("doc_id", "text"), load(spark, sf_dir, "labels"))
    return neighbour_quality.score(docs, model).where(F.col("predicted") == 1).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return order_minhash.one_of_each(docs.select(*COLUMNS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes that earlier documents have too; texts of which nothing is left go.
    Characters cut in two by a removed range are removed whole."""
    docs = docs.select(*COLUMNS, F.col("text").isNull().alias("no_text"))
    left = suffix_dedup.remove_repeats(docs, carried=["lang", "source", "n_chars", "no_text"], as_text=True)
    same = F.size("spans") == 0
    return (left.where(same | F.col("kept").rlike(r"\S"))
            .select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
                    F.when(~F.col("rest.no_text"), F.col("kept")).alias("text"), "rest.lang", "rest.source",
                    F.when(same, F.col("rest.n_chars")).otherwise(F.length("kept")).cast("long").alias("n_chars")))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    marked = decontaminate.contamination(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark"))
    return marked.where(~F.col("contaminated")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number and digest of its tokens, and the digest of the bytes they decode to."""
    return byte_bpe.report(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings),
          ("contamination", contamination), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; returns the rows of the last."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
