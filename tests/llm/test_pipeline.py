"""The corpus pipeline stage by stage on small tables with planted cases."""

import hashlib
import random

import pytest

import corpus_pipeline as pipeline
from barlake.llm import byte_bpe

from .samples import prose
from .test_contamination import brute_force as contamination
from .test_near import brute_force as near_groups
from .test_near import near_copy
from .test_removal import brute_force as removal

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, items string, root string"


def rows():
    rng, found = random.Random(6), []
    for k in range(60):
        found.append((k, prose(k, 70)))
    for k in range(60, 80):
        found.append((k, prose(k, 60).upper().replace(" ", "!! ")))  # junk
    found += [(100 + k, found[k][1]) for k in range(5)]  # copies
    found += [(110 + k, near_copy(found[10 + k][1], 2, rng)) for k in range(5)]
    for k in range(5):  # a passage of 55 words that repeats
        words = prose(300 + k, 60).split()
        found.append((120 + k, " ".join(words[:30] + found[20 + k][1].split()[5:60] + words[30:])))
    for k in range(4):  # benchmark passages
        found.append((130 + k, prose(400 + k, 30) + " " + prose(900 + k, 25) + " " + prose(410 + k, 30)))
    return found + [(140, None), (141, ""), (142, " \n "), (None, prose(77, 50)), (143, prose(78, 50)), (143, prose(78, 50))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = [(d, t, "xx", None, len(t or ""), 1.0, "i", "r") for d, t in rows()]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k < 60), None) for k in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(k, prose(900 + k, 25)) for k in range(4)] + [(9, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), SCHEMA.split(", score")[0])
        assert docs.columns == pipeline.COLUMNS
        kept[name] = pairs(docs)
    good = kept["quality"]
    junk = {d for d, _ in good if d is not None and 60 <= d < 80}
    assert len(junk) <= 1 and len([d for d, _ in good if d is not None and d < 60]) >= 59

    groups = {}
    for d, g in near_groups(good):
        groups.setdefault(g, []).append(d)
    expected = {g for g in groups if g is not None} | {None}
    found = kept["near_duplicates"]
    assert {d for d, _ in found} == expected and len(found) == len(set(found))
    assert set(found) <= set(good)
    assert not any(d is not None and 100 <= d < 105 for d, _ in found)

    digests = {(d, n): sha for d, n, _, _, sha in removal(found)}
    assert {d for d, _ in kept["repeated_strings"]} == {
        d for d, t in found if digests[d, len((t or "").encode())] != hashlib.sha256(b"").hexdigest() or not t}
    for d, t in kept["repeated_strings"]:
        before = len((dict(found)[d] or "").encode())
        assert hashlib.sha256((t or "").encode()).hexdigest() == digests[d, before]  # ASCII: no character is cut
    assert all(len(t) < 900 for d, t in kept["repeated_strings"] if d is not None and 120 <= d < 125)

    items = [(k, prose(900 + k, 25)) for k in range(4)]
    clean = {d for d, *_, bad in contamination(kept["repeated_strings"], items) if not bad}
    assert {d for d, _ in kept["contamination"]} == clean and not clean & set(range(130, 134))


def test_run(spark, tables):
    found = pipeline.run(spark, tables)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    by_id = {r.doc_id: r for r in found.collect()}
    text = dict(rows())[30]
    path = pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids, = byte_bpe.coder(path).encode([text])
    assert by_id[30].n_tokens == len(ids) // 4 and by_id[30].ids_sha256 == hashlib.sha256(ids).hexdigest()
    assert by_id[30].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
