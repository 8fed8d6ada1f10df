"""Benchmark windows against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from barlake.llm import decontaminate
from barlake.llm.shared import utf8
from barlake.llm.words import words_of
from .samples import ODD_ROWS, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_force(docs, items):
    windows = set()
    for item, text in items:
        w = words(text)
        if item is not None and w:
            size = min(13, len(w))
            windows |= {(item, tuple(w[i:i + size])) for i in range(len(w) - size + 1)}
    result = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i:i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
        ids = ",".join(sorted(map(str, found)))
        result.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
                       bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(result, key=repr)


ITEMS = [(k, prose(500 + k, 5 + 3 * k)) for k in range(12)] + [
    (30, "single"), (31, "two words"), (32, None), (33, ""), (34, "!?"), (None, "la le"), (35, prose(505, 20)),
    (2, prose(502, 11)), (36, "ÄÖ é 日本 42 x")]


def documents():
    rng, rows = random.Random(3), list(ODD_ROWS)
    for k in range(40):
        text = prose(k, rng.randint(1, 80)).split()
        item = (ITEMS[rng.randrange(len(ITEMS))][1] or "").upper().split()
        cut = rng.randint(0, 3)
        text[rng.randint(0, len(text)):0] = item[cut:]
        rows.append((k, rng.choice([" ", ", ", "\n", "--"]).join(text)))
    rows += [(70, "single two words single"), (70, "single"), (71, ITEMS[5][1] + " " + ITEMS[6][1]),
             (72, "äö É 日本 42 X! äö é 日本 42 x")]
    return rows


@pytest.mark.parametrize("slice_bytes", [1 << 25, 3000])
def test_equals_brute_force(spark, make_docs, monkeypatch, slice_bytes):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", slice_bytes)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = documents()
    found = decontaminate.report(make_docs(rows), benchmark)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_force(rows, ITEMS)


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(make_docs([]), none).collect() == []
    found = decontaminate.report(make_docs([(1, "a b"), (2, None)]), none).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in found) == [(1, 2, 0, False), (2, 0, 0, False)]


def test_marks_keep_other_columns(spark, make_docs):
    benchmark = spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")
    docs = make_docs([(5, "intro " + prose(1, 20) + " end")]).drop("score")
    row = decontaminate.mark_benchmark(docs, benchmark).first()
    assert row.size == 5 and [tuple(h) for h in row.hits] == [(1, 21)] and row["items"] == [1]


def test_words_made_to_clash_differ():
    """A Thue-Morse word and its complement have the same sum of any powers modulo 2^64."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(4_096))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = pa.array([word, other, word.upper()])
    names = words_of(*utf8(texts))[2]
    assert names[0] != names[1] and names[0] == names[2]
