"""Learned operators: held-out accuracy, and the rows that can't be learned from or scored."""

import random
import tracemalloc

import numpy as np
import pytest

from barlake.llm import language_id, neighbour_quality

from .samples import ODD_ROWS, SYLLABLES, held_out, prose

LANGUAGES = {"xa": SYLLABLES[:14], "xb": SYLLABLES[10:24], "xc": SYLLABLES[22:]}


def language_rows(count=300):
    rng, rows = random.Random(2), []
    for k in range(count):
        lang = rng.choice(list(LANGUAGES))
        words = ["".join(rng.choices(LANGUAGES[lang], k=rng.randint(2, 4))) for _ in range(rng.randint(4, 60))]
        rows.append((k, " ".join(words), lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows],
                                 "doc_id long, text string, lang string, n int, lang_pred string, score double")


def test_language(spark):
    rows = language_rows()
    odd = [(d, t, lang) for (d, t), lang in zip(ODD_ROWS, ["xa", None] * len(ODD_ROWS))]
    found = language_id.report(frame(spark, rows + odd)).collect()
    assert len(found) == len(rows) + len(odd)
    truth, marks = {r[0]: r[2] for r in rows}, {r.doc_id: r for r in found}
    apart = [marks[d].lang_pred == truth[d] for d in truth if held_out(d)]
    assert len(apart) > 30 and np.mean(apart) > 0.95
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in found)
    assert all(r.lang_pred in LANGUAGES for r in found if r.doc_id in truth)
    for odd_id in (900, 901, 902, 904):
        assert (marks[odd_id].lang_pred, marks[odd_id].score, marks[odd_id].accepted) == ("und", 0.0, False)
    for odd_id in (903, 905, 906):
        assert marks[odd_id].lang_pred in LANGUAGES


def test_language_reads_only_text_and_what_may_be_learned(spark):
    """Another lang of held-out rows, other ids and sources change no prediction."""
    rows = language_rows(200)
    changed = [(d, t, "zz" if held_out(d) else lang) for d, t, lang in rows]
    first = {r.doc_id: (r.lang_pred, r.score) for r in language_id.report(frame(spark, rows)).collect()}
    assert first == {r.doc_id: (r.lang_pred, r.score) for r in language_id.report(frame(spark, changed)).collect()}


def test_rare_language_is_learned(spark):
    """Thirty documents among thousands of others, and few of them are drawn."""
    rng, rare = random.Random(8), ["zu", "zo", "zi", "xu", "xi", "wo"]
    rows = [(k, prose(k, 12), "xa") for k in range(3000)]
    rows += [(9000 + k, " ".join("".join(rng.choices(rare, k=3)) for _ in range(12)), "xr") for k in range(30)]
    docs = frame(spark, rows)
    model = language_id.learn(docs.select("doc_id", "lang", "text"), sample=60)
    assert model.languages == ["xa", "xr"]
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs.select("doc_id", "text"), model).collect()}
    assert all(found[d] == lang for d, _, lang in rows if held_out(d))


def test_language_without_anything_to_learn(spark):
    found = language_id.report(frame(spark, [(1, "some text", None), (2, None, "xa")])).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
    assert language_id.report(frame(spark, [])).collect() == []


def quality_rows(count=300):
    rng, docs, labels = random.Random(4), [], []
    for k in range(count):
        good = rng.random() < 0.7
        text = prose(k, rng.randint(30, 80))
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " | ".join(text.split()), (text[:9] + " ") * 40])
        docs.append((k, text))
        labels.append((k, int(good), None))
    return docs, labels


def test_quality(spark, make_docs):
    docs, labels = quality_rows()
    labels += [(None, 1, 0), (5, None, 1), (5000, 1, 0), (7, labels[7][1], 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = neighbour_quality.report(make_docs(docs + ODD_ROWS), marks).collect()
    assert len(found) == len(docs) + len(ODD_ROWS)
    truth, by_id = {d: q for d, q, _ in labels[:300]}, {r.doc_id: r for r in found}
    apart = [by_id[d].predicted == q for d, q in truth.items() if held_out(d)]
    assert len(apart) > 30 and np.mean(apart) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert by_id[900].score == by_id[901].score == pytest.approx(np.mean(
        [q for d, q in truth.items() if not held_out(d)] + [1]), abs=0.02)


def test_quality_of_held_out_labels_is_not_read(spark, make_docs):
    docs, labels = quality_rows(150)
    changed = [(d, 1 - q if held_out(d) else q, t) for d, q, t in labels]
    first, second = (
        {r.doc_id: r.score for r in neighbour_quality.report(
            make_docs(docs), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()}
        for x in (labels, changed))
    assert first == second


def test_quality_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in neighbour_quality.report(make_docs(ODD_ROWS), none).collect()} == {0.5}
    assert neighbour_quality.report(make_docs([]), none).collect() == []


def test_term_weights_count_all_documents(make_docs):
    rows = [(k, prose(k, 20) if k % 3 else None) for k in range(50)] + ODD_ROWS
    texts = [(t or "").encode() for _, t in rows]
    having = sum((neighbour_quality.term_counts(np.frombuffer(t, np.uint8), np.array([0, len(t)])) > 0)[0].astype(int)
                 for t in texts)
    found = neighbour_quality.term_weights(make_docs(rows).repartition(5))
    assert np.allclose(found, np.log((1 + len(texts)) / (1 + having)) + 1, atol=1e-6)


def test_latent_cosines_are_exact():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.02, (60, neighbour_quality.TERMS)).astype(np.float32)
    weights = neighbour_quality.inverse_frequencies((counts > 0).sum(0), len(counts))
    model = neighbour_quality.fit(counts, np.arange(60) % 2, 0.5, weights)
    vectors = neighbour_quality.unit(neighbour_quality.weighted(counts, model.weights) @ model.axes)
    assert np.allclose(vectors, model.vectors, atol=1e-4)
    odds = model.votes(vectors @ model.vectors.T)
    for k in range(60):
        cosine = vectors[k] @ model.vectors.T
        near = np.argsort(-cosine)[:neighbour_quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0).astype(float) ** neighbour_quality.SHARPNESS
        share = np.clip((weight * model.labels[near]).sum() / weight.sum(), 0.01, 0.99)
        assert odds[k] == pytest.approx(np.log(share / (1 - share)), rel=1e-4, abs=1e-6)


def test_fit_holds_the_counts_once():
    """The driver's peak beyond the counts is less than they take: no second matrix, votes a few rows at a time."""
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.2, (1500, neighbour_quality.TERMS)).astype(np.float32)
    counts[:750, :40] += 2
    size = counts.nbytes
    tracemalloc.start()
    try:
        model = neighbour_quality.fit(counts, np.arange(1500) < 750, 0.5, np.ones(neighbour_quality.TERMS, np.float32), overwrite=True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 0.8 * size and model.curve[0] > 0
