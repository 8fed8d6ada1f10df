"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from barlake.llm import multi_index

KIND = "vec_id long, embedding array<float>, label int, vector string, ids int, size int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], KIND)


def brute_force(rows, query_ids, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0):
            good.setdefault(i, np.array(v, np.float32).astype(float))
    found = {}
    for q in query_ids:
        near = sorted((float(np.sqrt(((good[i] - good[q]) ** 2).sum())), i) for i in good if i != q)[:k]
        found[q] = near
    return found


def vectors(count, size=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    x = centres[rng.integers(0, 12, count)] + 0.7 * rng.normal(size=(count, size))
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]


def answers(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(found[r.query_id])
    return found


def test_recall_and_exact_scores(spark):
    rows = vectors(3000)
    expected, found = brute_force(rows, range(0, 3000, 100)), answers(multi_index.search(table(spark, rows)))
    assert set(found) == set(expected)
    hits = [len({i for _, i in found[q]} & {i for _, i in expected[q]}) / 10 for q in expected]
    assert np.mean(hits) >= 0.9
    vector = dict(rows)
    for q, near in found.items():
        assert near == sorted(near) and len(near) == 10
        for score, i in near:
            assert score == float(np.sqrt(((np.array(vector[i], np.float32).astype(float)
                                            - np.array(vector[q], np.float32)) ** 2).sum()))


def test_odd_rows_ties_and_copies(spark):
    rows = vectors(60, 8)
    same = rows[3][1]
    rows += [(100 + k, same) for k in range(120)] + [(100, same)]
    rows += [(None, same), (400, None), (401, []), (402, [0.0] * 8), (403, [float("nan")] + [1.0] * 7),
             (404, [float("inf")] + [1.0] * 7), (405, [None] + [1.0] * 7), (500, [1.0] * 9), (600, [-0.0] + [1.0] * 7)]
    valid = [r for r in rows if r[0] not in (500,)]
    assert answers(multi_index.search(table(spark, rows))) == brute_force(valid, [0, 100, 200, 600])


def test_few_rows(spark):
    assert multi_index.search(table(spark, [])).collect() == []
    assert multi_index.search(table(spark, [(100, [0.0, 0.0])])).collect() == []
    rows = [(100, [1.0, 2.0]), (7, [1.0, 2.0]), (5, [3.0, 1.0])]
    assert answers(multi_index.search(table(spark, rows))) == {100: [(0.0, 7), (5 ** 0.5, 5)]}
    assert multi_index.search(table(spark, rows[:1])).collect() == []


def test_queries_in_groups(spark, monkeypatch):
    rows = vectors(700, 8)
    whole = answers(multi_index.search(table(spark, rows)))
    monkeypatch.setattr(multi_index, "QUERY_BYTES", 200)
    assert answers(multi_index.search(table(spark, rows))) == whole


@pytest.mark.parametrize("radius", [0, 1, 3, 5, 8, 11, 17, 24])
def test_every_code_within_the_radius_is_found(radius):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 256, (500, 3)).astype(np.uint8) & rng.integers(0, 256, (500, 3)).astype(np.uint8)
    index = multi_index.Slice(np.zeros((500, 1)), codes)
    for q in range(0, 500, 50):
        distance = np.unpackbits(codes ^ codes[q], axis=1).sum(1)
        assert index.within(codes[q], radius).tolist() == np.flatnonzero(distance <= radius).tolist()


def test_axes_are_a_rotation():
    x = np.random.default_rng(0).normal(size=(400, 16))
    axes = multi_index.learn_codes(x, 10).axes
    assert np.allclose(axes.T @ axes, np.eye(16), atol=1e-8)
