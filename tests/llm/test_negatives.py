"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest

from barlake.llm import bond_negatives as bond


def brute_force(rows):
    whole = sorted({(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows
                    if i is not None and y is not None and v is not None and len(v) == 8
                    and all(x is not None and math.isfinite(x) and abs(x) < 2**18 for x in v)})
    found = []
    for a, y, v in whole:
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, z) for i, z, w in whole if i != a)
        positives = [s for s in scored if s[2] == y][:5]
        for minus, p, _ in positives:
            hits = [s for s in scored if s[2] != y and -50 * minus <= -100 * s[0] <= -95 * minus][:3]
            found += [(a, p, k + 1, i, -minus, -s) for k, (s, i, _) in enumerate(hits)]
    return sorted(found)


def some_rows(seed, count=900):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, 8))
    rows = []
    for i in range(count):
        y = int(rng.integers(10)) if i % 3 else 1
        rows.append((i, y, [float(np.float32(x)) for x in centres[y] * 0.3 + rng.normal(size=8) * 0.3]))
    odd = [0.5] * 8
    rows += [(1000, None, odd), (1050, 3, None), (1100, 3, odd[:7] + [None]), (1150, 3, odd[:7] + [float("nan")]),
             (1200, 3, odd[:7] + [float("inf")]), (1250, 3, odd[:5]), (None, 3, odd), (1300, 1, [0.0] * 8), (1350, 1, []),
             (1400, 1, odd), (1400, 1, odd), (1401, 1, odd), (1402, 2, odd), (1403, 2, odd), (-50, 1, odd), (-49, 2, odd),
             (1450, 2, odd), (1450, 1, odd), (1500, 99, odd), (1550, 1, [1e30] + odd[1:])]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame([(i, y, v, 1, "x", 2.0) for i, y, v in rows],
                                              "vec_id long, label int, embedding array<float>, rank int, slice string, score double")


@pytest.mark.parametrize("size", [bond.SLICE, 100])
def test_equal_brute_force(make, monkeypatch, size):
    monkeypatch.setattr(bond, "SLICE", size)
    monkeypatch.setattr(bond, "PACK", 64)
    rows = some_rows(size)
    assert sorted(map(tuple, bond.mine(make(rows)).collect())) == brute_force(rows)


def test_equal_vectors_and_nothing(make):
    assert bond.mine(make([])).collect() == []
    assert bond.mine(make([(50, 1, None)])).collect() == []
    rows = [(i, i % 2, [0.25] * 8) for i in range(300)]
    assert sorted(map(tuple, bond.mine(make(rows)).collect())) == brute_force(rows)


@pytest.mark.parametrize("seed", range(10))
def test_pruned_scan_equals_all_scores(seed):
    rng = np.random.default_rng(seed)
    columns = (rng.normal(size=(33, 500)) * rng.uniform(0, 300, size=(33, 1))).astype(np.int32)
    part = bond.Slice(np.arange(500), rng.integers(0, 3, 500), columns)
    anchor = columns[:, 7].astype(np.int64)
    scores = anchor @ columns.astype(np.int64)
    for label in range(3):
        order = sorted((-int(scores[i]), i) for i in range(500) if part.labels[i] == label and i != 7)[:5]
        assert bond.positives_in(part, 7, label, anchor) == [(i, label, -s) for s, i in order]
        tops = sorted({-s for s, _ in order})
        found = bond.negatives_in(part, 7, label, anchor, tops)
        for top in tops:
            hits = sorted((-int(scores[i]), i) for i in range(500) if part.labels[i] != label and i != 7 and 50 * top <= 100 * scores[i] <= 95 * top)[:3]
            assert [(i, s) for i, _, s in found[top]] == [(i, -s) for s, i in hits]


def test_most_dimensions_are_not_read():
    """Where a few dimensions carry the score, few candidates are left after the first."""
    rng = np.random.default_rng(2)
    scale = np.r_[np.full(8, 200), np.full(56, 4)][:, None]
    columns = (rng.normal(size=(64, 8192)) * scale).astype(np.int32)
    part, left = bond.Slice(np.arange(8192), np.zeros(8192, np.int64), columns), []

    def prune(partial, least, most):
        stay = partial + most >= bond._kth(partial, 5) + least
        left.append(int(stay.sum()))
        return stay
    part.scan(columns[:, 3].astype(np.int64), np.arange(8192), prune)
    assert left[0] < 400 and left[-1] < 50
