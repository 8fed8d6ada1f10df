"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from barlake.llm import divide_skip as join
from barlake.llm import lists

from .samples import ODD_ROWS, prose
from .test_near import near_copy


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    found = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        found.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return sorted(found, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(d, t if len(t or "") < 1000 else t[:50] + " x" * 40) for d, t in ODD_ROWS]
    passages = [prose(4242 + k, 40) for k in range(3)]
    for k in range(40):  # passages that many share, alone and with others
        rows.append((10 * k + 3, " ".join([prose(k, rng.choice([3, 10, 80])), *rng.sample(passages, rng.randint(1, 2))])))
        for c in range(k % 4):
            rows.append((10 * k + rng.choice([0, 1, 2, 4, 5]) + 500 * c, near_copy(rows[-1][1], rng.randint(1, 4), rng)))
    big = prose(77, 150)
    rows += [(3000 + k, near_copy(big, rng.randint(0, 9), rng)) for k in range(120)]  # many near the limit
    for k in range(60):  # short ones, one word apart
        words = [f"w{k % 9}x{i}" for i in range(rng.randint(1, 12))]
        rows.append((4000 + k, " ".join(words)))
    rows += [(2000, big.upper()), (2001, "\x0b".join(big.split())), (2002, big), (2002, big), (2002, prose(1, 30))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [lists.BLOCK, 16])
def test_components_equal_brute_force(make_docs, monkeypatch, block):
    monkeypatch.setattr(lists, "BLOCK", block)
    rows = corpus(block)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join.report(make_docs(rows)).collect()), key=repr)
    assert found == brute_force(rows)


def test_nothing(make_docs):
    assert join.report(make_docs([])).collect() == []
    assert sorted(map(tuple, join.report(make_docs([(4, None), (5, " \t")])).collect())) == [(4, 0, 4), (5, 0, 5)]


@pytest.mark.parametrize("seed", range(30))
def test_search_equals_counting(seed):
    rng = np.random.default_rng(seed)
    query = np.unique(rng.integers(0, 400, rng.integers(1, 120)).astype(np.uint64))
    sets = []
    for _ in range(rng.integers(1, 50)):
        keep = query[rng.random(len(query)) > rng.choice([0.0, 0.05, 0.1, 0.5])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 400, rng.integers(0, 12)).astype(np.uint64)])))
    sets = [s for s in sets if len(s)]
    expected = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(query, s)) >= 80 * len(np.union1d(query, s))]
    assert join.t_occurrence(query, sets) == expected


@pytest.mark.parametrize("seed", range(20))
def test_linked_sets_share_a_short_list(seed):
    """The prefixes without their longest lists still meet, whatever the lengths of the lists."""
    rng = np.random.default_rng(seed)
    for _ in range(200):
        n = int(rng.integers(1, 200))
        a = rng.choice(2**40, n, replace=False).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.random(n) > 0.1], rng.integers(0, 2**40, rng.integers(0, n // 8 + 1)).astype(np.uint64)]))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        if not len(b) or common < join.needed(len(a), len(b)):
            continue
        sizes, kept = {}, []
        for x in (a, b):
            prefix = x[:len(x) - join.least_needed(len(x)) + int(join.spare(len(x)))]
            sizes |= {int(t): sizes.get(int(t), int(rng.integers(2, 9))) for t in prefix}
            left_out = int(join.spare(join.least_needed(len(x)))) - 1
            ordered = sorted(prefix.tolist(), key=lambda t: (sizes[t], t - 2**64 if t >= 2**63 else t))
            kept.append(set(ordered[:len(ordered) - left_out]))
        assert kept[0] & kept[1]
