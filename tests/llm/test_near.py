"""Near-duplicates against all pairs."""

import os
import random

import numpy as np
import pytest

from barlake.llm import order_minhash as near
from barlake.sources import scratch

from .samples import ODD_ROWS, prose
from .test_contamination import words


def shingles(text):
    w = words(text)
    return [hash(tuple(w[i:i + 5])) for i in range(max(1, len(w) - 4))] if w else []


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def brute_force(rows):
    """Smallest id of each document's group."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    all_shingles = [shingles(t) for _, t in rows]
    for i, a in enumerate(all_shingles):
        for j, b in enumerate(all_shingles[:i]):
            if a and b and len(set(a) & set(b)) and (n := common(a, b)) / (len(a) + len(b) - n) >= 0.8:
                parent[root(i)] = root(j)
    found = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        group = (min(ids) if ids else None) if all_shingles[i] else None
        found.append((d, d if group is None else group))
    return sorted(found, key=repr)


def near_copy(text, changes, rng):
    w = text.split()
    for _ in range(changes):
        k = rng.randrange(len(w))
        w[k:k + 1] = rng.choice([[], ["new"], [w[k], "more"]])
    return " ".join(w)


def corpus():
    rng = random.Random(8)
    rows = [r for r in ODD_ROWS if len(r[1] or "") < 1000]
    passage = prose(4242, 30)
    for k in range(25):
        rows.append((10 * k + 3, prose(k, 80) + " " + passage))  # a passage that many share links nothing
        for c in range(k % 4):
            rows.append((10 * k + rng.choice([0, 1, 2, 4, 5]) + 300 * c, near_copy(rows[-1][1], rng.randint(1, 4), rng)))
    big = prose(77, 120)
    rows += [(1000 + k, near_copy(big, 2, rng)) for k in range(40)]
    rows += [(2000, big.upper().replace(" ", ", ")), (2001, big), (2001, big), (2002, " ".join(big.split()[60:] + big.split()[:60]))]
    return rows


def test_groups_equal_brute_force(make_docs):
    rows = corpus()
    found = near.report(make_docs(rows)).collect()
    assert sorted(((r.doc_id, r.group_id) for r in found), key=repr) == brute_force(rows)
    assert all(r.first == (r.group_id == r.doc_id) for r in found)


def test_nothing(make_docs):
    assert near.report(make_docs([])).collect() == []
    assert [tuple(r) for r in near.report(make_docs([(4, None)])).collect()] == [(4, 4, True)]


def test_one_of_each(make_docs):
    rows = corpus()
    kept = [(r.doc_id, r.text) for r in near.one_of_each(make_docs(rows)).collect()]
    groups = dict(brute_force(rows))
    with_words = [(d, t) for d, t in rows if words(t)]
    expected = {groups[d] for d, _ in with_words if d is not None}
    assert sorted(d for d, t in kept if words(t) and d is not None) == sorted(expected)
    assert sorted((r for r in rows if not words(r[1])), key=repr) == sorted((r for r in kept if not words(r[1])), key=repr)
    assert [t for d, t in kept if d is None and words(t)] == ["no id at all"]


@pytest.mark.parametrize("seed", range(30))
def test_banded_alignment(seed):
    rng = random.Random(seed)
    a = [rng.randint(0, 12) for _ in range(rng.randint(1, 60))]
    b = near_copy(" ".join(map(str, a)), rng.randint(0, 6), rng).replace("new", "99").replace("more", "98").split()
    b = [int(x) for x in b] or [1]
    x, y = np.array(a, np.uint32), np.array(b, np.uint32)
    n = common(a, b)
    assert near.common_subsequence(x, y, 100) == n
    assert near.similar(x, y) == (n / (len(a) + len(b) - n) >= 0.8)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 7), (7, 5), (20, 21)] + [(100 + k, 101 + k) for k in range(30)]
    found = near.components(spark.createDataFrame(links, "a long, b long"))
    roots = {r.node: r.root for r in found.collect()}
    assert {roots[k] for k in (1, 2, 3, 9)} == {1} and {roots[k] for k in (5, 6, 7)} == {5}
    assert {roots[100 + k] for k in range(31)} == {100} and roots[21] == 20


def test_order_matters():
    a = np.arange(100, dtype=np.uint32)
    assert not near.similar(a, np.concatenate([a[50:], a[:50]]))
    assert near.similar(a, np.delete(a, [3, 50, 51]))


def test_parities_bound_what_two_texts_do_not_share():
    rng = np.random.default_rng(3)
    names = rng.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2)
    sizes = [0, 1, 40, 41, 120, 118]
    texts = [np.sort(rng.choice(names[:60 if n < 60 else 400], n)) for n in sizes]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    found = near.parities(np.concatenate(texts), offsets)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            bound = int(np.bitwise_count(found[i].view(np.uint64) ^ found[j].view(np.uint64)).sum())
            both = sum(min((a == x).sum(), (b == x).sum()) for x in set(a.tolist()) & set(b.tolist()))
            assert bound <= len(a) + len(b) - 2 * both


def test_short_pairs_always_meet(make_docs):
    """One word more before or after a text of 4 to 8 shingles; the sketches alone miss 2.8 % at 4."""
    rows = []
    for k in range(400):
        text = " ".join(f"w{k}x{i}" for i in range(8 if k < 300 else 9 + k % 4))
        rows += [(2 * k, text), (2 * k + 1, f"{text} end" if k % 2 else f"start {text}")]
    found = {r.doc_id: r.group_id for r in near.report(make_docs(rows)).collect()}
    assert [k for k in range(400) if found[2 * k + 1] != 2 * k or found[2 * k] != 2 * k] == []


def test_short_buckets_of_repeated_shingles():
    names, offsets = np.array([7, 7, 7, 7, 7, 1, 2, 3], np.uint64), np.array([0, 5, 5, 8])
    assert [len(x) for x in near.short_buckets(names, offsets)] == [2, 0, 0]


def test_rounds_of_components_leave_no_tables(spark, monkeypatch):
    """Each round writes a table; those of earlier rounds and the edges are gone at the end, and a small graph is one file."""
    made = []

    def kept(df):
        found = scratch.kept(df)
        made.append(found)
        return found

    monkeypatch.setattr(near, "kept", kept)
    links = spark.createDataFrame([(b"%03d" % k, b"%03d" % (k + 1)) for k in range(40) if k != 20], "a binary, b binary")
    found = {bytes(r.node): bytes(r.root) for r in near.components(links).collect()}
    assert found == {b"%03d" % k: b"000" if k <= 20 else b"021" for k in range(41)}
    left = [files for files in (df.inputFiles() for df in made) if any(os.path.exists(f.removeprefix("file://")) for f in files)]
    assert len(made) > 3 and len(left) == 1 and len(left[0]) == 1


@pytest.mark.parametrize("seed", range(4))
def test_components_of_new_links_read_no_others(spark, monkeypatch, seed):
    """Later links join components found before; rounds go on with the links that are left, not with all."""
    rng = random.Random(seed)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(500, 700 + k) for k in range(200)] + [(k, k + 1) for k in range(900, 960)]
    parent = {k: k for link in links for k in link if link[0] != link[1]}

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for a, b in links:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    read = []

    def kept(df):
        found = scratch.kept(df)
        if found.columns == ["a", "b"]:
            read.append(found.count())
        return found

    monkeypatch.setattr(near, "kept", kept)
    found = near.components(spark.createDataFrame(links[10:], "a long, b long"))
    assert sum(read) < 2 * read[0] and read[0] > 1000
    del read[:]
    found = near.components(spark.createDataFrame(links[:10], "a long, b long"), found)
    assert {r.node: r.root for r in found.collect()} == {k: root(k) for k in parent} and found.count() == len(parent)
    assert read[0] <= 20
    same = near.components(spark.createDataFrame([], "a long, b long"), found)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, found.collect()))
