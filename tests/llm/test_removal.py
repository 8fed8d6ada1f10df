"""Suffix-array and chunk dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from barlake.llm import chunk_dedup, names, suffix_dedup
from barlake.llm.packed import removal_report
from .samples import ODD_ROWS, prose

LATE = 1 << 62


def brute_force(rows, length=50):
    encoded = [(LATE if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in encoded:
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            first[w] = min(first.get(w, LATE), d)
    result = []
    for (doc, _), (d, b) in zip(rows, encoded):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < d:
                gone[i:i + length] = b"\1" * length
        result.append(line(doc, b, gone))
    return sorted(result, key=repr)


def line(doc, b, gone):
    kept = bytes(x for x, g in zip(b, gone) if not g)
    spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
    return doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus():
    """Copies, near copies, a passage in every text, repeated lines, short and odd texts."""
    rng, rows = random.Random(5), list(ODD_ROWS)
    passage = prose(999, 14)
    for k in range(40):
        words = prose(k, 50).split()
        words.insert(rng.randint(0, 49), passage)
        rows.append((k, " ".join(words)))
    for k in range(8):
        rows.append((100 + k, rows[-1 - k][1]))
        changed = rows[20 + k][1].split()
        changed[rng.randrange(len(changed))] = "changed"
        rows.append((50 - k, " ".join(changed)))
    rows += [(200, "la la " * 40), (201, "la la " * 60), (201, "la la " * 30), (None, passage), (None, passage)]
    return rows


def test_suffix_equals_brute_force(make_docs):
    rows = corpus()
    assert collected(suffix_dedup.digests(make_docs(rows))) == brute_force(rows)


def test_equal_names_of_different_bytes(monkeypatch):
    """Names cut to three bits: windows and runs are told apart by their bytes."""
    rng, length = np.random.default_rng(3), 12
    count = rng.integers(1, 9, 400)
    sizes = count + length - 1
    at = np.cumsum(sizes) - sizes
    data = rng.choice(np.frombuffer(b"ab", np.uint8), int(sizes.sum()), p=[0.8, 0.2])
    ids, anchor = rng.integers(0, 9, 400), rng.integers(0, 3, 400).astype(np.uint64)
    names = suffix_dedup.window_names
    monkeypatch.setattr(suffix_dedup, "window_names", lambda *x: names(*x) & np.uint64(7))
    monkeypatch.setattr(suffix_dedup, "WINDOWS", 300)
    found = set()
    for own in suffix_dedup._whole_anchors(anchor, count, np.argsort(anchor, kind="stable")):
        run, step = suffix_dedup._later_windows(ids, anchor, count, data, at, own, length)
        found |= set(zip(run.tolist(), step.tolist()))
    first = {}
    for k in range(400):
        for j in range(count[k]):
            w = anchor[k], data[at[k] + j:at[k] + j + length].tobytes()
            first[w] = min(first.get(w, LATE), ids[k])
    assert found == {(k, j) for k in range(400) for j in range(count[k])
                     if first[anchor[k], data[at[k] + j:at[k] + j + length].tobytes()] < ids[k]}

    whole = suffix_dedup.exact_runs(data, at, sizes, np.zeros(400, np.uint64), np.zeros(400, np.uint64))
    texts = [data[a:a + n].tobytes() for a, n in zip(at, sizes)]
    assert len(set(whole.tolist())) == len(set(texts)) == len(set(zip(whole.tolist(), texts)))


def test_suffix_of_nothing(make_docs):
    assert collected(suffix_dedup.digests(make_docs([]))) == []
    assert collected(chunk_dedup.digests(make_docs([]))) == []


@pytest.mark.parametrize("seed", range(4))
def test_suffix_random_bytes_of_few_kinds(make_docs, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 20), "".join(rng.choices("ab", weights=[9, 1], k=rng.randint(0, 300)))) for _ in range(30)]
    assert collected(suffix_dedup.digests(make_docs(rows))) == brute_force(rows)


def test_long_text_in_pieces(monkeypatch):
    data = (prose(1, 4000) + prose(1, 500)).encode()
    flat, offsets = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    whole = suffix_dedup.text_runs(flat, offsets, 50, 24)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    pieces = suffix_dedup.text_runs(flat, offsets, 50, 24)

    def windows(runs):
        return {(int(s) + i, int(n)) for _, s, c, n in zip(*runs) for i in range(c)}

    assert windows(pieces) == windows(whole)
    assert len(windows(whole)) == len(data) - 49


def test_kept_text_has_whole_characters(make_docs):
    passage = "ä" * 60
    docs = make_docs([(1, passage), (2, "x" + "ä" * 55 + "é tail"), (3, None)])
    left = {r.id: r.kept for r in suffix_dedup.remove_repeats(docs, as_text=True).collect()}
    assert left == {1: passage, 2: "x tail", 3: ""}  # the first byte of é went with the passage


def gear_chunks(data):
    """Chunk ends by the definition, one place at a time."""
    def gear(i):
        if i < chunk_dedup.GEAR - 1:
            return 0
        return sum(int(names.BYTE_NAMES[data[i - j]]) << j for j in range(chunk_dedup.GEAR)) % (1 << 64)

    hashes, reach, ends = [gear(i) for i in range(len(data))], chunk_dedup.REACH, []
    for i, h in enumerate(hashes):
        if h > max(hashes[max(0, i - reach):i], default=0) and h >= max(hashes[i + 1:i + 1 + reach], default=0):
            ends.append(i + 1)
    full, start = [], 0
    for end in sorted({*ends, len(data)} - {0}):
        while end - start > chunk_dedup.LONGEST:
            start += chunk_dedup.LONGEST
            full.append(start)
        full.append(end)
        start = end
    return full


def chunk_brute_force(rows):
    found, first = [], {}
    for d, t in rows:
        data, start, chunks = (t or "").encode(), 0, []
        for end in gear_chunks(data):
            chunks.append((start, end, data[start:end]))
            first[data[start:end]] = min(first.get(data[start:end], LATE), LATE if d is None else d)
            start = end
        found.append((d, data, chunks))
    result = []
    for d, data, chunks in found:
        gone = bytearray(len(data))
        for a, b, c in chunks:
            if first[c] < (LATE if d is None else d):
                gone[a:b] = b"\1" * (b - a)
        i = 0
        while i < len(gone):  # only ranges of 50 bytes go
            j = i
            while j < len(gone) and gone[j] == gone[i]:
                j += 1
            if gone[i] and j - i < chunk_dedup.LEAST_REMOVED:
                gone[i:j] = bytes(j - i)
            i = j
        result.append(line(d, data, gone))
    return sorted(result, key=repr)


def test_chunks_equal_brute_force(make_docs):
    rows = [r for r in corpus() if len(r[1] or "") < 5000] + [(300, "z" * 3000), (301, "z" * 3000 + "end of it")]
    assert collected(chunk_dedup.digests(make_docs(rows))) == chunk_brute_force(rows)


def test_insertion_moves_few_boundaries():
    data = prose(7, 3000).encode()
    other = data[:500] + b"inserted" + data[500:]

    def ends(x):
        return set(chunk_dedup.chunk_ends(np.frombuffer(x, np.uint8), np.array([0, len(x)])).tolist())

    moved = {e + 8 if e > 500 else e for e in ends(data)} ^ ends(other)
    assert len(moved) < 8 and len(ends(data)) > 200


def test_chunks_of_long_text_in_pieces(monkeypatch):
    data = prose(3, 3000).encode()
    flat, offsets = np.frombuffer(data, np.uint8), np.array([0, len(data)])
    whole = chunk_dedup.chunk_ends(flat, offsets)
    monkeypatch.setattr(chunk_dedup, "PIECE", 700)
    assert chunk_dedup.chunk_ends(flat, offsets).tolist() == whole.tolist()


def test_passages_of_fifty_words_are_caught(make_docs):
    rows = [(k, prose(k, 120)) for k in range(30)]
    for k in range(30, 60):
        words = prose(k, 120).split()
        words[40:40] = prose(k - 30, 120).split()[20:75]
        rows.append((k, " ".join(words)))
    rows += [(k, prose(k, 120)) for k in range(60, 90)]
    removed = {r.doc_id: r.n_removed for r in chunk_dedup.digests(make_docs(rows)).collect()}
    assert all(removed[k] > 50 for k in range(30, 60))
    assert not any(removed[k] for k in [*range(30), *range(60, 90)])


def shared_lines():
    """Copies under 50 bytes, and one line in many texts that holds few whole chunks."""
    lines = [prose(500 + k, 14) for k in range(4)]
    rows = [(k, "\n".join([prose(k, 25), lines[k % 4], prose(1000 + k, 25)])) for k in range(24)]
    return rows + [(50, "twin"), (51, "twin"), (52, "a short text of few words"), (None, "a short text of few words"), (53, "")]


def test_short_chunks_and_copies_go(make_docs, monkeypatch):
    rows = shared_lines()
    with monkeypatch.context() as limit:
        limit.setattr(chunk_dedup, "LEAST_REMOVED", 0)
        every = chunk_brute_force(rows)
        limit.setattr(chunk_dedup, "LEAST_REMOVED", 50)
        long_ones = chunk_brute_force(rows)
    docs = make_docs(rows)
    assert collected(chunk_dedup.digests(docs)) == every
    removed = {(r.id, s.end - s.start) for r in chunk_dedup.remove_repeats(docs).collect() for s in r.spans}
    assert {(51, 4), (chunk_dedup.NO_ID, 25)} <= removed
    assert any(25 <= n < 50 for d, n in removed if d < 24)
    assert collected(removal_report(chunk_dedup.remove_repeats(docs, least=50))) == long_ones != every
