"""Conversation repair against all edits of small conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from barlake.llm import conversation_repair as repair

SPACE = " \t\n\x0b\x0c\r"


def harmed(rows):
    """Rows (conv, turn, role, text) after the damage, by conversation and in order."""
    found = {}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = found.setdefault(conv, [])
        if harm == 0:
            continue
        row = (turn, "user" if harm == 4 else role, "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text)
        own += [row] * (2 if harm == 3 else 1)
    for own in found.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return found


def cheapest(rows):
    """(cost, edits, repaired) by a queue of all paths, least cost and edits first."""
    seen, kinds = set(), []
    for _, role, text in rows:
        core = text.strip(SPACE)
        kinds.append("blank" if not core else "duplicate" if (role, text) in seen else None if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, edits, at, roles, kept = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return kinds, cost, edits, kept
        if (at, roles[-2:], len(roles) > 2) in done:
            continue
        done.add((at, roles[-2:], len(roles) > 2))

        def go(price, edit, used, role=None, text=None):
            now = roles + ("" if role is None else role[:1] or "x")
            if re.fullmatch("s?(ua)*u?", now):
                heapq.heappush(queue, (cost + price, edits + edit, at + used, now, kept if role is None else kept + ((role, text),)))
        for role in ("user", "assistant"):
            go(3, "I", 0, role, "")
        if at < len(rows):
            go(4, "D", 1)
            if kinds[at] in (None, "truncated"):
                more = 3 if kinds[at] else 0
                go(more, "K", 1, rows[at][1], rows[at][2])
                for role in ("user", "assistant"):
                    go(3 + more, "R", 1, role, rows[at][2])


def brute_force(rows):
    found = {}
    for conv, own in harmed(rows).items():
        kinds, cost, edits, kept = cheapest(own)
        turns = {t for t, _, _ in own if t is not None}
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        found[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                       pairs, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return found


TEXTS = ["Yes.", "Yes.", "no", "What? ", "  ", "", "A long answer!\n", "cut off,", "3.5", "é.", None, "Fine. "]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "  user"]


def some_rows(seed, conversations=60, most=9):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(ROLES) if rng.random() < 0.4 else ["user", "assistant"][turn % 2]
            text = rng.choice(TEXTS) if rng.random() < 0.4 else f"Text {rng.random()}."
            rows.append((None if conv == 7 else conv * 13, rng.choice([turn, turn + 2, None, 3, -5]) if rng.random() < 0.2 else turn, role, text))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    rng.shuffle(rows)
    return rows


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(
        [(*r, "x", 1, None) for r in rows], "conv_id long, turn long, role string, text string, kinds string, seq int, edits string")


def told(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("segment", [repair.SEGMENT, 3, 1])
def test_equal_brute_force(make, segment):
    rows = some_rows(segment)
    assert told(repair.report(make(rows), segment)) == brute_force(rows)


def test_long_conversation_in_segments(make):
    """One conversation that many tasks share, with a run of equal rows."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(TEXTS) if rng.random() < 0.3 else f"{t}.")
            for t in range(150)] + [(1, 40, "user", "Again and again.")] * 30 + [(2, 1, "user", "Hm")]
    assert told(repair.report(make(rows), 7)) == brute_force(rows)


@pytest.mark.parametrize("seed", range(40))
def test_search_between_all_states(seed):
    """Segments joined by their best states give what one search over all rows gives."""
    rng = random.Random(seed)
    kinds = "".join(rng.choice("-suaxSUAXuauaua") for _ in range(rng.randint(0, 12)))
    cut = rng.randint(0, len(kinds))
    both = []
    for middle in range(4):
        left, right = repair.search(kinds[:cut], 0, (middle,), False), repair.search(kinds[cut:], middle)
        if left:
            both.append((left[0] + right[0], left[1] + right[1]))
    assert min(both) == repair.search(kinds)


def test_many_faults_are_found_in_reasonable_time():
    kinds = "".join(random.Random(1).choice("-suaxSUAX") for _ in range(4_096))
    cost, edits = repair.search(kinds)
    assert sum(e != "I" for e in edits) == 4_096 and cost > 4_096


def test_nothing_and_repaired_rows(make):
    assert repair.report(make([])).collect() == []
    rows = repair.repaired(make([(1, 0, "user", "Hello."), (1, 1, "user", "And?"), (3, 0, "tool", " ")])).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.place, r.edit, r.role, r.text, r.fault) for r in rows] == [
        (1, 0, "K", "user", "Hello.", None), (1, 1, "R", "assistant", "And?", None), (3, 0, "D", None, None, "blank")]
