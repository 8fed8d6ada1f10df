"""Reconciliation by digests of partitions, then by rows."""

import random
from collections import Counter

import pytest

from barlake.operators import stats
from conftest import plan_of

SCHEMA = "day string, place string, code string, price double, size decimal(20,0)"


def some_rows(seed, count=300):
    rng = random.Random(seed)
    return [(rng.choice(["d1", "d2", "d3", None]), rng.choice(["x", "y"]), rng.choice(["a", "b", None]),
             rng.choice([0.0, -0.0, 1.5, None, float("nan")]), rng.choice([None, 1, 2])) for _ in range(count)]


def plain(row):
    return tuple("nan" if v != v else None if v is None else v + 0 if isinstance(v, float) else v if isinstance(v, str) else int(v) for v in row)


def difference(before, after):
    one, two = Counter(map(plain, before)), Counter(map(plain, after))
    return sorted([("before", n, *r) for r, n in (one - two).items()] + [("after", n, *r) for r, n in (two - one).items()], key=repr)


def both(spark, before, after):
    from decimal import Decimal
    wide = [[(*r[:4], None if r[4] is None else Decimal(r[4])) for r in rows] for rows in (before, after)]
    return [spark.createDataFrame(rows, SCHEMA) for rows in wide]


@pytest.mark.parametrize("most", [stats.EXACT_PARTITIONS, 1])
def test_rows_that_differ(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "EXACT_PARTITIONS", most)
    before = some_rows(1)
    after = before[40:] + before[:30] + [(None, "x", "new", 2.0, 1), ("d4", "y", None, None, None), before[50], before[50]]
    random.Random(2).shuffle(after)
    left, right = both(spark, before, after)
    found = stats.differing_rows(left, right.select(*reversed(right.columns)), ["day", "place"])
    assert sorted(((r.side, r.times, *plain(tuple(r)[2:])) for r in found.collect()), key=repr) == difference(before, after)


def test_partitions_that_differ(spark):
    before = [("d1", "x", "a", 1.0, 1), ("d2", "x", "a", 1.0, 1), (None, "x", "a", 1.0, 1), ("d5", None, "a", None, 1)]
    after = [("d1", "x", "a", -0.0, 1), ("d2", "x", "a", 1.0, 1), (None, "x", "a", 1.0, 1), (None, "x", "a", 1.0, 1), ("d5", None, None, None, 1)]
    found = stats.differing_partitions(*both(spark, before, after), ["day", "place"])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("d1", "x", 1, 1), (None, "x", 1, 2), ("d5", None, 1, 1)], key=repr)


@pytest.mark.parametrize("by", [["day"], []])
def test_equal_and_empty(spark, by):
    rows = some_rows(3)
    same = both(spark, rows, random.Random(1).sample(rows, len(rows)))
    assert stats.differing_partitions(*same, by).count() == 0 and stats.differing_rows(*same, by).count() == 0
    none = both(spark, rows, [])
    assert stats.differing_rows(*none, by).selectExpr("sum(times)").first()[0] == len(rows)
    assert stats.differing_rows(*both(spark, [], []), by).count() == 0


def test_rows_are_not_moved_for_the_digests(spark):
    left, right = both(spark, some_rows(1), some_rows(2))
    plan = plan_of(stats.differing_partitions(left, right, ["day"]))
    assert plan.count("partial_sum") >= 2 and "BroadcastNestedLoopJoin" not in plan
