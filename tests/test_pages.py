"""Pages by cursor against the whole result."""

import random

import pytest

from barlake.operators import pages
from barlake.operators.pages import page
from barlake.operators.write import write_data
from barlake.sources.scan import read_data
from conftest import FLAT


def all_pages(store, name, size, **more):
    found, after, read = [], None, []
    while True:
        own = page(store, name, size, after=after, **more)
        found += [tuple(r) for r in own.rows]
        read.append(own.partitions_read)
        if own.cursor is None:
            return found, read
        assert len(own.rows) == size
        after = own.cursor


@pytest.fixture
def filled(store, bars):
    rng, rows = random.Random(4), []
    for day in range(10, 22):
        for k in range(9):
            rows.append((f"2026-05-{day}", f"{rng.randrange(5)}", rng.choice(["XHKG", "XSHG"]), rng.choice(["09:30", "10:30"]),
                         rng.choice([1.0, 2.0, None])))
    rows += [("2026-05-15", "1", "XHKG", "09:30", 7.0)] * 30
    write_data(store, bars(*rows), "bars_by_market", check_duplicates=False)
    return store, rows


def order(row):
    return tuple((v is not None, v) for v in (row[2], row[0], row[1], row[3], row[4]))


@pytest.mark.parametrize("size", [7, 50, 1000])
def test_pages_are_the_whole_result_in_order(filled, size):
    store, rows = filled
    found, read = all_pages(store, "bars_by_market", size)
    assert found == sorted(rows, key=order)
    if size == 7:
        assert max(read) <= pages.FIRST_STEP  # of 24


def test_filters(filled):
    store, rows = filled
    wanted = {"open": {"start": 2}, "date": {"start": "2026-05-13", "end": "2026-05-18"}}
    found, _ = all_pages(store, "bars_by_market", 5, filters=wanted)
    assert found == sorted((tuple(r) for r in read_data(store, "bars_by_market", filters=wanted).collect()), key=order)
    assert all_pages(store, "bars_by_market", 5, filters={"open": {"start": 99}})[0] == []


def test_columns_and_flat_and_empty_tables(filled, spark):
    store, rows = filled
    assert page(store, "bars_by_market", 3, columns=["open", "code"]).rows[0].asDict().keys() == {"open", "code"}
    assert page(store, "flat", 3).rows == []
    flat = [(f"{k % 40:02}", None if k % 3 else "n", float(k % 2)) for k in range(100)]
    write_data(store, spark.createDataFrame(flat, FLAT.schema), "flat", check_duplicates=False)
    found, _ = all_pages(store, "flat", 30)
    assert found == sorted(flat, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    with pytest.raises(ValueError):
        page(store, "flat", 0)
