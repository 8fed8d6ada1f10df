"""Merged sketches against exact counts."""

import pytest
from pyspark.sql import functions as F

from barlake.operators.layout import compact
from barlake.operators.profiles import merged_profile, update_profile
from barlake.operators.write import write_data
from barlake.sources.scan import read_data
from conftest import FLAT

COLUMNS = ["code", "time", "open"]


def put(store, bars, days, first, count):
    rows = [(day, f"{(first + k) % 3_001:06}", "XHKG", f"{k % 97:02}", None if k % 10 == 0 else float(k)) for day in days for k in range(count)]
    assert write_data(store, bars(*rows), "bars_by_market", check_duplicates=False).success


def agrees(store, name="bars_by_market", columns=COLUMNS, **filters):
    rows = read_data(store, name, filters=filters)
    exact = rows.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    about = {r.column: r.about for r in merged_profile(store, name, filters=filters).collect()}
    return set(about) == set(columns) and all(abs(about[c] - exact[c]) <= 0.02 * exact[c] for c in columns)


def test_only_touched_partitions_are_read_again(store, bars):
    put(store, bars, ["2026-05-15", "2026-05-16"], 0, 2_000)
    assert update_profile(store, "bars_by_market", COLUMNS) == 2 and agrees(store)
    assert update_profile(store, "bars_by_market", COLUMNS) == 0 and agrees(store)
    put(store, bars, ["2026-05-16", "2026-05-17"], 1_500, 2_500)
    assert update_profile(store, "bars_by_market", COLUMNS) == 2 and agrees(store)
    assert agrees(store, date="2026-05-16") and agrees(store, date="2026-05-30")
    assert compact(store, "bars_by_market").partitions == 1
    assert update_profile(store, "bars_by_market", COLUMNS) == 1 and agrees(store)
    assert update_profile(store, "bars_by_market", ["code"]) == 3 and agrees(store, columns=["code"])
    assert read_data(store, "bars_by_market").count() == 9_000  # the profile is no part of the table


def test_flat_and_missing(store, spark):
    with pytest.raises(ValueError):
        merged_profile(store, "flat")
    assert update_profile(store, "flat", ["name"]) == 0
    write_data(store, spark.createDataFrame([(str(k), None if k % 2 else f"n{k}", 1.0) for k in range(500)], FLAT.schema), "flat")
    assert update_profile(store, "flat", ["name", "close"]) == 1
    assert {r.column: r.about for r in merged_profile(store, "flat").collect()}["close"] == 1 and agrees(store, "flat", ["name", "close"])
