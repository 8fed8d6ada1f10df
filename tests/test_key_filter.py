"""Appends that look for their keys through the Bloom filters of the stored files."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from barlake.operators import keys, stats, write
from barlake.operators.layout import compact
from barlake.operators.write import read_touched, route_batch, write_data
from barlake.sources.scan import read_by_key_hash, read_data
from barlake.tables import KEY_HASH, Store, Table
from conftest import BARS_BY_MARKET

FILTERED = replace(BARS_BY_MARKET, name="filtered", key_filter=True)
DAY = "2026-05-15"


def rows_of(first, count):
    return [(DAY, f"{k % 977:06}", "XHKG", f"{k:08}", float(k)) for k in range(first, first + count)]


@pytest.fixture
def filled(spark, tmp_path, bars):
    """Twelve files of 500 rows in one partition."""
    store = Store(spark, str(tmp_path / "store"), (FILTERED,), allow_overwrite=True)
    for k in range(12):
        assert write_data(store, bars(*rows_of(1000 * k, 500)).coalesce(1), "filtered", check_duplicates=False).success
    return store


def rows_scanned(df):
    """Rows that the scans of an executed plan hand on."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children().iterator()
        while children.hasNext():
            todo.append(children.next())
    return total


def stored(store):
    return sorted(tuple(r) for r in read_data(store, "filtered").collect())


def test_only_row_groups_that_may_hold_a_key_are_read(filled, bars):
    batch = bars(*rows_of(3010, 3), *rows_of(3700, 2))
    route = route_batch(batch, FILTERED)
    assert rows_scanned(read_touched(filled, FILTERED, route)) == 6_000
    hashes = [r[0] for r in batch.select(keys.key_hash(FILTERED.identity)).collect()]
    assert rows_scanned(read_by_key_hash(filled, FILTERED, hashes)) == 500
    near = read_touched(filled, FILTERED, route, None, batch)
    assert sorted(map(tuple, keys.find_duplicates(batch, near, FILTERED.identity).collect())) == rows_of(3010, 3)


def test_append_of_few_rows(filled, bars):
    before = stored(filled)
    assert write_data(filled, bars(*rows_of(3010, 3), *rows_of(3700, 2)), "filtered").duplicates_found == 3
    assert write_data(filled, bars(*rows_of(3700, 2)), "filtered").success
    result = write_data(filled, bars(*rows_of(3010, 3), *rows_of(3701, 2)), "filtered", remove_duplicates=True)
    assert (result.total_rows, result.duplicates_found) == (1, 4)
    assert stored(filled) == sorted(before + rows_of(3700, 3))


@pytest.mark.parametrize("same", [True, False])
def test_wrong_hits_change_nothing(filled, bars, monkeypatch, same):
    """Equal hashes of different keys only mean that more is read."""
    if same:
        monkeypatch.setattr(keys, "key_hash", lambda key: F.lit(7).cast("long"))
        write_data(filled, bars(*rows_of(50_000, 100)), "filtered", check_duplicates=False)
    batch = bars(*rows_of(50_000, 2), *rows_of(60_000, 3))
    assert write_data(filled, batch, "filtered", remove_duplicates=True).total_rows == (3 if same else 5)


def test_rows_stored_without_hash_are_found(filled, bars):
    plain = replace(FILTERED, key_filter=False)
    older = Store(filled.spark, filled.base, (plain,))
    assert write_data(older, bars(*rows_of(90_000, 50)), "filtered", check_duplicates=False).success
    assert write_data(filled, bars(*rows_of(90_010, 2), *rows_of(91_000, 1)), "filtered").duplicates_found == 2
    assert compact(filled, "filtered").files_after == 1  # gives all rows their hash
    assert rows_scanned(filled.spark.read.parquet(filled.location(FILTERED)).where(F.col(KEY_HASH).isNull())) == 0
    assert write_data(filled, bars(*rows_of(90_010, 2), *rows_of(91_000, 1)), "filtered").duplicates_found == 2


def test_null_keys_and_large_batches(filled, bars, monkeypatch):
    odd = [(DAY, None, "XHKG", None, 1.0), (DAY, "1", "XHKG", None, 1.0)]
    assert write_data(filled, bars(*odd), "filtered").success
    assert write_data(filled, bars(*odd, (DAY, None, "XHKG", "1", 1.0)), "filtered").duplicates_found == 2
    monkeypatch.setattr(write, "FILTERED_KEYS", 1)
    assert write_data(filled, bars(*odd, (DAY, None, "XHKG", "1", 1.0)), "filtered").duplicates_found == 2


def test_the_column_is_not_shown(filled):
    assert KEY_HASH not in read_data(filled, "filtered", extra_columns=True).columns
    assert stats.stored_conformance(filled, "filtered").where("not conforms").count() == 0
    with pytest.raises(ValueError):
        Table("t", "v1", {"_KEY_hash": "int64", "a": "string"}, "t.parquet", key_filter=True)
