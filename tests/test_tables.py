import pytest
from pyspark.sql import types as T

from barlake.tables import (INDEX_CONSTITUENTS, STOCK_1DAY, STOCK_5MIN, TYPES, Store, Table,
                            default_key)
from conftest import ALL_TYPES, BY_MONTH


def test_all_declared_types_have_a_stored_type():
    assert len(TYPES) == 12
    assert TYPES["uint64"] == T.DecimalType(20, 0)
    assert TYPES["timestamp"] == T.LongType()
    assert {TYPES[t] for t in ("string", "date", "datetime")} == {T.StringType()}
    assert [f.dataType for f in ALL_TYPES.schema] == [TYPES[t] for t in ALL_TYPES.columns.values()]


@pytest.mark.parametrize("columns, key", [
    (("date", "code", "market", "time"), ("date", "code", "time")),
    (("stock_code", "trade_date"), ("trade_date", "stock_code")),
    (("index_code", "date", "stock_code"), ("date", "index_code")),
    (("DATETIME", "a"), ("DATETIME",)),
    (("a", "b", "c"), ("a", "b")),
])
def test_default_key(columns, key):
    assert default_key(dict.fromkeys(columns, "string")) == key


def test_shipped_keys_and_partitions():
    assert STOCK_5MIN.key == ("date", "stock_code", "time")
    assert STOCK_5MIN.partitions == ("Year", "Month", "date")
    assert STOCK_1DAY.key == ("date", "stock_code")
    assert STOCK_1DAY.partitions == ("Year", "Month")
    assert INDEX_CONSTITUENTS.key == ("date", "index_code")
    assert STOCK_1DAY.identity == ("Year", "Month", "date", "stock_code")


def test_derived_partitions():
    assert BY_MONTH.derived == ("year", "month")
    assert BY_MONTH.stored_schema.names == ["date", "code", "close", "year", "month"]


@pytest.mark.parametrize("columns, path", [
    ({}, "x.parquet"),
    ({"a": "decimal"}, "x.parquet"),
    ({"a": "integer"}, "x.parquet"),
    ({"a": "string"}, "{b}.parquet"),
    ({"a": "string"}, "{year}.parquet"),
    ({"date": "string", "Year": "string"}, "{schema.year}.parquet"),
])
def test_bad_declarations(columns, path):
    with pytest.raises(ValueError):
        Table("t", "v1", columns, path)


def test_calendar_columns_are_text():
    columns = {"Year": "int32", "Month": "string", "date": "string"}
    with pytest.raises(ValueError):
        Table("t", "v1", columns, "{Year}/{Month}.parquet", calendar=True)


def test_unknown_dataset_and_version():
    store = Store(None, "/nowhere")
    with pytest.raises(KeyError):
        store.table("stock_2min")
    with pytest.raises(KeyError):
        store.table("stock_5min", "v9")


def test_later_declaration_wins():
    other = Table("stock_5min", "v1", {"a": "string", "b": "string"}, "x.parquet")
    assert Store(None, "/nowhere", (STOCK_5MIN, other)).table("stock_5min") is other
