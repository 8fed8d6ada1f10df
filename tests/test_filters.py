from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from barlake.functions.columns import all_of
from barlake.functions.filters import (compile_filters, filter_arguments, filter_value,
                                       implied_by_date, named_partitions)
from barlake.tables import STOCK_1DAY, STOCK_5MIN, Table
from conftest import ALL_TYPES, BARS_BY_MARKET, BY_MONTH, FLAT


@pytest.mark.parametrize("text, value", [
    ("plain", "plain"),
    ("x1,y2", ["x1", "y2"]),
    (" x1 ,y2 , z3", ["x1", "y2", "z3"]),
    ("x1,,y2,", ["x1", "y2"]),
    ("2031-02-03~2031-04-05", {"start": "2031-02-03", "end": "2031-04-05"}),
    ("~17", {"end": "17"}),
    ("-3~", {"start": "-3"}),
    ("2~2.5", {"start": "2", "end": "2.5"}),
    ("b~c,d", {"start": "b", "end": "c,d"}),
    ("a~b~c", {"start": "a", "end": "b~c"}),
    ("~", {}),
    (",", []),
    ("", ""),
])
def test_filter_text(text, value):
    assert filter_value(text) == value


def test_arguments_need_the_prefix_and_a_known_field():
    filters, warnings = filter_arguments(
        {"version": "v1", "date": "2026-05-19", "f_foo": "1", "f_market": "XHKG", "f_close__gt": "4"},
        STOCK_5MIN.columns)
    assert filters == {"market": "XHKG", "close__gt": "4"}
    assert warnings == ["No column for filter 'foo', it is left out"]


def test_arguments_without_fields_are_not_checked():
    assert filter_arguments({"f_foo": "1"}) == ({"foo": "1"}, [])


def test_signs_are_plain_text_after_some_suffixes():
    given = {"f_close__gt": "1~2", "f_market__like": "a,b", "f_market__ne": "a~b", "f_market__in": "a,b"}
    assert filter_arguments(given, STOCK_5MIN.columns)[0] == {
        "close__gt": "1~2", "market__like": "a,b", "market__ne": "a~b", "market__in": ["a", "b"]}


def test_long_lists_are_not_multiplied():
    import time
    lists = {"market": [f"m{k}" for k in range(1500)], "date": [f"d{k}" for k in range(1500)]}
    start = time.perf_counter()
    assert named_partitions(BARS_BY_MARKET, lists) is None
    assert time.perf_counter() - start < 1


def test_repeated_argument_keeps_the_last():
    assert filter_arguments([("f_a", "1"), ("f_a", "2,3")])[0] == {"a": ["2", "3"]}


BIG = 2**53 + 1
ROWS = [
    ("r0", 1, 1, 1, 1, Decimal(1), 1.0, 1.0, True, "2026-05-15", "2026-05-15 09:30", 1),
    ("r1", BIG, 7, 7, 7, Decimal(2**64 - 1), 0.1, 0.1, False, "2026-05-16", "2026-05-16 09:30", BIG),
    ("r2", BIG - 1, -7, -7, -7, Decimal(0), -2.5, -2.5, True, "2026-05-17", "x", -1),
    ("r3", *[None] * 11),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, ALL_TYPES.schema).cache()


def ids(rows, filters):
    predicates, _ = compile_filters(ALL_TYPES.columns, filters)
    return {r["id"] for r in rows.where(all_of(predicates)).select("id").collect()}


@pytest.mark.parametrize("filters, expected", [
    ({"a_int64": str(BIG)}, {"r1"}),                      # exact beyond 2^53
    ({"a_int64": ["1", str(BIG - 1), "abc"]}, {"r0", "r2"}),
    ({"a_int64": "1.0"}, {"r0"}),
    ({"a_int64": "1.5"}, set()),
    ({"a_int64": "abc"}, set()),
    ({"a_int64": {"start": "1.5"}}, {"r1", "r2"}),
    ({"a_int64": {"end": "1.5"}}, {"r0"}),
    ({"a_int64": {"start": "-inf", "end": "1e400"}}, {"r0", "r1", "r2"}),
    ({"a_int64": {"start": "1e30"}}, set()),
    ({"a_int64": "nan"}, set()),
    ({"a_int8": {"start": "-200", "end": "200"}}, {"r0", "r1", "r2"}),
    ({"a_int8": "300"}, set()),
    ({"a_int16__gt": 1}, {"r1"}),
    ({"a_int16__gt": "0.5"}, {"r0", "r1"}),
    ({"a_int32__lt": "1"}, {"r2"}),
    ({"a_int32__lt": "1.5"}, {"r0", "r2"}),
    ({"a_int32__lte": 1}, {"r0", "r2"}),
    ({"a_int32__gte": 7}, {"r1"}),
    ({"a_uint64": str(2**64 - 1)}, {"r1"}),
    ({"a_uint64": {"start": "-1"}}, {"r0", "r1", "r2"}),
    ({"a_uint64": {"start": str(2**64 - 1)}}, {"r1"}),
    ({"a_float": "0.1"}, {"r1"}),
    ({"a_double": "0.1"}, {"r1"}),
    ({"a_double": {"start": "-2.5", "end": "0.1"}}, {"r1", "r2"}),
    ({"a_double": " 1 "}, {"r0"}),
    ({"a_bool": "1"}, {"r0", "r2"}),
    ({"a_bool": False}, {"r1"}),
    ({"a_bool": {"start": "0.5"}}, {"r0", "r2"}),
    ({"a_bool": "true"}, set()),
    ({"a_stamp": {"end": "0"}}, {"r2"}),
    ({"a_date": {"start": "2026-05-16"}}, {"r1", "r2"}),
    ({"a_date": {"start": "2026-05-17", "end": "2026-05-15"}}, set()),
    ({"a_date__in": "2026-05-15, 2026-05-17"}, {"r0", "r2"}),
    ({"a_date__between": "2026-05-15,2026-05-16"}, {"r0", "r1"}),
    ({"a_double__between": ["0", "1"]}, {"r0", "r1"}),
    ({"a_datetime__like": "09:"}, {"r0", "r1"}),
    ({"a_date__ne": "2026-05-15"}, {"r1", "r2"}),
    ({"a_int64__ne": "abc"}, {"r0", "r1", "r2"}),
    ({"id": None}, set()),
    ({"id__eq": "r0"}, {"r0"}),
    ({"id": []}, set()),
    ({"id": {}}, set()),
    ({"id": ["r0", "r0", "r3"]}, {"r0", "r3"}),
    ({"id": {"start": "r1"}, "a_bool": True}, {"r2"}),
])
def test_typed_predicates(rows, filters, expected):
    assert ids(rows, filters) == expected


@pytest.mark.parametrize("filters", [{"a_double": {"start": "abc"}}, {"a_int64__lt": "x"},
                                     {"a_double__like": "1"}, {"a_double__between": "1"}])
def test_predicates_that_cannot_be_built(filters):
    with pytest.raises(ValueError):
        compile_filters(ALL_TYPES.columns, filters)


def test_empty_and_unknown_filters_warn():
    predicates, warnings = compile_filters(ALL_TYPES.columns, {"id": [], "foo": "1"})
    assert len(predicates) == 1 and len(warnings) == 2


number = st.one_of(st.integers(-10, 10).map(str), st.floats(-10, 10).map(lambda v: f"{v:.2f}"))


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(low=number, high=number, column=st.sampled_from(["a_int32", "a_double", "a_uint64", "a_bool"]))
def test_ranges_agree_with_plain_comparison(rows, low, high, column):
    expected = {r[0] for r in ROWS if (v := r[ALL_TYPES.schema.names.index(column)]) is not None
                and float(low) <= float(v) <= float(high)}
    assert ids(rows, {column: {"start": low, "end": high}}) == expected


def test_text_is_never_read_as_a_number(spark):
    df = spark.createDataFrame([("00700",), ("700",)], "stock_code string")
    predicates, _ = compile_filters({"stock_code": "string"}, {"stock_code": 700})
    assert [r[0] for r in df.where(all_of(predicates)).collect()] == ["700"]


def test_values_are_never_patterns(spark):
    df = spark.createDataFrame([("XHKG",), ("*",)], "market string")
    predicates, _ = compile_filters({"market": "string"}, {"market": "*"})
    assert [r[0] for r in df.where(all_of(predicates)).collect()] == ["*"]


MONTHS = [(f"{y}", f"{m:02}") for y in (2023, 2024, 2025) for m in range(1, 13)]


@pytest.mark.parametrize("value, months", [
    ("2024-02-10", {"2024-02"}),
    (["2024-02-10", "2024-02-11", "2025-01-01"], {"2024-02", "2025-01"}),
    ({"start": "2024-11-30", "end": "2025-01-02"}, {"2024-11", "2024-12", "2025-01"}),
    ({"start": "2025-11-30"}, {"2025-11", "2025-12"}),
    ({"end": "2023-02-01"}, {"2023-01", "2023-02"}),
])
def test_months_implied_by_date(spark, value, months):
    parts = spark.createDataFrame(MONTHS, "Year string, Month string")
    implied = implied_by_date(STOCK_1DAY, {"date": value})
    assert {f"{r[0]}-{r[1]}" for r in parts.where(all_of(implied)).collect()} == months


def test_only_text_partitions_are_named():
    table = Table("t", "v1", {"rank": "int32", "v": "string"}, "{rank}.parquet")
    assert named_partitions(table, {"rank": "05"}) is None


@pytest.mark.parametrize("table, filters, tuples", [
    (STOCK_5MIN, {"date": "2026-05-15"}, [("2026", "05", "2026-05-15")]),
    (STOCK_5MIN, {"date__in": "2026-05-15,2026-06-01", "market": "x"},
     [("2026", "05", "2026-05-15"), ("2026", "06", "2026-06-01")]),
    (STOCK_5MIN, {"date": {"start": "2026-05-15", "end": "2026-05-16"}}, None),  # text between days counts
    (STOCK_5MIN, {"Year": "2026", "Month": ["05", "06"]}, None),
    (STOCK_1DAY, {"date": ["2026-05-15", "2026-05-16"]}, [("2026", "05")]),
    (STOCK_1DAY, {"Year": "2026", "Month": "05,06"}, [("2026", "05,06")]),
    (STOCK_1DAY, {"Year": "2026", "Month": ["06", "05"]}, [("2026", "05"), ("2026", "06")]),
    (STOCK_1DAY, {"Year__ne": "2026", "Month": "05"}, None),
    (BY_MONTH, {"date": "2026-05-15"}, [("2026", "05")]),
    (BARS_BY_MARKET, {"date": "2026-05-15"}, None),
    (BARS_BY_MARKET, {"date": "2026-05-15", "market": ["b", "a"]}, [("a", "2026-05-15"), ("b", "2026-05-15")]),
    (BARS_BY_MARKET, {"date": "2026-05-15", "market": []}, []),
    (FLAT, {"code": "1"}, None),
    (STOCK_5MIN, {}, None),
])
def test_partitions_named_by_filters(table, filters, tuples):
    assert named_partitions(table, filters) == tuples


def test_nothing_is_implied_without_reason():
    assert implied_by_date(STOCK_1DAY, {"date__ne": "2024-02-10", "market": "x"}) == []
    assert implied_by_date(STOCK_5MIN, {"date": "2024-02-10"}) == []  # date itself prunes
    assert len(implied_by_date(BY_MONTH, {"date__gt": "2024-02-10"})) == 1


