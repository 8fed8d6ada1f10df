import random

import pytest

from barlake.operators import requests as bulk
from barlake.operators.requests import answer_requests, count_requests, request_problems
from barlake.operators.write import write_data
from barlake.sources.scan import query_data
from conftest import plan_of

TEXTS = {
    "date": ["2026-05-15", "2026-05-15,2026-05-17", "2026-05-16~", "~2026-05-16", "2026-05-16~2026-05-30"],
    "Month": ["05", "04, 06", "05~"],
    "market": ["XHKG", "XHKG , XSHE", "XSHG~", "XSHE,XSHE", "~"],
    "stock_code": ["00700", "00700,600519,nope", "600000~", ","],
    "time": ["09:30", "10:00~11:00"],
    "close": ["150~", "~120.5", "100~160", "120.5", "120.5,130,x", "x"],
    "volume": ["1000~1010", "~1000.5", "1005", "1e3~"],
    "unknown": ["1"],
    "close__gt": ["120.5", "150"], "close__lte": ["160"], "volume__gte": ["1000.5", "-1e45"], "volume__lt": ["1e45", "1010"],
    "market__ne": ["XHKG", "XHKG, XSHE"], "stock_name__like": ["S00", "519"], "date__gt": ["2026-05-15"],
    "time__between": ["10:00,11:00", "10:00~11:00"], "stock_code__in": ["00700", "00700, 600519"], "volume__ne": ["1005,1006.0"],
}


def random_requests(n, seed):
    source = random.Random(seed)
    asked = {}
    for i in range(n):
        fields = source.sample(sorted(TEXTS), source.randint(1, 4))
        asked[f"q{i}"] = [(f, source.choice(TEXTS[f])) for f in fields]
    return asked


def frame(spark, asked):
    return spark.createDataFrame([(r, f, t) for r, args in asked.items() for f, t in args],
                                 "request_id string, field string, text string")


@pytest.fixture(params=["broadcast", "shuffled"])
def join_path(request, monkeypatch):
    if request.param == "shuffled":
        monkeypatch.setattr(bulk, "BROADCAST_BYTES", -1)
    return request.param


@pytest.mark.parametrize("name", ["stock_5min", "stock_30min"])
def test_bulk_answers_equal_single_queries(spark, integration, name, join_path):
    store, asked = integration[0], random_requests(24, name)
    got = {r["request_id"]: r["rows"] for r in count_requests(store, name, frame(spark, asked)).collect()}
    for request, args in asked.items():
        single = query_data(store, name, args=[(f"f_{f}", t) for f, t in args])[0].count()
        assert got[request] == single, (request, args)


def test_rows_are_whole(spark, integration):
    asked = {"a": [("date", "2026-05-15"), ("stock_code", "00700")], "b": [("stock_code", "00700,00941")]}
    rows = answer_requests(integration[0], "stock_5min", frame(spark, asked))[0]
    assert rows.columns == ["request_id", *integration[0].table("stock_5min").columns]
    assert sorted((r["request_id"], r["count"]) for r in rows.groupBy("request_id").count().collect()) == [
        ("a", 72), ("b", 432)]


def test_no_nested_loop_and_pruned_scan(spark, integration, join_path):
    asked = {"a": [("date", "2026-05-15"), ("close", "150~")], "b": [("date", "2026-05-16")]}
    rows = answer_requests(integration[0], "stock_5min", frame(spark, asked))[0]
    text = plan_of(rows)
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "(date" in text and ">= 2026-05-15" in text and "<= 2026-05-16" in text


def test_repeated_field_keeps_the_last(spark, integration):
    rows = [("a", "market", "XHKG", 1), ("a", "market", "XSHG", 2), ("a", "date", "2026-05-15", 0)]
    asked = spark.createDataFrame(rows, "request_id string, field string, text string, seq int")
    found = answer_requests(integration[0], "stock_5min", asked)[0].select("market").distinct().collect()
    assert [r[0] for r in found] == ["XSHG"]


def test_problems_are_reported(spark, integration):
    asked = {"a": [("foo", "1")], "b": [("close", "x~")], "c": [("market", "~")], "d": [("market", " , ")],
             "e": [("date", "x~")], "f": [("volume", "1~2")], "g": [("close__gt", "x")], "h": [("close__like", "1")],
             "i": [("date__between", "1")], "j": [("date__between", "1,2")], "k": [("foo__gt", "1")]}
    problems = request_problems(integration[0].table("stock_5min"), frame(spark, asked)).collect()
    assert {r["request_id"] for r in problems} == {"a", "b", "c", "d", "g", "h", "i", "k"}
    answered = answer_requests(integration[0], "stock_5min", frame(spark, asked))[1].collect()
    assert sorted(answered) == sorted(problems)


def test_one_scan_and_code_requests_are_not_spread(spark, integration, monkeypatch):
    """Requests of every kind meet the rows in one scan, and one by code is one row to join."""
    asked = {"a": [("stock_code", "00700")], "b": [("time", "09:30")], "c": [("date", "2026-05-15")], "d": [("close", "1~")]}
    written, write = [], bulk.kept
    monkeypatch.setattr(bulk, "kept", lambda df: written.append(write(df)) or written[-1])
    rows = answer_requests(integration[0], "stock_5min", frame(spark, asked))[0]
    plan = plan_of(rows)
    assert plan.count("ReadSchema: struct<time:") == 1  # the table; requests are written once and read as they were
    assert len(written) == 1 and plan.count("FileScan parquet") <= 3 and "NestedLoop" not in plan
    keyed = {r["request_id"]: r["count"] for r in written[-1].groupBy("request_id").count().collect()}
    assert (keyed["a"], keyed["b"], keyed["c"]) == (1, 1, 1)
    assert {r["request_id"] for r in rows.select("request_id").distinct().collect()} == set("abcd")


@pytest.mark.parametrize("text", ["-1e45~", "~1e45", "1e45~", "~-1e45", "nan~", "-Infinity~Infinity", "1e45", "1,1e45"])
def test_extreme_numbers_as_in_single_reads(spark, store, text):
    df = spark.createDataFrame([("r", 1, 1.0, 7), ("s", -5, 2.5, 8)], "id string, a_int64 long, a_double double, a_uint64 long")
    write_data(store, df, "all_types", validate_schema=False)
    asked = {c: [(c, text)] for c in ("a_int64", "a_double", "a_uint64")}
    got = {r["request_id"]: r["rows"] for r in count_requests(store, "all_types", frame(spark, asked)).collect()}
    single = {c: query_data(store, "all_types", args=[(f"f_{c}", text)])[0].count() for c in asked}
    assert got == single


@pytest.mark.parametrize("text, rows", [("1", 1), (f"{2**53}", 0), (f"{2**53 + 1}", 1), ("1~", 2), ("0.5~1.5", 1)])
def test_unpartitioned_table_and_exact_whole_numbers(spark, store, text, rows, join_path):
    df = spark.createDataFrame([("r", 1), ("s", 2**53 + 1), ("t", None)], "id string, a_int64 long")
    write_data(store, df, "all_types", validate_schema=False)
    got = count_requests(store, "all_types", frame(spark, {"q": [("a_int64", text)]})).first()
    assert got["rows"] == rows


def test_flag_and_float_columns(spark, store):
    df = spark.createDataFrame([("r", True, 0.1), ("s", False, 0.2)], "id string, a_bool boolean, a_float float")
    write_data(store, df, "all_types", validate_schema=False)
    asked = {"a": [("a_bool", "1")], "b": [("a_float", "0.1,0.3")], "c": [("a_bool", "~0.5")],
             "d": [("id", "r,s"), ("a_float", "0.15~")], "e": [("nothing", "1")]}
    got = {r["request_id"]: r["rows"] for r in count_requests(store, "all_types", frame(spark, asked)).collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 2}


def test_nothing_stored_or_asked(spark, store, integration):
    asked = frame(spark, {"a": [("code", "1")]})
    assert [tuple(r) for r in count_requests(store, "flat", asked).collect()] == [("a", 0)]
    none = asked.where("false")
    assert answer_requests(integration[0], "stock_5min", none)[0].count() == 0


def test_bounds_meet_partitions_by_month(spark, store, integration, monkeypatch):
    """Bounds on the day, sound or not, meet the partition list by equality and give what single reads give."""
    asked = {"a": [("date", "2026-05-10~2026-05-16")], "b": [("date", "2026-05~2026-05-15")], "c": [("date", "2025-12-31~2027")],
             "d": [("date", "2026-05-16~2026-05-15")], "e": [("date", "x~y")], "f": [("date", "0001-01-01~9999-12-31")],
             "g": [("Year", "2025~"), ("time", "09:30")], "h": [("date__gt", "2026-05-15")], "i": [("Month__ne", "04")]}
    for name in ("stock_5min", "stock_1day"):
        fitting = {k: [(f, t) for f, t in v if f in integration[0].table(name).columns] for k, v in asked.items()}
        rows, problems = answer_requests(integration[0], name, frame(spark, fitting))
        assert "NestedLoop" not in plan_of(rows)
        got = {r["request_id"]: r["rows"] for r in count_requests(integration[0], name, frame(spark, fitting)).collect()}
        whole = {r["request_id"]: r["count"] for r in rows.groupBy("request_id").count().collect()}
        for request, args in fitting.items():
            single = query_data(integration[0], name, args=[(f"f_{f}", t) for f, t in args])[0].count()
            assert got[request] == single and whole.get(request, 0) == single, (name, request)


def test_derived_partitions(spark, store):
    rows = [("2026-05-15", "a", 1.0), ("2026-06-15", "a", 2.0), ("2026-06-16", "b", 3.0)]
    write_data(store, spark.createDataFrame(rows, "date string, code string, close double"), "by_month")
    asked = {"a": [("date", "2026-06-01~")], "b": [("date", "2026-05-15,2026-06-16"), ("code", "a")],
             "c": [("close", "2~")]}
    got = {r["request_id"]: r["rows"] for r in count_requests(store, "by_month", frame(spark, asked)).collect()}
    assert got == {"a": 2, "b": 1, "c": 2}
