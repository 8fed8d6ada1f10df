import glob
import os

import pytest
from pyspark.sql import functions as F

from barlake.operators import manage, stats
from barlake.operators.export import export_records, records
from barlake.operators.write import write_data
from barlake.sources.files import stored_files, stored_partitions
from barlake.sources.scan import read_data
from barlake.tables import Store
from conftest import BARS_BY_MARKET, FLAT, TABLES, partition_filters

ROWS = [(f"2026-05-{d}", code, market, "09:30", float(d))
        for d in (15, 16, 17) for market, code in (("XHKG", "00700"), ("XSHG", "600519"))]


@pytest.fixture
def filled(store, bars):
    write_data(store, bars(*ROWS), "bars_by_market")
    return store


# ---------------------------------------------------------------- listing and coverage

def test_files_and_partitions(filled):
    table = filled.table("bars_by_market")
    files = stored_files(filled, table)
    assert files.count() == 6 and files.where("length > 0").count() == 6
    one = files.where(F.col("market") == "XHKG")
    assert one.count() == 3 and "XHKG" in partition_filters(one)[0]
    assert stored_partitions(filled, table).count() == 6
    assert manage.partitions(filled, "bars_by_market", filters={"date": {"start": "2026-05-16"}}).count() == 4


def test_listing_of_nothing(store):
    assert stored_files(store, store.table("stock_5min")).count() == 0
    assert stats.storage_stats(store, "stock_5min").first()["files"] == 0
    assert manage.mark_existing(store, manage.calendar(store.spark, "2026-05-15", "2026-05-15"),
                                "stock_5min").first()["present"] is False


@pytest.mark.parametrize("start, end, days", [
    ("2025-12-30", "2026-01-02", ["2025-12-30", "2025-12-31", "2026-01-01", "2026-01-02"]),
    ("2026-07-04", "2026-07-04", ["2026-07-04"]),
    ("2026-07-05", "2026-07-04", []),
    ("2024-02-28", "2024-03-01", ["2024-02-28", "2024-02-29", "2024-03-01"])])
def test_calendar(spark, start, end, days):
    assert sorted(r[0] for r in manage.calendar(spark, start, end).collect()) == days


def test_calendar_needs_dates(spark):
    with pytest.raises(ValueError):
        manage.calendar(spark, "soon", "2026-05-15")


def test_coverage_by_day_and_by_month(filled, spark):
    days = manage.calendar_coverage(filled, "bars_by_market", "2026-05-14", "2026-05-18")
    assert {r["date"]: r["present"] for r in days.collect()} == {
        "2026-05-14": False, "2026-05-15": True, "2026-05-16": True, "2026-05-17": True, "2026-05-18": False}
    df = spark.createDataFrame([("2026-05-15", "a", 1.0)], "date string, code string, close double")
    write_data(filled, df, "by_month")
    days = manage.calendar_coverage(filled, "by_month", "2026-05-14", "2026-05-15")
    assert {r["date"]: r["present"] for r in days.collect()} == {"2026-05-14": False, "2026-05-15": True}


def test_existing_partitions_with_null(filled, spark, bars):
    write_data(filled, bars(("2026-05-15", "x", None, "09:30", 1.0)), "bars_by_market")
    wanted = spark.createDataFrame([("XHKG", "2026-05-15"), ("XHKG", "2026-06-15"), (None, "2026-05-15"),
                                    (None, "2026-05-16")], "market string, date string")
    marked = manage.mark_existing(filled, wanted, "bars_by_market")
    assert {(r["market"], r["date"]): r["present"] for r in marked.collect()} == {
        ("XHKG", "2026-05-15"): True, ("XHKG", "2026-06-15"): False, (None, "2026-05-15"): True,
        (None, "2026-05-16"): False}
    with pytest.raises(ValueError):
        manage.mark_existing(filled, spark.createDataFrame([("a",)], "code string"), "bars_by_market")


# ---------------------------------------------------------------- delete

def test_delete_by_partition_columns(filled):
    result = manage.delete_partitions(filled, "bars_by_market", market="XHKG",
                                      date={"start": "2026-05-15", "end": "2026-05-16"})
    assert (result.partitions_deleted, result.files_deleted, result.rows_deleted, result.errors) == (2, 2, 2, [])
    left = {(r["date"], r["market"]) for r in read_data(filled, "bars_by_market").collect()}
    assert left == {(r[0], r[2]) for r in ROWS} - {("2026-05-15", "XHKG"), ("2026-05-16", "XHKG")}


@pytest.mark.parametrize("filters", [
    {}, {"code": "00700"}, {"market": "XHKG", "open": "1"}, {"foo": "1"}, {"market": []}, {"date": {}}])
def test_delete_refuses_anything_but_partition_filters(filled, filters):
    with pytest.raises(ValueError):
        manage.delete_partitions(filled, "bars_by_market", filters=filters)
    assert read_data(filled, "bars_by_market").count() == 6


@pytest.mark.parametrize("filters, left", [
    ({"date": {"start": "2026-05-17", "end": "2026-05-15"}}, 6),  # reversed range
    ({"market": "*"}, 6), ({"market": "../XHKG"}, 6), ({"date": {"end": "2026-05-15"}}, 4),
    ({"market__ne": "XHKG"}, 3), ({"date": "2026-05-1"}, 6)])
def test_delete_is_exact(filled, filters, left):
    manage.delete_partitions(filled, "bars_by_market", filters=filters)
    assert read_data(filled, "bars_by_market").count() == left


def test_delete_everything_then_write_again(filled, bars):
    manage.delete_partitions(filled, "bars_by_market", date={"start": "2026"})
    assert read_data(filled, "bars_by_market").count() == 0
    assert write_data(filled, bars(*ROWS), "bars_by_market").success


def test_delete_of_escaped_and_null_values(store, bars):
    odd = [("2026-05-15", "c", m, "09:30", 1.0) for m in ("a/b", "a=b", None)]
    write_data(store, bars(*odd), "bars_by_market")
    assert manage.delete_partitions(store, "bars_by_market", market="a/b").rows_deleted == 1
    assert {r["market"] for r in read_data(store, "bars_by_market").collect()} == {"a=b", None}


def test_delete_is_off_by_default(spark, tmp_path):
    with pytest.raises(PermissionError):
        manage.delete_partitions(Store(spark, str(tmp_path), TABLES), "bars_by_market", market="XHKG")


def test_delete_reports_folders_that_stay(filled, monkeypatch):
    original = manage.remove_folder
    def fail_once(spark, folder):
        if "XSHG" in folder:
            raise OSError("read-only")
        return original(spark, folder)
    monkeypatch.setattr(manage, "remove_folder", fail_once)
    result = manage.delete_partitions(filled, "bars_by_market", date="2026-05-15")
    assert (result.partitions_deleted, result.rows_deleted) == (1, 1)
    assert len(result.errors) == 1 and "read-only" in result.errors[0]["error"]


def test_delete_reports_what_the_file_system_refuses(filled, monkeypatch):
    monkeypatch.setattr(manage, "remove_folder", lambda spark, folder: False)
    result = manage.delete_partitions(filled, "bars_by_market", date="2026-05-15")
    assert (result.partitions_deleted, result.rows_deleted, len(result.errors)) == (0, 0, 2)
    assert read_data(filled, "bars_by_market").count() == 6


def test_delete_of_unreadable_files(filled):
    folder = os.path.dirname(glob.glob(f"{filled.base}/**/market=XHKG/date=2026-05-15/*.parquet", recursive=True)[0])
    with open(f"{folder}/broken.parquet", "wb") as file:
        file.write(b"not parquet")
    result = manage.delete_partitions(filled, "bars_by_market", date="2026-05-15")
    assert (result.partitions_deleted, result.rows_deleted, result.errors) == (2, 2, [])
    assert len(result.unreadable) == 1 and read_data(filled, "bars_by_market").count() == 4


# ---------------------------------------------------------------- statistics and reports

def test_storage_stats_count_unreadable_files(filled):
    folder = os.path.dirname(glob.glob(f"{filled.base}/**/*.parquet", recursive=True)[0])
    sizes = sum(os.path.getsize(f) for f in glob.glob(f"{filled.base}/**/*.parquet", recursive=True))
    with open(f"{folder}/broken.parquet", "wb") as file:
        file.write(b"not parquet")
    row = stats.storage_stats(filled, "bars_by_market").first()
    assert (row["files"], row["rows"], row["bytes"]) == (7, 6, sizes)
    assert row["size_mb"] == round(sizes / 1024 / 1024, 2)


def test_unreachable_file_system_is_not_an_unreadable_file(spark):
    from barlake.sources.files import footers
    listed = spark.createDataFrame([("nosuch://host/a.parquet", 1)], "path string, length long")
    with pytest.raises(Exception, match="nosuch"):
        footers(listed).collect()


def test_footers_of_escaped_partition_folders(store, bars):
    write_data(store, bars(("2026-05-15", "c", "a/b%", "09:30", 1.0)), "bars_by_market")
    assert stats.file_metadata(store, "bars_by_market").first()["rows"] == 1


def test_file_metadata(filled):
    rows = stats.file_metadata(filled, "bars_by_market").collect()
    assert len(rows) == 6
    for row in rows:
        assert (row["rows"], row["column_count"], row["columns"]) == (1, 3, ["code", "time", "open"])
        assert row["error"] is None and row["format_version"] and row["length"] > 0


def test_partition_counts(filled):
    assert {r["rows"] for r in manage.partition_counts(filled, "bars_by_market").collect()} == {1}


def test_conformance(spark, store):
    location = store.location(FLAT)
    spark.createDataFrame([("1", "a", "1.0")], "code string, name string, close string").write.parquet(location)
    spark.createDataFrame([("2", 2.0, 5), ("3", 3.0, 6)], "code string, close double, more long").write.mode(
        "append").option("maxRecordsPerFile", 10).parquet(location)
    found = {(r["column"], r["stored_type"]): (r["declared"], r["conforms"], r["rows"])
             for r in stats.stored_conformance(store, "flat").collect()}
    assert found == {("code", "string"): ("string", True, 3), ("name", "string"): ("string", True, 1),
                     ("name", None): ("string", False, 2), ("close", "string"): ("double", False, 1),
                     ("close", "double"): ("double", True, 2), ("more", "int64"): (None, False, 2)}


def test_every_type_conforms_after_a_write(spark, store):
    from conftest import ALL_TYPES
    row = ["1"] * len(ALL_TYPES.columns)
    df = spark.createDataFrame([tuple(row)], ", ".join(f"{c} string" for c in ALL_TYPES.columns))
    assert write_data(store, df, "all_types").success
    assert stats.stored_conformance(store, "all_types").where("NOT conforms").count() == 0


def test_profile_and_reconciliation(filled, bars):
    after = read_data(filled, "bars_by_market")
    assert stats.value_profile(after, ["date", "market", "code"]).first().asDict() == {
        "date_values": 3, "market_values": 2, "code_values": 2}
    both = stats.reconcile(bars(*ROWS), after, ["open"], ["date", "market"])
    assert both.count() == 4 and both.where("NOT agrees").count() == 0
    short = stats.reconcile(bars(*ROWS[1:]), after, ["open"], ["date"])
    assert {r["measure"] for r in short.where("NOT agrees").collect()} == {"rows", "sum open"}


def test_reconciliation_is_exact_at_size(spark):
    big = spark.range(0, 1000, 1, 4).select((F.lit(9 * 10**15) + F.col("id")).alias("n"))
    less = big.withColumn("n", F.when(F.col("n") == 9 * 10**15, F.col("n") - 1).otherwise(F.col("n")))
    assert [r["agrees"] for r in stats.reconcile(big, less, ["n"]).where("measure = 'sum n'").collect()] == [False]
    widest = spark.range(3).select(F.lit(2**63 - 1).alias("n"))
    assert stats.reconcile(widest, widest, ["n"]).where("NOT agrees").count() == 0
    wild = spark.range(0, 200_000, 1, 8).select((F.rand(3) * 1e9).alias("x"))
    other_order = wild.repartition(3, F.col("x")).sortWithinPartitions("x")
    assert stats.reconcile(wild, other_order, ["x"]).where("NOT agrees").count() == 0


# The published totals of the round trip.
def test_round_trip_sums(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [("2026", "05", day, f"{9 + i // 12:02}:{i % 12 * 5:02}", market, code, "n",
             100.0 + k, 101.0 + k, 102.0, 99.0, 13430) for day in ("2026-05-21", "2026-05-22")
            for market, code, k in (("XHKG", "00700", 0.0), ("XSHG", "600519", 34.3)) for i in range(120)]
    df = spark.createDataFrame(rows, store.table("stock_5min").schema)
    write_data(store, df, "stock_5min")
    both = stats.reconcile(df, read_data(store, "stock_5min"), ["open", "close", "volume"],
                           ["date", "market", "stock_code"]).collect()
    values = {r["measure"]: r["after"] for r in both}
    assert all(r["agrees"] for r in both)
    assert values["rows"] == 480 and abs(values["sum open"] - 56232.0) < 0.01 and values["sum volume"] == 6446400


# ---------------------------------------------------------------- export

def test_records_keep_nulls(bars):
    row = records(bars(("2026-05-15", None, "XHKG", "09:30", None))).first()["record"]
    assert row == '{"date":"2026-05-15","code":null,"market":"XHKG","time":"09:30","open":null}'


def test_export(filled, spark, tmp_path):
    path = str(tmp_path / "out")
    described = export_records(filled, "bars_by_market", path, args={"f_market": "XHKG", "f_foo": "1"})
    assert described == {"data_type": "bars_by_market", "version": "v1", "total_rows": 3,
                         "filters": {"market": "XHKG"}, "warnings": ["No column for filter 'foo', it is left out"]}
    assert spark.read.schema(BARS_BY_MARKET.schema).json(path).count() == 3


def test_export_of_nothing(store, tmp_path):
    assert export_records(store, "stock_5min", str(tmp_path / "out"))["total_rows"] == 0
