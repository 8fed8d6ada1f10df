import glob
import math
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.columns import cleaned, with_calendar
from barlake.operators import checks, keys, write
from barlake.operators.write import route_batch, route_preview, write_data
from barlake.sources import scan
from barlake.sources.scan import read_data, read_stored
from barlake.tables import INDEX_CONSTITUENTS, STOCK_1DAY, STOCK_5MIN, Store, Table
from conftest import ALL_TYPES, BARS_BY_MARKET, BY_MONTH, FLAT, TABLES, partition_filters, plan_of, pushed_filters

ROW = ("2026-05-15", "00317", "XHKG", "09:30", 380.0)
OTHER = ("2026-05-15", "600421", "XSHG", "09:30", 1500.0)


def stored_rows(store, name="bars_by_market"):
    return sorted((tuple(r) for r in read_data(store, name).collect()), key=repr)


# ---------------------------------------------------------------- append and overwrite

def test_one_and_two_groups(store, bars):
    assert write_data(store, bars(ROW), "bars_by_market").partitions_written == 1
    result = write_data(store, bars(("2026-05-16", *ROW[1:]), ("2026-05-16", *OTHER[1:])), "bars_by_market")
    assert (result.partitions_written, result.total_rows) == (2, 2)
    assert result.paths == ["bars_by_market/XHKG/2026-05-16.parquet", "bars_by_market/XSHG/2026-05-16.parquet"]


def test_append_adds_other_times(store, bars):
    later = (*ROW[:3], "09:35", 381.0)
    write_data(store, bars(ROW), "bars_by_market")
    assert write_data(store, bars(later), "bars_by_market").success
    assert stored_rows(store) == [ROW, later]


def test_overwrite_replaces_only_touched_partitions(store, bars):
    write_data(store, bars(ROW, (*ROW[:3], "09:35", 1.0), OTHER), "bars_by_market")
    result = write_data(store, bars((*ROW[:4], 2.0)), "bars_by_market", mode="overwrite")
    assert result.success and result.duplicates_found == 0
    assert stored_rows(store) == [(*ROW[:4], 2.0), OTHER]


def test_partition_can_be_rewritten_from_itself(store, bars):
    write_data(store, bars(ROW, OTHER), "bars_by_market")
    changed = read_data(store, "bars_by_market", market="XHKG").withColumn("open", F.col("open") + 1)
    assert write_data(store, changed, "bars_by_market", mode="overwrite").success
    assert stored_rows(store) == [(*ROW[:4], 381.0), OTHER]


def test_unpartitioned_table_can_be_rewritten_from_itself(spark, store):
    rows = [("1", "a", 1.0), ("2", "b", 2.0)]
    write_data(store, spark.createDataFrame(rows, FLAT.schema), "flat")
    kept = read_data(store, "flat", code="2")
    assert write_data(store, kept, "flat", mode="overwrite").success
    assert stored_rows(store, "flat") == rows[1:]


def test_switches_and_modes(spark, bars, tmp_path):
    closed = Store(spark, str(tmp_path), TABLES)
    with pytest.raises(PermissionError):
        write_data(closed, bars(ROW), "bars_by_market", mode="overwrite")
    with pytest.raises(ValueError):
        write_data(closed, bars(ROW), "bars_by_market", mode="merge")
    with pytest.raises(KeyError):
        write_data(closed, bars(ROW), "bars_by_market", "v7")


def test_empty_batch_writes_nothing(spark, store, bars):
    for empty in (bars(), spark.createDataFrame([], "x string")):
        result = write_data(store, empty, "bars_by_market")
        assert result.success and (result.total_rows, result.partitions_written, result.paths) == (0, 0, [])
    assert not os.path.exists(store.base)


def test_missing_columns(spark, store, bars):
    result = write_data(store, bars(ROW).drop("open", "code"), "bars_by_market")
    assert not result.success and result.errors == ["Missing columns: ['code', 'open']"]
    with pytest.raises(ValueError):
        write_data(store, bars(ROW).drop("market"), "bars_by_market", validate_schema=False)
    assert write_data(store, bars(ROW).drop("open"), "bars_by_market", validate_schema=False).success
    assert stored_rows(store) == [(*ROW[:4], None)]


@pytest.mark.parametrize("codec", ["snappy", "gzip", "none"])
def test_codecs(spark, bars, tmp_path, codec):
    import pyarrow.parquet as pq
    store = Store(spark, str(tmp_path), TABLES, compression=codec)
    write_data(store, bars(ROW), "bars_by_market")
    file = glob.glob(f"{tmp_path}/**/*.parquet", recursive=True)[0]
    used = pq.ParquetFile(file).metadata.row_group(0).column(0).compression
    assert used == {"none": "UNCOMPRESSED"}.get(codec, codec.upper())
    assert stored_rows(store) == [ROW]


def test_unknown_codec_fails_at_write(spark, bars, tmp_path):
    store = Store(spark, str(tmp_path), TABLES, compression="nope")
    with pytest.raises(Exception):
        write_data(store, bars(ROW), "bars_by_market")


def test_row_limited_files(spark, store):
    rows = [("2026-05-15", f"{i:05}", "XHKG", "09:30", 1.0) for i in range(10)]
    write_data(store, spark.createDataFrame(rows, BARS_BY_MARKET.schema), "bars_by_market",
               max_records_per_file=3)
    assert len(glob.glob(f"{store.base}/**/*.parquet", recursive=True)) == 4
    assert stored_rows(store) == rows


def test_many_row_limited_files_are_dealt_over_tasks(spark, store):
    """The tasks go by files to make: a large partition and a single key are dealt over several of them."""
    rows = spark.range(0, 3_000, 1, 2).select(
        F.when(F.col("id") % 300 == 0, F.concat(F.lit("2026-04-"), F.lpad((F.col("id") / 300 + 1).cast("int").cast("string"), 2, "0")))
        .otherwise("2026-05-15").alias("date"), F.lit("000001").alias("code"), F.lit("XHKG").alias("market"),
        F.lit("09:30").alias("time"), F.col("id").cast("double").alias("open"))
    write_data(store, rows, "bars_by_market", max_records_per_file=5)
    files = glob.glob(f"{store.base}/**/*.parquet", recursive=True)
    hot = [os.path.basename(f) for f in files if "date=2026-05-15" in f]
    assert len({f.split("-")[1] for f in hot}) >= 5  # tasks that wrote it
    assert len(files) <= 10 + 3_000 / 5 + 7
    assert read_data(store, "bars_by_market").count() == read_data(store, "bars_by_market").distinct().count() == 3_000


def test_one_file_per_partition_sorted_by_key(spark, store):
    import pyarrow.parquet as pq
    rows = [(d, f"{i:05}", m, "09:30", 1.0) for d in ("2026-05-15", "2026-05-16") for i in range(50, 0, -1)
            for m in ("XHKG", "XSHG")]
    df = spark.createDataFrame(rows, BARS_BY_MARKET.schema).repartition(8)
    write_data(store, df, "bars_by_market")
    files = glob.glob(f"{store.base}/**/*.parquet", recursive=True)
    assert len(files) == 4
    codes = pq.ParquetFile(files[0]).read(columns=["code"])["code"].to_pylist()
    assert codes == sorted(codes)


def test_hot_partition_is_split_and_small_ones_joined(spark, store):
    rows = spark.range(0, 40_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("2026-05-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")))
        .otherwise("2026-05-15").alias("date"), F.col("id").cast("string").alias("code"),
        F.rand(1).alias("open"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50KB")
    try:
        assert write_data(store, rows, "daily_min").total_rows == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    hot = glob.glob(f"{store.base}/**/date=2026-05-15/*.parquet", recursive=True)
    cold = glob.glob(f"{store.base}/**/date=2026-05-16/*.parquet", recursive=True)
    assert len(hot) > 3 and len(cold) == 1
    assert read_data(store, "daily_min").count() == 40_000


# ---------------------------------------------------------------- duplicates

def test_stored_key_is_refused_or_left_out(store, bars):
    write_data(store, bars(ROW), "bars_by_market")
    refused = write_data(store, bars((*ROW[:4], 9.0), OTHER), "bars_by_market")
    assert not refused.success and "duplicate" in refused.errors[0]
    assert stored_rows(store) == [ROW]  # nothing of the batch was written
    result = write_data(store, bars((*ROW[:4], 9.0), OTHER), "bars_by_market", remove_duplicates=True)
    assert (result.duplicates_found, result.duplicates_removed, result.total_rows) == (1, 1, 1)
    assert stored_rows(store) == [ROW, OTHER]


def test_all_rows_stored_already(store, bars):
    write_data(store, bars(ROW), "bars_by_market")
    before = glob.glob(f"{store.base}/**/*.parquet", recursive=True)
    result = write_data(store, bars(ROW, ROW), "bars_by_market", remove_duplicates=True)
    assert result.success and (result.total_rows, result.duplicates_removed) == (0, 2)
    assert glob.glob(f"{store.base}/**/*.parquet", recursive=True) == before


def test_check_can_be_switched_off(store, bars):
    write_data(store, bars(ROW), "bars_by_market")
    assert write_data(store, bars(ROW), "bars_by_market", check_duplicates=False).success
    assert stored_rows(store) == [ROW, ROW]


def test_same_key_in_another_partition_is_no_duplicate(store, bars):
    write_data(store, bars(ROW), "bars_by_market")
    assert write_data(store, bars((*ROW[:2], "XSHG", *ROW[3:])), "bars_by_market").success


def test_repeats_inside_a_batch(store, bars):
    batch = bars(ROW, (*ROW[:4], 381.0), OTHER)
    result = write_data(store, batch, "bars_by_market")
    assert (result.total_rows, result.duplicates_in_batch) == (3, 1)
    single = write_data(store, bars(*[("2026-06-01", *r[1:]) for r in (ROW, ROW, OTHER)]),
                        "bars_by_market", drop_repeats=True)
    assert (single.total_rows, single.duplicates_in_batch) == (2, 1)
    assert read_data(store, "bars_by_market", date="2026-06-01").count() == 2


def test_dropping_repeats_and_stored_keys_together(store, bars):
    write_data(store, bars(ROW), "bars_by_market")
    result = write_data(store, bars(ROW, ROW, OTHER, OTHER), "bars_by_market",
                        remove_duplicates=True, drop_repeats=True)
    assert (result.total_rows, result.duplicates_removed) == (1, 2)
    assert stored_rows(store) == [ROW, OTHER]


NULLS = [("2026-05-15", None, "XHKG", "09:30", 1.0), ("2026-05-15", "a", "XHKG", None, 2.0),
         ("2026-05-15", None, "XHKG", None, 3.0), (None, "a", "XHKG", "09:30", 4.0)]


@pytest.fixture(params=["broadcast keys", "bounded rows", "all rows"])
def key_path(request, monkeypatch):
    if request.param != "all rows":
        monkeypatch.setattr(write, "NARROW_STORED_BYTES", 1)
    if request.param == "bounded rows":
        monkeypatch.setattr(write, "BROADCAST_KEY_BYTES", -1)
    return request.param


def test_null_keys_match_null_keys(store, bars, key_path):
    write_data(store, bars(*NULLS), "bars_by_market")
    fresh = ("2026-05-15", "", "XHKG", None, 5.0)  # empty text is not null
    result = write_data(store, bars(*NULLS, fresh), "bars_by_market", remove_duplicates=True)
    assert (result.duplicates_found, result.total_rows) == (4, 1)
    assert stored_rows(store) == sorted([*NULLS, fresh], key=repr)


def brute_force(batch, stored, positions):
    key = lambda r: tuple(r[i] for i in positions)
    known = {key(r) for r in stored}
    return [r for r in batch if key(r) in known]


def test_matching_agrees_with_brute_force(spark, store, key_path):
    make = lambda n, step: [(f"2026-05-{1 + i % 5:02}", f"{i % 7}" if i % 11 else None,
                             "XHKG" if i % 2 else "XSHG", f"{i % 13:02}:00", float(i))
                            for i in range(0, n, step)]
    stored, batch = make(300, 3), make(400, 1)
    positions = (0, 1, 2, 3)
    frame = lambda rows: spark.createDataFrame(rows, BARS_BY_MARKET.schema)
    write_data(store, frame(stored), "bars_by_market")
    expected = brute_force(batch, stored, positions)
    found = keys.find_duplicates(frame(batch), read_stored(store, BARS_BY_MARKET), BARS_BY_MARKET.identity)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    result = write_data(store, frame(batch), "bars_by_market", remove_duplicates=True)
    assert result.duplicates_found == len(expected)
    assert result.duplicates_in_batch == len(batch) - len({tuple(r[i] for i in positions) for r in batch})
    left = [r for r in batch if r not in expected]
    assert stored_rows(store) == sorted(stored + left, key=repr)


def test_hot_key_is_split_by_adaptive_execution(spark):
    hot = spark.range(0, 60_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"),
        F.repeat(F.lit("x"), 50).alias("v"))
    stored = spark.range(0, 60_000, 2, 6).select(F.col("id").cast("string").alias("k")).union(
        spark.range(1000).select(F.lit(None).cast("string")))
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1",
               "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
               "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
               "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
               "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        found = keys.find_duplicates(hot, stored, ["k"])
        assert len(found.collect()) == 20_000 + 20_000
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in text and "skew=true" in text
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_key_count_shuffles_each_side_once(spark, store, bars):
    write_data(store, bars(ROW), "bars_by_market")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = keys.key_counts(bars(ROW, OTHER), read_stored(store, BARS_BY_MARKET), BARS_BY_MARKET.identity)
        assert plan_of(counts).count("Exchange hashpartitioning") == 2
        assert tuple(counts.first()) == (2, 1, 0, 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_touched_partitions_are_read(store, bars):
    write_data(store, bars(ROW, OTHER, ("2026-05-16", *ROW[1:])), "bars_by_market")
    route = route_batch(bars((*ROW[:4], 5.0)), BARS_BY_MARKET)
    stored = write.read_touched(store, BARS_BY_MARKET, route)
    assert stored.count() == 1
    assert "XHKG" in partition_filters(stored)[0] and "2026-05-15" in partition_filters(stored)[0]
    bounded = write.within_key_bounds(stored, bars((*ROW[:4], 5.0)), BARS_BY_MARKET)
    assert bounded.count() == 1 and "GreaterThanOrEqual(code,00317)" in pushed_filters(bounded)[0]


def test_only_touched_folders_are_listed(store, bars):
    write_data(store, bars(ROW, OTHER, ("2026-05-16", *ROW[1:])), "bars_by_market")
    batch = bars((*ROW[:4], 5.0), ("2026-07-01", *ROW[1:]))
    route = route_batch(batch, BARS_BY_MARKET)
    folders = write.touched_folders(store, BARS_BY_MARKET, route)
    assert [f.split("/v1/")[1] for f in folders] == ["market=XHKG/date=2026-05-15"]
    stored = write.read_touched(store, BARS_BY_MARKET, route, folders)
    assert [tuple(r) for r in stored.collect()] == [ROW] and len(stored.inputFiles()) == 1
    odd = route_batch(bars((*ROW[:2], "a/b", *ROW[3:])), BARS_BY_MARKET)
    assert write.touched_folders(store, BARS_BY_MARKET, odd) is None
    new = route_batch(bars(("2026-07-01", *ROW[1:])), BARS_BY_MARKET)
    assert write.touched_folders(store, BARS_BY_MARKET, new) == []
    assert write.touched_bytes(store, BARS_BY_MARKET, new, []) == 0


def test_batch_checks_do_not_sort_the_rows(bars, monkeypatch):
    seen = []
    collect = type(bars(ROW)).collect
    monkeypatch.setattr(type(bars(ROW)), "collect", lambda df: (seen.append(plan_of(df)), collect(df))[1])
    route_batch(bars(ROW), BARS_BY_MARKET)
    assert "HashAggregate" in seen[0] and "SortAggregate" not in seen[0]


def test_many_partitions_are_bounded_instead_of_listed(store, bars, monkeypatch):
    rows = [(f"2026-05-{d:02}", f"{d}", "XHKG", "09:30", 1.0) for d in range(1, 21)]
    write_data(store, bars(*rows), "bars_by_market")
    monkeypatch.setattr(write, "EXACT_PARTITIONS", 3)
    batch = bars(*rows[5:15], ("2026-06-01", None, "XHKG", "09:30", 1.0))
    route = route_batch(batch, BARS_BY_MARKET)
    assert (route.rows, route.partitions, len(route.paths)) == (11, 11, 11)
    result = write_data(store, batch, "bars_by_market", remove_duplicates=True)
    assert (result.duplicates_found, result.total_rows) == (10, 1)
    assert len(stored_rows(store)) == 21


def test_every_path_is_returned_however_many(spark, store):
    df = spark.range(1500).select(F.format_string("d%05d", "id").alias("date"), F.lit("c").alias("code"),
                                  F.lit(1.0).alias("open"))
    result = write_data(store, df, "daily_min", count_repeats=False)
    assert result.partitions_written == 1500
    assert result.paths == [f"daily_min/d{k:05}.parquet" for k in range(1500)]


def test_the_smallest_of_repeated_rows_stays(store, bars):
    batch = bars((*ROW[:4], 3.0), (*ROW[:4], 1.0), (*ROW[:4], 2.0), OTHER).withColumn("arrived", F.col("open") * -1)
    assert write_data(store, batch.drop("arrived"), "bars_by_market", drop_repeats=True).total_rows == 2
    assert stored_rows(store) == [(*ROW[:4], 1.0), OTHER]
    later = batch.withColumn("date", F.lit("2026-06-01"))
    assert write_data(store, later, "bars_by_market", drop_repeats=True, order=["arrived"]).success
    assert (("2026-06-01", *ROW[1:4], 3.0)) in stored_rows(store)


def test_failed_overwrite_leaves_the_old_rows(spark, store, monkeypatch):
    rows = [("1", "a", 1.0), ("2", "b", 2.0)]
    df = spark.createDataFrame(rows, FLAT.schema)
    write_data(store, df, "flat")
    from dataclasses import replace
    with pytest.raises(ValueError):
        write_data(replace(store, compression="nope"), df, "flat", mode="overwrite")
    fails = read_data(store, "flat").withColumn("name", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        write_data(store, fails, "flat", mode="overwrite", stage=False)
    real = write.rename_folder

    def refuse(spark, path, target):
        if path.endswith("-new"):
            raise OSError("no rename")
        real(spark, path, target)

    monkeypatch.setattr(write, "rename_folder", refuse)
    with pytest.raises(OSError):
        write_data(store, df.limit(1), "flat", mode="overwrite")
    assert stored_rows(store, "flat") == rows


def test_extra_columns_keep_their_stored_type(spark, store):
    row = spark.createDataFrame([("2026-05-15", "a", 1.0, 2.5)], "date string, code string, open double, x double")
    assert write_data(store, row, "daily_min", extra_columns=True).success
    other = row.withColumns({"x": F.lit("text"), "code": F.lit("b")})
    refused = write_data(store, other, "daily_min", extra_columns=True)
    assert refused.errors == ["Column x is stored as double, not string"]
    assert [r["x"] for r in read_data(store, "daily_min", extra_columns=True).collect()] == [2.5]


def test_moments_and_whole_numbers_with_a_point(spark, store):
    df = spark.sql("""SELECT '1' AS id, TIMESTAMP_NTZ '2026-05-15 09:30:00.250' AS a_stamp, '1000.0' AS a_int64, '7.00' AS a_uint64
                      UNION ALL SELECT '2', TIMESTAMP_NTZ '1969-12-31 23:59:59', '-1e3', null""")
    assert write_data(store, df, "all_types", validate_schema=False).success
    rows = {r["id"]: (r["a_stamp"], r["a_int64"], r["a_uint64"]) for r in read_data(store, "all_types").collect()}
    assert rows == {"1": (1778837400250, 1000, Decimal(7)), "2": (-1000, -1000, None)}
    day = spark.sql("SELECT '3' AS id, DATE '2026-05-15' AS a_stamp")
    assert write_data(store, day, "all_types", validate_schema=False).success
    assert read_data(store, "all_types", id="3").first()["a_stamp"] == 1778803200000
    bad = spark.createDataFrame([("4", "1000.5")], "id string, a_int64 string")
    assert not write_data(store, bad, "all_types", validate_schema=False).success


def test_unfit_types_are_reported(spark, store):
    df = spark.sql("SELECT '1' AS id, X'00' AS a_int64, current_date() AS a_double")
    full = df.select("*", *[F.lit(None).cast("string").alias(c) for c in ALL_TYPES.columns if c not in df.columns])
    [error] = write_data(store, full, "all_types").errors
    assert "a_int64 (binary)" in error and "a_double (date)" in error
    counts = {r["column"]: r["failed"] for r in checks.type_report(df, ALL_TYPES).collect()}
    assert (counts["a_int64"], counts["a_double"]) == (1, 1)


def test_the_source_is_read_once(spark, store, bars):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    write_data(store, bars(ROW), "bars_by_market")
    source = bars(ROW, OTHER, (*OTHER[:3], "09:35", 1.0)).mapInPandas(count, BARS_BY_MARKET.schema)
    result = write_data(store, source, "bars_by_market", remove_duplicates=True, drop_repeats=True)
    assert (result.total_rows, read.value) == (2, 3)


@pytest.mark.parametrize("limit", [write.BROADCAST_KEY_BYTES, -1])
def test_rows_are_read_twice_behind_the_counts(spark, store, bars, monkeypatch, limit):
    """Once for the rows whose key is neither stored nor repeated, and once for the repeated ones."""
    monkeypatch.setattr(write, "BROADCAST_KEY_BYTES", limit)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    write_data(store, bars(ROW), "bars_by_market")
    several = [(*OTHER[:3], None, 3.0), (*OTHER[:3], None, 2.0)]
    source = bars(ROW, ROW, OTHER, *several).mapInPandas(count, BARS_BY_MARKET.schema)
    result = write_data(store, source, "bars_by_market", remove_duplicates=True, drop_repeats=True, stage=False)
    assert (result.total_rows, result.duplicates_removed, result.duplicates_in_batch) == (2, 2, 2)
    assert stored_rows(store) == sorted([ROW, OTHER, several[1]], key=repr)
    assert read.value <= 4 * 5  # the checks, the keys and those two


def test_members_need_their_own_key(spark, store, tmp_path):
    first = spark.createDataFrame([("hsi", "a", "a", "2026-05-19", 2026, 5, "00700", "T")],
                                  ["index_code", "index_name_en", "index_name_cn", "date", "Year",
                                   "Month", "stock_code", "stock_name"])
    second = first.withColumn("stock_code", F.lit("00005"))
    assert write_data(store, first, "index_constituents").success
    assert not write_data(store, second, "index_constituents").success
    assert read_data(store, "index_constituents").first()["Year"] == "2026"  # cast to the declared text
    from dataclasses import replace
    wide = Store(spark, str(tmp_path / "wide"),
                 (replace(INDEX_CONSTITUENTS, key=("date", "index_code", "stock_code")),))
    assert write_data(wide, first, "index_constituents").success
    assert write_data(wide, second, "index_constituents").success


# ---------------------------------------------------------------- values and types

def test_types_are_cast_before_the_write(spark, store):
    source = spark.createDataFrame(
        [("r", "5", 5.0, "7", 3, Decimal("18446744073709551615"), "0.5", 2, 1, "2026-05-15", None, "12")],
        "id string, a_int64 string, a_int32 double, a_int16 string, a_int8 int, a_uint64 decimal(25,0), "
        "a_float string, a_double int, a_bool int, a_date string, a_datetime string, a_stamp string")
    assert write_data(store, source, "all_types").success
    row = read_data(store, "all_types").first()
    assert tuple(row) == ("r", 5, 5, 7, 3, Decimal(2**64 - 1), 0.5, 2.0, True, "2026-05-15", None, 12)


@pytest.mark.parametrize("column, value, kind", [
    ("a_int64", "abc", "string"), ("a_int64", "1.5", "string"), ("a_int64", 1.5, "double"),
    ("a_int64", 1e30, "double"), ("a_int8", 300, "long"), ("a_uint64", -1, "long"),
    ("a_uint64", "1.5", "string"), ("a_uint64", str(2**64), "string"), ("a_double", "x", "string"),
    ("a_bool", "maybe", "string"), ("a_stamp", "soon", "string")])
def test_values_that_do_not_fit_are_refused(spark, store, column, value, kind):
    row = {c: None for c in ALL_TYPES.columns} | {"id": "r"}
    schema = T.StructType([T.StructField(c, T.StringType()) for c in row])
    df = spark.createDataFrame([tuple(row.values())], schema).withColumn(column, F.lit(value).cast(kind))
    result = write_data(store, df, "all_types")
    assert not result.success and f"column {column}: 1 rows" in result.errors[0]
    report = {r["column"]: r["failed"] for r in checks.type_report(df, ALL_TYPES).collect()}
    assert report.pop(column) == 1 and not any(report.values())


def test_nan_becomes_null(spark, store):
    df = spark.createDataFrame([("1", "a", math.nan), ("2", "b", 2.0)], FLAT.schema)
    write_data(store, df, "flat")
    assert stored_rows(store, "flat") == [("1", "a", None), ("2", "b", 2.0)]
    assert read_data(store, "flat", close={"start": "1"}).count() == 1


def test_whole_number_column_with_nan_from_pandas(spark, store):
    df = spark.createDataFrame([("r", 5.0), ("s", math.nan)], "id string, a_int64 double")
    assert write_data(store, df, "all_types", validate_schema=False).success
    assert {r["id"]: r["a_int64"] for r in read_data(store, "all_types").collect()} == {"r": 5, "s": None}


def test_timestamps_become_epoch_milliseconds(spark, store):
    df = spark.createDataFrame([("r",)], "id string").withColumn(
        "a_stamp", F.lit("2026-05-15 09:30:00.250").cast("timestamp"))
    write_data(store, df, "all_types", validate_schema=False)
    assert read_data(store, "all_types").first()["a_stamp"] == 1778837400250


def test_nested_columns_are_refused(spark, store):
    df = spark.createDataFrame([("1", ["a"], 1.0)], "code string, name array<string>, close double")
    assert write_data(store, df, "flat").errors == ["Nested columns: ['name']"]


@pytest.mark.parametrize("value", ["a/b", "a=b", "a*b", "a b", "a%2Fb", "北", None])
def test_partition_values_round_trip(store, bars, value):
    row = (*ROW[:2], value, *ROW[3:])
    assert write_data(store, bars(row, OTHER), "bars_by_market").success
    assert row in stored_rows(store)
    assert not write_data(store, bars(row), "bars_by_market").success
    if value is not None:
        assert read_data(store, "bars_by_market", market=value).count() == 1


def test_blank_partition_value_is_refused(store, bars):
    result = write_data(store, bars((*ROW[:2], "", *ROW[3:])), "bars_by_market")
    assert result.errors == ["Blank partition value: 1 rows"]


def test_values_of_one_text_share_a_partition(spark, store):
    df = spark.createDataFrame([(5, "a", 1.0)], "date int, code string, open double").union(
        spark.createDataFrame([("5", "b", 2.0)], "date string, code string, open double"))
    assert write_data(store, df, "daily_min").partitions_written == 1
    assert read_data(store, "daily_min", date="5").count() == 2


def test_calendar_columns_must_agree_with_the_date(spark, store):
    row = ("2026", "05", "2026-06-15", "XHKG", "00700", "T", 1.0, 2.0, 3.0, 0.5, 10)
    df = spark.createDataFrame([row], STOCK_1DAY.schema)
    assert write_data(store, df, "stock_1day").errors == ["Year or Month differs from date: 1 rows"]
    assert write_data(store, with_calendar(df), "stock_1day").success


def test_derived_partitions(spark, store):
    df = spark.createDataFrame([("2026-05-15", "a", 1.0), ("2026-06-15", "a", 1.0)], BY_MONTH.schema)
    result = write_data(store, df, "by_month")
    assert result.paths == ["by_month/2026/05.parquet", "by_month/2026/06.parquet"]
    assert write_data(store, df, "by_month", remove_duplicates=True).duplicates_removed == 2


def test_required_and_allowed_values(spark, tmp_path):
    table = Table("t", "v1", {"code": "string", "market": "string", "open": "double"}, "t.parquet",
                  required=("code",), allowed={"market": ("XHKG", "XSHG")})
    store = Store(spark, str(tmp_path), (table,))
    df = spark.createDataFrame([(None, "XHKG", 1.0), ("b", "NYSE", 1.0), ("c", None, None)], table.schema)
    report = {r["column"]: (r["missing"], r["outside"]) for r in checks.value_report(df, table).collect()}
    assert report == {"code": (1, 0), "market": (0, 1)}
    assert len(write_data(store, df, "t").errors) == 2


def test_staged_batch_is_written_once_and_removed(spark, store, bars):
    from barlake.sources.scratch import shared_folder
    noisy = bars(ROW).withColumn("open", F.rand())
    assert write_data(store, noisy, "bars_by_market", stage=True).success
    assert not glob.glob(f"{shared_folder(spark)}/barlake-stage-*")


def test_without_spreading_every_row_is_still_written(spark, store):
    rows = [(f"2026-05-{1 + i % 9:02}", f"{i}", "XHKG", "09:30", 1.0) for i in range(90)]
    df = spark.createDataFrame(rows, BARS_BY_MARKET.schema).repartition(3)
    write_data(store, df, "bars_by_market", spread=False)
    assert stored_rows(store) == sorted(rows)


# ---------------------------------------------------------------- routing and cleaning

def test_route_preview(bars):
    preview = route_preview(bars(ROW, ROW, OTHER, (None, *ROW[1:])), BARS_BY_MARKET)
    assert {(r["path"], r["rows"]) for r in preview.collect()} == {
        ("bars_by_market/XHKG/2026-05-15.parquet", 2), ("bars_by_market/XSHG/2026-05-15.parquet", 1),
        ("bars_by_market/XHKG/.parquet", 1)}
    with pytest.raises(ValueError):
        route_preview(bars(ROW).drop("date"), BARS_BY_MARKET)


def test_route_of_unpartitioned_table(spark):
    df = spark.createDataFrame([("1", "a", 1.0)], FLAT.schema)
    assert [tuple(r) for r in route_preview(df, FLAT).select("path", "rows").collect()] == [("flat.parquet", 1)]


def test_cleaning(spark):
    df = spark.createDataFrame([("700", "20260515", "093000", 1.0), ("600519", "20260516", "0935", None),
                                ("1", "bad", "093500", 2.0)], "code string, date string, time string, open double")
    rows = cleaned(df, codes={"code": 5}, days={"date": "yyyyMMdd"}, times={"time": "HHmmss"}).collect()
    assert [tuple(r) for r in rows] == [("00700", "2026-05-15", "09:30", 1.0), ("600519", "2026-05-16", None, None),
                                        ("00001", None, "09:35", 2.0)]
    assert cleaned(df, drop_nulls=["open"]).count() == 2
    assert cleaned(df, days={"date": "yyyyMMdd"}, drop_nulls=True).count() == 1


def test_multi_day_write_makes_one_partition_per_day(spark, store):
    rows = [("2026", "05", f"2026-05-{d}", f"{9 + i // 12:02}:{i % 12 * 5:02}", "XHKG", f"{c:05}", "n",
             1.0, 1.0, 1.0, 1.0, 1) for d in (18, 19, 20) for i in range(48) for c in range(5)]
    result = write_data(store, spark.createDataFrame(rows, STOCK_5MIN.schema), "stock_5min")
    assert (result.total_rows, result.partitions_written) == (720, 3)
    counts = read_data(store, "stock_5min").groupBy("date").count().collect()
    assert {r["count"] for r in counts} == {240}
    assert scan.read_stored(store, STOCK_5MIN).count() == 720
