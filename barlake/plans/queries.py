"""The registered queries: each stores bars through the checked write and works on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.columns import cleaned
from barlake.operators import checks, keys, manage, stats
from barlake.operators.export import export_records
from barlake.operators.ingest import ingest_envelopes
from barlake.operators.layout import compact, key_ranges
from barlake.operators.pages import page
from barlake.operators.profiles import merged_profile, update_profile
from barlake.operators.requests import answer_requests, count_requests
from barlake.operators.series import daily, missing_ranges, roll_up
from barlake.operators.write import read_touched, route_batch, route_preview, write_data
from barlake.plans.bridge import BARS1D, BARS5, MEMBERS, bars1d, bars5, load, members, moment
from barlake.sources.scan import query_data, read_data
from barlake.sources.scratch import kept, new_folder
from barlake.streaming.ingest import ingest_stream
from barlake.tables import Store, Table

SOURCES = {BARS5.name: bars5, BARS1D.name: bars1d, MEMBERS.name: members}
BARS1D_V2 = Table("stock_1day", "v2", {**BARS1D.columns, "amount": "double"}, BARS1D.path,
                  calendar=True, reads=("v1",))
FLAT5 = Table("flat_bars", "v1", BARS5.columns, "flat.parquet", key=("volume",))
EVENT_TIMES = Table("event_times", "v1", {"event_id": "int64", "ts": "timestamp", "day": "timestamp", "text": "int64"},
                    "event_times.parquet", key=("event_id",))
KEYED5 = replace(BARS5, name="keyed_5min", key_filter=True)
CHECKED5 = replace(BARS5, required=("open",), allowed={"market": ("view", "click", "purchase")})

_loaded: dict[tuple[str, str, str], Store] = {}


def new_store(spark: SparkSession, **options) -> Store:
    """An empty store in a folder of its own."""
    return Store(spark, new_folder(spark, "query"), (BARS5, BARS1D, BARS1D_V2, MEMBERS, FLAT5, EVENT_TIMES, KEYED5),
                 **{"allow_overwrite": True, "allow_delete": True, **options})


def put(store: Store, data: DataFrame, name: str, version: str = "v1", **options) -> None:
    result = write_data(store, data, name, version, **options)
    if not result.success:
        raise ValueError(f"{name} refused: {result.errors}")


def loaded(spark: SparkSession, sf_dir: str, name: str) -> Store:
    """A store holding the whole bridge table, written once per session and only read after."""
    place = (spark.sparkContext.applicationId, sf_dir, name)
    if place not in _loaded:
        store = new_store(spark)
        put(store, SOURCES[name](spark, sf_dir), name, count_repeats=False)
        _loaded[place] = store
    return _loaded[place]


def fresh(spark: SparkSession, sf_dir: str, name: str) -> Store:
    """A store of its own holding the whole bridge table, for queries that change it."""
    store = new_store(spark)
    put(store, SOURCES[name](spark, sf_dir), name, count_repeats=False)
    return store


def _filtered(name: str, **args: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query_data(loaded(spark, sf_dir, name), name,
                          args={f"f_{c}": text for c, text in args.items()})[0]
    return run


# ---------------------------------------------------------------- reads

def read_all(spark, sf_dir):
    return read_data(loaded(spark, sf_dir, "stock_1day"), "stock_1day")


def project_columns(spark, sf_dir):
    return read_data(loaded(spark, sf_dir, "stock_5min"), "stock_5min",
                     columns=["date", "stock_code", "close"])


def ops_suffix(spark, sf_dir):
    return read_data(loaded(spark, sf_dir, "stock_5min"), "stock_5min", filters={
        "close__gt": "20", "market__ne": "view", "stock_name__like": "U1",
        "time__between": ["09:30", "16:00"], "volume__gte": "100"})


def cross_version(spark, sf_dir):
    store, bars = new_store(spark), bars1d(spark, sf_dir)
    put(store, bars.where(F.col("date") < "1998-01-01"), "stock_1day")
    put(store, bars.where(F.col("date") >= "1998-01-01").withColumn("amount", F.col("open") * 2),
        "stock_1day", "v2")
    return read_data(store, "stock_1day", "v2")


def extra_columns(spark, sf_dir):
    """An undeclared column stored in both versions of a table, read over both."""
    store = new_store(spark)
    bars = bars1d(spark, sf_dir).withColumn("note", F.col("open") * 2)
    put(store, bars.where(F.col("date") < "1996-01-01"), "stock_1day", extra_columns=True)
    put(store, bars.where(F.col("date") >= "1996-01-01").withColumn("amount", F.col("open") * 3),
        "stock_1day", "v2", extra_columns=True)
    return read_data(store, "stock_1day", "v2", extra_columns=True, filters={"note": {"start": "500000"}})


def paged(spark, sf_dir):
    """The first three pages of a result, each begun behind the cursor of the one before."""
    store, found, after = loaded(spark, sf_dir, "stock_1day"), [], None
    for _ in range(3):
        own = page(store, "stock_1day", 100, after=after, filters={"open": {"start": "50000"}})
        found, after = found + own.rows, own.cursor
        if after is None:
            break
    return spark.createDataFrame(found, BARS1D.schema)


# ---------------------------------------------------------------- time series

SESSIONS = (("09:30", "12:00"), ("13:00", "16:00"))


def rolled_bars(spark, sf_dir):
    """Bars of 30 and 60 minutes and of the day's sessions."""
    bars = read_data(loaded(spark, sf_dir, "stock_5min"), "stock_5min")
    halves = roll_up(bars, 30, SESSIONS).withColumn("span", F.lit("30"))
    hours = roll_up(bars, 60).withColumn("span", F.lit("60"))
    days = daily(bars, SESSIONS).withColumns({"span": F.lit("day"), "time": F.lit("")})
    return halves.unionByName(hours).unionByName(days)


def missing_bars(spark, sf_dir):
    """Ranges of five-minute steps of a day for which a market has no bar."""
    bars = read_data(loaded(spark, sf_dir, "stock_5min"), "stock_5min")
    return missing_ranges(bars, 5, SESSIONS, by=["date", "market"])


# ---------------------------------------------------------------- writes

def append_two_batches(spark, sf_dir):
    store, bars = new_store(spark), bars5(spark, sf_dir)
    put(store, bars.where(F.col("date") < "2024-01-16"), "stock_5min")
    put(store, bars.where(F.col("date") >= "2024-01-16"), "stock_5min")
    return read_data(store, "stock_5min")


def overwrite_partition(spark, sf_dir):
    store = fresh(spark, sf_dir, "stock_5min")
    later = bars5(spark, sf_dir).where(F.col("date") >= "2024-01-20")
    put(store, later.withColumn("close", F.col("close") + 1.0), "stock_5min", mode="overwrite")
    return read_data(store, "stock_5min")


def overwrite_unpartitioned(spark, sf_dir):
    """A table in one folder, replaced by rows read from itself."""
    store = new_store(spark)
    put(store, bars5(spark, sf_dir), "flat_bars")
    put(store, read_data(store, "flat_bars", market=["view", "click"]), "flat_bars", mode="overwrite")
    return read_data(store, "flat_bars")


def timestamps_stored(spark, sf_dir):
    """Moments without zone, dates and whole numbers written with a point, stored as whole numbers."""
    store, ts = new_store(spark), F.col("ts")
    events = load(spark, sf_dir, "events").select(
        "event_id", ts, ts.cast("date").alias("day"), F.concat(F.col("user_id").cast("string"), F.lit(".0")).alias("text"))
    put(store, events, "event_times")
    return read_data(store, "event_times")


def write_outcomes(spark, sf_dir):
    """What writes, deletes and reads report that do nothing or may not be done."""
    bars, store = bars5(spark, sf_dir), new_store(spark, allow_overwrite=False, allow_delete=False)

    def refused(action: Callable[[], object], error: type[Exception] = PermissionError) -> bool:
        try:
            action()
        except error:
            return True
        return False

    empty = write_data(store, bars.where(F.lit(False)), "stock_5min")
    missing = write_data(store, bars.drop("open"), "stock_5min")
    unknown = write_data(store, bars.withColumn("open", F.lit(b"x")), "stock_5min")
    nothing = read_data(store, "stock_5min").count()
    written = write_data(store, bars.drop("open"), "stock_5min", validate_schema=False)
    stored = read_data(store, "stock_5min")
    size = stats.storage_stats(store, "stock_5min").first()
    outcomes = [
        ("empty batch", empty.success, empty.total_rows), ("missing column", missing.success, missing.total_rows),
        ("unfit type", unknown.success, unknown.total_rows), ("nothing stored", True, nothing),
        ("unchecked batch", written.success, written.total_rows),
        ("column not in files is null", True, stored.where("open IS NULL").count()),
        ("partition values stay text", dict(stored.dtypes)["Month"] == "string", stored.where("Month = '01'").count()),
        ("overwrite off", refused(lambda: write_data(store, bars, "stock_5min", mode="overwrite")), 0),
        ("delete off", refused(lambda: manage.delete_partitions(store, "stock_5min", date="2024-01-15")), 0),
        ("unknown mode", refused(lambda: write_data(store, bars, "stock_5min", mode="merge"), ValueError), 0),
        ("size in megabytes", size["size_mb"] == round(size["bytes"] / 1024 / 1024, 2), size["unreadable"])]
    return spark.createDataFrame(outcomes, '"case" string, holds boolean, "rows" long'.replace('"', "`"))


def _half_stored(spark, sf_dir) -> tuple[Store, DataFrame]:
    """Bars of all markets but `purchase` stored, and all bars as the next batch."""
    store, bars = new_store(spark), bars5(spark, sf_dir)
    put(store, bars.where(F.col("market") != "purchase"), "stock_5min", count_repeats=False)
    return store, bars


def find_duplicates(spark, sf_dir):
    store, batch = _half_stored(spark, sf_dir)
    stored = read_touched(store, BARS5, route_batch(batch, BARS5))
    return keys.find_duplicates(batch, stored, BARS5.identity)


def find_duplicates_filtered(spark, sf_dir):
    """The first bars of each day and market, looked for through the key filters of the stored files."""
    store, bars = new_store(spark), bars5(spark, sf_dir)
    for half in (F.col("volume") % 2 == 0, F.col("volume") % 2 == 1):
        put(store, bars.where(F.col("market") != "purchase").where(half), "keyed_5min", check_duplicates=False)
    first = bars.groupBy("date", "market").agg(F.min("volume").alias("volume"))
    batch = bars.join(F.broadcast(first), ["date", "market", "volume"], "left_semi")
    stored = read_touched(store, KEYED5, route_batch(batch, KEYED5), None, batch)
    return keys.find_duplicates(batch, stored, KEYED5.identity)


def remove_duplicates(spark, sf_dir):
    store, batch = _half_stored(spark, sf_dir)
    stored = read_touched(store, BARS5, route_batch(batch, BARS5))
    return keys.remove_duplicates(batch, stored, BARS5.identity)


def append_dedup(spark, sf_dir):
    store, batch = _half_stored(spark, sf_dir)
    put(store, batch, "stock_5min", remove_duplicates=True)
    return read_data(store, "stock_5min")


def duplicate_counts(spark, sf_dir):
    store, batch = _half_stored(spark, sf_dir)
    result = write_data(store, batch, "stock_5min", remove_duplicates=True)
    after = stats.storage_stats(store, "stock_5min")
    return after.select("rows", F.lit(result.total_rows).cast("long").alias("written"),
                        F.lit(result.duplicates_found).cast("long").alias("found"),
                        F.lit(result.duplicates_in_batch).cast("long").alias("repeated"))


def drop_repeats(spark, sf_dir):
    store = new_store(spark)
    put(store, bars1d(spark, sf_dir), "stock_1day", drop_repeats=True)
    return read_data(store, "stock_1day")


def compressed_store(spark, sf_dir):
    store = new_store(spark, compression="gzip")
    put(store, bars1d(spark, sf_dir), "stock_1day")
    return read_data(store, "stock_1day")


def row_limited_files(spark, sf_dir):
    store = new_store(spark)
    put(store, bars1d(spark, sf_dir), "stock_1day", max_records_per_file=100)
    return stats.file_metadata(store, "stock_1day").agg(
        F.sum("rows").alias("rows"), (F.max("rows") <= 100).alias("within_limit"))


# target of the queries on file sizes, small enough that the smallest tables have several files
FILE_MB = 0.1


def _many_appends(spark, sf_dir) -> tuple[Store, DataFrame]:
    """Daily bars stored by four appends, then compacted, and what the partitions held before that."""
    store, bars = new_store(spark), bars1d(spark, sf_dir)
    for k in range(4):
        put(store, bars.where(F.col("volume") % 4 == k), "stock_1day", check_duplicates=False)
    before = kept(manage.partitions(store, "stock_1day"))
    compact(store, "stock_1day", target_mb=FILE_MB)
    return store, before


def compacted_rows(spark, sf_dir):
    return read_data(_many_appends(spark, sf_dir)[0], "stock_1day")


def compacted_files(spark, sf_dir):
    """Per partition its rows, and whether it has no more files than its bytes need."""
    store, before = _many_appends(spark, sf_dir)
    month, target = ["Year", "Month"], FILE_MB * (1 << 20)
    needed = before.select(*month, F.ceil(F.col("bytes") / target).alias("needed"), F.col("files").alias("were"))
    return (manage.partitions(store, "stock_1day").join(needed, month)
            .join(manage.partition_counts(store, "stock_1day"), month)
            .select(*month, "rows", (F.col("files") <= F.col("needed")).alias("packed"), (F.col("were") > 1).alias("were_several")))


def sized_files(spark, sf_dir):
    """Files of a limited size: rows, the limit kept, neighbours apart, no more files than it needs."""
    store = new_store(spark)
    put(store, bars5(spark, sf_dir), "flat_bars", max_mb_per_file=FILE_MB)
    limit = FILE_MB * (1 << 20)
    dataset = F.lit("flat_bars").alias("dataset")
    ranges = key_ranges(store, "flat_bars").agg(dataset, F.sum("rows").alias("rows"), F.bool_and("apart").alias("apart"))
    sizes = stats.file_metadata(store, "flat_bars").agg(
        dataset, (F.max("length") <= 1.2 * limit).alias("within_limit"),
        (F.count("*") <= F.ceil(F.sum("length") / (0.7 * limit))).alias("few_files"))
    return ranges.join(sizes, "dataset")


def cleaned_codes(spark, sf_dir):
    raw = load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("stock_code"),
        F.replace(moment("ts", 1, 10), F.lit("-"), F.lit("")).alias("date"),
        F.replace(moment("ts", 12, 8), F.lit(":"), F.lit("")).alias("time"),
        F.col("value").alias("open"))
    return cleaned(raw, codes={"stock_code": 4}, days={"date": "yyyyMMdd"},
                   times={"time": "HHmmss"}, drop_nulls=["open"])


# ---------------------------------------------------------------- checks

def type_report(spark, sf_dir):
    text = F.when(F.col("market") == "click", "bad").otherwise(F.col("open").cast("string"))
    return checks.type_report(bars5(spark, sf_dir).withColumn("open", text), BARS5)


def value_report(spark, sf_dir):
    known = F.when(F.col("market") != "error", F.col("open"))
    return checks.value_report(bars5(spark, sf_dir).withColumn("open", known), CHECKED5)


def stored_conformance(spark, sf_dir):
    store, bars = new_store(spark), bars5(spark, sf_dir)
    location = store.location(BARS5)
    first, rest = bars.where(F.col("market") == "view"), bars.where(F.col("market") != "view")
    for part in (first.withColumn("open", F.col("open").cast("string")), rest):
        part.write.mode("append").partitionBy(*BARS5.partitions).parquet(location)
    return stats.stored_conformance(store, "stock_5min").select(
        "column", "declared", "stored_type", "conforms", "rows")


# ---------------------------------------------------------------- management and reports

def route_preview_query(spark, sf_dir):
    return route_preview(bars5(spark, sf_dir), BARS5)


def delete_partitions(spark, sf_dir):
    store = fresh(spark, sf_dir, "stock_5min")
    manage.delete_partitions(store, "stock_5min", date={"start": "2024-01-10", "end": "2024-01-12"})
    return read_data(store, "stock_5min")


def stats_rows(spark, sf_dir):
    return stats.storage_stats(loaded(spark, sf_dir, "stock_1day"), "stock_1day").select(
        "dataset", "version", "rows", "unreadable")


def partition_stats(spark, sf_dir):
    return manage.partition_counts(loaded(spark, sf_dir, "stock_5min"), "stock_5min")


def file_metadata(spark, sf_dir):
    return (stats.file_metadata(loaded(spark, sf_dir, "stock_5min"), "stock_5min")
            .groupBy("column_count", F.concat_ws(",", "columns").alias("names")).agg(F.sum("rows").alias("rows")))


def stored_partitions(spark, sf_dir):
    return manage.partitions(loaded(spark, sf_dir, "stock_1day"), "stock_1day",
                             filters={"Year": {"start": "1996", "end": "1998"}}).select("Year", "Month")


def calendar_days(spark, sf_dir):
    return manage.calendar_coverage(loaded(spark, sf_dir, "stock_5min"), "stock_5min",
                                    "2023-12-25", "2024-02-10")


def calendar_days_monthly(spark, sf_dir):
    return manage.calendar_coverage(loaded(spark, sf_dir, "stock_1day"), "stock_1day",
                                    "1994-12-01", "1996-06-30")


def existing_partitions(spark, sf_dir):
    shipped = load(spark, sf_dir, "lineitem").select(
        moment("l_shipdate", 1, 4).alias("Year"), moment("l_shipdate", 6, 2).alias("Month")).distinct()
    return manage.mark_existing(loaded(spark, sf_dir, "stock_1day"), shipped, "stock_1day")


def value_profile(spark, sf_dir):
    bars = read_data(loaded(spark, sf_dir, "stock_5min"), "stock_5min")
    return stats.value_profile(bars, ["date", "market", "stock_code"])


def merged_profiles(spark, sf_dir):
    """Distinct values from the sketches of all partitions, half of them stored before the second update."""
    store, bars, columns = new_store(spark), bars5(spark, sf_dir), ["market", "stock_code", "volume"]
    found = []
    for half in (F.col("date") < "2024-01-16", F.col("date") >= "2024-01-16"):
        put(store, bars.where(half), "stock_5min", check_duplicates=False)
        found.append(update_profile(store, "stock_5min", columns))
    exact = stats.value_profile(read_data(store, "stock_5min"), columns).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_values").alias("exact")) for c in columns])))
    return merged_profile(store, "stock_5min").join(exact, "column").select(
        "column", "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.02 * F.col("exact")).alias("close"),
        F.lit(found[1]).cast("long").alias("read_again"))


def distinct_dates(spark, sf_dir):
    return stats.distinct_values(read_data(loaded(spark, sf_dir, "stock_5min"), "stock_5min"), "date")


def reconcile(spark, sf_dir):
    """The bars against what is stored, and against all of it but the last row."""
    before, after = bars5(spark, sf_dir), read_data(loaded(spark, sf_dir, "stock_5min"), "stock_5min")
    last = after.agg(F.max("volume")).first()[0]
    found = None
    for side, rows in (("all", after), ("one less", after.where(F.col("volume") != last))):
        both = stats.reconcile(before, rows, ["open", "close", "volume"], ["date", "market", "stock_code"])
        shown = both.select(F.lit(side).alias("side"), "measure", F.round("before", 2).alias("before"),
                            F.round("after", 2).alias("after"), "agrees")
        found = shown if found is None else found.unionByName(shown)
    return found


def _changed(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[str]]:
    """The bars, and what is stored after a day was deleted and prices of the last days were replaced."""
    store, bars = fresh(spark, sf_dir, "stock_5min"), bars5(spark, sf_dir)
    manage.delete_partitions(store, "stock_5min", date="2024-01-12")
    raised = F.when(F.col("market") == "click", F.col("close") + 1).otherwise(F.col("close"))
    put(store, bars.where(F.col("date") >= "2024-01-28").withColumn("close", raised), "stock_5min", mode="overwrite")
    return bars, read_data(store, "stock_5min"), list(BARS5.partitions)


def reconcile_partitions(spark, sf_dir):
    return stats.differing_partitions(*_changed(spark, sf_dir))


def reconcile_rows(spark, sf_dir):
    return stats.differing_rows(*_changed(spark, sf_dir))


# ---------------------------------------------------------------- ingest, export, bulk requests

def _envelopes(df: DataFrame) -> DataFrame:
    """Each row posted as an envelope of its own."""
    return df.select(F.to_json(F.struct(F.lit("v1").alias("version"),
                                        F.array(F.struct(*df.columns)).alias("data"))))


def ingest_envelopes_query(spark, sf_dir):
    drop, store = new_folder(spark, "query"), new_store(spark)
    _envelopes(bars5(spark, sf_dir)).write.text(drop)
    for result in ingest_envelopes(store, drop, "stock_5min"):
        if not result.success:
            raise ValueError(result.errors)
    return read_data(store, "stock_5min")


def stream_ingest(spark, sf_dir):
    """Two drops; the second sends the last day of the first again. Rows of one key lie in one file."""
    drop, checkpoint, store = new_folder(spark, "query"), new_folder(spark, "query"), new_store(spark)
    bars = bars5(spark, sf_dir).repartition("date", "stock_code", "time")
    for part in (bars.where(F.col("date") <= "2024-01-15"), bars.where(F.col("date") >= "2024-01-15")):
        _envelopes(part).write.mode("append").text(drop)
        ingest_stream(store, drop, "stock_5min", checkpoint).awaitTermination()
    return read_data(store, "stock_5min")


def export_query(spark, sf_dir):
    path = new_folder(spark, "query")
    export_records(loaded(spark, sf_dir, "stock_1day"), "stock_1day", path)
    return spark.read.schema(BARS1D.schema).json(path)


def saved_requests(spark, sf_dir) -> DataFrame:
    """Requests derived from the bars: one per code, per day, per pair of day and market, per market
    with an open range of volumes, and per market with suffixes for all others."""
    bars = bars5(spark, sf_dir)
    per_code = bars.select("stock_code").distinct().select(
        F.concat(F.lit("code "), "stock_code").alias("request_id"),
        F.map_from_arrays(F.array(F.lit("stock_code"), F.lit("close")),
                          F.array(F.concat("stock_code", F.lit(", none")), F.lit("10~"))).alias("asked"))
    per_day = bars.select("date").distinct().select(
        F.concat(F.lit("day "), "date").alias("request_id"),
        F.map_from_arrays(F.array(F.lit("date"), F.lit("unknown")),
                          F.array(F.concat(F.lit("~"), "date"), F.lit("x"))).alias("asked"))
    per_pair = bars.select("date", "market").distinct().select(
        F.concat_ws(" ", F.lit("pair"), "date", "market").alias("request_id"),
        F.map_from_arrays(F.array(F.lit("date"), F.lit("market")), F.array("date", "market")).alias("asked"))
    per_market = bars.groupBy("market").agg(F.max("volume").alias("top")).select(
        F.concat(F.lit("market "), "market").alias("request_id"),
        F.map_from_arrays(F.array(F.lit("market"), F.lit("volume")),
                          F.array(F.col("market"), F.concat(F.lit("100.5~"), F.col("top").cast("string"))))
        .alias("asked"))
    per_limit = bars.groupBy("market").agg(F.avg("close").alias("mean")).select(
        F.concat(F.lit("limit "), "market").alias("request_id"),
        F.map_from_arrays(F.array(F.lit("market__ne"), F.lit("close__gt"), F.lit("stock_name__like")),
                          F.array(F.col("market"), F.round("mean").cast("string"), F.lit("U1"))).alias("asked"))
    every = per_code.unionByName(per_day).unionByName(per_pair).unionByName(per_market).unionByName(per_limit)
    return every.select("request_id", F.explode("asked").alias("field", "text"))


def bulk_filters(spark, sf_dir):
    store = loaded(spark, sf_dir, "stock_5min")
    return count_requests(store, "stock_5min", saved_requests(spark, sf_dir))


def bulk_rows(spark, sf_dir):
    store = loaded(spark, sf_dir, "stock_5min")
    return answer_requests(store, "stock_5min", saved_requests(spark, sf_dir))[0].select(
        "request_id", "date", "time", "market", "stock_code", "close", "volume")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_all": read_all,
    "filter_eq_date": _filtered("stock_5min", date="2024-01-15"),
    "filter_in_code": _filtered("stock_5min", stock_code="00008, 00046"),
    "filter_range_date_market": _filtered("stock_5min", date="2024-01-10~2024-01-12",
                                          market="view,click"),
    "filter_lower_volume": _filtered("stock_5min", volume="9000~"),
    "filter_upper_close": _filtered("stock_5min", close="~50"),
    "filter_closed_price": _filtered("stock_5min", close="50~100"),
    "filter_implied_month": _filtered("stock_1day", date="1996-03-05~1996-04-10", open="100000~"),
    "filter_month_list": _filtered("stock_1day", Month="03,04"),
    "filter_open_start_date": _filtered("stock_5min", date="2024-01-20~"),
    "filter_unknown_ignored": _filtered("stock_5min", foo="1", market="view"),
    "project_columns": project_columns,
    "paged": paged,
    "rolled_bars": rolled_bars,
    "missing_bars": missing_bars,
    "members_read": _filtered("index_constituents", index_code="asia"),
    "ops_suffix": ops_suffix,
    "cross_version": cross_version,
    "extra_columns": extra_columns,
    "append_two_batches": append_two_batches,
    "overwrite_unpartitioned": overwrite_unpartitioned,
    "timestamps_stored": timestamps_stored,
    "write_outcomes": write_outcomes,
    "overwrite_partition": overwrite_partition,
    "find_duplicates": find_duplicates,
    "find_duplicates_filtered": find_duplicates_filtered,
    "remove_duplicates": remove_duplicates,
    "append_dedup": append_dedup,
    "duplicate_counts": duplicate_counts,
    "drop_repeats": drop_repeats,
    "compressed_store": compressed_store,
    "row_limited_files": row_limited_files,
    "compacted_rows": compacted_rows,
    "compacted_files": compacted_files,
    "sized_files": sized_files,
    "cleaned_codes": cleaned_codes,
    "type_report": type_report,
    "value_report": value_report,
    "stored_conformance": stored_conformance,
    "route_preview": route_preview_query,
    "delete_partitions": delete_partitions,
    "stats_rows": stats_rows,
    "partition_stats": partition_stats,
    "file_metadata": file_metadata,
    "stored_partitions": stored_partitions,
    "calendar_days": calendar_days,
    "calendar_days_monthly": calendar_days_monthly,
    "existing_partitions": existing_partitions,
    "value_profile": value_profile,
    "merged_profiles": merged_profiles,
    "distinct_dates": distinct_dates,
    "reconcile": reconcile,
    "reconcile_partitions": reconcile_partitions,
    "reconcile_rows": reconcile_rows,
    "ingest_envelopes": ingest_envelopes_query,
    "stream_ingest": stream_ingest,
    "export_records": export_query,
    "bulk_filters": bulk_filters,
    "bulk_rows": bulk_rows,
}
