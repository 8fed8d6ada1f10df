import itertools
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barlake.tables import SHIPPED, Store, Table  # noqa: E402

BARS_BY_MARKET = Table(
    "bars_by_market", "v1",
    {"date": "string", "code": "string", "market": "string", "time": "string", "open": "double"},
    "{name}/{market}/{date}.parquet")
DAILY_MIN = Table("daily_min", "v1", {"date": "string", "code": "string", "open": "double"},
                  "{schema.name}/{schema.date}.parquet")
FLAT = Table("flat", "v1", {"code": "string", "name": "string", "close": "double"}, "flat.parquet",
             key=("code",))
BY_MONTH = Table("by_month", "v1", {"date": "string", "code": "string", "close": "double"},
                 "{name}/{year}/{month}.parquet")
ALL_TYPES = Table(
    "all_types", "v1",
    {"id": "string", "a_int64": "int64", "a_int32": "int32", "a_int16": "int16", "a_int8": "int8",
     "a_uint64": "uint64", "a_float": "float", "a_double": "double", "a_bool": "bool",
     "a_date": "date", "a_datetime": "datetime", "a_stamp": "timestamp"},
    "all_types.parquet", key=("id",))
TABLES = (*SHIPPED, BARS_BY_MARKET, DAILY_MIN, FLAT, BY_MONTH, ALL_TYPES)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (SparkSession.builder.master("local[4]").appName("barlake-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .config("spark.sql.session.timeZone", "UTC"))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), TABLES, allow_overwrite=True, allow_delete=True)


@pytest.fixture
def bars(spark):
    """Rows of `bars_by_market` from tuples."""
    def make(*rows):
        return spark.createDataFrame([tuple(r) for r in rows], BARS_BY_MARKET.schema)
    return make


# The days, markets and codes that the published filter counts name.
DATES = ("2026-05-15", "2026-05-16", "2026-05-17")
NAMED = {"XHKG": ("00700", "00941"), "XSHG": ("600519",), "XSHE": ()}
# Published numbers of bars of one code and day.
BARS = {"stock_5min": 72, "stock_30min": 11, "stock_60min": 6, "stock_1day": 1}


def _three_codes(market, named):
    """The named codes, filled up to three by a rule."""
    first, width = {"XHKG": (0, 5), "XSHG": (600_000, 6), "XSHE": (0, 6)}[market]
    made = (f"{first + 101 * k:0{width}}" for k in (1, 2, 3))
    return (*named, *made)[:3]


def _times(name):
    """Equal steps from half past nine on."""
    step = {"stock_5min": 5, "stock_30min": 30, "stock_60min": 60, "stock_1day": 0}[name]
    minutes = [9 * 60 + 30 + step * k for k in range(BARS[name])]
    return [f"{m // 60:02}:{m % 60:02}" for m in minutes]


MARKETS = {market: _three_codes(market, named) for market, named in NAMED.items()}
TIMES = {name: _times(name) for name in BARS}


def integration_rows(name):
    """(columns, rows): three days, three markets, three codes each; prices by a fixed rule."""
    columns = ["Year", "Month", "date", "time", "market", "stock_code", "stock_name", "open",
               "close", "high", "low", "volume"]
    rows = []
    for n, (day, (market, codes), k, time) in enumerate(itertools.product(
            DATES, MARKETS.items(), range(3), TIMES[name])):
        price = 100.0 + (n * 7 % 400) / 4
        rows.append((day[:4], day[5:7], day, time, market, codes[k], f"S{codes[k]}", price,
                     price + 0.5, price + 1.0, price - 1.0, 1000 + n))
    return columns, rows


@pytest.fixture(scope="session")
def integration(spark, tmp_path_factory):
    """The four stock datasets of the integration data, stored once."""
    from barlake.operators.write import write_data

    store = Store(spark, str(tmp_path_factory.mktemp("integration")))
    results = {}
    for name in TIMES:
        columns, rows = integration_rows(name)
        results[name] = write_data(store, spark.createDataFrame(rows, columns), name)
    return store, results


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def partition_filters(df):
    """The PartitionFilters text of every scan in the plan."""
    import re
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"PartitionFilters: (\[.*\])", text)


def pushed_filters(df):
    import re
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"PushedFilters: (\[.*\])", text)
