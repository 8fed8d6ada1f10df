"""Bars and index members derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.tables import INDEX_CONSTITUENTS, STOCK_1DAY, STOCK_5MIN

BARS5 = STOCK_5MIN
BARS1D = STOCK_1DAY
MEMBERS = replace(INDEX_CONSTITUENTS, key=("date", "index_code", "stock_code"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prices(value: str) -> list[Column]:
    price = F.col(value)
    return [price.alias("open"), (price + 0.5).alias("close"), (price + 1.0).alias("high"),
            (price - 1.0).alias("low")]


def _code(number: str) -> Column:
    return F.lpad(F.col(number).cast("string"), 5, "0").alias("stock_code")


def moment(column: str, first: int, length: int) -> Column:
    """Part of a `yyyy-MM-dd HH:mm:ss` moment, cut from its text so that no time zone matters."""
    return F.substring(F.col(column).cast("string"), first, length)


def _day_parts(column: str) -> list[Column]:
    return [moment(column, 1, 4).alias("Year"), moment(column, 6, 2).alias("Month"),
            moment(column, 1, 10).alias("date")]


def bars5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday bars from `events`."""
    return load(spark, sf_dir, "events").select(
        *_day_parts("ts"), moment("ts", 12, 5).alias("time"),
        F.col("event_type").alias("market"), _code("user_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("stock_name"),
        *_prices("value"), F.col("event_id").alias("volume"))


def bars1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars from `orders`."""
    return load(spark, sf_dir, "orders").select(
        *_day_parts("o_orderdate"), F.col("o_orderpriority").alias("market"),
        _code("o_custkey"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("stock_name"),
        *_prices("o_totalprice"), F.col("o_orderkey").alias("volume"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index members from `customer`, `nation` and `region`."""
    placed = (load(spark, sf_dir, "customer")
              .join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
              .join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    return placed.select(
        F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("index_code"),
        F.col("r_name").alias("index_name_en"), F.col("r_name").alias("index_name_cn"),
        F.lit("2026-05-19").alias("date"), F.lit("2026").alias("Year"), F.lit("05").alias("Month"),
        _code("c_custkey"), F.col("c_name").alias("stock_name"))


BARS5_SQL = """bars5 AS (
  SELECT strftime(ts, '%Y') AS "Year", strftime(ts, '%m') AS "Month",
         strftime(ts, '%Y-%m-%d') AS "date", strftime(ts, '%H:%M') AS "time",
         event_type AS market, lpad(CAST(user_id AS varchar), 5, '0') AS stock_code,
         'U' || CAST(user_id AS varchar) AS stock_name, value AS "open", value + 0.5 AS "close",
         value + 1.0 AS high, value - 1.0 AS low, event_id AS volume
  FROM events)"""

BARS1D_SQL = """bars1d AS (
  SELECT strftime(o_orderdate, '%Y') AS "Year", strftime(o_orderdate, '%m') AS "Month",
         strftime(o_orderdate, '%Y-%m-%d') AS "date", o_orderpriority AS market,
         lpad(CAST(o_custkey AS varchar), 5, '0') AS stock_code,
         'C' || CAST(o_custkey AS varchar) AS stock_name, o_totalprice AS "open",
         o_totalprice + 0.5 AS "close", o_totalprice + 1.0 AS high, o_totalprice - 1.0 AS low,
         o_orderkey AS volume
  FROM orders)"""

MEMBERS_SQL = """members AS (
  SELECT lower(replace(r_name, ' ', '_')) AS index_code, r_name AS index_name_en,
         r_name AS index_name_cn, '2026-05-19' AS "date", '2026' AS "Year", '05' AS "Month",
         lpad(CAST(c_custkey AS varchar), 5, '0') AS stock_code, c_name AS stock_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey)"""
