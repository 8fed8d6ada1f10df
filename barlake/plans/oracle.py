"""SQL that gives the same rows as the registered queries, on the given tables."""

from __future__ import annotations

from barlake.plans.bridge import BARS1D_SQL, BARS5_SQL, MEMBERS_SQL

_KEY5 = """s."date" = b."date" AND s.stock_code = b.stock_code AND s."time" = b."time" """
_STORED = f"""SELECT 1 FROM bars5 s WHERE s.market <> 'purchase' AND {_KEY5}"""


def _five(body: str) -> str:
    return f"WITH {BARS5_SQL}\n{body}"


def _day(body: str) -> str:
    return f"WITH {BARS1D_SQL}\n{body}"



_MEASURES = """
SELECT 'rows' AS measure, CAST(count(*) AS double) AS v FROM bars5
UNION ALL SELECT 'distinct date', count(DISTINCT "date") FROM bars5
UNION ALL SELECT 'distinct market', count(DISTINCT market) FROM bars5
UNION ALL SELECT 'distinct stock_code', count(DISTINCT stock_code) FROM bars5
UNION ALL SELECT 'sum open', sum("open") FROM bars5
UNION ALL SELECT 'sum close', sum("close") FROM bars5
UNION ALL SELECT 'sum volume', sum(volume) FROM bars5"""

_REQUESTS = """
asked AS (
  SELECT 'code ' || stock_code AS request_id, NULL AS until_day, NULL AS day, NULL AS mkt,
         stock_code AS code, 10.0 AS low_close, NULL AS low_volume, NULL AS high_volume,
         NULL AS other_mkt, NULL AS above
  FROM (SELECT DISTINCT stock_code FROM bars5)
  UNION ALL SELECT 'day ' || "date", "date", NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM (SELECT DISTINCT "date" FROM bars5)
  UNION ALL SELECT 'pair ' || "date" || ' ' || market, NULL, "date", market, NULL, NULL, NULL, NULL, NULL, NULL
  FROM (SELECT DISTINCT "date", market FROM bars5)
  UNION ALL SELECT 'market ' || market, NULL, NULL, market, NULL, NULL, 100.5, max(volume), NULL, NULL
  FROM bars5 GROUP BY market
  UNION ALL SELECT 'limit ' || market, NULL, NULL, NULL, NULL, NULL, NULL, NULL, market, round(avg("close"))
  FROM bars5 GROUP BY market),
answered AS (
  SELECT request_id, b.* FROM asked a LEFT JOIN bars5 b
  ON (until_day IS NULL OR b."date" <= until_day) AND (day IS NULL OR b."date" = day)
     AND (mkt IS NULL OR b.market = mkt) AND (code IS NULL OR b.stock_code = code)
     AND (low_close IS NULL OR b."close" >= low_close)
     AND (low_volume IS NULL OR b.volume BETWEEN low_volume AND high_volume)
     AND (other_mkt IS NULL OR (b.market <> other_mkt AND b."close" > above AND contains(b.stock_name, 'U1'))))"""

# column, declared type and type in the file, for the columns kept inside a file
_KEPT5 = {"time": "string", "market": "string", "stock_code": "string", "stock_name": "string",
          "close": "double", "high": "double", "low": "double", "volume": "int64"}
_CONFORMANCE = "\nUNION ALL ".join(
    [f"SELECT '{c}' AS \"column\", '{t}' AS declared, '{t}' AS stored_type, true AS conforms, "
     f"count(*) AS \"rows\" FROM bars5" for c, t in _KEPT5.items()]
    + ["SELECT 'open', 'double', 'string', false, count(*) FROM bars5 WHERE market = 'view'",
       "SELECT 'open', 'double', 'double', true, count(*) FROM bars5 WHERE market <> 'view'"])

_TYPE_ROWS = "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {'market' if c == 'open' else 'NULL'} = 'click') "
    f"AS failed FROM bars5"
    for c in ("Year", "Month", "date", "time", "market", "stock_code", "stock_name", "open",
              "close", "high", "low", "volume"))

_MINUTE = """60 * CAST(substr("time", 1, 2) AS integer) + CAST(substr("time", 4, 2) AS integer)"""
_GROUP = """"Year", "Month", "date", market, stock_code, stock_name"""
_BAR = """first("open" ORDER BY "time", volume) AS "open", last("close" ORDER BY "time", volume) AS "close",
       max(high) AS high, min(low) AS low, CAST(sum(volume) AS bigint) AS volume"""
_IN_SESSION = """("time" >= '09:30' AND "time" < '12:00' OR "time" >= '13:00' AND "time" < '16:00')"""

_CHANGED = """, changed AS (
  SELECT * REPLACE (CASE WHEN "date" >= '2024-01-28' AND market = 'click' THEN "close" + 1 ELSE "close" END AS "close")
  FROM bars5 WHERE "date" <> '2024-01-12')"""

ORACLE: dict[str, str] = {
    "read_all": _day("SELECT * FROM bars1d"),
    "filter_eq_date": _five("SELECT * FROM bars5 WHERE \"date\" = '2024-01-15'"),
    "filter_in_code": _five("SELECT * FROM bars5 WHERE stock_code IN ('00008', '00046')"),
    "filter_range_date_market": _five(
        "SELECT * FROM bars5 WHERE \"date\" BETWEEN '2024-01-10' AND '2024-01-12' "
        "AND market IN ('view', 'click')"),
    "filter_lower_volume": _five("SELECT * FROM bars5 WHERE volume >= 9000"),
    "filter_upper_close": _five("SELECT * FROM bars5 WHERE \"close\" <= 50"),
    "filter_closed_price": _five("SELECT * FROM bars5 WHERE \"close\" BETWEEN 50 AND 100"),
    "filter_implied_month": _day(
        "SELECT * FROM bars1d WHERE \"date\" BETWEEN '1996-03-05' AND '1996-04-10' "
        "AND \"open\" >= 100000"),
    "filter_month_list": _day("SELECT * FROM bars1d WHERE \"Month\" IN ('03', '04')"),
    "filter_open_start_date": _five("SELECT * FROM bars5 WHERE \"date\" >= '2024-01-20'"),
    "filter_unknown_ignored": _five("SELECT * FROM bars5 WHERE market = 'view'"),
    "project_columns": _five("SELECT \"date\", stock_code, \"close\" FROM bars5"),
    "paged": _day("""
SELECT * FROM bars1d WHERE "open" >= 50000
ORDER BY "Year", "Month", "date", stock_code, market, stock_name, "open", "close", high, low, volume LIMIT 300"""),
    "rolled_bars": _five(f"""
SELECT {_GROUP}, printf('%02d:%02d', minute // 30 * 30 // 60, minute // 30 * 30 % 60) AS "time", {_BAR}, '30' AS span
FROM (SELECT *, {_MINUTE} AS minute FROM bars5 WHERE {_IN_SESSION}) GROUP BY {_GROUP}, minute // 30
UNION ALL
SELECT {_GROUP}, substr("time", 1, 2) || ':00', {_BAR}, '60' FROM bars5 GROUP BY {_GROUP}, substr("time", 1, 2)
UNION ALL
SELECT {_GROUP}, '', {_BAR}, 'day' FROM bars5 WHERE {_IN_SESSION} GROUP BY {_GROUP}"""),
    "missing_bars": f"WITH {BARS5_SQL}" + f"""
, steps AS (
  SELECT DISTINCT "date", market, CASE WHEN "time" < '12:00' THEN (minute - 570) // 5 ELSE 30 + (minute - 780) // 5 END AS step
  FROM (SELECT *, {_MINUTE} AS minute FROM bars5 WHERE {_IN_SESSION})),
gone AS (
  SELECT "date", market, s FROM (SELECT DISTINCT "date", market FROM steps), range(66) AS expected(s)
  WHERE ("date", market, s) NOT IN (SELECT "date", market, step FROM steps)),
runs AS (
  SELECT "date", market, min(s) AS low, max(s) AS high
  FROM (SELECT *, s - row_number() OVER (PARTITION BY "date", market ORDER BY s) AS run FROM gone) GROUP BY "date", market, run),
times AS (SELECT s, CASE WHEN s < 30 THEN 570 + 5 * s ELSE 780 + 5 * (s - 30) END AS minute FROM range(66) AS expected(s))
SELECT "date", market, printf('%02d:%02d', a.minute // 60, a.minute % 60) AS "first",
       printf('%02d:%02d', b.minute // 60, b.minute % 60) AS "last", high - low + 1 AS bars
FROM runs JOIN times a ON a.s = low JOIN times b ON b.s = high""",
    "members_read": f"WITH {MEMBERS_SQL}\nSELECT * FROM members WHERE index_code = 'asia'",
    "ops_suffix": _five(
        "SELECT * FROM bars5 WHERE \"close\" > 20 AND market <> 'view' "
        "AND contains(stock_name, 'U1') AND \"time\" BETWEEN '09:30' AND '16:00' AND volume >= 100"),
    "cross_version": _day(
        "SELECT *, CASE WHEN \"date\" >= '1998-01-01' THEN \"open\" * 2 END AS amount FROM bars1d"),
    "extra_columns": _day(
        "SELECT *, \"open\" * 2 AS note, CASE WHEN \"date\" >= '1996-01-01' THEN \"open\" * 3 END AS amount "
        "FROM bars1d WHERE \"open\" * 2 >= 500000"),
    "append_two_batches": _five("SELECT * FROM bars5"),
    "overwrite_unpartitioned": _five("SELECT * FROM bars5 WHERE market IN ('view', 'click')"),
    "timestamps_stored": """
SELECT event_id, epoch_us(CAST(ts AS timestamp)) // 1000 AS ts, epoch_ms(CAST(CAST(ts AS date) AS timestamp)) AS day,
       CAST(user_id AS bigint) AS text FROM events""",
    "write_outcomes": _five("""
SELECT * FROM (VALUES ('empty batch', true, 0), ('missing column', false, 0), ('unfit type', false, 0),
                      ('nothing stored', true, 0), ('overwrite off', true, 0), ('delete off', true, 0),
                      ('unknown mode', true, 0),
                      ('size in megabytes', true, 0)) AS fixed("case", holds, "rows")
UNION ALL SELECT 'unchecked batch', true, count(*) FROM bars5
UNION ALL SELECT 'column not in files is null', true, count(*) FROM bars5
UNION ALL SELECT 'partition values stay text', true, count(*) FROM bars5 WHERE "Month" = '01'"""),
    "overwrite_partition": _five(
        "SELECT * REPLACE (CASE WHEN \"date\" >= '2024-01-20' THEN \"close\" + 1.0 "
        "ELSE \"close\" END AS \"close\") FROM bars5"),
    "find_duplicates": _five(f"SELECT * FROM bars5 b WHERE EXISTS ({_STORED})"),
    "find_duplicates_filtered": _five(f"""
SELECT * FROM bars5 b WHERE EXISTS ({_STORED})
AND volume IN (SELECT min(volume) FROM bars5 GROUP BY "date", market)"""),
    "remove_duplicates": _five(f"SELECT * FROM bars5 b WHERE NOT EXISTS ({_STORED})"),
    "append_dedup": _five(
        f"SELECT * FROM bars5 WHERE market <> 'purchase' "
        f"UNION ALL SELECT * FROM bars5 b WHERE NOT EXISTS ({_STORED})"),
    "duplicate_counts": _five(f"""
SELECT (SELECT count(*) FROM bars5 WHERE market <> 'purchase')
       + (SELECT count(*) FROM bars5 b WHERE NOT EXISTS ({_STORED})) AS "rows",
       (SELECT count(*) FROM bars5 b WHERE NOT EXISTS ({_STORED})) AS written,
       (SELECT count(*) FROM bars5 b WHERE EXISTS ({_STORED})) AS found,
       (SELECT count(*) - count(DISTINCT ("date", stock_code, "time")) FROM bars5) AS repeated"""),
    "drop_repeats": _day(
        "SELECT * FROM bars1d QUALIFY row_number() OVER (PARTITION BY \"date\", stock_code ORDER BY market, "
        "stock_name, \"open\", \"close\", high, low, volume) = 1"),
    "compressed_store": _day("SELECT * FROM bars1d"),
    "row_limited_files": _day("SELECT count(*) AS \"rows\", true AS within_limit FROM bars1d"),
    "compacted_rows": _day("SELECT * FROM bars1d"),
    "compacted_files": _day("""
SELECT "Year", "Month", count(*) AS "rows", true AS packed, count(DISTINCT volume % 4) > 1 AS were_several
FROM bars1d GROUP BY "Year", "Month\""""),
    "sized_files": _five("SELECT 'flat_bars' AS dataset, count(*) AS \"rows\", true AS apart, true AS within_limit, true AS few_files FROM bars5"),
    "cleaned_codes": """
SELECT CASE WHEN user_id < 1000 THEN lpad(CAST(user_id AS varchar), 4, '0')
            ELSE CAST(user_id AS varchar) END AS stock_code,
       strftime(ts, '%Y-%m-%d') AS "date", strftime(ts, '%H:%M') AS "time", value AS "open"
FROM events WHERE value IS NOT NULL""",
    "type_report": _five(_TYPE_ROWS),
    "value_report": _five("""
SELECT 'market' AS "column", 0 AS missing,
       count(*) FILTER (WHERE market NOT IN ('view', 'click', 'purchase')) AS outside FROM bars5
UNION ALL SELECT 'open', count(*) FILTER (WHERE market = 'error'), 0 FROM bars5"""),
    "stored_conformance": _five(_CONFORMANCE),
    "route_preview": _five("""
SELECT "Year", "Month", "date", count(*) AS "rows",
       'stock_5min/' || "Year" || '/' || "Month" || '/' || "date" || '.parquet' AS path
FROM bars5 GROUP BY "Year", "Month", "date\""""),
    "delete_partitions": _five(
        "SELECT * FROM bars5 WHERE \"date\" NOT BETWEEN '2024-01-10' AND '2024-01-12'"),
    "stats_rows": _day("SELECT 'stock_1day' AS dataset, 'v1' AS version, count(*) AS \"rows\", "
                       "CAST(0 AS bigint) AS unreadable FROM bars1d"),
    "partition_stats": _five("SELECT \"Year\", \"Month\", \"date\", count(*) AS \"rows\" FROM bars5 "
                             "GROUP BY \"Year\", \"Month\", \"date\""),
    "file_metadata": _five(
        "SELECT 9 AS column_count, 'time,market,stock_code,stock_name,open,close,high,low,volume' AS \"names\", "
        "count(*) AS \"rows\" FROM bars5"),
    "stored_partitions": _day("SELECT DISTINCT \"Year\", \"Month\" FROM bars1d "
                              "WHERE \"Year\" BETWEEN '1996' AND '1998'"),
    "calendar_days": _five("""
SELECT strftime(d, '%Y-%m-%d') AS "date",
       EXISTS (SELECT 1 FROM bars5 b WHERE b."date" = strftime(d, '%Y-%m-%d')) AS present
FROM generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-10', INTERVAL 1 DAY) AS days(d)"""),
    "calendar_days_monthly": _day("""
SELECT strftime(d, '%Y-%m-%d') AS "date",
       EXISTS (SELECT 1 FROM bars1d b WHERE b."date" = strftime(d, '%Y-%m-%d')) AS present
FROM generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '1996-06-30', INTERVAL 1 DAY) AS days(d)"""),
    "existing_partitions": _day("""
SELECT w."Year", w."Month", EXISTS (SELECT 1 FROM bars1d b WHERE b."Year" = w."Year"
                                    AND b."Month" = w."Month") AS present
FROM (SELECT DISTINCT strftime(l_shipdate, '%Y') AS "Year", strftime(l_shipdate, '%m') AS "Month"
      FROM lineitem) w"""),
    "value_profile": _five("SELECT count(DISTINCT \"date\") AS date_values, "
                           "count(DISTINCT market) AS market_values, "
                           "count(DISTINCT stock_code) AS stock_code_values FROM bars5"),
    "merged_profiles": f"WITH {BARS5_SQL}\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS exact, true AS close, "
        "count(DISTINCT \"date\") FILTER (\"date\" >= '2024-01-16') AS read_again FROM bars5" for c in ("market", "stock_code", "volume")),
    "distinct_dates": _five("SELECT DISTINCT \"date\" FROM bars5"),
    "reconcile": _five(f"""
SELECT 'all' AS side, measure, round(v, 2) AS "before", round(v, 2) AS "after", true AS agrees FROM ({_MEASURES})
UNION ALL
SELECT 'one less', measure, round(b.v, 2), round(a.v, 2), b.v = a.v
FROM ({_MEASURES}) b JOIN ({_MEASURES.replace('FROM bars5', 'FROM (SELECT * FROM bars5 WHERE volume <> (SELECT max(volume) FROM bars5))')}) a
USING (measure)"""),
    "reconcile_partitions": f"""
WITH {BARS5_SQL}{_CHANGED}
SELECT "Year", "Month", "date", count(*) AS rows_before, count(*) FILTER ("date" <> '2024-01-12') AS rows_after
FROM bars5 WHERE "date" = '2024-01-12' OR "date" >= '2024-01-28'
GROUP BY "Year", "Month", "date" HAVING "date" = '2024-01-12' OR count(*) FILTER (market = 'click') > 0""",
    "reconcile_rows": f"""
WITH {BARS5_SQL}{_CHANGED}
SELECT 'before' AS side, count(*) AS times, * FROM (SELECT * FROM bars5 EXCEPT ALL SELECT * FROM changed) AS lost GROUP BY ALL
UNION ALL
SELECT 'after', count(*), * FROM (SELECT * FROM changed EXCEPT ALL SELECT * FROM bars5) AS gained GROUP BY ALL""",
    "ingest_envelopes": _five("SELECT * FROM bars5"),
    "stream_ingest": _five(
        "SELECT * FROM bars5 QUALIFY row_number() OVER (PARTITION BY \"date\", stock_code, \"time\" ORDER BY market, "
        "stock_name, \"open\", \"close\", high, low, volume) = 1"),
    "export_records": _day("SELECT * FROM bars1d"),
    "bulk_filters": f"WITH {BARS5_SQL},{_REQUESTS}\nSELECT request_id, count(volume) AS \"rows\" "
                    f"FROM answered GROUP BY request_id",
    "bulk_rows": f"WITH {BARS5_SQL},{_REQUESTS}\nSELECT request_id, \"date\", \"time\", market, "
                 f"stock_code, \"close\", volume FROM answered "
                 f"WHERE volume IS NOT NULL",
}
