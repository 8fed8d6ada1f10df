"""Coarser bars and missing ranges against plain loops."""

import random

import pytest

from barlake.operators import series
from barlake.operators.stats import differing_rows
from conftest import plan_of

SCHEMA = "Year string, Month string, date string, time string, market string, stock_code string, stock_name string, open double, close double, high double, low double, volume long"
SESSIONS = {"XHKG": [("09:30", "12:00"), ("13:00", "16:00")], "XSHG": [("09:30", "11:30"), ("13:00", "14:57")]}


def some_rows(seed, count=600):
    rng, rows = random.Random(seed), []
    for n in range(count):
        day = rng.choice(["2026-05-15", "2026-05-16"])
        time = rng.choice([None, "x", f"{rng.randint(9, 16):02}:{rng.randrange(60):02}"]) if rng.random() < 0.1 else \
            f"{rng.randint(9, 16):02}:{rng.randrange(60):02}"
        price = rng.choice([None, float(rng.randint(1, 99))])
        rows.append((day[:4], day[5:7], day, time, rng.choice(["XHKG", "XSHG", "other"]), rng.choice("ab"), "n", price, price,
                     price, price, n))
    return rows


def step(time, minutes, sessions):
    """(number, begin) of the step of a time."""
    first = 0
    try:
        now = int(time[:2]) * 60 + int(time[3:])
    except (TypeError, ValueError):
        return None
    for opens, closes in sessions or []:
        a, b = (int(x[:2]) * 60 + int(x[3:]) for x in (opens, closes))
        if a <= now < b:
            return first + (now - a) // minutes, a + (now - a) // minutes * minutes
        first += -(-(b - a) // minutes)
    return None


def brute_force(rows, minutes, sessions):
    groups = {}
    for r in rows:
        at = step(r[3], minutes, sessions.get(r[4]))
        if at:
            groups.setdefault((*r[:3], *r[4:7], f"{at[1] // 60:02}:{at[1] % 60:02}"), []).append(r)
    found = []
    for key, own in groups.items():
        own.sort(key=lambda r: (r[3], r[11]))
        prices = [r[9] for r in own if r[9] is not None]
        found.append((*key, own[0][7], own[-1][8], max(prices, default=None), min(prices, default=None), sum(r[11] for r in own)))
    return sorted(found, key=repr)


@pytest.mark.parametrize("minutes", [5, 30, 60, 47])
def test_roll_up(spark, minutes):
    rows = some_rows(minutes)
    found = series.roll_up(spark.createDataFrame(rows, SCHEMA), minutes, SESSIONS)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(rows, minutes, SESSIONS)


def test_rolled_twice_and_daily(spark):
    """Bars of bars are the bars, and the day's are those of all its sessions."""
    bars = spark.createDataFrame([r for r in some_rows(1) if r[7] is not None], SCHEMA)
    once, twice = series.roll_up(bars, 60, ties=()), series.roll_up(series.roll_up(bars, 30, ties=()), 60, ties=())
    keys = ["date", "market", "stock_code", "stock_name", "time", "high", "low", "volume", "Year", "Month"]
    assert differing_rows(once.select(keys), twice.select(keys), ["date"]).count() == 0
    day = {tuple(r[c] for c in ("date", "market", "stock_code")): r for r in series.daily(bars, SESSIONS).collect()}
    for r in series.roll_up(bars, 500, SESSIONS).groupBy("date", "market", "stock_code").agg({"volume": "sum", "high": "max"}).collect():
        own = day[r.date, r.market, r.stock_code]
        assert (own.volume, own.high) == (r["sum(volume)"], r["max(high)"])


def test_only_partial_results_move(spark):
    plan = plan_of(series.roll_up(spark.createDataFrame(some_rows(1), SCHEMA), 30))
    assert "partial_min" in plan and "Window" not in plan


@pytest.mark.parametrize("minutes", [5, 30])
def test_missing_ranges(spark, minutes):
    rows = some_rows(minutes, 150)
    expected = []
    have = {}
    for r in rows:
        at = step(r[3], minutes, SESSIONS.get(r[4]))
        if at:
            have.setdefault((r[2], r[4], r[5]), set()).add(at[0])
    for key, own in have.items():
        begins = []
        for opens, closes in SESSIONS[key[1]]:
            a, b = (int(x[:2]) * 60 + int(x[3:]) for x in (opens, closes))
            begins += [f"{m // 60:02}:{m % 60:02}" for m in range(a, b, minutes)]
        run = []
        for k in range(len(begins) + 1):
            if k < len(begins) and k not in own:
                run.append(k)
            elif run:
                expected.append((*key, begins[run[0]], begins[run[-1]], len(run)))
                run = []
    found = series.missing_ranges(spark.createDataFrame(rows, SCHEMA), minutes, SESSIONS)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_sessions_are_checked(spark):
    bars = spark.createDataFrame(some_rows(1, 5), SCHEMA)
    for sessions in ([("12:00", "09:00")], [("09:00", "12:00"), ("11:00", "13:00")], [("09:00", "25:00")]):
        with pytest.raises(ValueError):
            series.roll_up(bars, 30, sessions)
    with pytest.raises(ValueError):
        series.roll_up(bars, 0)
    assert series.roll_up(bars.limit(0), 30).count() == 0 and series.missing_ranges(bars.limit(0), 30).count() == 0
