"""Bars as time series: coarser bars, and the ranges of a day for which bars are missing.

A day is a list of sessions, (opens, closes) as `HH:mm`, the same for all rows or one list for each
market. Bars are counted through a day's sessions in steps of some minutes; the last step of a session
may be shorter. Bars outside the sessions take no part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Sessions = Sequence[tuple[str, str]]
WHOLE_DAY: Sessions = (("00:00", "24:00"),)


def _minute(text: str) -> int:
    hour, minute = text.split(":")
    return 60 * int(hour) + int(minute)


def _steps(sessions: Sessions, minutes: int) -> list[tuple[int, int, int]]:
    """(opens, closes, number of the first step) of each session."""
    found, first, last = [], 0, 0
    for opens, closes in ((_minute(a), _minute(b)) for a, b in sessions):
        if not last <= opens < closes <= 24 * 60:
            raise ValueError(f"Sessions follow each other within a day: {list(sessions)}")
        found.append((opens, closes, first))
        first, last = first + -(-(closes - opens) // minutes), closes
    return found


def _by_market(sessions: Sessions | Mapping[str, Sessions], minutes: int, market: str, value) -> Column:
    """`value` of the steps of the market's sessions; null for markets without any."""
    if minutes < 1:
        raise ValueError("A step takes a minute at least")
    if not isinstance(sessions, Mapping):
        return value(_steps(sessions, minutes))
    found = F.lit(None)
    for name, own in sessions.items():
        found = F.when(F.col(market) == name, value(_steps(own, minutes))).otherwise(found)
    return found


def step_of(time: str, minutes: int, sessions: Sessions | Mapping[str, Sessions] = WHOLE_DAY) -> Column:
    """Number of the step in which an `HH:mm` time lies; null outside the sessions."""
    clock = F.try_to_timestamp(F.col(time), F.lit("HH:mm"))
    minute = F.hour(clock) * 60 + F.minute(clock)

    def number(steps: list[tuple[int, int, int]]) -> Column:
        found = F.lit(None)
        for opens, closes, first in steps:
            inside = (minute >= opens) & (minute < closes)
            found = F.when(inside, F.floor((minute - opens) / minutes) + first).otherwise(found)
        return found

    return _by_market(sessions, minutes, "market", number).cast("int")


def begin_of(step: Column, minutes: int, sessions: Sessions | Mapping[str, Sessions] = WHOLE_DAY) -> Column:
    """`HH:mm` at which a step begins."""
    def begin(steps: list[tuple[int, int, int]]) -> Column:
        found = F.lit(None)
        for opens, _, first in steps:
            found = F.when(step >= first, (step - first) * minutes + opens).otherwise(found)
        return found

    minute = _by_market(sessions, minutes, "market", begin).cast("int")
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), minute % 60)


BY = ("Year", "Month", "date", "market", "stock_code", "stock_name")


def roll_up(bars: DataFrame, minutes: int, sessions: Sessions | Mapping[str, Sessions] = WHOLE_DAY, *,
            by: Sequence[str] = BY, ties: Sequence[str] = ("volume",)) -> DataFrame:
    """Bars of `minutes` from finer ones: first open, last close, highest, lowest, summed volume.

    A bar takes the time at which its step begins. First and last go by time, among bars of one time by
    `ties` and then by price. One hash aggregation with partial results in each task, so that a code
    with a third of all bars moves a row per step.
    """
    stepped = bars.withColumn("step", step_of("time", minutes, sessions)).where("step IS NOT NULL")
    rolled = stepped.groupBy(*by, "step").agg(*_bar(ties))
    begin = begin_of(F.col("step"), minutes, sessions).alias("time")
    return rolled.select(*by, begin, "open", "close", "high", "low", "volume")


def daily(bars: DataFrame, sessions: Sessions | Mapping[str, Sessions] = WHOLE_DAY, *,
          by: Sequence[str] = BY, ties: Sequence[str] = ("volume",)) -> DataFrame:
    """One bar for each day, without time, of all bars within the sessions."""
    return bars.where(step_of("time", 24 * 60, sessions).isNotNull()).groupBy(*by).agg(*_bar(ties))


def _bar(ties: Sequence[str]) -> list[Column]:
    place = ["time", *ties]
    return [F.min(F.struct(*place, "open"))["open"].alias("open"), F.max(F.struct(*place, "close"))["close"].alias("close"),
            F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume")]


def missing_ranges(bars: DataFrame, minutes: int, sessions: Sessions | Mapping[str, Sessions] = WHOLE_DAY, *,
                   by: Sequence[str] = ("date", "market", "stock_code")) -> DataFrame:
    """(by, first, last, bars): ranges of steps of a day without any bar, by the times their first and
    last steps begin.

    `by` names the day, the market and what a row of bars stands for; only groups with a bar in a
    session are looked at. The steps that have bars are made distinct before they are ordered, so a
    window holds a day's steps at most, however many bars there are.
    """
    steps = bars.select(*by, step_of("time", minutes, sessions).alias("step")).where("step IS NOT NULL").distinct()

    def all_steps(found: list[tuple[int, int, int]]) -> Column:
        opens, closes, first = found[-1]
        return F.lit(first - (opens - closes) // minutes)

    # each step closes the gap before it, and a step after the day's last one closes that after the last bar
    order = Window.partitionBy(*by).orderBy("step")
    ends = F.when(F.lead("step").over(order).isNull(), F.array("step", _by_market(sessions, minutes, "market", all_steps))).otherwise(
        F.array("step"))
    before = F.lag("step", 1, -1).over(order)
    edges = steps.select(*by, "step", before.alias("before"), ends.alias("ends")).select(
        *by, F.inline(F.transform("ends", lambda e, i: F.struct(F.when(i == 0, F.col("before")).otherwise(F.col("step")).alias("low"), e.alias("high")))))
    begin = [begin_of(F.col(c), minutes, sessions).alias(c) for c in ("first", "last")]
    return (edges.where("high > low + 1").select(*by, (F.col("low") + 1).alias("first"), (F.col("high") - 1).alias("last"))
            .select(*by, *begin, (F.col("last") - F.col("first") + 1).alias("bars")))
