"""Local wall-clock arithmetic. Instants travel as microseconds or slot numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlog.schema import SLOT_US


def slot_of(us: Column) -> Column:
    """The half-hour slot an instant falls in."""
    return F.call_function("div", us, F.lit(SLOT_US))


def slot_start(slot: Column) -> Column:
    return slot * F.lit(SLOT_US)


def instant(us: Column) -> Column:
    return F.timestamp_micros(us)


def localise(us: Column, tz: Column | str) -> Column:
    """Household wall time of an instant (the session zone is UTC)."""
    return F.from_utc_timestamp(instant(us), tz)


def local_slot(local: Column) -> Column:
    return F.hour(local) * 2 + F.floor(F.minute(local) / 30).cast("int")


def weekday(local: Column) -> Column:
    """Monday is 0."""
    return F.weekday(local)


def is_weekend(dow: Column) -> Column:
    return (dow >= 5).cast("double")


def slot_sin(slot: Column) -> Column:
    return F.sin(2 * math.pi * slot / 48)


def calendar(local: Column, prefix: str = "", holiday: Column | None = None) -> dict[str, Column]:
    """The clock of a slot, as points on a circle and as plain integers."""
    slot, dow, month = local_slot(local), weekday(local), F.month(local) - 1
    turn = 2 * math.pi
    named = {
        "slot_sin": slot_sin(slot), "slot_cos": F.cos(turn * slot / 48),
        "dow_sin": F.sin(turn * dow / 7), "dow_cos": F.cos(turn * dow / 7),
        "month_sin": F.sin(turn * month / 12), "month_cos": F.cos(turn * month / 12),
        "is_weekend": is_weekend(dow),
        "is_holiday": F.lit(0.0) if holiday is None else holiday,
        "slot_of_day": slot, "dow": dow,
    }
    return {prefix + name: column for name, column in named.items()}


def at_hour(local_date: Column, hour: Column, tz: Column | str) -> Column:
    """A fractional local hour on a local date, as an instant.

    A wall time inside a skipped hour moves to the first moment after it; a
    repeated one is its first occurrence.
    """
    minutes = F.bround(hour * 60, 0).cast("int")
    wall = F.timestamp_seconds(F.unix_date(local_date).cast("long") * 86400 + minutes * 60)
    direct = F.to_utc_timestamp(wall, tz)
    back = F.from_utc_timestamp(direct, tz)
    gap_s = F.unix_seconds(back) - F.unix_seconds(wall)
    landed = F.timestamp_seconds(
        F.unix_seconds(back) - F.pmod(F.unix_seconds(back), F.when(gap_s > 0, gap_s).otherwise(1)))
    return F.when(gap_s > 0, F.to_utc_timestamp(landed, tz)).otherwise(direct)
