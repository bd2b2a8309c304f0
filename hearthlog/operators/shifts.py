"""Lookups at an exact offset on the slot grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_offset(column: Column | str, slots: int, keys: Sequence[str], slot: str = "slot") -> Column:
    """The value of the same key exactly `slots` away; NULL where no such row is.

    A range frame, never a positional shift: the table may have holes. A key's
    rows are bounded by the calendar.
    """
    w = Window.partitionBy(*keys).orderBy(slot).rangeBetween(slots, slots)
    return F.max(column).over(w)


def at_time_offset(table: DataFrame, series: DataFrame, keys: Sequence[str], slots: int,
                   value: str, out: str, slot: str = "slot") -> DataFrame:
    """A household-wide series read `slots` away, by an equality join."""
    moved = series.select(*keys, (F.col(slot) - slots).alias(slot), F.col(value).alias(out))
    return table.join(moved, [*keys, slot], "left")
