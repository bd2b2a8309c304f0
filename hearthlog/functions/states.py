"""Column functions over state text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlog.schema import EMPTY_STATES, HOME


def norm(value: Column) -> Column:
    """Trimmed state text; a missing value reads as the empty text."""
    return F.coalesce(F.trim(value), F.lit(""))


def is_empty(value: Column) -> Column:
    return value.isNull() | F.lower(F.trim(value)).isin(*EMPTY_STATES)


def is_home(value: Column) -> Column:
    return norm(value) == F.lit(HOME)


def slugify(entity_id: Column) -> Column:
    """`person.Alice Smith` -> `alice_smith`."""
    tail = F.regexp_replace(entity_id, r"^[^.]*\.", "")
    return F.regexp_replace(
        F.regexp_replace(F.lower(tail), r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")


def real(value: Column) -> Column:
    """The number in a state text, NULL when it is not a finite number."""
    text = F.trim(value)
    number = text.try_cast("double")
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(plain & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def should_fire(old: Column, new: Column) -> Column:
    """True for a change of state, False for a repeat or a lost reading."""
    before, after = F.lower(F.trim(old)), F.lower(F.trim(new))
    return (F.when(is_empty(new), F.lit(False))
            .when(is_empty(old), F.lit(True))
            .otherwise(before != after))


def safe_number(value: Column, digits: int = 4) -> Column:
    """NULL instead of NaN or an infinity, rounded half to even."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, F.bround(value, digits))


def clamp(value: Column, low, high, default=None) -> Column:
    """`value` held inside [low, high]; a missing value is `default`."""
    held = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return held if default is None else F.when(value.isNull(), F.lit(default)).otherwise(held)


def clamp_days(days: Column) -> Column:
    """Days of history on show: 1 to 90, a week when unset or zero."""
    return F.when(days.isNull() | (days == 0), F.lit(7)).otherwise(clamp(days, 1, 90))


EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = (b - a) / 2, (F.radians(lon2) - F.radians(lon1)) / 2
    chord = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(half_lon), F.lit(2))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(chord))
