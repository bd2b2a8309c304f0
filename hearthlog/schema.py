"""Schemas, keys and the constants every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

# The grid, coverage and silence rules results depend on.
GRID_MINUTES = 30
SLOTS_PER_HOUR = 2
SLOTS_PER_DAY = 48
SLOT_US = GRID_MINUTES * 60 * 1_000_000
MIN_SLOT_COVERAGE = 0.5
MAX_SILENCE_H = 12
HORIZONS_H = tuple(range(1, 49))
DAILY_LAGS = (1, 2, 3, 7, 14, 21)
CLIMATOLOGY_WEEKS = 4
WIDE_CLIMATOLOGY_WEEKS = 8
SLOT_CLIMATOLOGY_DAYS = 14
HOME_THRESHOLD = 0.5
SHRINK_GRID = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4)

# State vocabulary.
EMPTY_STATES = ("unknown", "unavailable", "", "none")
HOME, NOT_HOME, UNKNOWN, ABSENT = "home", "not_home", "unknown", "absent"
HOUSE = "house"
OTHER_ZONE = "__other__"
TOWARDS, AWAY_FROM = "towards", "away_from"

# One subject of one household.
SID = ("household_id", "subject")

STATES = T.StructType([
    T.StructField("household_id", T.LongType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.StringType()),
    T.StructField("seq", T.LongType()),
])

# Readings addressed to a subject: what the grid integrates.
SIGNALS = T.StructType([
    T.StructField("household_id", T.LongType()),
    T.StructField("subject", T.StringType()),
    T.StructField("signal", T.StringType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("value", T.StringType()),
])

FORECASTS = T.StructType([
    T.StructField("household_id", T.LongType()),
    T.StructField("subject", T.StringType()),
    T.StructField("target_slot", T.LongType()),
    T.StructField("horizon_h", T.IntegerType()),
    T.StructField("p", T.DoubleType()),
    T.StructField("written_at", T.LongType()),
])
