from pyspark.sql import functions as F

from hearthlog.functions import clock
from hearthlog.operators import days as d
from hearthlog.operators import household

DAY = 86_400_000_000
S = 1_800_000_000
SETTINGS = "household_id long, valid_from_us long, tz string, country string"


def settings(spark):
    return spark.createDataFrame([
        (0, 100 * DAY, "Asia/Tokyo", "JP"), (0, 50 * DAY, "Europe/Amsterdam", "NL"), (1, 0, "America/New_York", None)], SETTINGS)


def test_a_row_takes_the_version_of_its_instant(spark):
    rows = spark.createDataFrame([(h, t * DAY) for h in (0, 1, 2) for t in (10, 50, 99, 100)], "household_id long, ts_us long")
    got = {(r[0], r[1]): (r["tz"], r["country"]) for r in household.with_settings(rows, settings(spark), F.col("ts_us")).collect()}
    ams, tokyo = ("Europe/Amsterdam", "NL"), ("Asia/Tokyo", "JP")
    assert [got[0, t * DAY] for t in (10, 50, 99, 100)] == [ams, ams, ams, tokyo]
    assert {got[1, t * DAY] for t in (10, 100)} == {("America/New_York", None)}
    assert {got[2, t * DAY] for t in (10, 100)} == {("UTC", None)}


def test_holidays_fall_on_the_local_day(spark):
    # 15:00 UTC is midnight in Tokyo.
    holidays = spark.createDataFrame([("JP", "1970-04-12"), ("JP", "1970-04-12"), ("NL", "1970-04-12")], "country string, day string")
    holidays = holidays.select("country", F.to_date("day").alias("date"))
    slots = [100 * 48 + 48 + 29, 100 * 48 + 48 + 30, 100 * 48 + 2 * 48 + 29, 100 * 48 + 2 * 48 + 30]
    rows = spark.createDataFrame([(h, s) for h in (0, 1, 2) for s in slots], "household_id long, slot long")
    out = household.with_calendar(rows, settings(spark), holidays, prefix="x_")
    assert "tz" not in out.columns and out.count() == 12
    got = {(r["household_id"], r["slot"]): r for r in out.collect()}
    assert [got[0, s]["x_is_holiday"] for s in slots] == [1.0, 0.0, 0.0, 0.0]
    assert got[0, slots[1]]["x_slot_of_day"] == 0 and got[2, slots[1]]["x_slot_of_day"] == 30
    assert {got[h, s]["x_is_holiday"] for h in (1, 2) for s in slots} == {0.0}


def test_days_by_a_column_of_zones_equal_days_by_each_zone(spark):
    zones = {0: "Europe/Amsterdam", 1: "America/New_York"}
    rows = spark.createDataFrame([(h, "s", s, float(s % 7 > 3), zones[h]) for h in zones for s in range(19_000 * 48, 19_000 * 48 + 200)],
                                 "household_id long, subject string, slot long, home_frac double, tz string")
    mixed = {tuple(map(str, r)) for r in d.day_grid(rows, F.col("tz")).collect()}
    apart = {tuple(map(str, r)) for h, tz in zones.items() for r in d.day_grid(rows.where(F.col("household_id") == h), tz).collect()}
    assert mixed == apart and len(mixed) > 8


def test_no_settings_and_no_holidays(spark):
    rows = spark.createDataFrame([(7, 5)], "household_id long, slot long")
    none = settings(spark).where("false")
    days = spark.createDataFrame([], "country string, date date")
    got = household.with_calendar(rows, none, days).first()
    assert (got["slot_of_day"], got["is_holiday"]) == (5, 0.0)
    assert clock.calendar(F.lit(0))  # the calendar itself needs neither
