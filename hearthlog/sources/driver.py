"""The `events` table read as the log of many small households.

Three users make a household. A view or a click finds a person home, a signup in
the ticked zone "Office", a purchase out, and an error is a lost reading. The
event's value is their distance in units of 100 m.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.schema import HOUSE


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return raw.select(
        F.call_function("div", F.col("user_id"), F.lit(3)).alias("household_id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("subject"),
        "user_id", micros.alias("ts_us"), F.col("event_id").alias("seq"), "event_type",
        F.col("value").alias("reading"))


def person_events(ev: DataFrame) -> DataFrame:
    state = (F.when(F.col("event_type").isin("view", "click"), "home")
             .when(F.col("event_type") == "signup", "Office")
             .when(F.col("event_type") == "purchase", "not_home").otherwise("unknown"))
    return ev.select("household_id", "subject", "ts_us", "seq", state.alias("value"))


def states(ev: DataFrame) -> DataFrame:
    """The raw log: every entity of every household."""
    people = person_events(ev).select(
        "household_id", F.concat(F.lit("person."), "subject").alias("entity_id"), "ts_us", "seq", "value")
    metres = distance_events(ev).select(
        "household_id", F.concat(F.lit("sensor."), "subject", F.lit("_distance")).alias("entity_id"),
        "ts_us", "seq", "value")
    return people.unionByName(metres)


def distance_events(ev: DataFrame) -> DataFrame:
    metres = F.bround(F.col("reading") * 100, 1).cast("string")
    text = F.when(F.col("event_type") == "error", "unavailable").otherwise(metres)
    return ev.select("household_id", "subject", "ts_us", "seq", text.alias("value"))


def direction_events(ev: DataFrame) -> DataFrame:
    """A direction sensor, which only the first person of each household has."""
    way = (F.when(F.col("event_type") == "view", "towards")
           .when(F.col("event_type") == "purchase", "away_from")
           .when(F.col("event_type") == "error", "unavailable").otherwise("stationary"))
    return (ev.where(F.col("user_id") % 3 == 0)
            .select("household_id", "subject", "ts_us", "seq", way.alias("value")))


def alarm_events(ev: DataFrame) -> DataFrame:
    """A purchase sets the alarm for 07:00 next day, a signup cancels it."""
    day = F.to_date(F.timestamp_micros("ts_us"))
    text = (F.when(F.col("event_type") == "purchase",
                   F.concat(F.date_format(F.date_add(day, 1), "yyyy-MM-dd"), F.lit("T07:00:00+00:00")))
            .otherwise("absent"))
    return (ev.where(F.col("event_type").isin("purchase", "signup"))
            .select("household_id", "subject", "ts_us", "seq", text.alias("value")))


def people(ev: DataFrame) -> DataFrame:
    return ev.select("household_id", "subject").distinct()


def subjects(ev: DataFrame) -> DataFrame:
    """People plus the house of every household."""
    houses = ev.select("household_id").distinct().withColumn("subject", F.lit(HOUSE))
    return people(ev).unionByName(houses)


def zones(ev: DataFrame) -> DataFrame:
    return ev.select("household_id").distinct().select(
        "household_id", F.lit("zone.office").alias("entity_id"), F.lit("Office").alias("name"),
        F.lit("office").alias("slug"), F.lit(0).alias("position"))


def direction_people(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("user_id") % 3 == 0).select("household_id", "subject").distinct()


# When one household in four moves, and the holidays of the span.
MOVED_US = 1_705_276_800_000_000
HOLIDAYS = (("NL", "2024-01-01"), ("US", "2024-01-01"), ("US", "2024-01-15"))


def settings(ev: DataFrame) -> DataFrame:
    """Clocks of three places; one household in four moves on, one in five has no calendar."""
    number = F.col("household_id")
    zones = F.array(F.lit("Europe/Amsterdam"), F.lit("America/New_York"), F.lit("Asia/Kolkata"))
    homes = ev.select("household_id").distinct().withColumn(
        "country", F.when(number % 5 == 4, None).when(number % 2 == 0, "NL").otherwise("US"))
    first = homes.select("household_id", F.lit(0).cast("long").alias("valid_from_us"),
                         F.get(zones, (number % 3).cast("int")).alias("tz"), "country")
    moved = homes.where(number % 4 == 0).select(
        "household_id", F.lit(MOVED_US).alias("valid_from_us"), F.lit("Asia/Tokyo").alias("tz"), "country")
    return first.unionByName(moved)


def holidays(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(HOLIDAYS, "country string, day string")
    return rows.select("country", F.to_date("day").alias("date"))
