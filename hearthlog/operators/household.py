"""Settings of households over time: the zone of their clock and their holidays.

Settings are a slowly changing table (`household_id`, `valid_from_us`, `tz`,
`country`), holidays a table (`country`, `date`). A row takes the version that holds
at its instant; before the first version the first holds. A household without
settings has UTC, one without a known calendar no holidays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.functions import clock


def with_settings(rows: DataFrame, settings: DataFrame, at_us: Column) -> DataFrame:
    """Add `tz` and `country` as they are at `at_us`.

    The few versions of a household travel as one array, so a row meets one row of
    the table and no range is joined.
    """
    versions = settings.groupBy("household_id").agg(
        F.sort_array(F.collect_list(F.struct("valid_from_us", "tz", "country"))).alias("_versions"))
    begun = F.filter("_versions", lambda v: v["valid_from_us"] <= at_us)
    held = F.coalesce(F.get(begun, F.size(begun) - 1), F.get("_versions", F.lit(0)))
    return (rows.join(versions, "household_id", "left").withColumn("_held", held)
            .withColumn("tz", F.coalesce("_held.tz", F.lit("UTC"))).withColumn("country", F.col("_held.country"))
            .drop("_versions", "_held"))


def with_holidays(rows: DataFrame, holidays: DataFrame, date: Column, out: str = "is_holiday") -> DataFrame:
    """1.0 on a holiday of the row's `country`, else 0.0."""
    known = holidays.select("country", F.col("date").alias("_date"), F.lit(1.0).alias("_flag")).distinct()
    found = rows.withColumn("_date", date).join(known, ["country", "_date"], "left")
    return found.withColumn(out, F.coalesce("_flag", F.lit(0.0))).drop("_date", "_flag")


def with_calendar(rows: DataFrame, settings: DataFrame, holidays: DataFrame, slot: str = "slot", prefix: str = "") -> DataFrame:
    """The calendar columns of `slot` by each household's own clock and calendar."""
    at = clock.slot_start(F.col(slot))
    out = with_settings(rows, settings, at)
    local = clock.localise(at, F.col("tz"))
    out = with_holidays(out, holidays, F.to_date(local), "_holiday")
    return out.withColumns(clock.calendar(local, prefix, F.col("_holiday"))).drop("_holiday", "tz", "country")
