"""The shared stages of every plan over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.functions import clock
from hearthlog.operators import grid as g
from hearthlog.operators import household
from hearthlog.schema import HOUSE, SID
from hearthlog.session import written
from hearthlog.sources import driver

ZONES = ("zone_office", "zone_other")

_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A phase written once per application and read by every query after it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = written(make(), name)
    return _TABLES[key]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver.events(spark, sf_dir)


def presence_signals(ev: DataFrame) -> DataFrame:
    return g.presence_signals(driver.person_events(ev))


def subjects(ev: DataFrame) -> DataFrame:
    return g.spine(driver.subjects(ev), ev)


def households(ev: DataFrame) -> DataFrame:
    return g.spine(ev.select("household_id").distinct(), ev)


def person_grid_signals(ev: DataFrame) -> DataFrame:
    """Every signal of every subject, in one table."""
    columns = ["household_id", "subject", "signal", "ts_us", "seq", "value"]
    parts = [presence_signals(ev),
             driver.distance_events(ev).withColumn("signal", F.lit("distance")).where("value <> 'unavailable'"),
             driver.direction_events(ev).withColumn("signal", F.lit("direction")),
             driver.alarm_events(ev).withColumn("signal", F.lit("alarm"))]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


PRESENCE_MATCHES = {
    "home_frac": g.equals("home"), "zone_office": g.equals("Office"), "zone_other": g.equals("not_home")}


def slots(ev: DataFrame, extra_slots: int = 0) -> DataFrame:
    """Presence per slot, blanked where the recorder was silent."""
    out = g.integrate(presence_signals(ev), subjects(ev),
                      [g.presence({"home_frac": g.equals("home")})], extra_slots=extra_slots)
    out = (out.withColumnRenamed("presence_coverage", "coverage")
           .withColumnRenamed("presence_minutes", "minutes_in_state").drop("presence_observed_us"))
    return g.blanked(out, g.live_spans(ev), ["home_frac", "minutes_in_state"])


def origins(ev: DataFrame, extra_slots: int = 0, tz: str = "UTC", settings: DataFrame | None = None,
            holidays: DataFrame | None = None) -> DataFrame:
    """One row per (subject, slot): state, zones, travel, alarm and calendar, the last by
    the clock and holidays of each household where `settings` and `holidays` are given."""
    signals = g.resolve_zones(person_grid_signals(ev).where("signal = 'presence'"), driver.zones(ev))
    zoned = signals.select("household_id", "subject", F.lit("presence").alias("signal"), "ts_us", "seq",
                           F.col("zone").alias("value"))
    signals = zoned.unionByName(person_grid_signals(ev).where("signal <> 'presence'"))
    parts = [g.presence({"home_frac": g.equals("home"), **g.zone_matches(["office"])}),
             g.distance(), g.direction(), g.alarm()]
    out = g.integrate(signals, subjects(ev), parts, extra_slots=extra_slots)
    out = (out.withColumnRenamed("presence_coverage", "coverage")
           .withColumnRenamed("presence_minutes", "minutes_in_state")
           .drop("presence_observed_us", "direction_observed_us", "direction_coverage", "direction_minutes"))
    for zone in ZONES:
        out = out.withColumn(zone, F.when(F.col("subject") != HOUSE, F.col(zone)))
    out = g.proximity(out, driver.direction_people(ev))
    out = out.withColumn("next_alarm_h", g.next_alarm_h(F.col("slot"), F.col("alarm_us"))).drop("alarm_us")
    out = g.blanked(out, g.live_spans(ev),
                    ["home_frac", "minutes_in_state", *ZONES, "distance_km", "distance_delta_30m",
                     "distance_delta_60m", "dir_towards", "dir_away"])
    out = g.with_house_zones(out, ZONES).withColumn("state_now", F.col("home_frac"))
    if settings is not None:
        return household.with_calendar(out, settings, holidays)
    local = clock.localise(clock.slot_start(F.col("slot")), tz)
    return out.withColumns(clock.calendar(local))


def day_slots(ev: DataFrame) -> DataFrame:
    """Presence and the ticked zone per slot: what days are labelled from."""
    out = g.integrate(presence_signals(ev), subjects(ev), [g.presence(
        {"home_frac": g.equals("home"), "zone_office": g.equals("Office")}, duration=False)])
    out = out.withColumn("zone_office", F.when(F.col("subject") != HOUSE, F.col("zone_office")))
    out = g.blanked(out, g.live_spans(ev), ["home_frac", "zone_office"])
    return g.with_house_zones(out, ["zone_office"]).select(*SID, "slot", "home_frac", "zone_office")
