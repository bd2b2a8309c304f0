"""Grid and interval integration over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlog.operators import grid as g
from hearthlog.plans import build
from hearthlog.plans.oracle import (ALL_ORIGINS, EVENTS, FRACTIONS, HOUSE, LIVE, PRESENCE, PROXIMITY, S,
                                    sql)
from hearthlog.schema import SID
from hearthlog.sources import driver

QUERIES, ORACLE = {}, {}


def rnd(column, digits=6):
    """Rounded for comparison; the nudge keeps exact halves on one side."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column + F.lit(1e-9), digits)


def rounded(df, *columns, digits=6):
    return df.withColumns({name: rnd(name, digits) for name in columns})


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


@query("g1_grid", sql([EVENTS], "SELECT household_id, subject, slot FROM grid"))
def g1_grid(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    return g.grid(build.subjects(ev)).select(*SID, "slot")


@query("g2_slot_fraction", sql(PRESENCE, """
SELECT household_id, subject, slot, round(home_frac, 6) AS home_frac, round(coverage, 6) AS coverage FROM frac"""))
def g2_slot_fraction(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    out = g.slot_fraction(build.presence_signals(ev), build.subjects(ev))
    return rounded(out, "home_frac", "coverage").select(*SID, "slot", "home_frac", "coverage")


@query("g3_observability", sql([EVENTS, LIVE], "SELECT household_id, slot, observable FROM seen"))
def g3_observability(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    return g.observability(build.households(ev), ev)


@query("g4_liveness", sql([EVENTS, LIVE], f"""
SELECT household_id, ts_us // {S} AS slot, min(ts_us) AS first_us, max(ts_us) AS last_us,
       max(CAST(ts_us % {S} = 0 AS INT)) AS at_edge
FROM live GROUP BY ALL"""))
def g4_liveness(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    cols = ["household_id", "ts_us"]
    tracked = (driver.person_events(ev).select(*cols).unionByName(driver.distance_events(ev).select(*cols))
               .unionByName(driver.direction_events(ev).select(*cols)))
    return g.liveness_chunks(tracked).drop("next_us")


@query("g5_outage_blanking", sql(ALL_ORIGINS, """
SELECT household_id, subject, slot, round(home_frac, 6) AS home_frac, round(coverage, 6) AS coverage,
       minutes_in_state, observable FROM blank"""))
def g5_outage_blanking(spark, sf_dir):
    out = build.slots(build.events(spark, sf_dir))
    return rounded(out, "home_frac", "coverage").drop("in_grid")


@query("g6_as_of", sql([EVENTS], f"""
SELECT g.household_id, g.subject, g.slot, d.metres AS distance_m,
       CASE WHEN g.slot * {S} - d.ts_us <= 7200000000 THEN d.metres END AS fresh_m
FROM grid g ASOF LEFT JOIN (SELECT * FROM ev WHERE metres IS NOT NULL) d
  ON g.household_id = d.household_id AND g.subject = d.subject AND g.slot * {S} >= d.ts_us
WHERE g.subject <> 'house'"""))
def g6_as_of(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    signals = driver.distance_events(ev).withColumn("signal", F.lit("distance")).where("value <> 'unavailable'")
    parts = [g.ValueSignal("distance", "distance_m", g.real(F.col("value"))),
             g.ValueSignal("distance", "fresh_m", g.real(F.col("value")), 120)]
    people = g.spine(driver.people(ev), ev)
    return g.integrate(signals, people, parts).drop("in_grid")


@query("g7_minutes_in_state", sql(PRESENCE, """
SELECT household_id, subject, slot, minutes AS minutes_in_state FROM held"""))
def g7_minutes_in_state(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    return g.minutes_in_state(build.presence_signals(ev), build.subjects(ev))


@query("g8_house_or_merge", sql([EVENTS, HOUSE], """
SELECT household_id, ts_us, state AS value FROM (
  SELECT *, lag(state) OVER (PARTITION BY household_id ORDER BY ts_us) AS was FROM house_ev)
WHERE was IS DISTINCT FROM state"""))
def g8_house_or_merge(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    return g.house_changes(driver.person_events(ev)).select("household_id", "ts_us", "value")


@query("g9_house_zones", sql(ALL_ORIGINS, """
SELECT household_id, slot, round(zone_office, 6) AS zone_office, round(zone_other, 6) AS zone_other
FROM origins WHERE subject = 'house'"""))
def g9_house_zones(spark, sf_dir):
    out = build.origins(build.events(spark, sf_dir)).where("subject = 'house'")
    return rounded(out.select("household_id", "slot", *build.ZONES), *build.ZONES)


@query("g10_usable_days", sql(ALL_ORIGINS, """
SELECT household_id, count(*) FILTER (valid) / 48.0::DOUBLE AS usable_days
FROM (SELECT household_id, slot, bool_and(observable AND home_frac IS NOT NULL) AS valid
      FROM origins WHERE subject <> 'house' GROUP BY ALL) GROUP BY ALL"""))
def g10_usable_days(spark, sf_dir):
    return g.usable_days(build.slots(build.events(spark, sf_dir)))


@query("g11_next_alarm", sql([EVENTS, PROXIMITY], """
SELECT household_id, subject, slot, round(next_alarm_h, 6) AS next_alarm_h FROM next_alarm WHERE subject <> 'house'"""))
def g11_next_alarm(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    signals = driver.alarm_events(ev).withColumn("signal", F.lit("alarm"))
    out = g.integrate(signals, g.spine(driver.people(ev), ev), [g.alarm()])
    out = out.withColumn("next_alarm_h", g.next_alarm_h(F.col("slot"), F.col("alarm_us")))
    return rounded(out.select(*SID, "slot", "next_alarm_h"), "next_alarm_h")


PROX = ["distance_km", "distance_delta_30m", "distance_delta_60m", "dir_towards", "dir_away"]


@query("g12_proximity", sql([EVENTS, PROXIMITY], "SELECT household_id, subject, slot, " + ", ".join(
    f"round({c}, 6) + 0.0 AS {c}" for c in PROX) + " FROM prox WHERE subject <> 'house'"))
def g12_proximity(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    signals = build.person_grid_signals(ev).where("signal in ('distance', 'direction')")
    out = g.integrate(signals, g.spine(driver.people(ev), ev), [g.distance(), g.direction()])
    return rounded(g.proximity(out, driver.direction_people(ev)).select(*SID, "slot", *PROX), *PROX)


ZONE_COLS = ["home_frac", "zone_office", "zone_other"]


def _zones(spark, sf_dir, unknown_as_other):
    ev = build.events(spark, sf_dir)
    people = driver.person_events(ev)
    zoned = g.resolve_zones(people, driver.zones(ev), unknown_as_other)
    signals = zoned.withColumn("value", F.col("zone")).withColumn("signal", F.lit("presence"))
    out = g.slot_fraction(signals, g.spine(driver.people(ev), ev),
                          {"home_frac": g.equals("home"), **g.zone_matches(["office"])})
    return rounded(out, *ZONE_COLS)


@query("g13_zone_fractions", sql(PRESENCE, """
SELECT household_id, subject, slot, round(home_frac, 6) AS home_frac, round(zone_office, 6) AS zone_office,
       round(zone_other, 6) AS zone_other FROM frac WHERE subject <> 'house'"""))
def g13_zone_fractions(spark, sf_dir):
    return _zones(spark, sf_dir, False).select(*SID, "slot", *ZONE_COLS)


@query("g13_zone_fractions_unknown_as_other", sql(PRESENCE, """
SELECT household_id, subject, slot, round(zone_office_q, 6) AS zone_office, round(zone_other_q, 6) AS zone_other
FROM frac WHERE subject <> 'house'"""))
def g13_unknown_as_other(spark, sf_dir):
    return _zones(spark, sf_dir, True).select(*SID, "slot", "zone_office", "zone_other")


@query("g13_zones_sum_to_one", sql(PRESENCE, """
SELECT count(*) AS covered, count(*) FILTER (abs(home_frac + zone_office + zone_other - 1) > 1e-9) AS broken
FROM frac WHERE subject <> 'house' AND home_frac IS NOT NULL"""))
def g13_zones_sum_to_one(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    out = g.slot_fraction(build.presence_signals(ev), g.spine(driver.people(ev), ev), build.PRESENCE_MATCHES)
    total = F.col("home_frac") + F.col("zone_office") + F.col("zone_other")
    # The house has no row on a grid of people, so its own events drop out here.
    return out.where("subject <> 'house' and home_frac is not null").agg(
        F.count("*").alias("covered"), F.count_if(F.abs(total - 1) > 1e-9).alias("broken"))


@query("g14_window_fraction", sql(PRESENCE + [f"""
at_now AS (SELECT household_id, subject, hi * {S} AS at_us FROM subjects JOIN bounds USING (household_id)),
w AS (SELECT i.household_id, i.subject, sum(least(b, at_us) - greatest(a, at_us - 300000000)) FILTER (state <> 'unknown') AS obs,
             coalesce(sum(least(b, at_us) - greatest(a, at_us - 300000000)) FILTER (state = 'home'), 0) AS home
      FROM iv i JOIN at_now USING (household_id, subject) WHERE a < at_us AND b > at_us - 300000000 GROUP BY ALL)"""], """
SELECT at_now.household_id, at_now.subject, round(CASE WHEN obs >= 150000000 THEN home / obs END, 6) AS now_frac
FROM at_now LEFT JOIN w USING (household_id, subject)"""))
def g14_window_fraction(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    at = build.subjects(ev).select(*SID, (F.col("stop_slot") * S).alias("at_us"))
    return rounded(g.window_fraction(build.presence_signals(ev), at), "now_frac").select(*SID, "now_frac")


@query("h13_subject_summary", sql(PRESENCE, """
SELECT household_id, subject, round(avg(home_frac), 6) AS mean_home_frac,
       round(avg(CAST(home_frac >= 0.5 AS DOUBLE)), 6) AS share_home
FROM frac GROUP BY ALL"""))
def h13_subject_summary(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    out = g.slot_fraction(build.presence_signals(ev), build.subjects(ev))
    return subject_summary(out)


def subject_summary(table):
    home = F.col("home_frac")
    return rounded(table.groupBy(*SID).agg(
        F.avg(home).alias("mean_home_frac"),
        F.avg((home >= 0.5).cast("double")).alias("share_home")), "mean_home_frac", "share_home")


@query("h11_origins", sql(ALL_ORIGINS + [PROXIMITY], "SELECT o.household_id, o.subject, o.slot, " + ", ".join(
    f"round({c}, 6) + 0.0 AS {c}" for c in ["home_frac", "coverage", "zone_office", "zone_other"]) + ", minutes_in_state, " + ", ".join(
    f"CASE WHEN o.observable THEN round({c}, 6) + 0.0 END AS {c}" for c in PROX) + """,
  round(next_alarm_h, 6) AS next_alarm_h,
  round(sin(2 * pi() * sod / 48), 6) + 0.0 AS slot_sin, round(cos(2 * pi() * dow / 7), 6) + 0.0 AS dow_cos,
  round(cos(2 * pi() * (extract(month FROM at_ts) - 1) / 12), 6) + 0.0 AS month_cos, CAST(dow >= 5 AS DOUBLE) AS is_weekend, sod AS slot_of_day, dow
FROM origins o JOIN prox p ON p.household_id = o.household_id AND p.subject = o.subject AND p.slot = o.slot
JOIN next_alarm a ON a.household_id = o.household_id AND a.subject = o.subject AND a.slot = o.slot"""))
def h11_origins(spark, sf_dir):
    out = build.origins(build.events(spark, sf_dir))
    numbers = ["home_frac", "coverage", *build.ZONES, *PROX, "next_alarm_h",
               "slot_sin", "dow_cos", "month_cos"]
    return (rounded(out, *numbers)
            .withColumn("slot_of_day", F.col("slot_of_day").cast("long")).withColumn("dow", F.col("dow").cast("long"))
            .select(*SID, "slot", *numbers, "minutes_in_state", "is_weekend", "slot_of_day", "dow"))
