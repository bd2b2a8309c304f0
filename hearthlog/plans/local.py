"""Every household by its own clock and its own holidays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hearthlog.functions import clock
from hearthlog.operators import days as d
from hearthlog.operators import fan
from hearthlog.operators import household
from hearthlog.plans import build, oracle
from hearthlog.plans import days as pd_
from hearthlog.plans.features import ROLES, SQL_ROLE, ahead_slots, role
from hearthlog.plans.grid import rnd, rounded
from hearthlog.plans.oracle import ALL_ORIGINS, S, SAMPLES, sql
from hearthlog.schema import SID
from hearthlog.sources import driver

QUERIES, ORACLE = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


SETTINGS = """
st AS (SELECT household_id, ['Europe/Amsterdam', 'America/New_York', 'Asia/Kolkata'][household_id % 3 + 1] AS tz0, household_id % 4 = 0 AS moves,
              CASE WHEN household_id % 5 = 4 THEN NULL WHEN household_id % 2 = 0 THEN 'NL' ELSE 'US' END AS country
       FROM (SELECT DISTINCT household_id FROM ev)),
hol AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', DATE '{day}')" for c, day in driver.HOLIDAYS) + ") h(country, date))"


def _wall(slot):
    zone = f"CASE WHEN moves AND {slot} * {S} >= {driver.MOVED_US} THEN 'Asia/Tokyo' ELSE tz0 END"
    return f"(make_timestamp({slot} * {S}) AT TIME ZONE 'UTC') AT TIME ZONE {zone}"


LOCAL = SETTINGS + f""",
lorigins AS MATERIALIZED (
  SELECT * EXCLUDE (w), w AS at_ts, CAST(extract(hour FROM w) * 2 + extract(minute FROM w) // 30 AS BIGINT) AS sod, CAST(isodow(w) - 1 AS BIGINT) AS dow
  FROM (SELECT o.* EXCLUDE (at_ts, sod, dow), st.country, {_wall("o.slot")} AS w FROM origins o JOIN st USING (household_id)))"""


@query("c1_household_time", sql([ALL_ORIGINS[0], SETTINGS], f"""
SELECT seq, country, epoch_us((make_timestamp(ts_us) AT TIME ZONE 'UTC') AT TIME ZONE CASE WHEN moves AND ts_us >= {driver.MOVED_US} THEN 'Asia/Tokyo' ELSE tz0 END) AS local_us
FROM ev JOIN st USING (household_id)"""))
def c1_household_time(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    rows = household.with_settings(ev, driver.settings(ev), F.col("ts_us"))
    return rows.select("seq", "country", F.unix_micros(clock.localise(F.col("ts_us"), F.col("tz"))).alias("local_us"))


@query("h11_local_origins", sql(ALL_ORIGINS + [LOCAL], """
SELECT o.household_id, subject, slot, round(home_frac, 6) AS home_frac, sod AS slot_of_day, dow, CAST(dow >= 5 AS DOUBLE) AS is_weekend,
       CAST(h.date IS NOT NULL AS DOUBLE) AS is_holiday, round(sin(2 * pi() * sod / 48), 6) + 0.0 AS slot_sin
FROM lorigins o LEFT JOIN hol h ON h.country = o.country AND h.date = CAST(at_ts AS DATE)"""))
def h11_local_origins(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    out = build.origins(ev, settings=driver.settings(ev), holidays=driver.holidays(spark))
    return rounded(out, "home_frac", "slot_sin").select(
        *SID, "slot", "home_frac", F.col("slot_of_day").cast("long").alias("slot_of_day"), F.col("dow").cast("long").alias("dow"),
        "is_weekend", "is_holiday", "slot_sin")


@query("h2_local_targets", sql(SAMPLES + [SETTINGS, f"""
lt AS (SELECT household_id, horizon_h, y, country, {_wall("t")} AS w FROM smp JOIN st USING (household_id))"""], """
SELECT household_id, horizon_h, count(*) AS n, CAST(sum(extract(hour FROM w) * 2 + extract(minute FROM w) // 30) AS BIGINT) AS sum_slot,
       CAST(count(*) FILTER (isodow(w) >= 6) AS BIGINT) AS weekend, count(h.date) AS holiday, round(avg(y) FILTER (h.date IS NOT NULL), 6) AS holiday_y
FROM lt LEFT JOIN hol h ON h.country = lt.country AND h.date = CAST(w AS DATE) GROUP BY ALL"""))
def h2_local_targets(spark, sf_dir):
    """What the calendar of the target says of each household's horizons."""
    ev = build.events(spark, sf_dir)
    # The calendar is a fact of the target slot: told once a slot, read ahead by every horizon.
    slots = household.with_calendar(ahead_slots(ev), driver.settings(ev), driver.holidays(spark), "slot", "tgt_")

    def sums(s):
        holiday, y = s.ahead("tgt_is_holiday") == 1, s["y"]
        return {"n": np.full(s.shape[0], s.shape[1]), "sum_slot": s.ahead("tgt_slot_of_day").sum(1), "weekend": (s.ahead("tgt_is_weekend") == 1).sum(1),
                "holiday": holiday.sum(1), "n_y": (holiday & ~np.isnan(y)).sum(1), "sum_y": fan.total(y, holiday)}

    told = fan.summed(slots, ["tgt_is_holiday", "tgt_slot_of_day", "tgt_is_weekend"], sums,
                      "n long, sum_slot long, weekend long, holiday long, n_y long, sum_y double", oracle.HORIZONS)
    return told.groupBy("household_id", "horizon_h").agg(
        *[F.sum(c).alias(c) for c in ("n", "sum_slot", "weekend", "holiday")],
        rnd(F.sum("sum_y") / F.sum("n_y")).alias("holiday_y"))


def local_days(spark, sf_dir):
    """Days as each household lives them, labelled, with what its mornings knew."""
    def make():
        ev = build.events(spark, sf_dir)
        slots = household.with_settings(build.day_slots(ev), driver.settings(ev), clock.slot_start(F.col("slot")))
        return d.label_days(d.day_grid(slots, F.col("tz"), ["zone_office"]))
    return build.table(spark, sf_dir, "local-days", make)


NUMBERS = ["wday_rate", "wday_hour", "recent_rate", "recent_hour", "baseline_hour"]


@query("d9_departure_frame", sql(ALL_ORIGINS + [LOCAL, pd_.DAYS.replace("FROM origins", "FROM lorigins"), pd_.LEFT, f"""
r AS (SELECT *, coalesce(wday_hour, recent_hour, all_hour) AS baseline_hour, {SQL_ROLE} AS role FROM cz),
p AS (SELECT household_id, date, """ + ", ".join(f"max(wday_hour) FILTER (role = '{x}') AS _{x}" for x in ROLES) + " FROM r GROUP BY ALL)"],
    "SELECT r.household_id, subject, CAST(r.date - DATE '1970-01-01' AS BIGINT) AS day, dow, CAST(dow >= 5 AS DOUBLE) AS is_weekend, "
    "CAST(h.date IS NOT NULL AS DOUBLE) AS is_holiday, wday_n, left_today, " + ", ".join(f"round({c}, 6) AS {c}" for c in NUMBERS) + ", "
    + ", ".join(f"CASE WHEN role <> '{x}' THEN round(_{x}, 6) END AS other_{x}_wday_hour" for x in ROLES) + """
FROM r JOIN p ON p.household_id = r.household_id AND p.date = r.date JOIN st ON st.household_id = r.household_id
LEFT JOIN hol h ON h.country = st.country AND h.date = r.date"""))
def d9_departure_frame(spark, sf_dir):
    """Every column the day model reads: weekday, weekend, holiday, causal rates and
    hours, and the same morning of the others."""
    ev = build.events(spark, sf_dir)
    rows = d.causal(local_days(spark, sf_dir)).withColumn("role", role())
    rows = d.with_partners(rows, ROLES, "wday_hour", "wday_hour")
    midnight = F.unix_date("date").cast("long") * 86_400_000_000
    rows = household.with_holidays(household.with_settings(rows, driver.settings(ev), midnight), driver.holidays(spark), F.col("date"))
    others = [f"other_{x}_wday_hour" for x in ROLES]
    return rounded(pd_.day(rows).select(*SID, "day", "dow", "is_weekend", "is_holiday", "wday_n", "left_today", *NUMBERS, *others),
                   *NUMBERS, *others)
