"""Sources, ingest, state predicates and inventories over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlog import session
from hearthlog.functions import states as st
from hearthlog.operators import catalog as cat
from hearthlog.operators import explore as x
from hearthlog.operators import grid as g
from hearthlog.plans import build
from hearthlog.plans.grid import rnd, rounded
from hearthlog.plans.oracle import ALL_ORIGINS, EVENTS, S, sql
from hearthlog.sources import devices, driver, exports
from hearthlog.sources import statelog as log

QUERIES, ORACLE = {}, {}
# 2024-01-10 and 2024-01-20, in microseconds.
START, STOP, NOW = 1_704_844_800_000_000, 1_705_708_800_000_000, 1_706_745_600_000_000
DAY = 86_400_000_000


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


def states(spark, sf_dir):
    return driver.states(build.events(spark, sf_dir))


LOG = """
lg AS MATERIALIZED (
  SELECT household_id, 'person.' || subject AS entity_id, ts_us, seq, state AS value, NULL::DOUBLE AS number FROM ev
  UNION ALL SELECT household_id, 'sensor.' || subject || '_distance', ts_us, seq, CASE WHEN metres IS NULL THEN 'unavailable' ELSE 'number' END, metres FROM ev)"""
L = [EVENTS, LOG]
# Numbers are compared as numbers: the two engines print them differently.
TEXT = "CASE WHEN entity_id LIKE 'sensor%' AND value <> 'unavailable' THEN 'number' ELSE value END"


def plain(df):
    return df.withColumn("number", st.real(F.col("value"))).withColumn("value", F.expr(TEXT))


@query("s1_states", sql(L, f"SELECT household_id, entity_id, ts_us, seq, value, number FROM lg WHERE ts_us >= {START} AND ts_us < {STOP}"))
def s1_states(spark, sf_dir):
    return plain(log.states(states(spark, sf_dir), START, STOP))


@query("s2_seeded_states", sql(L, f"""
SELECT household_id, entity_id, ts_us, seq, value, number FROM lg WHERE ts_us >= {START} AND ts_us < {STOP}
UNION ALL SELECT household_id, entity_id, {START}, -1, arg_max(value, ts_us), arg_max(coalesce(number, -1), ts_us) FROM lg
WHERE ts_us < {START} AND ts_us >= {START} - 3 * {DAY} GROUP BY ALL""").replace("arg_max(coalesce(number, -1), ts_us)", "nullif(arg_max(coalesce(number, -1), ts_us), -1)"))
def s2_seeded_states(spark, sf_dir):
    return plain(log.seeded_states(states(spark, sf_dir), START, STOP, seed_days=3))


@query("s3_numeric", sql(L, f"SELECT household_id, entity_id, ts_us, seq, number FROM lg WHERE number IS NOT NULL AND ts_us >= {START} AND ts_us < {STOP}"))
def s3_numeric(spark, sf_dir):
    return log.numeric(states(spark, sf_dir), START, STOP).drop("value")


@query("s4_seeded_numeric", sql(L, f"""
SELECT household_id, entity_id, ts_us, seq, number FROM lg WHERE number IS NOT NULL AND ts_us >= {START} AND ts_us < {STOP}
UNION ALL SELECT household_id, entity_id, {START}, -1, arg_max(number, ts_us) FROM lg WHERE number IS NOT NULL AND ts_us < {START} GROUP BY ALL"""))
def s4_seeded_numeric(spark, sf_dir):
    return log.seeded_numeric(states(spark, sf_dir), START, STOP, seed_days=None).drop("value")


@query("s5_annotated_csv", sql([EVENTS], "SELECT seq, ts_us, state AS value FROM ev"))
def s5_annotated_csv(spark, sf_dir):
    """The log exported as annotated CSV, with headers repeated, and read back."""
    path = session.new_folder(spark, "csv")
    ev = build.events(spark, sf_dir)
    lines = driver.person_events(ev).select(
        F.concat_ws(",", F.lit(""), F.lit("_result"), "seq", "ts_us", "value").alias("value"), "seq")
    lines = lines.select(F.explode(F.when(F.col("seq") % 50 == 0, F.array(
        F.lit("#datatype,string,long,long,string"), F.lit(",result,seq,_time,_value"), F.col("value"),
        F.concat_ws(",", F.lit(""), F.lit("_result"), "seq", F.lit(""), F.lit("lost")))).otherwise(F.array("value"))).alias("value"))
    lines.write.text(path)
    rows = exports.annotated_csv(spark, path, "none string, result string, seq string, _time string, _value string")
    return rows.select(F.col("seq").cast("long"), F.col("_time").cast("long").alias("ts_us"), F.col("_value").alias("value"))


@query("s6_unit_keyed", sql(L, "SELECT household_id, entity_id, ts_us, seq, number FROM lg WHERE number IS NOT NULL"))
def s6_unit_keyed(spark, sf_dir):
    """Sensors of even households have a unit; the others are filed under their own id."""
    rows = states(spark, sf_dir).where("entity_id like 'sensor%'")
    unit = F.when(F.col("household_id") % 2 == 0, "m")
    object_id = F.regexp_replace("entity_id", r"^[^.]*\.", "")
    points = rows.select("household_id", F.coalesce(unit, "entity_id").alias("measurement"), object_id.alias("object_id"),
                         F.lit("value").alias("field"), "ts_us", "seq", "value")
    units = rows.select("household_id", "entity_id").distinct().withColumn("unit", unit)
    return log.unit_keyed(points, units)


@query("s7_history_json", sql([EVENTS], "SELECT household_id, 'person.' || subject AS entity_id, ts_us, state AS value FROM ev"))
def s7_history_json(spark, sf_dir):
    """Responses of one entity-day each, only their first entry naming the entity."""
    ev = driver.person_events(build.events(spark, sf_dir))
    entity = F.concat(F.lit("person."), "subject")
    day = F.call_function("div", F.col("ts_us"), F.lit(DAY))
    stamp = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    entry = F.struct("ts_us", F.col("value").alias("state"), stamp.alias("at"))
    grouped = ev.groupBy("household_id", entity.alias("entity"), day.alias("day")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    body = F.to_json(F.array(F.transform("e", lambda e, i: F.struct(
        F.when(i == 0, F.col("entity")).alias("entity_id"), e["state"].alias("state"),
        F.when(i % 2 == 0, e["at"]).alias("last_changed"), F.when(i % 2 == 1, e["at"]).alias("last_updated")))))
    flat = exports.history_json(grouped.select("household_id", "day", "entity", body.alias("body")), "body", ["household_id", "day", "entity"])
    return flat.select("household_id", "entity_id", "ts_us", "value")


@query("s7_normalised_gaps", sql(L, """
SELECT household_id, entity_id, ts_us, CASE WHEN value IN ('unknown', 'unavailable') THEN 'unknown' ELSE value END AS value FROM lg
WHERE NOT (entity_id LIKE 'sensor%' AND value = 'unavailable')"""))
def s7_normalised_gaps(spark, sf_dir):
    rows = states(spark, sf_dir)
    flags = rows.select(*log.ENTITY).distinct().withColumn("keep_gap", F.col("entity_id").startswith("person")).withColumn("keep_absence", F.lit(False))
    return log.normalise_empty(rows, flags).select("household_id", "entity_id", "ts_us", F.expr(TEXT).alias("value"))


# Keys collide when time is cut to six hours.
COARSE = "ts_us // 21600000000 * 21600000000"


def coarse(df):
    six = F.lit(21_600_000_000)
    return df.withColumn("ts_us", F.call_function("div", F.col("ts_us"), six) * six)


@query("s8_insert_or_ignore", sql(L, f"""
SELECT household_id, entity_id, {COARSE} AS ts_us, min(seq) AS seq, arg_min(value, seq) AS value FROM lg GROUP BY 1, 2, 3"""))
def s8_insert_or_ignore(spark, sf_dir):
    """Everything up to a moment is there already, then everything is sent again."""
    rows = coarse(states(spark, sf_dir))
    there = log.first_rows(rows.where(F.col("ts_us") < START))
    return log.append(there, rows).withColumn("value", F.expr(TEXT))


@query("s9_collect", sql(L, f"""
SELECT l.household_id, l.entity_id, l.ts_us FROM lg l LEFT JOIN (SELECT household_id, entity_id, ts_us FROM lg WHERE ts_us < {START}) o
  ON o.household_id = l.household_id AND o.entity_id = l.entity_id AND o.ts_us = l.ts_us
WHERE l.ts_us < {NOW} AND o.ts_us IS NULL
UNION ALL SELECT DISTINCT household_id, 'hearthlog.heartbeat', {NOW} FROM lg"""))
def s9_collect(spark, sf_dir):
    rows = states(spark, sf_dir)
    wanted = rows.select(*log.ENTITY).distinct()
    return log.pull(rows.where(F.col("ts_us") < START), rows, wanted, NOW).select("household_id", "entity_id", "ts_us")


@query("s10_pull_windows", sql(L, f"""
SELECT household_id, entity_id, CAST(i AS INT) AS position, {NOW} - i * 7 * {DAY} AS until_us, greatest(b, {NOW} - (i + 1) * 7 * {DAY}) AS from_us, ({NOW} - b) // 21600000000 AS bucket
FROM (SELECT household_id, entity_id, max(ts_us) - 5400000000 AS b FROM lg WHERE ts_us < {START} GROUP BY ALL) CROSS JOIN range(0, 60) r(i)
WHERE {NOW} - i * 7 * {DAY} > b"""))
def s10_pull_windows(spark, sf_dir):
    known = states(spark, sf_dir).where(F.col("ts_us") < START)
    plan = log.pull_plan(known, known.select(*log.ENTITY).distinct(), NOW)
    return log.pull_windows(plan, NOW, 7).select(*log.ENTITY, "position", "until_us", "from_us", "bucket")


@query("s11_liveness_times", sql([EVENTS], "SELECT DISTINCT household_id, ts_us // 86400000000 * 86400000000 AS ts_us FROM ev"))
def s11_liveness_times(spark, sf_dir):
    """A heartbeat per household and day with traffic, found again in the log."""
    ev = build.events(spark, sf_dir)
    beats = ev.select("household_id", (F.call_function("div", F.col("ts_us"), F.lit(DAY)) * DAY).alias("ts_us")).distinct().select(
        "household_id", F.lit(log.HEARTBEAT).alias("entity_id"), "ts_us", F.lit(0).cast("long").alias("seq"), F.lit("ok").alias("value"))
    return log.liveness_times(states(spark, sf_dir).unionByName(beats))


@query("s12_sampled_distances", sql([EVENTS], """
SELECT household_id, seq, round(12742000.0 * asin(sqrt(pow(sin(radians(lat - 52) / 2), 2) + cos(radians(52.0)) * cos(radians(lat)) * pow(sin(radians(lon - 4.5) / 2), 2))), 3) AS metres
FROM (SELECT household_id, user_id, seq, 52 + reading / 1000 AS lat, 4.5 + (seq % 100) / 1000.0::DOUBLE AS lon FROM ev) WHERE user_id % 3 <> 0"""))
def s12_sampled_distances(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    fixes = ev.select("household_id", "subject", "ts_us", "seq", (F.col("reading") / 1000 + 52).alias("lat"), ((F.col("seq") % 100) / 1000.0 + 4.5).alias("lon"))
    homes = ev.select("household_id").distinct().withColumn("home_lat", F.lit(52.0)).withColumn("home_lon", F.lit(4.5))
    return log.sampled_distances(fixes, homes, driver.direction_people(ev)).select("household_id", "seq", rnd("metres", 3).alias("metres"))


@query("s13_backfill", sql(L, f"""
SELECT household_id, entity_id, count(DISTINCT ts_us) FILTER (ts_us >= {START}) AS n_before, count(DISTINCT ts_us) AS n_after FROM lg GROUP BY ALL"""))
def s13_backfill(spark, sf_dir):
    rows = states(spark, sf_dir)
    return log.backfill_report(rows.where(F.col("ts_us") >= START), rows)


@query("s14_history_start", sql([EVENTS], f"SELECT household_id, min(ts_us) AS start_us FROM ev GROUP BY ALL"))
def s14_history_start(spark, sf_dir):
    rows = states(spark, sf_dir)
    return log.history_start(rows.select("household_id").distinct(), rows, NOW)


@query("s15_last_seen", sql(L, "SELECT household_id, entity_id, max(ts_us) AS last_us FROM lg GROUP BY ALL"))
def s15_last_seen(spark, sf_dir):
    return log.last_seen(states(spark, sf_dir))


@query("s16_count", sql(L, "SELECT count(*) AS n FROM lg"))
def s16_count(spark, sf_dir):
    return states(spark, sf_dir).agg(F.count("*").alias("n"))


@query("s17_span", sql(L, f"""
SELECT min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS n_rows, round_even((max(ts_us) - min(ts_us)) / 8.64e10, 1) AS days FROM lg"""))
def s17_span(spark, sf_dir):
    return log.span(states(spark, sf_dir))


@query("s18_inventory", sql(L, "SELECT household_id, entity_id, count(*) AS n_rows, min(ts_us) AS first_us, max(ts_us) AS last_us FROM lg GROUP BY ALL"))
def s18_inventory(spark, sf_dir):
    return log.inventory(states(spark, sf_dir))


@query("s19_value_counts", sql(L, """
SELECT household_id, entity_id, value, n, CAST(place AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY household_id, entity_id ORDER BY n DESC, value) AS place
  FROM (SELECT household_id, entity_id, value, count(*) AS n FROM lg WHERE entity_id LIKE 'person%' GROUP BY ALL)) WHERE place <= 3"""))
def s19_value_counts(spark, sf_dir):
    return log.value_counts(states(spark, sf_dir).where("entity_id like 'person%'"), 3)


@query("s20_archive", sql([EVENTS], """
SELECT household_id, 'person.' || subject AS entity_id, 'state' AS field, count(*) AS n_rows, min(ts_us) AS first_us, max(ts_us) AS last_us,
       arg_min(state, ts_us) AS first_value, arg_max(state, ts_us) AS last_value FROM ev GROUP BY ALL
UNION ALL SELECT DISTINCT household_id, 'person.absent', NULL, 0, NULL, NULL, NULL, NULL FROM ev"""))
def s20_archive(spark, sf_dir):
    """Every person is archived twice, as text and as a number; nobody counts twice."""
    rows = states(spark, sf_dir).where("entity_id like 'person%'").withColumn("field", F.lit("state"))
    twin = rows.withColumn("field", F.lit("value")).withColumn("value", F.lit("1"))
    people = rows.select(*log.ENTITY).distinct()
    nobody = people.select("household_id", F.lit("person.absent").alias("entity_id")).distinct()
    return log.archive(rows.unionByName(twin), people.unionByName(nobody))


# --- catalogs --------------------------------------------------------------------

def catalog(ev):
    """What each household owns, one entry per thing, in order of first use."""
    people = ev.groupBy("household_id", "subject", "user_id").agg(F.min("seq").alias("at"))
    u = F.col("subject")
    def thing(entity, name, unit=None, when=None):
        return F.when(F.lit(True) if when is None else when, F.struct(
            entity.alias("entity_id"), name.alias("name"), F.lit(unit).cast("string").alias("unit")))
    n = F.col("user_id") % 3
    things = F.array(thing(F.concat(F.lit("person."), u), F.concat(F.lit("User "), u)),
                     thing(F.concat(F.lit("sensor.home_"), u, F.lit("_distance")), F.lit(""), "m", n == 0),
                     thing(F.concat(F.lit("sensor.home_"), u, F.lit("_direction_of_travel")), F.lit(""), None, n != 1),
                     thing(F.concat(F.lit("sensor."), u, F.lit("_next_alarm")), F.lit("")),
                     thing(F.concat(F.lit("light."), u, F.lit("_distance")), F.lit("Lamp")))
    own = people.select("household_id", "at", F.posexplode(things).alias("i", "t")).where("t is not null").select(
        "household_id", (F.col("at") * 10 + F.col("i")).alias("position"), "t.*", F.lit(None).cast("array<string>").alias("members"))
    shared = people.groupBy("household_id").agg(F.collect_set(F.concat(F.lit("person."), u)).alias("m"))
    fixed = F.array(*[F.struct(F.lit(a).alias("entity_id"), F.lit(b).alias("name"), F.lit(c).alias("peopled")) for a, b, c in
                      [("zone.home", "Home", False), ("zone.office", "Office", False), ("group.family", "Family", True), ("group.lamps", "All lamps", False)]])
    rest = shared.select("household_id", "m", F.posexplode(fixed).alias("i", "t")).select(
        "household_id", (F.col("i") - 10).cast("long").alias("position"), "t.entity_id", "t.name", F.lit(None).cast("string").alias("unit"),
        F.when(F.col("t.peopled"), F.col("m")).otherwise(F.array(F.lit("light.one"))).alias("members"))
    return own.unionByName(rest)


@query("s21_entity_sets", sql([EVENTS], """
SELECT DISTINCT household_id, 'person.' || subject AS entity_id, true AS tracked, false AS absence, true AS presence, true AS trigger FROM ev
UNION ALL SELECT DISTINCT household_id, 'group.family', true, false, true, true FROM ev
UNION ALL SELECT DISTINCT household_id, 'zone.office', true, false, false, true FROM ev
UNION ALL SELECT DISTINCT household_id, 'sensor.' || subject || '_next_alarm', true, true, false, false FROM ev
UNION ALL SELECT DISTINCT household_id, 'sensor.home_' || subject || '_distance', true, false, false, false FROM ev WHERE user_id % 3 = 0
UNION ALL SELECT DISTINCT household_id, 'sensor.home_' || subject || '_direction_of_travel', true, false, false, false FROM ev WHERE user_id % 3 <> 1"""))
def s21_entity_sets(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    things = catalog(ev)
    # Match by the whole slug here, so that u1 does not take the sensors of u10.
    return devices.entity_sets(exact_subjects(things), driver.zones(ev), devices.proposed_households(things))


def exact_subjects(things):
    out = devices.people(things)
    ids = things.select("household_id", "entity_id").where("entity_id like 'sensor%'")
    for role, suffix in devices.SUFFIXES.items():
        mine = ids.where(F.col("entity_id").endswith(suffix)).select(
            "household_id", F.regexp_extract("entity_id", "(u[0-9]+)" + suffix + "$", 1).alias("slug"), F.col("entity_id").alias(f"{role}_entity"))
        out = out.join(mine, ["household_id", "slug"], "left")
    return out


MATCH = """
ppl AS (SELECT DISTINCT household_id, 'person.' || subject AS person, subject AS slug FROM ev),
fst AS (SELECT household_id, subject, user_id, min(seq) AS at_seq FROM ev GROUP BY ALL),
sen AS (SELECT household_id, at_seq * 10 + 1 AS pos, 'distance' AS role, 'sensor.home_' || subject || '_distance' AS id FROM fst WHERE user_id % 3 = 0
        UNION ALL SELECT household_id, at_seq * 10 + 2, 'direction', 'sensor.home_' || subject || '_direction_of_travel' FROM fst WHERE user_id % 3 <> 1
        UNION ALL SELECT household_id, at_seq * 10 + 3, 'alarm', 'sensor.' || subject || '_next_alarm' FROM fst)"""


@query("s22_match_sensors", sql([EVENTS, MATCH], """
SELECT household_id, person, slug, role, arg_min(id, pos) AS entity_id FROM ppl JOIN sen USING (household_id) WHERE contains(id, slug) GROUP BY ALL"""))
def s22_match_sensors(spark, sf_dir):
    return devices.match_sensors(catalog(build.events(spark, sf_dir)))


@query("s23_candidates", sql([EVENTS], """
SELECT DISTINCT household_id, 'people' AS kind, 'person.' || subject AS entity_id, 'User ' || subject AS label, 'user ' || subject AS sort_key FROM ev
UNION ALL SELECT DISTINCT household_id, 'zones', 'zone.office', 'Office', 'office' FROM ev
UNION ALL SELECT DISTINCT household_id, 'groups', 'group.family', 'Family', 'family' FROM ev"""))
def s23_candidates(spark, sf_dir):
    return devices.candidates(catalog(build.events(spark, sf_dir)))


@query("s24_units", sql([EVENTS], "SELECT DISTINCT household_id, 'sensor.home_' || subject || '_distance' AS entity_id, 'm' AS unit FROM ev WHERE user_id % 3 = 0"))
def s24_units(spark, sf_dir):
    things = catalog(build.events(spark, sf_dir))
    return devices.named(things, things, "unit")


@query("s25_proposed_subjects", sql([EVENTS, MATCH], """
SELECT p.household_id, person, slug, max(f) FILTER (role = 'distance') AS distance_entity, max(f) FILTER (role = 'direction') AS direction_entity,
       max(f) FILTER (role = 'alarm') AS alarm_entity, CASE WHEN max(f) FILTER (role = 'distance') IS NOT NULL THEN 'm' END AS unit
FROM ppl p LEFT JOIN (SELECT household_id, person, role, arg_min(id, pos) AS f FROM ppl JOIN sen USING (household_id) WHERE contains(id, slug) GROUP BY ALL) USING (household_id, person) GROUP BY ALL"""))
def s25_proposed_subjects(spark, sf_dir):
    return devices.proposed_subjects(catalog(build.events(spark, sf_dir)))


# --- predicates -------------------------------------------------------------------

@query("p1_is_empty", sql([EVENTS], "SELECT seq, event_type = 'error' AS is_empty FROM ev"))
def p1_is_empty(spark, sf_dir):
    """Lost readings in many spellings."""
    ev = driver.person_events(build.events(spark, sf_dir))
    spelt = F.when(F.col("value") != "unknown", F.concat(F.lit(" "), "value")).otherwise(F.get(F.array(
        F.lit(None).cast("string"), F.lit(""), F.lit("  "), F.lit("Unknown"), F.lit(" UNAVAILABLE "), F.lit("none")), (F.col("seq") % 6).cast("int")))
    return ev.select("seq", st.is_empty(spelt).alias("is_empty"))


@query("p2_slugify", sql([EVENTS], "SELECT seq, 'user_' || subject || '_' || event_type AS slug FROM ev"))
def p2_slugify(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    return ev.select("seq", st.slugify(F.concat(F.lit("person.User "), "subject", F.lit("--"), F.upper("event_type"), F.lit("!_"))).alias("slug"))


@query("p3_unique_slugs", sql([EVENTS], """
SELECT household_id, entity_id, CASE WHEN n = 1 THEN 'guest' ELSE 'guest_' || n END AS slug
FROM (SELECT household_id, 'person.' || repeat('_', CAST(user_id % 3 AS INT)) || 'guest' AS entity_id, row_number() OVER (PARTITION BY household_id ORDER BY user_id) AS n
      FROM (SELECT DISTINCT household_id, user_id FROM ev))"""))
def p3_unique_slugs(spark, sf_dir):
    people = build.events(spark, sf_dir).select("household_id", "user_id").distinct()
    dashes = F.repeat(F.lit("_"), (F.col("user_id") % 3).cast("int"))
    return devices.unique_slugs(people.select("household_id", F.col("user_id").alias("position"), F.concat(F.lit("person."), dashes, F.lit("guest")).alias("entity_id")))


@query("p4_zone_names", sql([EVENTS], """
SELECT seq, CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'home' WHEN 'signup' THEN 'zone:office' WHEN 'purchase' THEN '__other__' ELSE 'unknown' END AS zone FROM ev"""))
def p4_zone_names(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    shouted = driver.person_events(ev).withColumn("value", F.when(F.col("value") == "Office", " OFFICE ").otherwise(F.col("value")))
    return g.resolve_zones(shouted, driver.zones(ev)).select("seq", "zone")


@query("p5_unmatched_away", sql([EVENTS], "SELECT household_id, state, count(*) AS n FROM ev WHERE state = 'unknown' GROUP BY ALL"))
def p5_unmatched_away(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    return g.unmatched_away_states(driver.person_events(ev), driver.zones(ev))


@query("p9_should_fire", sql([EVENTS], """
SELECT seq, CASE WHEN state = 'unknown' THEN false WHEN was IS NULL OR was = 'unknown' THEN true ELSE was <> state END AS fires
FROM (SELECT *, lag(state) OVER (PARTITION BY subject ORDER BY ts_us, seq) AS was FROM ev)"""))
def p9_should_fire(spark, sf_dir):
    from hearthlog.operators.chunks import with_previous
    moved = with_previous(driver.person_events(build.events(spark, sf_dir)), ["household_id", "subject"], "value", "was")
    return moved.select("seq", st.should_fire(F.col("was"), F.col("value")).alias("fires"))


@query("p10_kinds", sql(L, "SELECT DISTINCT household_id, entity_id, CASE WHEN entity_id LIKE 'person%' THEN 'presence' ELSE 'numeric' END AS kind FROM lg"))
def p10_kinds(spark, sf_dir):
    return x.kinds(states(spark, sf_dir).where("value <> 'unavailable'"))


@query("p11_roles", sql(L, """
SELECT DISTINCT household_id, entity_id, CASE WHEN entity_id LIKE 'person%' THEN 'person' ELSE 'untracked' END AS role FROM lg
UNION ALL SELECT DISTINCT household_id, 'group.family', 'house' FROM ev UNION ALL SELECT DISTINCT household_id, 'zone.office', 'zone' FROM ev
UNION ALL SELECT DISTINCT household_id, 'sensor.home_' || subject || '_distance', 'proximity' FROM ev WHERE user_id % 3 = 0
UNION ALL SELECT DISTINCT household_id, 'sensor.home_' || subject || '_direction_of_travel', 'direction' FROM ev WHERE user_id % 3 <> 1
UNION ALL SELECT DISTINCT household_id, 'hearthlog.' || subject || '_distance', 'synthetic-distance' FROM ev"""))
def p11_roles(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    things = catalog(ev)
    subjects = exact_subjects(things)
    parts = [states(spark, sf_dir).select(*log.ENTITY).distinct(),
             things.where("entity_id in ('group.family', 'zone.office') or entity_id like 'sensor.home%'").select(*log.ENTITY),
             subjects.select("household_id", F.concat(F.lit("hearthlog."), "slug", F.lit("_distance")).alias("entity_id"))]
    return x.roles(parts[0].unionByName(parts[1]).unionByName(parts[2]), subjects, driver.zones(ev), devices.proposed_households(things))


@query("p12_clamps", "SELECT event_id AS seq, CASE WHEN round_even(value, 0) = 0 THEN 7 ELSE least(greatest(round_even(value * 2, 0), 1), 90) END AS days, least(greatest(value / 50, 0.01), 0.99) AS cut FROM events")
def p12_clamps(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    asked = F.when(F.bround("reading", 0) != 0, F.bround(F.col("reading") * 2, 0))
    return ev.select("seq", st.clamp_days(asked).alias("days"), st.clamp(F.col("reading") / 50, 0.01, 0.99).alias("cut"))


@query("p13_safe_numbers", "SELECT event_id AS seq, CASE WHEN event_type NOT IN ('error', 'view') THEN round_even(value / 7, 4) END AS safe FROM events")
def p13_safe_numbers(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    odd = F.when(F.col("event_type") == "error", float("nan")).when(F.col("event_type") == "view", float("inf")).otherwise(F.col("reading") / 7)
    return ev.select("seq", st.safe_number(odd).alias("safe"))


# --- the explorer -----------------------------------------------------------------------

@query("x1_inventory", sql(L, """
SELECT household_id, entity_id, count(*) AS n_rows, min(ts_us) AS first_us, max(ts_us) AS last_us, CASE WHEN entity_id LIKE 'person%' THEN 'presence' ELSE 'numeric' END AS kind, entity_id LIKE 'person%' AS tracked
FROM lg WHERE value <> 'unavailable' GROUP BY ALL
UNION ALL SELECT DISTINCT household_id, 'zone.office', 0, NULL, NULL, 'other', true FROM ev"""))
def x1_inventory(spark, sf_dir):
    rows = states(spark, sf_dir).where("value <> 'unavailable'")
    ev = build.events(spark, sf_dir)
    tracked = rows.where("entity_id like 'person%'").select(*log.ENTITY).distinct().unionByName(driver.zones(ev).select("household_id", "entity_id"))
    return x.archive_inventory(rows, tracked)


@query("x2_feature_inventory", sql(ALL_ORIGINS, " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{fam}' AS family, count(*) AS n_rows, count(*) - count({c}) AS nulls, round(min({c}), 6) AS low, round(max({c}), 6) AS high FROM origins"
    for c, fam in [("home_frac", "target"), ("coverage", "state"), ("minutes_in_state", "state"), ("zone_office", "zone"), ("zone_other", "zone")])))
def x2_feature_inventory(spark, sf_dir):
    table = build.origins(build.events(spark, sf_dir))
    return rounded(cat.null_statistics(table, ["home_frac", "coverage", "minutes_in_state", "zone_office", "zone_other"]), "low", "high")


@query("x2_family_nulls", sql(ALL_ORIGINS, """
SELECT 'target' AS family, 1 AS n_columns, round_even((count(*) - count(home_frac)) / count(*), 4) AS null_frac FROM blank
UNION ALL SELECT 'state', 2, round_even((2 * count(*) - count(coverage) - count(minutes_in_state)) / (2 * count(*)), 4) FROM blank"""))
def x2_family_nulls(spark, sf_dir):
    return cat.family_statistics(cat.null_statistics(build.slots(build.events(spark, sf_dir)), ["home_frac", "coverage", "minutes_in_state"]))


@query("x3_feature_series", sql(ALL_ORIGINS, """
SELECT household_id, subject, slot, round(home_frac, 6) AS home_frac, thinned FROM (
  SELECT household_id, subject, slot, home_frac, count(*) OVER w > 400 AS thinned, row_number() OVER (w ORDER BY slot) - 1 AS i,
         CASE WHEN count(*) OVER w > 400 THEN count(*) OVER w // 400 + 1 ELSE 1 END AS k
  FROM (SELECT *, max(slot) OVER (PARTITION BY household_id, subject) AS top FROM blank) WHERE slot >= top - 480 WINDOW w AS (PARTITION BY household_id, subject)) WHERE i % k = 0"""))
def x3_feature_series(spark, sf_dir):
    return rounded(x.feature_series(build.slots(build.events(spark, sf_dir)), "home_frac", 10, 400), "home_frac")


@query("x8_observed_runs", sql(ALL_ORIGINS, """
SELECT household_id, min(slot) AS first, max(slot) AS last FROM (
  SELECT household_id, slot, slot - row_number() OVER (PARTITION BY household_id ORDER BY slot) AS island FROM seen WHERE NOT observable) GROUP BY household_id, island""").replace("SELECT household_id, min(slot) AS first", "SELECT household_id, min(slot) AS first"))
def x8_observed_runs(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    return x.runs(g.observability(build.households(ev), ev).where("not observable"), ["household_id"], "slot")


@query("x10_signals", sql([EVENTS], """
SELECT household_id, count(DISTINCT subject) AS people, count(DISTINCT CASE WHEN user_id % 3 = 0 THEN subject END) AS real_distance,
       count(DISTINCT CASE WHEN user_id % 3 <> 0 THEN subject END) AS synthesised, count(*) FILTER (state = 'unknown') AS unmatched FROM ev GROUP BY ALL"""))
def x10_signals(spark, sf_dir):
    ev = build.events(spark, sf_dir)
    subjects = exact_subjects(catalog(ev))
    lost = g.unmatched_away_states(driver.person_events(ev), driver.zones(ev)).groupBy("household_id").agg(F.sum("n").alias("unmatched"))
    have = subjects.groupBy("household_id").agg(F.count("*").alias("people"), F.count("distance_entity").alias("real_distance"),
                                                F.count_if(F.col("distance_entity").isNull()).alias("synthesised"))
    return have.join(lost, "household_id", "left").withColumn("unmatched", F.coalesce("unmatched", F.lit(0)))


@query("g15_entity_series", sql(L, """
SELECT household_id, entity_id, ts_us, value, number, raw_rows, raw_rows > 50 AS truncated FROM (
  SELECT *, count(*) OVER (PARTITION BY household_id, entity_id) AS raw_rows, row_number() OVER (PARTITION BY household_id, entity_id ORDER BY ts_us DESC, seq DESC) AS i FROM lg) WHERE i <= 50"""))
def g15_entity_series(spark, sf_dir):
    return plain(x.newest_events(states(spark, sf_dir), limit=50)).drop("seq")


def _catalog_columns(spark, sf_dir):
    """The wide columns of each household: its subjects give the cross-subject ones."""
    ev = build.events(spark, sf_dir)
    roles = driver.subjects(ev).groupBy("household_id").agg(F.sort_array(F.collect_set("subject")).alias("roles"))
    axis = roles.withColumn("horizon_h", F.explode(F.sequence(F.lit(1), F.lit(48))))
    return cat.horizon_columns(axis, F.col("roles"))


N_SUBJECTS = "ns AS (SELECT household_id, count(DISTINCT subject) + 1 AS k FROM ev GROUP BY ALL)"


@query("p6_column_family", sql([EVENTS, N_SUBJECTS, """
fam AS (SELECT * FROM (VALUES ('horizon_target', 1), ('target_calendar', 10), ('daily_lag', 6), ('climatology', 2), ('climatology_slope', 2), ('slot_climatology', 1), ('next_alarm', 1)) f(family, n))"""], """
SELECT household_id, family, n * 48 AS n_columns FROM ns CROSS JOIN fam UNION ALL SELECT household_id, 'cross_subject_lag', k * 48 FROM ns"""))
def p6_column_family(spark, sf_dir):
    return _catalog_columns(spark, sf_dir).groupBy("household_id", "family").agg(F.count("*").alias("n_columns"))


@query("x4_lag_safety", sql([EVENTS], """
SELECT household_id, h AS horizon_h, k AS days, 24 * k >= h AS safe FROM (SELECT DISTINCT household_id FROM ev) CROSS JOIN range(1, 49) r(h) CROSS JOIN (VALUES (1), (2), (3), (7), (14), (21)) k(k)"""))
def x4_lag_safety(spark, sf_dir):
    return cat.lag_safety(_catalog_columns(spark, sf_dir)).select("household_id", F.col("horizon_h").cast("long").alias("horizon_h"), "days", "safe")


@query("x5_horizon_recipe", sql([EVENTS, N_SUBJECTS], """
SELECT h AS horizon_h, CAST(sum(CASE WHEN h <= 24 THEN 6 ELSE 5 END) AS BIGINT) AS usable_lags, CAST(sum(k) AS BIGINT) AS cross_columns, h + 0.5 AS embargo_hours FROM ns CROSS JOIN range(1, 49) r(h) GROUP BY ALL""").replace("h + 0.5 AS", "CAST(h + 0.5 AS DOUBLE) AS"))
def x5_horizon_recipe(spark, sf_dir):
    recipe = cat.horizon_recipe(_catalog_columns(spark, sf_dir))
    return recipe.groupBy(F.col("horizon_h").cast("long").alias("horizon_h"), "embargo_hours").agg(
        F.max(F.when(F.col("family") == "daily_lag", F.col("n_usable"))).alias("usable_lags"),
        F.max(F.when(F.col("family") == "cross_subject_lag", F.col("n_columns"))).alias("cross_columns"))
