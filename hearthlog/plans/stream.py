"""Streams over the driver tables, each read until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlog.operators import grid as g
from hearthlog.plans import build
from hearthlog.plans.grid import rounded
from hearthlog.plans.log import DAY, NOW, STOP, TEXT, L
from hearthlog.plans.oracle import EVENTS, FRACTIONS, S, sql
from hearthlog.session import new_folder
from hearthlog.sources import driver, statelog
from hearthlog.streaming import ingest, slots

QUERIES, ORACLE = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


def stream(spark, sf_dir):
    """The events table as a file stream."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = spark.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.select(
        F.call_function("div", F.col("user_id"), F.lit(3)).alias("household_id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("subject"), "user_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_id").alias("seq"),
        "event_type", F.col("value").alias("reading"))


@query("v15_slot_counts", sql([EVENTS], f"SELECT household_id, ts_us // {S} AS slot, count(*) AS n FROM ev GROUP BY ALL"))
def v15_slot_counts(spark, sf_dir):
    """Slots as the stream closes them, the late and the open ones from the log."""
    emitted = ingest.drained(slots.slot_counts(stream(spark, sf_dir), ["household_id"]), "slot-counts")
    return slots.repaired_counts(emitted, build.events(spark, sf_dir), ["household_id"])


@query("v12_triggered_counts", sql([EVENTS], f"SELECT ts_us // {S} AS slot, count(*) AS n FROM ev GROUP BY ALL"))
def v12_triggered_counts(spark, sf_dir):
    emitted = ingest.drained(slots.slot_counts(stream(spark, sf_dir)), "triggered")
    return slots.repaired_counts(emitted, build.events(spark, sf_dir))


@query("s8_streaming_append", sql(L, f"""
SELECT household_id, entity_id, ts_us, seq, {TEXT} AS value FROM lg"""))
def s8_streaming_append(spark, sf_dir):
    """Two sources of different rows, each with its own checkpoint, and the first again."""
    path = new_folder(spark, "log")
    for half in (0, 1, 0):
        rows = driver.states(stream(spark, sf_dir)).where(F.col("seq") % 2 == half)
        ingest.run_ingest(rows, path, new_folder(spark, "progress")).awaitTermination()
    return ingest.read_log(spark, path).withColumn("value", F.expr(TEXT))


HEARD = f"SELECT household_id, entity_id, ts_us, seq, {TEXT} AS value FROM lg WHERE ts_us < {NOW}"


@query("s9_streaming_collect", sql(L, HEARD + "".join(f"""
UNION ALL SELECT DISTINCT household_id, 'hearthlog.heartbeat', {now}, 0, 'ok' FROM lg""" for now in (STOP, NOW))))
def s9_streaming_collect(spark, sf_dir):
    """Two collecting passes into the stored log: all there is, then what came since."""
    path = new_folder(spark, "log")
    upstream = driver.states(build.events(spark, sf_dir))
    wanted = upstream.select(*statelog.ENTITY).distinct()
    for now in (STOP, NOW):
        ingest.insert_or_ignore(statelog.pull(ingest.read_log(spark, path), upstream, wanted, now), path)
    return ingest.read_log(spark, path).withColumn("value", F.expr(TEXT))


@query("v14_late_and_repeated", sql(L, f"SELECT household_id, entity_id, ts_us, seq * 10 + 3 AS seq, {TEXT} AS value FROM lg"))
def v14_late_and_repeated(spark, sf_dir):
    """A stream for each week of the log, the newest first, into one log; every reading
    three times, the copies disagreeing: the lowest number is the first reading."""
    path = new_folder(spark, "log")
    rows = driver.states(build.events(spark, sf_dir))
    copy = F.explode(F.array(F.lit(9), F.lit(3), F.lit(7)))
    rows = rows.withColumn("copy", copy).select(
        "household_id", "entity_id", "ts_us", (F.col("seq") * 10 + F.col("copy")).alias("seq"),
        F.when(F.col("copy") == 3, F.col("value")).otherwise(F.concat("value", F.lit("?"))).alias("value"))
    first, last = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    # The calendar bounds the loop, not the readings.
    for begin in reversed(range(first, last + 1, 7 * DAY) if first is not None else ()):
        folder = new_folder(spark, "files")
        rows.where((F.col("ts_us") >= begin) & (F.col("ts_us") < begin + 7 * DAY)).write.parquet(folder)
        files = spark.readStream.schema(rows.schema).parquet(folder)
        ingest.run_ingest(files, path, new_folder(spark, "progress")).awaitTermination()
    ingest.compact(spark, path, [r[0] for r in spark.range(3).selectExpr("date '2024-01-05' + int(id)").collect()])
    return ingest.read_log(spark, path).withColumn("value", F.expr(TEXT))


# The whole grid of the people, as a batch would make it.
PEOPLE_ONLY = EVENTS + """,
pres AS (SELECT household_id, subject, ts_us, seq, state FROM ev)"""


@query("v13_streaming_slots", sql([PEOPLE_ONLY, FRACTIONS], """
SELECT household_id, subject, slot, round(home_frac, 6) AS home_frac, round(coverage, 6) AS coverage FROM frac WHERE subject <> 'house'"""))
def v13_streaming_slots(spark, sf_dir):
    emitted = ingest.drained(slots.minute_summaries(driver.person_events(stream(spark, sf_dir))), "minutes")
    ev = build.events(spark, sf_dir)
    minutes = slots.repaired(emitted, driver.person_events(ev))
    return rounded(slots.finish(minutes, g.spine(driver.people(ev), ev)), "home_frac", "coverage")
