"""Slot integration on a stream.

The stream emits one summary per (subject, minute) once the watermark has passed
it, so state is a minute of one subject and leaves again. What the watermark has
not passed, or what came after it, is made good from the log: minutes whose number
of readings differs are summed up again in a batch. Carrying states across minutes
and slots is the batch step the grid uses anyway.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.functions.states import is_empty, is_home, norm
from hearthlog.operators.grid import StateSignal, equals, fill
from hearthlog.schema import HOME, SID, SLOT_US
from hearthlog.streaming.ingest import LATENESS

MINUTE_US = 60_000_000


def _summed(timed: DataFrame, start_us: Column, *by) -> DataFrame:
    """What each group, one subject's minute from `start_us`, holds."""
    rows = F.sort_array(F.collect_list(F.struct("ts_us", "seq", norm(F.col("value")).alias("v"))))
    per = timed.groupBy(*SID, *by).agg(rows.alias("r")).withColumn("minute_us", start_us)
    end = F.col("minute_us") + MINUTE_US
    held = F.transform("r", lambda e, i: F.struct(
        e["v"].alias("v"), (F.coalesce(F.get("r", i + 1)["ts_us"], end) - e["ts_us"]).alias("us")))

    def total(keep):
        return F.aggregate(F.filter(held, keep), F.lit(0).cast("long"), lambda a, e: a + e["us"])

    return per.select(*SID, "minute_us", F.size("r").cast("long").alias("n"),
                      F.get("r", F.lit(0))["ts_us"].alias("first_us"),
                      F.element_at("r", -1)["v"].alias("last"),
                      total(lambda e: ~is_empty(e["v"])).alias("obs_us"),
                      total(lambda e: is_home(e["v"])).alias("home_us"))


def minute_summaries(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """What each subject's minute holds, in append mode."""
    timed = stream.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", lateness)
    return _summed(timed, F.unix_micros("window.start"), F.window("ts", "1 minute"))


def _floor(width_us: int) -> Column:
    return F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(width_us))


def repaired(emitted: DataFrame, log: DataFrame) -> DataFrame:
    """`emitted` with every minute as the log has it: late readings counted in, and
    the minutes that no watermark has passed yet. `log` may be the days to repair."""
    keyed = log.withColumn("minute_us", _floor(MINUTE_US))
    key = [*SID, "minute_us"]
    there = keyed.groupBy(*key).agg(F.count("*").alias("n"))
    wrong = there.join(emitted.select(*key, "n"), [*key, "n"], "left_anti").select(*key)
    again = _summed(keyed.join(wrong, key, "left_semi"), F.col("minute_us"), "minute_us")
    return emitted.join(wrong, key, "left_anti").unionByName(again)


def finish(summaries: DataFrame, subjects: DataFrame) -> DataFrame:
    """The slot table of all minutes emitted so far."""
    keyed = summaries.withColumn("slot", F.call_function("div", F.col("minute_us"), F.lit(SLOT_US)))
    w = Window.partitionBy(*SID, "slot").orderBy("minute_us")
    until = F.coalesce(F.lead("first_us").over(w), (F.col("slot") + 1) * SLOT_US)
    idle = until - (F.col("minute_us") + MINUTE_US)
    known = ~is_empty(F.col("last"))
    chunks = keyed.withColumn("_idle", idle).groupBy(*SID, "slot").agg(
        F.min("first_us").alias("_presence_first_us"), F.max_by("last", "minute_us").alias("_presence_last"),
        F.sum(F.col("obs_us") + F.when(known, F.col("_idle")).otherwise(0)).alias("_presence_obs"),
        F.sum(F.col("home_us") + F.when(is_home(F.col("last")), F.col("_idle")).otherwise(0)).alias("_presence_m_home_frac"))
    part = StateSignal("presence", {"home_frac": equals(HOME)}, "presence")
    out = fill(chunks, subjects, [part])
    return out.select(*SID, "slot", "home_frac", F.col("presence_coverage").alias("coverage"))


def slot_counts(stream: DataFrame, keys: Sequence[str] = (), lateness: str = LATENESS) -> DataFrame:
    """Readings per half-hour slot, emitted once a slot is closed."""
    timed = stream.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", lateness)
    counted = timed.groupBy(*keys, F.window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    slot = F.call_function("div", F.unix_micros("window.start"), F.lit(SLOT_US))
    return counted.select(*keys, slot.alias("slot"), "n")


def repaired_counts(emitted: DataFrame, log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`emitted` with late readings and slots still open counted from the log."""
    slot = F.call_function("div", F.col("ts_us"), F.lit(SLOT_US))
    there = log.groupBy(*keys, slot.alias("slot")).agg(F.count("*").alias("n"))
    wrong = there.join(emitted, [*keys, "slot", "n"], "left_anti")
    return emitted.join(wrong, [*keys, "slot"], "left_anti").unionByName(wrong)
