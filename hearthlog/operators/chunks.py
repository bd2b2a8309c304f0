"""Ordered work on a log, one half-hour chunk at a time.

A window over a whole entity would put all its rows in one task, and one entity
may hold a third of the log. So rows are ordered inside (entity, slot) only, and
what crosses a chunk border travels as one summary row per chunk. The summaries
of an entity are bounded by the calendar, not by how chatty the entity is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hearthlog.functions.clock import slot_of


def with_slot(events: DataFrame) -> DataFrame:
    return events if "slot" in events.columns else events.withColumn("slot", slot_of(F.col("ts_us")))


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def after(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(1, Window.unboundedFollowing)


def in_chunk(keys: Sequence[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys, "slot").orderBy(*(order or ("ts_us", "seq")))


def chunk_carry(events: DataFrame, keys: Sequence[str], summaries: dict[str, Column],
                carries: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """Add what the other chunks of the same key contribute to each row.

    `summaries` are aggregates per chunk; `carries` turn them into values over
    the key's chunks in time order.
    """
    events = with_slot(events)
    per_chunk = events.groupBy(*keys, "slot").agg(
        *[column.alias(name) for name, column in summaries.items()])
    w = Window.partitionBy(*keys).orderBy("slot")
    carried = per_chunk.select(
        *keys, "slot", *[make(w).alias(name) for name, make in carries.items()])
    return events.join(carried, [*keys, "slot"])


def with_previous(events: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """The value of `column` on the previous row of the same key."""
    newest = F.max_by(F.struct(column), F.struct("ts_us", "seq"))
    carried = chunk_carry(events, keys, {"_newest": newest}, {
        "_carry": lambda w: F.last("_newest", ignorenulls=True).over(before(w))})
    here = F.lag(F.struct(column)).over(in_chunk(keys))
    return carried.withColumn(out, F.coalesce(here, F.col("_carry"))[column]).drop("_carry")


def as_of(points: DataFrame, readings: DataFrame, keys: Sequence[str], value: str,
          out: str, max_age_min: float | None = None) -> DataFrame:
    """Backward as-of join: the last reading at or before each point.

    Points carry `ts_us`; readings carry `ts_us`, `seq` and `value`. A reading at
    the very instant of a point counts. With `max_age_min` an older one does not.
    """
    extra = [c for c in points.columns if c not in (*keys, "ts_us", "slot")]
    p = points.select(*keys, "ts_us", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("seq"),
                      F.struct(*extra).alias("_point") if extra else F.lit(True).alias("_point"),
                      F.lit(None).alias("_read"))
    r = readings.select(*keys, "ts_us", F.lit(0).alias("_side"), "seq",
                        F.lit(None).alias("_point"),
                        F.struct(F.col("ts_us").alias("at"), F.col(value).alias("v")).alias("_read"))
    merged = with_slot(p.unionByName(r))
    newest = F.max_by("_read", F.when(F.col("_side") == 0, F.struct("ts_us", "seq")))
    merged = chunk_carry(merged, keys, {"_newest": newest}, {
        "_carry": lambda w: F.last("_newest", ignorenulls=True).over(before(w))})
    w = in_chunk(keys, "ts_us", "_side", "seq")
    found = F.coalesce(F.last("_read", ignorenulls=True).over(upto(w)), F.col("_carry"))
    merged = merged.withColumn("_found", found).where("_side = 1")
    reading = F.col("_found.v")
    if max_age_min is not None:
        reading = F.when(F.col("ts_us") - F.col("_found.at") <= int(max_age_min * 60e6), reading)
    point = ["_point.*"] if extra else []
    return merged.select(*keys, "ts_us", *point, reading.alias(out))
