"""Looking at the log and the tables built from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.functions.states import real
from hearthlog.functions.scores import clip_p
from hearthlog.operators import fan
from hearthlog.schema import HOME_THRESHOLD, HORIZONS_H, SID
from hearthlog.sources.statelog import ENTITY, HEARTBEAT, inventory, value_counts

MAX_EVENTS, MAX_POINTS = 2000, 4000


def summary(table: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    known = F.col(value).isNotNull()
    return table.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(~known).alias("nulls"), F.min(value).alias("low"),
        F.max(value).alias("high"), F.avg(value).alias("mean"),
        F.max_by(value, F.when(known, F.col(order))).alias("last"))


def kinds(log: DataFrame, sampled: int = 4) -> DataFrame:
    """What kind of series each entity is, from its commonest values."""
    top = value_counts(log, sampled)
    kind = F.when(F.every(real(F.col("value")).isNotNull()), "numeric").otherwise("presence")
    found = top.groupBy(*ENTITY).agg(kind.alias("kind"))
    return found.withColumn("kind", F.when(F.col("entity_id") == HEARTBEAT, "heartbeat").otherwise(F.col("kind")))


def roles(entities: DataFrame, subjects: DataFrame, zones: DataFrame, households: DataFrame) -> DataFrame:
    """What each entity is used for, by identity and never by its name."""
    def part(frame, column, role, rank):
        return frame.where(F.col(column).isNotNull()).select(
            "household_id", F.col(column).alias("entity_id"), F.struct(F.lit(rank).alias("rank"), F.lit(role).alias("role")).alias("_r"))

    own = subjects.withColumn("synthetic", F.concat(F.lit("hearthlog."), "slug", F.lit("_distance")))
    known = (part(subjects, "person", "person", 1).unionByName(part(households, "house_entity", "house", 2))
             .unionByName(part(zones, "entity_id", "zone", 3)).unionByName(part(subjects, "distance_entity", "proximity", 4))
             .unionByName(part(subjects, "direction_entity", "direction", 5))
             .unionByName(part(own, "synthetic", "synthetic-distance", 6)))
    first = known.groupBy(*ENTITY).agg(F.min("_r").alias("_r")).select(*ENTITY, F.col("_r.role").alias("role"))
    out = entities.join(first, list(ENTITY), "left")
    return out.withColumn("role", F.when(F.col("entity_id") == HEARTBEAT, "heartbeat")
                          .otherwise(F.coalesce("role", F.lit("untracked"))))


def archive_inventory(log: DataFrame, tracked: DataFrame) -> DataFrame:
    """Every archived entity but the heartbeat, and every tracked one never seen."""
    found = inventory(log).join(kinds(log), list(ENTITY), "left").where(F.col("entity_id") != HEARTBEAT)
    wanted = tracked.select(*ENTITY, F.lit(True).alias("tracked"))
    out = found.join(wanted, list(ENTITY), "full_outer")
    return out.select(*ENTITY, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "first_us", "last_us",
                      F.coalesce("kind", F.lit("other")).alias("kind"),
                      F.coalesce("tracked", F.lit(False)).alias("tracked"))


def newest_events(log: DataFrame, keys: Sequence[str] = ENTITY, limit: int = MAX_EVENTS) -> DataFrame:
    """The last transitions of each entity, with how many there are in all."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts_us"), F.desc("seq"))
    newest = log.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    counts = log.groupBy(*keys).agg(F.count("*").alias("raw_rows"))
    return newest.join(counts, list(keys)).withColumn("truncated", F.col("raw_rows") > limit).drop("place")


def feature_series(table: DataFrame, column: str, days: int = 30, max_points: int = MAX_POINTS) -> DataFrame:
    """One column of every subject over its last days, thinned evenly to be drawn."""
    whole = Window.partitionBy(*SID)
    recent = (table.withColumn("_top", F.max("slot").over(whole)).where(F.col("slot") >= F.col("_top") - days * 48)
              .withColumn("_n", F.count("*").over(whole))
              .withColumn("_at", F.row_number().over(whole.orderBy("slot")) - 1))
    step = F.when(F.col("_n") > max_points, F.call_function("div", F.col("_n"), F.lit(max_points)) + 1).otherwise(1)
    return (recent.where(F.col("_at") % step == 0)
            .select(*SID, "slot", F.col(column), (F.col("_n") > max_points).alias("thinned")))


def occupied(home_frac: Column) -> Column:
    return (home_frac >= HOME_THRESHOLD).cast("double")


def verification(grid: DataFrame, forecasts: DataFrame | fan.Log, horizons: Sequence[int] = HORIZONS_H) -> tuple[DataFrame, DataFrame]:
    """What was forecast for each slot against what happened, and its score.

    `grid` holds the truth per (subject, slot); `forecasts` the latest p per
    (subject, target slot, horizon). Every slot of the grid has a point at every
    horizon, p NULL where nothing was served; a horizon that nothing was ever served
    at has `served` 0 and no score. Points of a log that lies by subject are summed where
    they meet, per (subject, horizon), with `dot`, the sum of p times the truth.
    """
    if isinstance(forecasts, fan.Log):
        points = fan.verified(grid, forecasts, horizons)
        out = points.select(*SID, "horizon_h", "slots", "served", "n", (F.col("squared") / F.col("n")).alias("brier"),
                            (F.col("off") / F.col("n")).alias("mae_frac"))
        return points, out.withColumn("served_pct", 100.0 * F.col("served") / F.col("slots"))
    long = grid.select(*SID, "slot", "home_frac", F.explode(F.lit(list(horizons))).alias("horizon_h"))
    served = forecasts.select(*SID, F.col("target_slot").alias("slot"), "horizon_h", "p")
    points = long.join(served, [*SID, "slot", "horizon_h"], "left")
    right = F.col("home_frac").isNotNull() & F.col("p").isNotNull()
    q, off = clip_p(F.col("p")) - occupied(F.col("home_frac")), F.abs(F.col("p") - F.col("home_frac"))
    out = points.groupBy(*SID, "horizon_h").agg(
        F.count("*").alias("slots"), F.count("p").alias("served"), F.count_if(right).alias("n"),
        F.avg(F.when(right, q * q)).alias("brier"), F.avg(F.when(right, off)).alias("mae_frac"))
    return points, out.withColumn("served_pct", 100.0 * F.col("served") / F.col("slots"))


def runs(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Ranges of consecutive integers, first and last inclusive."""
    w = Window.partitionBy(*keys).orderBy(position)
    islands = rows.select(*keys, position).distinct().withColumn("_island", F.col(position) - F.row_number().over(w))
    return islands.groupBy(*keys, "_island").agg(F.min(position).alias("first"), F.max(position).alias("last")).drop("_island")
