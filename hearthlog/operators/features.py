"""Leakage-safe features for many horizons.

Everything about a forecast but its answer and the alarm is a fact about the
target slot, read a whole number of days back. So it is computed once per slot and
then read ahead by each horizon inside the same sorted partition: no join, and no
wide table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.functions import clock
from hearthlog.schema import (CLIMATOLOGY_WEEKS, DAILY_LAGS, HORIZONS_H, SID, SLOT_CLIMATOLOGY_DAYS,
                              SLOTS_PER_DAY, SLOTS_PER_HOUR, WIDE_CLIMATOLOGY_WEEKS)

# Slots past the end of the grid that a forecast may point at.
AHEAD_SLOTS = max(HORIZONS_H) * SLOTS_PER_HOUR
WEEK = 7 * SLOTS_PER_DAY


def lag_is_legal(days: int | Column, horizon_h: int | Column):
    """A daily lag of the target may be read only if it lies before the origin."""
    return 24 * days >= horizon_h


def safe_daily_lags(horizon_h: int) -> tuple[int, ...]:
    return tuple(k for k in DAILY_LAGS if lag_is_legal(k, horizon_h))


def slot_climatology_days(horizon_h: int) -> tuple[int, ...]:
    return tuple(k for k in range(1, SLOT_CLIMATOLOGY_DAYS + 1) if lag_is_legal(k, horizon_h))


def deepest_lookback_days(weeks: int = WIDE_CLIMATOLOGY_WEEKS) -> int:
    """History a served row needs before every feature is real."""
    return max(7 * weeks, SLOT_CLIMATOLOGY_DAYS, max(DAILY_LAGS))


def mean_of(columns: Sequence[Column]) -> Column:
    """Mean of the known values; NULL when there is none."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    known = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.when(known > 0, total / known)


TARGET_FIELDS = (*(f"lag{k}d" for k in DAILY_LAGS), f"wclim{CLIMATOLOGY_WEEKS}", f"wclim{WIDE_CLIMATOLOGY_WEEKS}",
                 "wclim_slope_back", "wclim_slope_fwd", "sclim_from_1", "sclim_from_2")


def target_slots(table: DataFrame, weeks: int = CLIMATOLOGY_WEEKS,
                 wide_weeks: int = WIDE_CLIMATOLOGY_WEEKS) -> DataFrame:
    """What is known about each slot as a target.

    `table` is dense per subject (as `grid.integrate` makes it), so a positional
    lag is an exact offset, and all of them share one sort.
    """
    w = Window.partitionBy(*SID).orderBy("slot")
    offsets = {k * SLOTS_PER_DAY for k in (*range(1, SLOT_CLIMATOLOGY_DAYS + 1), *DAILY_LAGS)}
    offsets |= {n * WEEK for n in range(1, wide_weeks + 1)}
    offsets |= {n * WEEK + side for n in range(1, weeks + 1) for side in (-SLOTS_PER_HOUR, SLOTS_PER_HOUR)}
    past = table.select("*", *[F.lag("home_frac", n).over(w).alias(f"_b{n}") for n in sorted(offsets)])

    def weekly(count: int, side: int = 0) -> Column:
        return mean_of([F.col(f"_b{n * WEEK + side}") for n in range(1, count + 1)])

    def daily(first: int) -> Column:
        return mean_of([F.col(f"_b{k * SLOTS_PER_DAY}") for k in range(first, SLOT_CLIMATOLOGY_DAYS + 1)])

    here = weekly(weeks)
    named = {f"lag{k}d": F.col(f"_b{k * SLOTS_PER_DAY}") for k in DAILY_LAGS}
    named[f"wclim{CLIMATOLOGY_WEEKS}"] = here
    named[f"wclim{WIDE_CLIMATOLOGY_WEEKS}"] = weekly(wide_weeks)
    # An hour before the target lies further back, so its offset is larger.
    named["wclim_slope_back"] = here - weekly(weeks, SLOTS_PER_HOUR)
    named["wclim_slope_fwd"] = weekly(weeks, -SLOTS_PER_HOUR) - here
    named["sclim_from_1"], named["sclim_from_2"] = daily(1), daily(2)
    return past.select(*table.columns, *[c.alias(n) for n, c in named.items()])


def samples(table: DataFrame, horizons: Sequence[int] = HORIZONS_H, origin: Sequence[str] = (),
            weeks: int = CLIMATOLOGY_WEEKS, wide_weeks: int = WIDE_CLIMATOLOGY_WEEKS,
            near: Sequence[str] = (), target: Sequence[str] = (), facts: Sequence[str] = TARGET_FIELDS) -> DataFrame:
    """One row per (subject, slot, horizon), each seeing only what its origin could.

    `table` reaches `AHEAD_SLOTS` past the grid, with NULL `home_frac` there. A name x
    in `near` has columns `x_from_1` and `x_from_2`, facts of the target slot a day
    and two days back, and gets the nearest legal one. Columns in `target` are read
    from the target slot as they are. Only `facts` of the target are made, as columns
    that nobody reads cannot be pruned from the arrays.
    """
    days = day_arrays(table, horizons, origin, weeks, wide_weeks, near, target, facts)
    return from_days(days, horizons, origin, near, target, facts)


def day_arrays(table: DataFrame, horizons: Sequence[int] = HORIZONS_H, origin: Sequence[str] = (),
               weeks: int = CLIMATOLOGY_WEEKS, wide_weeks: int = WIDE_CLIMATOLOGY_WEEKS,
               near: Sequence[str] = (), target: Sequence[str] = (), facts: Sequence[str] = TARGET_FIELDS) -> DataFrame:
    """What `samples` reads ahead: one row per (subject, day), its slots as `_now`, and those
    with the ones its horizons reach as `_ahead`."""
    targets = target_slots(table, weeks, wide_weeks)
    facts = [c for c in TARGET_FIELDS if c in facts]
    # Days are short arrays, and a day with the ones its horizons reach is one row. Fanning
    # out reads that row by position, so nothing is copied per horizon.
    fields = dict.fromkeys(["slot", "in_grid", "home_frac", "coverage", *origin, *target, *facts, *_seen(near)])
    day = F.call_function("div", F.col("slot"), F.lit(SLOTS_PER_DAY))
    days = targets.groupBy(*SID, day.alias("_day")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_now"))
    w = Window.partitionBy(*SID).orderBy("_day")
    reach = -(-SLOTS_PER_HOUR * max(horizons) // SLOTS_PER_DAY)
    nothing = F.slice("_now", 1, 0)
    following = [F.coalesce(F.lead("_now", n).over(w), nothing) for n in range(1, reach + 1)]
    return days.select(*SID, "_now", F.concat("_now", *following).alias("_ahead"))


def _seen(near: Sequence[str]) -> list[str]:
    return [f"{x}_from_{k}" for x in near for k in (1, 2)]


def from_days(days: DataFrame, horizons: Sequence[int] = HORIZONS_H, origin: Sequence[str] = (), near: Sequence[str] = (),
              target: Sequence[str] = (), facts: Sequence[str] = TARGET_FIELDS) -> DataFrame:
    """The rows of `samples`, of `day_arrays` made for these horizons or more."""
    facts, seen = [c for c in TARGET_FIELDS if c in facts], _seen(near)
    keep = [*SID, "slot", "home_frac", "coverage", *origin]
    rows = (days
            .select(*SID, "_ahead", F.posexplode("_now").alias("_at", "_origin"))
            .where("_origin.in_grid")
            .select(*SID, "_ahead", "_at", *[F.col(f"_origin.{c}") for c in keep if c not in SID],
                    F.explode(F.lit(list(horizons))).alias("horizon_h"))
            .withColumn("_target", F.get("_ahead", F.col("_at") + SLOTS_PER_HOUR * F.col("horizon_h")))
            .select(*keep, "horizon_h", F.col("_target.home_frac").alias("y"),
                    *[F.col(f"_target.{c}") for c in (*target, *facts, *seen)]))
    h = F.col("horizon_h")
    back = F.when(lag_is_legal(1, h), 1).otherwise(2)
    out = rows.withColumn("target_slot", F.col("slot") + h * SLOTS_PER_HOUR)
    for k in DAILY_LAGS:
        if f"lag{k}d" in facts and not lag_is_legal(k, max(horizons)):
            out = out.withColumn(f"lag{k}d", F.when(lag_is_legal(k, h), F.col(f"lag{k}d")))
    pairs = {"sclim14": ("sclim_from_1", "sclim_from_2"), "near_lag": ("lag1d", "lag2d"),
             **{x: (f"{x}_from_1", f"{x}_from_2") for x in near}}
    out = (out.withColumns({x: F.when(back == 1, F.col(a)).otherwise(F.col(b))
                            for x, (a, b) in pairs.items() if {a, b} <= {*facts, *seen}})
           .drop(*seen)
           .withColumn("other_lag_days", back)
           .drop("sclim_from_1", "sclim_from_2")
           .withColumn("state_now", F.col("home_frac")))
    if "next_alarm_h" in origin:
        out = out.withColumn("next_alarm_rel_h", F.col("next_alarm_h") - h)
    return out


def with_target_calendar(rows: DataFrame, tz: Column | str = "UTC") -> DataFrame:
    local = clock.localise(clock.slot_start(F.col("target_slot")), tz)
    return rows.withColumns(clock.calendar(local, "tgt_"))


def household_wide(table: DataFrame, roles: Sequence[str], prefix: str) -> DataFrame:
    """One column per role of the household: (household, slot) -> its `home_frac`."""
    return table.groupBy("household_id", "slot").agg(
        *[F.max(F.when(F.col("role") == role, F.col("home_frac"))).alias(prefix + role) for role in roles])


def with_others(table: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Where everyone else is at the origin. A role never mirrors itself.

    Many rows meet one row of the household, so nobody is paired with anybody.
    """
    wide = household_wide(table, roles, "other_")
    out = table.join(wide, ["household_id", "slot"], "left")
    for role in roles:
        out = out.withColumn(f"other_{role}", F.when(F.col("role") != role, F.col(f"other_{role}")))
    return out


def with_others_lagged(rows: DataFrame, table: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Where everyone else was in the target slot, on the nearest legal day.

    Rows that read it ahead from `with_others_before` have it; others meet the household.
    """
    if {f"other_{role}_lag" for role in roles} <= set(rows.columns):
        return rows
    wide = household_wide(table, roles, "_o_").withColumnRenamed("slot", "_seen_slot")
    seen = F.col("target_slot") - F.col("other_lag_days") * SLOTS_PER_DAY
    out = rows.withColumn("_seen_slot", seen).join(wide, ["household_id", "_seen_slot"], "left")
    for role in roles:
        out = out.withColumn(f"other_{role}_lag", F.when(F.col("role") != role, F.col(f"_o_{role}")))
    return out.drop("_seen_slot", *[f"_o_{role}" for role in roles])


def with_others_before(table: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Where everyone else was in this slot one and two days ago, for `samples` to
    read ahead: slots meet slots, so horizons cost no join."""
    out = table
    for days in (1, 2):
        wide = household_wide(table, roles, "_o_").withColumn("slot", F.col("slot") + days * SLOTS_PER_DAY)
        out = out.join(wide, ["household_id", "slot"], "left")
        out = out.withColumns({f"other_{role}_lag_from_{days}": F.when(F.col("role") != role, F.col(f"_o_{role}"))
                               for role in roles}).drop(*[f"_o_{role}" for role in roles])
    return out


def usable_rows(rows: DataFrame, required: Sequence[str] = ("y", "state_now", "coverage")) -> DataFrame:
    """Rows a score or a fit may use; every other column may be NULL."""
    return rows.dropna(subset=list(required))


def write_table(table: DataFrame, path: str) -> None:
    """The feature table, each household's rows together and in time order.

    Ranges of (household, slot), so a large household spreads over many files.
    """
    (table.repartitionByRange("household_id", "slot").sortWithinPartitions("household_id", "slot", "subject")
     .write.mode("overwrite").parquet(path))
