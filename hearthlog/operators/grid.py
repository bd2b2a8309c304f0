"""Irregular state changes integrated onto the half-hour grid.

Two shuffles, whatever the history: rows meet by (subject, slot), where they are
ordered and summed, then one summary row per slot meets by subject, where the
state still held from earlier slots is carried in and the silent slots between
are filled by `explode`. Time is counted in whole microseconds, so sums are exact
and do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.functions.clock import slot_of, slot_start
from hearthlog.functions.states import is_empty, is_home, norm, real
from hearthlog.operators.chunks import before, chunk_carry, upto, with_previous, with_slot
from hearthlog.operators.shifts import at_offset
from hearthlog.schema import (AWAY_FROM, HOME, HOUSE, MAX_SILENCE_H, MIN_SLOT_COVERAGE, NOT_HOME,
                              OTHER_ZONE, SID, SLOT_US, TOWARDS, UNKNOWN)

Match = Callable[[Column], Column]


def equals(state: str) -> Match:
    return lambda value: value == F.lit(state)


def grid_bounds(start_us: Column, stop_us: Column) -> tuple[Column, Column]:
    """First and last slot whose left edge lies in [start, stop]."""
    first = slot_of(start_us + F.lit(SLOT_US - 1))
    return first, slot_of(stop_us)


def spine(subjects: DataFrame, events: DataFrame) -> DataFrame:
    """Subjects with the grid their own household's log spans: `start_slot`, `stop_slot`."""
    first, last = grid_bounds(F.min("ts_us"), F.max("ts_us"))
    spans = events.groupBy("household_id").agg(first.alias("start_slot"), last.alias("stop_slot"))
    return subjects.join(spans, "household_id")


def grid(subjects: DataFrame) -> DataFrame:
    """Every slot of every subject."""
    return (subjects.where("start_slot <= stop_slot")
            .withColumn("slot", F.explode(F.sequence("start_slot", "stop_slot")))
            .drop("start_slot", "stop_slot"))


class StateSignal:
    """Time-weighted shares of a state signal, per slot."""

    def __init__(self, signal: str, matches: dict[str, Match], prefix: str, duration: bool = False):
        self.signal, self.matches, self.duration = signal, matches, duration
        self.p = prefix
        self.of = F.col("signal") == signal

    def _name(self, name: str) -> str:
        return f"_{self.p}_{name}"

    def summaries(self) -> dict[str, Column]:
        n, of = self._name, self.of
        held = F.when(of & ~F.col("_empty"), F.col("_held_us"))
        out = {
            n("first_us"): F.min(F.when(of, F.col("ts_us"))),
            n("last"): F.max(F.when(of & F.col("_is_last"), F.col("_norm"))),
            n("obs"): F.sum(held),
        }
        for name, match in self.matches.items():
            out[n("m_" + name)] = F.sum(F.when(match(F.col("_norm")), held))
        if self.duration:
            changed = of & (F.col("_prev") != F.col("_norm"))
            out[n("first")] = F.max(F.when(of & F.col("_prev").isNull(), F.col("_norm")))
            out[n("change_us")] = F.max(F.when(changed, F.col("ts_us")))
            out[n("edge_change_us")] = F.max(F.when(changed & F.col("_at_edge"), F.col("ts_us")))
        return out

    def carried(self, w) -> list[dict[str, Column]]:
        n = self._name
        first = {n("held_before"): F.last(n("last"), ignorenulls=True).over(before(w)),
                 n("held_after"): F.last(n("last"), ignorenulls=True).over(upto(w))}
        if not self.duration:
            return [first]
        fresh = F.col(n("first")).isNotNull() & (
            F.col(n("held_before")).isNull() | (F.col(n("held_before")) != F.col(n("first"))))
        second = {n("opens"): fresh,
                  n("changed"): F.coalesce(F.col(n("change_us")),
                                           F.when(fresh, F.col(n("first_us"))))}
        third = {n("since_before"): F.last(n("changed"), ignorenulls=True).over(before(w)),
                 n("since_after"): F.last(n("changed"), ignorenulls=True).over(upto(w))}
        return [first, second, third]

    def columns(self, own: Column) -> dict[str, Column]:
        """Shares of a slot; `own` tells a slot with readings from a silent one."""
        n = self._name
        lead_in = F.coalesce(F.col(n("first_us")), slot_start(F.col("slot") + 1)) - slot_start(F.col("slot"))

        def micros(inside: str, match: Match) -> Column:
            early = F.when(match(F.col(n("held_before"))), lead_in).otherwise(0)
            silent = F.when(match(F.col(n("held_after"))), F.lit(SLOT_US)).otherwise(0)
            return F.when(own, F.coalesce(F.col(n(inside)), F.lit(0)) + early).otherwise(silent)

        observed = micros("obs", lambda v: ~is_empty(v))
        out = {f"{self.p}_observed_us": observed,
               f"{self.p}_coverage": observed / F.lit(float(SLOT_US))}
        enough = observed >= int(MIN_SLOT_COVERAGE * SLOT_US)
        for name, match in self.matches.items():
            share = micros("m_" + name, lambda v, m=match: ~is_empty(v) & m(v))
            out[name] = F.when(enough, share / observed.cast("double"))
        if self.duration:
            edge = slot_start(F.col("slot"))
            at_edge = F.coalesce(
                F.col(n("edge_change_us")),
                F.when(F.col(n("opens")) & (F.col(n("first_us")) == edge), edge),
                F.col(n("since_before")))
            since = F.when(own, at_edge).otherwise(F.col(n("since_after")))
            out[f"{self.p}_minutes"] = (edge - since) / 6e7
        return out


class ValueSignal:
    """The reading in force at each slot's left edge."""

    def __init__(self, signal: str, out: str, reading: Column, max_age_min: float | None = None):
        self.of, self.out, self.reading = F.col("signal") == signal, out, reading
        self.max_age_us = None if max_age_min is None else int(max_age_min * 60e6)

    def summaries(self) -> dict[str, Column]:
        read = F.struct(F.col("ts_us").alias("at"), self.reading.alias("v"))
        stamp = F.struct("ts_us", "seq")
        return {f"_{self.out}_edge": F.max_by(read, F.when(self.of & F.col("_at_edge"), stamp)),
                f"_{self.out}_last": F.max_by(read, F.when(self.of, stamp))}

    def carried(self, w) -> list[dict[str, Column]]:
        last = f"_{self.out}_last"
        return [{f"_{self.out}_before": F.last(last, ignorenulls=True).over(before(w)),
                 f"_{self.out}_after": F.last(last, ignorenulls=True).over(upto(w))}]

    def columns(self, own: Column) -> dict[str, Column]:
        p = f"_{self.out}_"
        read = F.when(own, F.coalesce(F.col(p + "edge"), F.col(p + "before"))).otherwise(F.col(p + "after"))
        value = read["v"]
        if self.max_age_us is not None:
            value = F.when(slot_start(F.col("slot")) - read["at"] <= self.max_age_us, value)
        return {self.out: value}


def integrate(signals: DataFrame, subjects: DataFrame, parts: Sequence,
              keys: Sequence[str] = SID, extra_slots: int = 0) -> DataFrame:
    """Every part of `parts` on the grid of each subject, in one pass.

    `subjects` carries `start_slot` and `stop_slot`. `extra_slots` adds rows past
    the grid with `in_grid` false.
    """
    keys = list(keys)
    events = with_slot(signals).repartition(*keys, "slot")
    w = Window.partitionBy(*keys, "slot", "signal").orderBy("ts_us", "seq")
    following = F.lead("ts_us").over(w)
    edge = slot_start(F.col("slot"))
    marked = (events
              .withColumn("_norm", norm(F.col("value")))
              .withColumn("_empty", is_empty(F.col("value")))
              .withColumn("_next_us", following)
              .withColumn("_prev", F.lag("_norm").over(w))
              .withColumn("_is_last", F.col("_next_us").isNull())
              .withColumn("_held_us", F.coalesce(F.col("_next_us"), edge + SLOT_US) - F.col("ts_us"))
              .withColumn("_at_edge", F.col("ts_us") == edge))
    sums: dict[str, Column] = {}
    for part in parts:
        sums.update(part.summaries())
    return fill(marked.groupBy(*keys, "slot").agg(*[c.alias(n) for n, c in sums.items()]),
                subjects, parts, keys, extra_slots)


def fill(chunks: DataFrame, subjects: DataFrame, parts: Sequence, keys: Sequence[str] = SID,
         extra_slots: int = 0) -> DataFrame:
    """Chunk summaries as a dense grid: what was held is carried into silent slots."""
    keys = list(keys)
    chunks = chunks.withColumn("_own", F.lit(True))
    # One empty row just before the grid, so a subject is there from its first slot.
    opening = subjects.select(*keys, (F.col("start_slot") - 1).alias("slot"),
                              "start_slot", "stop_slot", F.lit(False).alias("_own"))
    sparse = chunks.unionByName(opening, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("slot", "_own")
    whole = Window.partitionBy(*keys)
    sparse = (sparse
              .withColumn("start_slot", F.max("start_slot").over(whole))
              .withColumn("stop_slot", F.max("stop_slot").over(whole))
              .withColumn("_next_slot", F.lead("slot").over(w)))
    steps: dict[int, dict[str, Column]] = {}
    for part in parts:
        for i, step in enumerate(part.carried(w)):
            steps.setdefault(i, {}).update(step)
    for i in sorted(steps):
        sparse = sparse.select("*", *[c.alias(n) for n, c in steps[i].items()])
    low = F.greatest("slot", "start_slot")
    end = F.col("stop_slot") + extra_slots
    high = F.least(F.coalesce(F.col("_next_slot") - 1, end), end)
    dense = (sparse.withColumn("_low", low).withColumn("_high", high)
             .where("_low <= _high")
             .withColumn("_chunk_slot", F.col("slot"))
             .withColumn("slot", F.explode(F.sequence("_low", "_high"))))
    own = F.col("_own") & (F.col("slot") == F.col("_chunk_slot"))
    out: dict[str, Column] = {}
    for part in parts:
        out.update(part.columns(own))
    return dense.select(*keys, "slot", (F.col("slot") <= F.col("stop_slot")).alias("in_grid"),
                        *[c.alias(n) for n, c in out.items()])


def presence(matches: dict[str, Match] | None = None, duration: bool = True) -> StateSignal:
    return StateSignal("presence", matches or {"home_frac": equals(HOME)}, "presence", duration)


def slot_fraction(signals: DataFrame, subjects: DataFrame, matches: dict[str, Match] | None = None,
                  keys: Sequence[str] = SID) -> DataFrame:
    """Share of each slot spent in each matched state, with coverage."""
    out = integrate(signals, subjects, [presence(matches, duration=False)], keys)
    return out.drop("in_grid", "presence_observed_us").withColumnRenamed("presence_coverage", "coverage")


def minutes_in_state(signals: DataFrame, subjects: DataFrame) -> DataFrame:
    """Minutes since the last change of state, at each slot's left edge."""
    return (integrate(signals, subjects, [presence()])
            .select(*SID, "slot", F.col("presence_minutes").alias("minutes_in_state")))


def numeric_on_grid(signals: DataFrame, subjects: DataFrame, signal: str, out: str,
                    stale_after_min: float | None = None) -> DataFrame:
    """Last number at or before each slot's left edge."""
    readings = (signals.where(F.col("signal") == signal).withColumn("number", real(F.col("value")))
                .where("number is not null"))
    part = ValueSignal(signal, out, F.col("number"), stale_after_min)
    return integrate(readings, subjects, [part]).drop("in_grid")


def window_fraction(signals: DataFrame, at: DataFrame, minutes: int = 5) -> DataFrame:
    """Share of the `minutes` before `at_us` spent home, one row per subject of `at`.

    Only the window itself and the last state before it are read.
    """
    span = minutes * 60_000_000
    rows = (signals.where("signal = 'presence'").join(at, list(SID))
            .where("ts_us < at_us").withColumn("_from", F.col("at_us") - span))
    stamp = F.struct("ts_us", "seq")
    seed = (rows.groupBy(*SID, "at_us", "_from")
            .agg(F.max_by("value", F.when(F.col("ts_us") <= F.col("_from"), stamp)).alias("value"),
                 F.count(F.when(F.col("ts_us") <= F.col("_from"), 1)).alias("n"))
            .where("n > 0")
            .select(*SID, "at_us", F.col("_from").alias("ts_us"), F.lit(-1).cast("long").alias("seq"), "value"))
    inside = rows.where("ts_us > _from").select(*SID, "at_us", "ts_us", "seq", "value")
    w = Window.partitionBy(*SID, "at_us").orderBy("ts_us", "seq")
    held = (seed.unionByName(inside)
            .withColumn("held", F.least(F.coalesce(F.lead("ts_us").over(w), F.col("at_us")), F.col("at_us"))
                        - F.col("ts_us")))
    known = ~is_empty(F.col("value"))
    sums = held.groupBy(*SID, "at_us").agg(
        F.sum(F.when(known, F.col("held"))).alias("obs"),
        F.sum(F.when(known & is_home(F.col("value")), F.col("held")).otherwise(0)).alias("home"))
    frac = F.when(F.col("obs") >= span * MIN_SLOT_COVERAGE, F.col("home") / F.col("obs").cast("double"))
    return at.join(sums, [*SID, "at_us"], "left").select(
        *SID, "at_us", frac.alias("now_frac"))


# --- when the recorder was alive ---------------------------------------------

def liveness_chunks(events: DataFrame) -> DataFrame:
    """Evidence that the recorder ran, folded to one row per (household, slot)."""
    live = with_slot(events)
    edge = slot_start(F.col("slot"))
    return live.groupBy("household_id", "slot").agg(
        F.max((F.col("ts_us") == edge).cast("int")).alias("at_edge"),
        F.min(F.when(F.col("ts_us") > edge, F.col("ts_us"))).alias("next_us"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def live_spans(events: DataFrame, max_silence_h: float = MAX_SILENCE_H) -> DataFrame:
    """Per household: the observed span and the silences inside it.

    A silence is longer than half a day, so a household has at most two per day.
    """
    w = Window.partitionBy("household_id").orderBy("slot")
    limit = int(max_silence_h * 3_600_000_000)
    gap = F.struct(F.col("last_us").alias("from_us"), F.col("following_us").alias("to_us"))
    return (liveness_chunks(events)
            .withColumn("following_us", F.lead("first_us").over(w))
            .groupBy("household_id")
            .agg(F.min("first_us").alias("live_from_us"), F.max("last_us").alias("live_to_us"),
                 F.collect_list(F.when(F.col("following_us") - F.col("last_us") > limit, gap)).alias("silences")))


def observed(slot: Column) -> Column:
    """Whether a slot lies between two signs of life close enough together."""
    edge = slot_start(slot)
    silent = F.exists("silences", lambda s: (edge >= s["from_us"]) & (edge < s["to_us"]))
    return F.coalesce(
        (edge >= F.col("live_from_us")) & (edge < F.col("live_to_us")) & ~silent, F.lit(False))


def observability(households: DataFrame, events: DataFrame,
                  max_silence_h: float = MAX_SILENCE_H) -> DataFrame:
    """`observable` for each slot of each household's grid."""
    spans = live_spans(events, max_silence_h)
    return (grid(households).join(spans, "household_id", "left")
            .select("household_id", "slot", observed(F.col("slot")).alias("observable")))


def blanked(table: DataFrame, spans: DataFrame, columns: Sequence[str]) -> DataFrame:
    """An unobserved slot is neither home nor away: its values become NULL."""
    seen = observed(F.col("slot"))
    out = table.join(spans, "household_id", "left")
    for name in columns:
        if name in out.columns:
            out = out.withColumn(name, F.when(seen, F.col(name)))
    if "coverage" in out.columns:
        out = out.withColumn("coverage", F.when(seen, F.col("coverage")).otherwise(0.0))
    return out.withColumn("observable", seen).drop("live_from_us", "live_to_us", "silences")


# --- the house -----------------------------------------------------------------

def house_states(person_events: DataFrame) -> DataFrame:
    """`home` while anybody is, `not_home` when all known people are out.

    Each event changes two counts, of people home and of people not known, by the
    difference to the same person's previous state; running sums of those are the
    state of the house. Nothing is paired with anything, however many people.
    """
    events = with_previous(with_slot(person_events), SID, "value", "_was")
    seen = F.col("_was").isNotNull()
    home = is_home(F.col("value")).cast("int") - F.when(seen, is_home(F.col("_was")).cast("int")).otherwise(0)
    lost = is_empty(F.col("value")).cast("int") - F.when(seen, is_empty(F.col("_was")).cast("int")).otherwise(0)
    events = events.withColumn("_home", home).withColumn("_lost", lost)
    events = chunk_carry(events, ["household_id"],
                         {"_dh": F.sum("_home"), "_dl": F.sum("_lost")},
                         {"_h0": lambda w: F.sum("_dh").over(before(w)),
                          "_l0": lambda w: F.sum("_dl").over(before(w))})
    running = (Window.partitionBy("household_id", "slot").orderBy("ts_us")
               .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counted = events.select(
        "household_id", "slot", "ts_us",
        (F.coalesce("_h0", F.lit(0)) + F.sum("_home").over(running)).alias("people_home"),
        (F.coalesce("_l0", F.lit(0)) + F.sum("_lost").over(running)).alias("people_lost"))
    state = (F.when(F.col("people_home") > 0, HOME).when(F.col("people_lost") == 0, NOT_HOME)
             .otherwise(UNKNOWN))
    return (counted.groupBy("household_id", "slot", "ts_us")
            .agg(F.max("people_home").alias("people_home"), F.max("people_lost").alias("people_lost"))
            .select("household_id", F.lit(HOUSE).alias("subject"), "slot", "ts_us",
                    F.lit(0).cast("long").alias("seq"), state.alias("value")))


def house_changes(person_events: DataFrame) -> DataFrame:
    """House states with repeats collapsed."""
    states = with_previous(house_states(person_events), ["household_id"], "value", "_was")
    return states.where("_was is null or _was <> value").drop("_was")


def presence_signals(person_events: DataFrame, house_groups: DataFrame | None = None) -> DataFrame:
    """People and house as presence signals.

    A household with a group entity of its own uses that group's states instead
    of the merge over people.
    """
    cols = ["household_id", "subject", "ts_us", "seq", "value"]
    people = person_events.select(*cols)
    house = house_states(person_events).select(*cols)
    if house_groups is not None:
        grouped = house_groups.select("household_id").distinct()
        house = (house.join(grouped, "household_id", "left_anti")
                 .unionByName(house_groups.withColumn("subject", F.lit(HOUSE)).select(*cols)))
    return people.unionByName(house).withColumn("signal", F.lit("presence"))


def with_house_zones(table: DataFrame, zones: Sequence[str]) -> DataFrame:
    """The house is in a zone when anyone is: a union, not a partition."""
    w = Window.partitionBy("household_id", "slot")
    person = F.col("subject") != HOUSE
    for zone in zones:
        table = table.withColumn(zone, F.when(person, F.col(zone)).otherwise(
            F.max(F.when(person, F.col(zone))).over(w)))
    return table


def usable_days(table: DataFrame) -> DataFrame:
    """Days of slots observed for every person of the household."""
    per_slot = table.where(F.col("subject") != HOUSE).groupBy("household_id", "slot").agg(
        F.every(F.col("observable") & F.col("home_frac").isNotNull()).alias("valid"))
    return per_slot.groupBy("household_id").agg(
        (F.count_if("valid") / F.lit(48.0)).alias("usable_days"))


# --- zones, distance, alarms ------------------------------------------------------

def resolve_zones(events: DataFrame, zones: DataFrame, unknown_as_other: bool = False) -> DataFrame:
    """Add `zone`: home, the slug of a ticked zone, or the rest.

    A zone is known by its friendly name only. Lost readings stay lost unless
    `unknown_as_other` counts them as being somewhere else.
    """
    names = (zones.withColumn("_name", F.lower(F.trim("name"))).where("_name <> ''")
             .groupBy("household_id", "_name").agg(F.max_by("slug", "position").alias("_slug")))
    text = F.lower(norm(F.col("value")))
    out = events.withColumn("_name", text).join(names, ["household_id", "_name"], "left")
    place = (F.when(is_home(F.col("value")), HOME)
             .when(F.col("_slug").isNotNull(), F.concat(F.lit("zone:"), F.col("_slug"))))
    if not unknown_as_other:
        place = place.when(is_empty(F.col("value")), F.lit(UNKNOWN))
    return out.withColumn("zone", place.otherwise(OTHER_ZONE)).drop("_name", "_slug")


def zone_matches(slugs: Sequence[str]) -> dict[str, Match]:
    out = {f"zone_{slug}": equals(f"zone:{slug}") for slug in slugs}
    out["zone_other"] = equals(OTHER_ZONE)
    return out


def unmatched_away_states(person_states: DataFrame, zones: DataFrame) -> DataFrame:
    """Away states no ticked zone explains, with how often each was seen."""
    names = zones.select("household_id", F.lower(F.trim("name")).alias("_name")).where("_name <> ''")
    text = norm(F.col("value"))
    return (person_states.select("household_id", text.alias("state"))
            .where(~F.col("state").isin(HOME, NOT_HOME))
            .groupBy("household_id", "state").agg(F.count("*").alias("n"))
            .withColumn("_name", F.lower("state"))
            .join(names, ["household_id", "_name"], "left_anti").drop("_name"))


def direction() -> StateSignal:
    return StateSignal("direction", {"sensor_towards": equals(TOWARDS), "sensor_away": equals(AWAY_FROM)},
                       "direction")


def distance() -> ValueSignal:
    return ValueSignal("distance", "distance_m", real(F.col("value")))


def alarm() -> ValueSignal:
    """The alarm in force; a cancelled one clears it."""
    # A time with no zone of its own is UTC, the session zone.
    return ValueSignal("alarm", "alarm_us",
                       F.unix_micros(F.try_to_timestamp(F.col("value"))))


def next_alarm_h(slot: Column, alarm_us: Column) -> Column:
    ahead = (alarm_us - slot_start(slot)) / 3.6e9
    return F.when(ahead > 0, ahead)


def proximity(table: DataFrame, with_sensor: DataFrame) -> DataFrame:
    """Distance, its change, and the way of travel, from a sensor or from the change."""
    km = F.col("distance_m") / 1000.0
    d30 = F.col("distance_km") - at_offset("distance_km", -1, SID)
    d60 = F.col("distance_km") - at_offset("distance_km", -2, SID)
    out = (table.withColumn("distance_km", km)
           .withColumn("distance_delta_30m", d30).withColumn("distance_delta_60m", d60)
           .join(with_sensor.select(*SID).distinct().withColumn("_sensor", F.lit(True)), list(SID), "left"))
    delta = F.col("distance_delta_30m")
    towards = F.when(delta.isNotNull(), (delta < -0.05).cast("double"))
    away = F.when(delta.isNotNull(), (delta > 0.05).cast("double"))
    return (out.withColumn("dir_towards", F.when(F.col("_sensor"), F.col("sensor_towards")).otherwise(towards))
            .withColumn("dir_away", F.when(F.col("_sensor"), F.col("sensor_away")).otherwise(away))
            .drop("_sensor", "sensor_towards", "sensor_away", "distance_m"))
