"""The state log: reads, idempotent appends and inventories.

A log has `household_id, entity_id, ts_us, seq, value`. Every read is a plan over
all entities at once; pass a filtered log to read one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.functions.states import haversine_m, is_empty, real
from hearthlog.schema import ABSENT, UNKNOWN

ENTITY = ("household_id", "entity_id")
HEARTBEAT = "hearthlog.heartbeat"
DAY_US = 86_400_000_000

# How a collector reaches back.
OVERLAP_US = 90 * 60_000_000
BOOTSTRAP_DAYS = 400
BOOTSTRAP_CHUNK_DAYS = 30
WINDOW_BUCKET_US = 6 * 3_600_000_000


def epoch_ms(iso: Column) -> Column:
    """ISO text to whole milliseconds; text without a zone is UTC (the session zone)."""
    return F.call_function("div", F.unix_micros(F.to_timestamp(iso)), F.lit(1000))


def states(log: DataFrame, start_us, stop_us=None) -> DataFrame:
    """Rows in [start, stop). Bounds are literals, so they reach the scan."""
    out = log.where(F.col("ts_us") >= F.lit(start_us))
    return out if stop_us is None else out.where(F.col("ts_us") < F.lit(stop_us))


def seeded_states(log: DataFrame, start_us, stop_us=None, seed_days: int | None = 14,
                  keys: Sequence[str] = ENTITY) -> DataFrame:
    """`states`, plus the last value before `start` stamped at `start`.

    `seed_days=None` looks back without limit.
    """
    earlier = log.where(F.col("ts_us") < F.lit(start_us))
    if seed_days is not None:
        earlier = earlier.where(F.col("ts_us") >= F.lit(start_us) - seed_days * DAY_US)
    rest = [c for c in log.columns if c not in (*keys, "ts_us", "seq")]
    seed = (earlier.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts_us", "seq")).alias("_v"))
            .select(*keys, F.lit(start_us).cast("long").alias("ts_us"), F.lit(-1).cast("long").alias("seq"), "_v.*"))
    return states(log, start_us, stop_us).unionByName(seed)


def numeric(log: DataFrame, start_us, stop_us=None) -> DataFrame:
    """`states` as numbers; a text that is not one is dropped."""
    return states(log, start_us, stop_us).withColumn("number", real(F.col("value"))).where("number is not null")


def seeded_numeric(log: DataFrame, start_us, stop_us=None, seed_days: int | None = 14) -> DataFrame:
    numbers = log.withColumn("number", real(F.col("value"))).where("number is not null")
    return seeded_states(numbers, start_us, stop_us, seed_days)


# --- appends -----------------------------------------------------------------------

KEY = ("household_id", "entity_id", "ts_us")


def first_rows(rows: DataFrame) -> DataFrame:
    """One row per (entity, time): the first to arrive. Combined before the shuffle."""
    return (rows.groupBy(*KEY).agg(F.min_by(F.struct("value", "seq"), "seq").alias("_v"))
            .select(*KEY, "_v.*"))


def new_rows(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows an append would really insert. Appending twice changes nothing."""
    return first_rows(rows).join(log.select(*KEY), list(KEY), "left_anti")


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    cols = [*KEY, "value", "seq"]
    return log.select(*cols).unionByName(new_rows(log, rows).select(*cols))


def backfill_report(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows per entity before and after an archive is added."""
    tagged = (log.select(*ENTITY, F.lit(1).alias("was"))
              .unionByName(new_rows(log, rows).select(*ENTITY, F.lit(0).alias("was"))))
    return tagged.groupBy(*ENTITY).agg(F.sum("was").alias("n_before"), F.count("*").alias("n_after"))


def normalise_empty(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Lost readings become boundaries where they mean something, else they go.

    `entities` names, per entity, whether a gap ends a state (`keep_gap`) and
    whether absence is a reading (`keep_absence`).
    """
    flags = entities.select(*ENTITY, "keep_gap", "keep_absence")
    out = rows.join(flags, list(ENTITY), "left")
    empty = is_empty(F.col("value"))
    value = (F.when(~empty, F.col("value")).when(F.col("keep_gap"), UNKNOWN)
             .when(F.col("keep_absence"), ABSENT))
    return out.withColumn("value", value).where("value is not null").drop("keep_gap", "keep_absence")


def pull_plan(log: DataFrame, wanted: DataFrame, now_us: int) -> DataFrame:
    """From when each entity is read again, and the request group it falls in."""
    seen = log.groupBy(*ENTITY).agg(F.max("ts_us").alias("last_us"))
    begin = F.coalesce(F.col("last_us") - OVERLAP_US, F.lit(now_us - BOOTSTRAP_DAYS * DAY_US))
    age = F.lit(now_us) - F.col("begin_us")
    return (wanted.select(*ENTITY).join(seen, list(ENTITY), "left")
            .withColumn("begin_us", begin).withColumn("bootstrap", F.col("last_us").isNull())
            .withColumn("bucket", F.call_function("div", age, F.lit(WINDOW_BUCKET_US))).drop("last_us"))


def pull(log: DataFrame, upstream: DataFrame, wanted: DataFrame, now_us: int) -> DataFrame:
    """What one collecting pass adds: new rows of each entity and a heartbeat.

    Reading an overlap again is harmless, because appends ignore known rows.
    """
    plan = pull_plan(log, wanted, now_us).select(*ENTITY, "begin_us")
    fresh = (upstream.join(plan, list(ENTITY))
             .where((F.col("ts_us") >= F.col("begin_us")) & (F.col("ts_us") < F.lit(now_us))).drop("begin_us"))
    beat = wanted.select("household_id").distinct().select(
        "household_id", F.lit(HEARTBEAT).alias("entity_id"), F.lit(now_us).cast("long").alias("ts_us"),
        F.lit("ok").alias("value"), F.lit(0).cast("long").alias("seq"))
    return new_rows(log, fresh.select(*KEY, "value", "seq").unionByName(beat))


def pull_windows(plan: DataFrame, now_us: int, chunk_days: int = BOOTSTRAP_CHUNK_DAYS) -> DataFrame:
    """Request windows over [begin, now], newest first."""
    span = chunk_days * DAY_US
    n = F.ceil((F.lit(now_us) - F.col("begin_us")) / F.lit(span)).cast("int")
    out = plan.withColumn("position", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    until = F.lit(now_us) - F.col("position").cast("long") * span
    return (out.withColumn("until_us", until)
            .withColumn("from_us", F.greatest(F.col("begin_us"), F.col("until_us") - span)))


def liveness_times(log: DataFrame) -> DataFrame:
    return log.where(F.col("entity_id") == HEARTBEAT).select("household_id", "ts_us")


def sampled_distances(fixes: DataFrame, homes: DataFrame, with_sensor: DataFrame) -> DataFrame:
    """Distance of a position fix from home, for people with no distance sensor."""
    cols = [F.col(c) for c in ("home_lat", "home_lon", "lat", "lon")]
    out = (fixes.where("lat is not null and lon is not null")
           .join(with_sensor.select("household_id", "subject").distinct(), ["household_id", "subject"], "left_anti")
           .join(homes.where("home_lat is not null"), "household_id"))
    metres = haversine_m(*cols)
    return out.select("household_id", F.concat(F.lit("hearthlog."), "subject", F.lit("_distance")).alias("entity_id"),
                      "ts_us", "seq", F.format_string("%.1f", metres).alias("value"), metres.alias("metres"))


# --- inventories ----------------------------------------------------------------------

def first_seen(log: DataFrame) -> DataFrame:
    return log.groupBy("household_id").agg(F.min("ts_us").alias("first_us"))


def history_start(households: DataFrame, log: DataFrame, now_us: int) -> DataFrame:
    """The earliest moment worth asking for; 400 days back when nothing is known."""
    out = households.join(first_seen(log), "household_id", "left")
    return out.select("household_id", F.coalesce(
        "first_us", F.lit(now_us - BOOTSTRAP_DAYS * DAY_US)).alias("start_us"))


def last_seen(log: DataFrame) -> DataFrame:
    return log.groupBy(*ENTITY).agg(F.max("ts_us").alias("last_us"))


def span(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    days = (F.max("ts_us") - F.min("ts_us")) / float(DAY_US)
    return log.groupBy(*keys).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
                                  F.count("*").alias("n_rows"), F.bround(days, 1).alias("days"))


def inventory(log: DataFrame) -> DataFrame:
    return log.groupBy(*ENTITY).agg(F.count("*").alias("n_rows"), F.min("ts_us").alias("first_us"),
                                    F.max("ts_us").alias("last_us"))


def value_counts(log: DataFrame, limit: int = 12) -> DataFrame:
    """The commonest values of each entity; ties go to the smaller text.

    The filter on `row_number` is applied before the shuffle as well.
    """
    counts = log.groupBy(*ENTITY, "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*ENTITY).orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def archive(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted entity, its text field if it has one, else its numeric twin."""
    fields = points.where("field in ('state', 'value')").groupBy(*ENTITY, "field").agg(
        F.count("*").alias("n_rows"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.min_by("value", F.struct("ts_us", "seq")).alias("first_value"),
        F.max_by("value", F.struct("ts_us", "seq")).alias("last_value"))
    best = fields.groupBy(*ENTITY).agg(F.min_by(
        F.struct("field", "n_rows", "first_us", "last_us", "first_value", "last_value"), "field").alias("_f"))
    out = wanted.select(*ENTITY).join(best, list(ENTITY), "left").select(*ENTITY, "_f.*")
    return out.withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def unit_keyed(points: DataFrame, units: DataFrame) -> DataFrame:
    """Numbers of an archive that files a sensor with a unit under the unit.

    Points carry `measurement`, `object_id`, `field`; `units` carries `entity_id`
    and its `unit` (NULL when it has none).
    """
    object_id = F.regexp_replace("entity_id", r"^[^.]*\.", "")
    points = points.where("field = 'value'")
    # A sensor without a unit is filed under its own id, so it needs no object id.
    own = units.where("unit is null").select("household_id", "entity_id", F.col("entity_id").alias("measurement"))
    shared = units.where("unit is not null").select(
        "household_id", "entity_id", F.col("unit").alias("measurement"), object_id.alias("object_id"))
    columns = ["household_id", "entity_id", "ts_us", "seq", "value"]
    out = points.join(own, ["household_id", "measurement"]).select(*columns).unionByName(
        points.join(shared, ["household_id", "measurement", "object_id"]).select(*columns))
    return (out.withColumn("number", real(F.col("value"))).where("number is not null")
            .select("household_id", "entity_id", "ts_us", "seq", "number"))
