"""Closing speed and minutes to arrival, from irregular distance traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.functions import clock
from hearthlog.operators.chunks import after, as_of, before, chunk_carry, in_chunk, with_slot
from hearthlog.operators.evaluate import quantiles
from hearthlog.schema import AWAY_FROM, HOUSE, SID, TOWARDS

# What a journey is.
ARRIVED_KM, MIN_JOURNEY_KM, MAX_LEAD_MIN = 0.2, 1.0, 180
SPEED_WINDOW_US = 15 * 60_000_000
MIN_CLOSING_KMH = 5.0
LOOKBACK_US = 6 * 3_600_000_000


def traces(distances: DataFrame, directions: DataFrame | None = None) -> DataFrame:
    """Distance per reading in km, with the direction in force at that moment."""
    km = (distances.groupBy(*SID, "ts_us").agg(F.max_by("number", "seq").alias("metres"))
          .withColumn("km", F.col("metres") / 1000.0).drop("metres"))
    if directions is None:
        return km.withColumn("direction", F.lit(None).cast("string"))
    ways = directions.groupBy(*SID, "ts_us").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    return as_of(km, ways, SID, "value", "direction")


def feature_frame(trace: DataFrame, tz: str = "UTC") -> DataFrame:
    """What a model reads at each observation.

    The speed window is shorter than a slot, so an observation is also shown to the
    chunk after its own, and the window never leaves a chunk.
    """
    own = with_slot(trace).withColumn("_shown", F.lit(False))
    both = own.unionByName(own.withColumn("slot", F.col("slot") + 1).withColumn("_shown", F.lit(True)))
    w = Window.partitionBy(*SID, "slot").orderBy("ts_us").rangeBetween(-SPEED_WINDOW_US, 0)
    back = (both.withColumn("_km0", F.first("km").over(w)).withColumn("_ts0", F.first("ts_us").over(w))
            .where("not _shown").drop("_shown"))
    hours = (F.col("ts_us") - F.col("_ts0")) / 3.6e9
    speed = F.when(hours > 0.02, (F.col("_km0") - F.col("km")) / hours).otherwise(0.0)
    local = clock.localise(F.col("ts_us"), tz)
    return (back.withColumn("closing_kmh", F.least(F.greatest(speed, F.lit(-200.0)), F.lit(200.0)))
            .withColumn("dir_towards", F.coalesce((F.col("direction") == TOWARDS).cast("double"), F.lit(0.0)))
            .withColumn("dir_away", F.coalesce((F.col("direction") == AWAY_FROM).cast("double"), F.lit(0.0)))
            .withColumn("hour", F.hour(local) + F.minute(local) / 60).withColumn("dow", F.weekday(local))
            .drop("_km0", "_ts0", "direction"))


def with_next_arrival(frame: DataFrame) -> DataFrame:
    """The first arrival at or after each observation."""
    arrived = F.when(F.col("km") * 1000 < ARRIVED_KM * 1000, F.col("ts_us"))
    carried = chunk_carry(frame, SID, {"_first": F.min(arrived)}, {
        "_later": lambda w: F.first("_first", ignorenulls=True).over(after(w))})
    here = F.min(arrived).over(in_chunk(SID, "ts_us").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return carried.withColumn("next_arrival_us", F.coalesce(here, F.col("_later"))).drop("_later")


def build_samples(frame: DataFrame) -> DataFrame:
    """Observations on a journey that ends within three hours."""
    minutes = (F.col("next_arrival_us") - F.col("ts_us")) / 6e7
    return (with_next_arrival(frame).withColumn("minutes_to_home", minutes)
            .where((F.col("minutes_to_home") > 0) & (F.col("minutes_to_home") <= MAX_LEAD_MIN)
                   & (F.col("km") >= MIN_JOURNEY_KM)).drop("next_arrival_us"))


def arrivals(trace: DataFrame, keys: Sequence[str] = SID) -> DataFrame:
    """How often each subject came within reach of home."""
    home = F.col("km") * 1000 < ARRIVED_KM * 1000
    flagged = with_slot(trace).withColumn("_home", home).withColumn("seq", F.lit(0))
    carried = chunk_carry(flagged, SID, {"_newest": F.max_by("_home", "ts_us")}, {
        "_carry": lambda w: F.last("_newest").over(before(w))})
    was = F.coalesce(F.lag("_home").over(in_chunk(SID, "ts_us")), F.col("_carry"), F.lit(False))
    return (carried.withColumn("_rise", F.col("_home") & ~was).groupBy(*keys)
            .agg(F.count_if("_rise").alias("n_arrivals")))


def split(samples: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Journeys that ended before their household's `cut_us`, and observations since:
    what a speed or a model is fitted on, and what it is scored on. `samples` still
    has `minutes_to_home`, so nothing that ends after the cut is learned from."""
    cut = samples.join(cuts.select("household_id", "cut_us"), "household_id")
    ended = F.col("ts_us") + F.col("minutes_to_home") * 6e7
    return cut.where(ended < F.col("cut_us")).drop("cut_us"), cut.where(F.col("ts_us") >= F.col("cut_us")).drop("cut_us")


def implied_kmh(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The median speed of journeys: the constant-speed baseline."""
    rated = samples.withColumn("_kmh", F.col("km") / (F.col("minutes_to_home") / 60))
    return quantiles(rated, keys, "_kmh", {"kmh": 0.5}).drop("n")


def baseline_minutes(samples: DataFrame, speeds: DataFrame, keys: Sequence[str]) -> DataFrame:
    eta = F.col("km") / F.col("kmh") * 60
    return (samples.join(speeds, list(keys))
            .withColumn("eta_min", F.least(F.greatest(eta, F.lit(0.0)), F.lit(float(MAX_LEAD_MIN)))))


def error_profile(predicted: DataFrame, keys: Sequence[str], eta: str = "eta_min") -> DataFrame:
    wrong = predicted.withColumn("_ae", F.abs(F.col(eta) - F.col("minutes_to_home")))
    mean = wrong.groupBy(*keys).agg(F.avg("_ae").alias("mae_min"))
    return quantiles(wrong, keys, "_ae", {"median_ae_min": 0.5, "p90_ae_min": 0.9}).join(mean, list(keys))


def current_rows(frame: DataFrame, now: int | DataFrame) -> DataFrame:
    """The newest observation of each subject, if it is on its way home.

    `now` is one moment, or `at_us` for each subject.
    """
    rest = [c for c in frame.columns if c not in SID]
    at = F.lit(now) if isinstance(now, int) else F.col("at_us")
    frame = frame if isinstance(now, int) else frame.join(now.select(*SID, "at_us"), list(SID))
    recent = frame.where((F.col("ts_us") >= at - LOOKBACK_US) & (F.col("ts_us") <= at))
    newest = recent.groupBy(*SID).agg(F.max_by(F.struct(*rest), "ts_us").alias("_r")).select(*SID, "_r.*")
    return newest.where((F.col("km") >= MIN_JOURNEY_KM) & (F.col("closing_kmh") >= MIN_CLOSING_KMH))


def arrival_etas(etas: DataFrame, subjects: DataFrame) -> DataFrame:
    """Minutes until each person is home; the house takes the first of them."""
    house = etas.groupBy("household_id").agg(F.min("eta_min").alias("eta_min")).withColumn("subject", F.lit(HOUSE))
    known = etas.select(*SID, "eta_min").unionByName(house.select(*SID, "eta_min"))
    return subjects.select(*SID).join(known, list(SID), "left").withColumn("eta_min", F.bround("eta_min", 1))
