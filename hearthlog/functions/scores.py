"""Column functions used when forecasts are scored and gated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlog.schema import HOME_THRESHOLD

EPS = 1e-6


def outcome(frac: Column) -> Column:
    """1.0 when the slot counts as spent home; NULL stays NULL."""
    return (frac >= HOME_THRESHOLD).cast("double")


def clip_p(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


def shrink(raw: Column, weight: Column, base: Column) -> Column:
    """A single observation pulled toward the base rate."""
    pulled = weight * raw + (F.lit(1.0) - weight) * base
    return F.when(pulled.isNotNull(), F.least(F.greatest(pulled, F.lit(0.0)), F.lit(1.0)))


def skill_pct(brier: Column, reference: Column) -> Column:
    return F.when(reference > 0, F.lit(100.0) * (F.lit(1.0) - brier / reference))


def sign_test(wins: Column, trials: Column) -> Column:
    """Two-sided p of at least `wins` heads in `trials` fair tosses."""
    n = trials.cast("int")
    start = F.struct(F.pow(F.lit(0.5), n).alias("term"), F.lit(0.0).alias("tail"))

    def step(acc, k):
        tail = acc["tail"] + F.when(k >= wins, acc["term"]).otherwise(0.0)
        return F.struct((acc["term"] * (n - k) / (k + 1)).alias("term"), tail.alias("tail"))

    tail = F.aggregate(F.sequence(F.lit(0), n), start, step, lambda acc: acc["tail"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def fold_record_allows(beat: Column, folds: Column) -> Column:
    """Refuse only a record shown to be worse than a coin."""
    losing = (beat * 2 < folds) & (sign_test(folds - beat, folds) < 0.05)
    return F.when(folds == 0, F.lit(False)).otherwise(~losing)


def min_ship_skill_pct(folds: Column) -> Column:
    """A larger effect is asked for when few folds carry it."""
    return F.when(folds <= 4, F.lit(15.0)).otherwise(F.lit(5.0))
