"""Arrival models: fitted before a fold, scored inside it, served where they win.

A subject tells itself apart by its own speed before the fold, so one model serves
any number of them and an unknown one is a missing value.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.functions.scores import sign_test, skill_pct
from hearthlog.operators import eta
from hearthlog.operators import evaluate as e
from hearthlog.operators import models as m
from hearthlog.schema import SID

FEATURES = ("km", "closing_kmh", "dir_towards", "dir_away", "hour", "dow", "kmh")
ALWAYS = FEATURES[:-1]

# A full fit, the folds it is judged on and what it takes to ship.
ROUNDS, MIN_LEAF = 200, 40
EMBARGO_US = 6 * 3_600_000_000
FOLD_DAYS, TRAIN_DAYS, FOLD_MIN_ROWS = 14, 45, 50
MIN_SAMPLES, MIN_SKILL_PCT = 500, 15.0


def placed(samples: DataFrame, test_days: int = FOLD_DAYS, train_days: int = TRAIN_DAYS, min_rows: int = FOLD_MIN_ROWS) -> DataFrame:
    """Journeys with the fold that tests them and the first that may learn from them.
    The people of a household share its windows."""
    rows = samples.withColumn("at_us", F.col("ts_us"))
    shape = rows.groupBy("household_id").agg(F.min("at_us").alias("begin_us"), F.max("at_us").alias("end_us")).withColumns(
        {name: F.lit(value).cast("long") for name, value in
         (("test_days", test_days), ("min_train_days", train_days), ("min_rows", min_rows))})
    folds = e.calendar_folds(rows, shape, F.lit(EMBARGO_US))
    return e.with_folds(rows, e.fold_lists(folds), F.lit(EMBARGO_US))


def speeds(rows: DataFrame) -> DataFrame:
    """The median speed of each subject's journeys before each fold."""
    train = rows.where("train_from is not null").withColumn(
        "fold", F.explode(F.sequence(F.col("train_from"), F.col("n_folds") - 1)))
    return eta.implied_kmh(train, [*SID, "fold"])


def fit(rows: DataFrame, rounds: int = ROUNDS, min_leaf: int = MIN_LEAF) -> PipelineModel:
    """Of the logarithm of the minutes, as errors count in proportion."""
    ready = rows.withColumn("log_min", F.log1p("minutes_to_home"))
    return m.fit_regressor(ready, FEATURES, "log_min", iterations=rounds, min_rows=min_leaf, always=ALWAYS)


def minutes(model: PipelineModel, rows: DataFrame) -> DataFrame:
    told = F.least(F.greatest(F.expm1("prediction"), F.lit(0.0)), F.lit(float(eta.MAX_LEAD_MIN)))
    return m.predict(model, rows, FEATURES, ALWAYS).withColumn("model_min", told).drop("prediction")


def out_of_fold(rows: DataFrame, rounds: int = ROUNDS, min_leaf: int = MIN_LEAF) -> DataFrame | None:
    """Each tested journey by both arms: `eta_min` at constant speed, `model_min` by a
    model of what its fold trains on. Without a speed before the fold there is neither."""
    known = speeds(rows)
    folds = rows.agg(F.max("n_folds")).first()[0] or 0

    def part(fold):
        mine = known.where(F.col("fold") == fold).drop("fold")
        train = rows.where(F.col("train_from") <= fold).join(mine, list(SID), "left")
        tested = eta.baseline_minutes(rows.where(F.col("test_fold") == fold), mine, SID)
        return minutes(fit(train, rounds, min_leaf), tested).withColumn("fold", F.lit(fold))
    out = None
    for one in m.at_once([lambda f=f: part(f) for f in range(folds)]):
        out = one if out is None else out.unionByName(one)
    return out


def fold_scores(told: DataFrame) -> DataFrame:
    def mae(column):
        return F.avg(F.abs(F.col(column) - F.col("minutes_to_home")))
    return told.groupBy(*SID, "fold").agg(
        F.count("*").alias("n"), mae("model_min").alias("mae_min"), mae("eta_min").alias("baseline_mae_min"))


def gate(scores: DataFrame, min_samples: int = MIN_SAMPLES, min_skill: float = MIN_SKILL_PCT) -> DataFrame:
    """Per subject: a model ships with a lower mean error, most folds won and enough skill."""
    per_fold = F.sort_array(F.collect_list(F.struct("fold", "n", "mae_min", "baseline_mae_min")))
    out = scores.groupBy(*SID).agg(
        F.sum("n").alias("n"), F.count("*").alias("n_folds"), F.avg("mae_min").alias("mae_min"),
        F.avg("baseline_mae_min").alias("baseline_mae_min"),
        F.count_if(F.col("mae_min") < F.col("baseline_mae_min")).alias("beat"), per_fold.alias("per_fold"))
    out = out.withColumn("skill_pct", skill_pct(F.col("mae_min"), F.col("baseline_mae_min"))) \
        .withColumn("sign_p", sign_test(F.col("beat"), F.col("n_folds")))
    ships = ((F.col("n") >= min_samples) & (F.col("mae_min") < F.col("baseline_mae_min"))
             & (F.col("beat") * 2 > F.col("n_folds")) & (F.col("skill_pct") >= min_skill))
    return out.withColumn("ships", F.coalesce(ships, F.lit(False)))


def served(model: PipelineModel, coming: DataFrame, known: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Minutes of those on their way whose model ships; others have no estimate."""
    ships = verdicts.where("ships").select(*SID)
    rows = coming.join(ships, list(SID), "left_semi").join(known, list(SID), "left")
    return minutes(model, rows).withColumnRenamed("model_min", "eta_min")
