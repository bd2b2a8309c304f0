import random

import pytest
from pyspark.sql import functions as F

from hearthlog.operators import eta
from hearthlog.operators import eta_models as em

DAY = 86_400_000_000
ROW = ("household_id long, subject string, ts_us long, km double, closing_kmh double, dir_towards double, dir_away double, "
       "hour double, dow int, minutes_to_home double")


@pytest.fixture(scope="module")
def journeys(spark):
    """A slow and a fast subject whose speed depends on the hour, over forty days."""
    rng = random.Random(2)
    rows = []
    for who, kmh in (("slow", 20), ("fast", 60)):
        for _ in range(400):
            at, km = rng.randrange(40 * DAY), rng.uniform(1, 20)
            hour = at % DAY / (DAY / 24)
            rows.append((0, who, at, km, 10.0, 1.0, 0.0, hour, 0, min(km / (kmh * (0.4 if hour < 12 else 1.6)) * 60, 180.0)))
    return spark.createDataFrame(rows, ROW).coalesce(2).cache()


def test_a_model_that_sees_the_hour_ships_and_no_row_is_scored_by_its_own_fit(spark, journeys):
    rows = em.placed(journeys, 13, 15, 20).cache()
    late = rows.where("test_fold is not null and train_from <= test_fold")
    assert late.count() == 0
    told = em.out_of_fold(rows, rounds=8, min_leaf=5).cache()
    assert told.count() == rows.where("test_fold is not null").count()
    verdicts = em.gate(em.fold_scores(told), min_samples=100).collect()
    assert len(verdicts) == 2 and all(v["ships"] and v["beat"] == v["n_folds"] and v["skill_pct"] > 15 for v in verdicts)
    assert not any(v["ships"] for v in em.gate(em.fold_scores(told), min_samples=10_000).collect())


def test_the_speed_of_a_fold_is_that_of_journeys_before_it(spark, journeys):
    rows = em.placed(journeys, 13, 15, 20).cache()
    got = {(r["subject"], r["fold"]): r["kmh"] for r in em.speeds(rows).collect()}
    for (who, fold), kmh in got.items():
        start = rows.where(F.col("test_fold") == fold).agg(F.min("at_us")).first()[0]
        before = rows.where((F.col("subject") == who) & (F.col("train_from") <= fold))
        assert before.agg(F.max("at_us")).first()[0] + em.EMBARGO_US < start
        assert kmh == pytest.approx(before.agg(F.percentile(F.col("km") / (F.col("minutes_to_home") / 60), 0.5)).first()[0])


def test_the_gate_asks_for_majority_and_skill(spark):
    def verdict(*folds):
        rows = [(0, "s", i, 100, float(a), float(b)) for i, (a, b) in enumerate(folds)]
        return em.gate(spark.createDataFrame(rows, "household_id long, subject string, fold int, n long, mae_min double, baseline_mae_min double")).first()
    assert verdict((5, 10), (5, 10), (5, 10), (5, 10), (5, 10))["ships"]
    assert not verdict((9, 10), (9, 10), (9, 10), (9, 10), (9, 10))["ships"]
    assert not verdict((1, 10), (10, 10), (10, 10), (1, 10), (10, 10))["ships"]
    assert not verdict((0, 0), (0, 0), (0, 0), (0, 0), (0, 0))["ships"]


def test_only_shipped_subjects_on_their_way_are_served(spark, journeys):
    known = eta.implied_kmh(journeys, ["household_id", "subject"])
    model = em.fit(journeys.join(known, ["household_id", "subject"]), rounds=2, min_leaf=5)
    coming = journeys.where("subject = 'fast'").limit(1).drop("minutes_to_home").unionByName(
        journeys.where("subject = 'slow'").limit(1).drop("minutes_to_home"))
    verdicts = spark.createDataFrame([(0, "fast", True), (0, "slow", False)], "household_id long, subject string, ships boolean")
    got = em.served(model, coming, known, verdicts).collect()
    assert [r["subject"] for r in got] == ["fast"] and 0 <= got[0]["eta_min"] <= 180
