"""Arrival models held against constant speed, subject by subject."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlog.operators import eta
from hearthlog.operators import eta_models as em
from hearthlog.plans import build
from hearthlog.plans import serve as ps
from hearthlog.plans.grid import rnd, rounded
from hearthlog.plans.oracle import sql
from hearthlog.schema import HOUSE, SID
from hearthlog.sources import driver

QUERIES, ORACLE = {}, {}

# The log spans thirty days and few journeys: folds of five days, twenty rounds. The
# operators' defaults are those of a full fit.
TEST_DAYS, TRAIN_DAYS, MIN_ROWS, ROUNDS, MIN_LEAF, MIN_SAMPLES = 5, 5, 1, 20, 10, 1


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


DAYS_US = TEST_DAYS * 86_400_000_000
JOURNEY_FOLDS = f"""
jw AS (SELECT household_id, unnest(range(b + {TRAIN_DAYS * 86_400_000_000}, e, {DAYS_US})) AS start
       FROM (SELECT household_id, min(ts_us) AS b, max(ts_us) AS e FROM sa GROUP BY ALL)),
jf AS (SELECT household_id, start, row_number() OVER (PARTITION BY household_id ORDER BY start) - 1 AS fold
       FROM (SELECT w.household_id, start, count(*) FILTER (ts_us + {em.EMBARGO_US} < start) AS n_train,
                    count(*) FILTER (ts_us >= start AND ts_us < start + {DAYS_US}) AS n_test
             FROM jw w JOIN sa ON sa.household_id = w.household_id GROUP BY ALL) WHERE n_train >= {MIN_ROWS} AND n_test >= {MIN_ROWS}),
jk AS (SELECT sa.household_id, subject, fold, start, median(km / (minutes_to_home / 60)) AS kmh
       FROM sa JOIN jf ON jf.household_id = sa.household_id WHERE ts_us + {em.EMBARGO_US} < start GROUP BY ALL),
jt AS (SELECT sa.household_id, sa.subject, fold, count(*) AS n, avg(abs(least(greatest(km / kmh * 60, 0), 180) - minutes_to_home)) AS mae
       FROM sa JOIN jk ON jk.household_id = sa.household_id AND jk.subject = sa.subject WHERE ts_us >= start AND ts_us < start + {DAYS_US} GROUP BY ALL)"""
J = ps.T + [JOURNEY_FOLDS]


def placed(spark, sf_dir):
    return build.table(spark, sf_dir, "journey-folds", lambda: em.placed(ps.journeys(spark, sf_dir), TEST_DAYS, TRAIN_DAYS, MIN_ROWS))


def scores(spark, sf_dir):
    def make():
        told = em.out_of_fold(placed(spark, sf_dir), ROUNDS, MIN_LEAF)
        if told is None:
            told = placed(spark, sf_dir).where("false").select(
                *SID, F.lit(0).alias("fold"), "minutes_to_home", F.lit(0.0).alias("model_min"), F.lit(0.0).alias("eta_min"))
        return em.fold_scores(told)
    return build.table(spark, sf_dir, "arrival-scores", make)


@query("t6_subject_folds", sql(J, "SELECT household_id, subject, fold, n, round(mae, 6) AS baseline_mae_min, true AS is_error FROM jt"))
def t6_subject_folds(spark, sf_dir):
    """The constant-speed arm of each subject and fold; the model's error is one."""
    out = scores(spark, sf_dir).withColumn("is_error", F.col("mae_min").between(0, eta.MAX_LEAD_MIN))
    return rounded(out.select(*SID, F.col("fold").cast("long").alias("fold"), "n", "baseline_mae_min", "is_error"), "baseline_mae_min")


@query("t6_arrival_gate", sql(J, """
SELECT household_id, subject, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_folds, round(avg(mae), 6) AS baseline_mae_min, true AS is_lawful FROM jt GROUP BY ALL"""))
def t6_arrival_gate(spark, sf_dir):
    """The verdict on each subject's model follows from its folds."""
    out = em.gate(scores(spark, sf_dir), MIN_SAMPLES)
    wins = F.size(F.filter("per_fold", lambda x: x["mae_min"] < x["baseline_mae_min"]))
    ought = ((F.col("mae_min") <= F.col("baseline_mae_min") * 0.85) & (wins * 2 > F.col("n_folds")) & (F.col("baseline_mae_min") > 0))
    close = F.abs(F.col("skill_pct") - em.MIN_SKILL_PCT) < 1e-9
    return out.select(*SID, "n", "n_folds", rnd("baseline_mae_min").alias("baseline_mae_min"),
                      (F.coalesce(close, F.lit(False)) | (F.col("ships") == ought)).alias("is_lawful"))


@query("t9_shipped_etas", sql(J, """
SELECT s.household_id, s.subject, true AS is_lawful FROM subjects s"""))
def t9_shipped_etas(spark, sf_dir):
    """Estimates of shipped models, for those on their way only; the house is the first home."""
    rows = placed(spark, sf_dir)
    known = eta.implied_kmh(rows, SID)
    on_way, verdicts = ps.coming(spark, sf_dir), em.gate(scores(spark, sf_dir), MIN_SAMPLES)
    people = driver.subjects(build.events(spark, sf_dir))
    told = rows.limit(0).select(*SID, F.lit(0.0).alias("eta_min"))
    if not rows.isEmpty():
        told = em.served(em.fit(rows.join(known, list(SID), "left"), ROUNDS, MIN_LEAF), on_way, known, verdicts)
    out = eta.arrival_etas(told, people)
    may = on_way.join(verdicts.where("ships").select(*SID), list(SID), "left_semi").select(*SID, F.lit(True).alias("may"))
    may = may.unionByName(may.select("household_id", F.lit(HOUSE).alias("subject"), "may").distinct())
    right = F.col("eta_min").isNotNull() == F.coalesce("may", F.lit(False))
    return out.join(may, list(SID), "left").select(
        *SID, (right & F.coalesce(F.col("eta_min").between(0, eta.MAX_LEAD_MIN), F.lit(True))).alias("is_lawful"))
