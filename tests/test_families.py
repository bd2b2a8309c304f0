import pytest
from pyspark.sql import functions as F

from hearthlog.operators import features as f
from hearthlog.operators import evaluate as e
from hearthlog.operators import gate
from hearthlog.operators import models as m
from hearthlog.operators import serve as v
from hearthlog.plans import chain

COLUMNS = ("state_now", "never_seen")


@pytest.fixture(scope="module")
def rows(spark):
    """Horizon 1 is the opposite of now, horizon 2 a coin; two test folds of 240 slots."""
    coin = lambda seed: (F.pmod(F.xxhash64("slot", F.lit(seed)), F.lit(2))).cast("double")
    base = spark.range(960, numPartitions=2).select(
        F.lit(0).cast("long").alias("household_id"), F.lit("a").alias("subject"), F.lit("p0").alias("role"), F.col("id").alias("slot"))
    out = base.withColumn("state_now", coin(1)).withColumn("horizon_h", F.explode(F.lit([1, 2])))
    ripe = F.col("slot") + 2 * F.col("horizon_h") + 1
    return (out.withColumn("y", F.when(F.col("horizon_h") == 1, 1 - F.col("state_now")).otherwise(coin(2)))
            .withColumn("never_seen", F.lit(None).cast("double"))
            .withColumn("test_fold", F.when(F.col("slot") >= 480, F.floor((F.col("slot") - 480) / 240).cast("int")))
            .withColumn("train_from", F.when(ripe < 480, 0).when(ripe < 720, 1))).cache()


@pytest.fixture(scope="module")
def families():
    return [m.Family("dedicated", COLUMNS, (1, 2), 2, min_rows=10, category="role", always=("state_now",)),
            m.Family("pooled", (*COLUMNS, "horizon_h"), None, 2, min_rows=10, rate=0.5, weighted=True, always=("state_now", "horizon_h"))]


@pytest.fixture(scope="module")
def told(rows, families):
    return m.families_out_of_fold(rows, families, 2).cache()


@pytest.fixture(scope="module")
def judged(spark, told):
    scored = e.score(told, [*gate.GROUP, "kind", "fold"])
    bar = spark.createDataFrame([(0, h, "base_rate", fold, 240, 0.5, 0.25, 0.69, 0.5, 0.5) for h in (1, 2) for fold in (0, 1)],
                                "household_id long, horizon_h int, rung string, fold int, n long, base_rate double, brier double, log_loss double, auc double, mae_frac double")
    return gate.verdicts(scored, bar).cache()


def test_each_tested_row_is_told_once_by_each_family(rows, told):
    keys = ["household_id", "subject", "slot", "horizon_h"]
    assert told.count() == told.select(*keys, "kind").distinct().count() == 2 * 2 * 480
    assert told.join(rows, keys).where(F.col("fold") != F.col("test_fold")).isEmpty()


def test_what_can_be_learned_ships_and_a_coin_does_not(judged):
    got = {(r["horizon_h"], r["kind"]): r for r in judged.collect()}
    assert {k: r["ships"] for k, r in got.items()} == {(1, "dedicated"): True, (1, "pooled"): True, (2, "dedicated"): False, (2, "pooled"): False}
    assert got[1, "dedicated"]["trials"] == 2 and [x["fold"] for x in got[1, "dedicated"]["per_fold"]] == [0, 1]


def test_metrics_say_why_a_candidate_lost(judged, told):
    kept = gate.metrics_table(judged, e.reliability(told, [*gate.GROUP, "kind"])).collect()
    assert all((r["failure"] is None) == r["ships"] for r in kept)
    assert all(sum(b["n"] for b in r["reliability"]) == r["n"] == 480 for r in kept)


def test_a_stored_model_serves_only_what_it_won(spark, rows, families, judged, tmp_path):
    chosen = gate.choose(judged)
    stored = m.store_families(rows, families, str(tmp_path))
    assert sorted((x.kind, head) for x, head, _path in stored if head) == [("dedicated", 1), ("dedicated", 2)] and len(stored) == 3
    now = rows.where("slot in (950, 951, 952, 953)")
    served = m.serve_families(now, stored, chosen).join(now, ["household_id", "subject", "slot", "horizon_h"]).collect()
    assert len(served) == 4 and {r["horizon_h"] for r in served} == {1}
    assert all(abs(r["p"] - r["y"]) < 0.2 for r in served)
    assert m.serve_families(now, stored, chosen.withColumn("ships", F.lit(False))).isEmpty()
    one = now.where("slot = 950")
    told = m.serve_families(one, stored, chosen).drop("slot")
    curve = v.curves(one.where("horizon_h = 1").select("household_id", "subject", "slot", "state_now"), told)
    assert [r["horizon_h"] for r in curve.collect()] == [1]


def test_a_fold_without_training_rows_foretells_nothing(rows, families):
    assert m.families_out_of_fold(rows.where("slot >= 480"), families[:1], 1) is None
    assert m.families_out_of_fold(rows.where("train_from = 1 or test_fold = 1"), families[:1], 2).select("fold").distinct().collect() == [(1,)]


def test_a_fold_without_rows_is_listed_and_is_no_trial(spark, told):
    scored = e.score(told.where("kind = 'pooled' and horizon_h = 1 and fold = 0"), [*gate.GROUP, "kind", "fold"])
    asked = spark.createDataFrame([(0, 1, "pooled", k) for k in (0, 1)], "household_id long, horizon_h int, kind string, fold int")
    bar = scored.drop("kind").withColumn("rung", F.lit("r")).withColumn("brier", F.lit(0.3))
    row = gate.verdicts(gate.with_empty_folds(scored, asked), bar).first()
    assert [(x["fold"], x["n"]) for x in row["per_fold"]] == [(0, 240), (1, 0)] and row["trials"] == 1


def test_others_before_equal_the_join_of_every_horizon(spark):
    roles = ("p0", "p1")
    table = spark.createDataFrame([(0, f"u{i}", f"p{i}", t, t < 240, float((t * 7 + i) % 5) / 5 if t < 240 and t % 11 else None, 1.0)
                                   for i in (0, 1) for t in range(240 + f.AHEAD_SLOTS)],
                                  "household_id long, subject string, role string, slot long, in_grid boolean, home_frac double, coverage double")
    names = [f"other_{r}_lag" for r in roles]
    horizons = [1, 24, 25, 48]
    new = f.samples(f.with_others_before(table, roles), horizons, origin=("role",), near=names)
    old = f.with_others_lagged(f.samples(table, horizons, origin=("role",)), table, roles)
    keep = ["subject", "slot", "horizon_h", "lag1d", *names]
    assert new.select(*keep).exceptAll(old.select(*keep)).isEmpty() and new.count() == old.count() == 2 * 240 * 4
    assert new.where("other_p1_lag is not null").count() > 0


def test_a_gap_in_the_feature_table_is_refused(rows):
    with pytest.raises(ValueError, match="wclim8"):
        chain.checked(rows)
