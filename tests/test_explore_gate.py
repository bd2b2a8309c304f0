from pyspark.sql import functions as F

from hearthlog.operators import catalog, explore, gate
from hearthlog.operators import grid as g
from hearthlog.sources import statelog

SLOT = 1_800_000_000


def test_each_household_has_the_grid_of_its_own_log(spark):
    events = spark.createDataFrame([(0, t * SLOT) for t in range(0, 17520, 48)] + [(1, 100 * SLOT), (1, 147 * SLOT + 5)], "household_id long, ts_us long")
    subjects = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b")], "household_id long, subject string")
    counts = {(r["household_id"], r["subject"]): r["count"] for r in
              g.grid(g.spine(subjects, events)).groupBy("household_id", "subject").count().collect()}
    assert counts == {(0, "a"): 17473, (1, "a"): 48, (1, "b"): 48}


def test_slots_and_horizons_without_a_forecast_stay(spark):
    grid = spark.createDataFrame([(0, "a", t, None if t == 3 else 1.0) for t in range(5)], "household_id long, subject string, slot long, home_frac double")
    made = spark.createDataFrame([(0, "a", 0, 1, 0.9), (0, "a", 3, 1, 0.9), (0, "a", 9, 1, 0.5)],
                                 "household_id long, subject string, target_slot long, horizon_h int, p double")
    points, scores = explore.verification(grid, made, [1, 2])
    assert points.count() == 10 and points.where("p is null").count() == 8
    rows = {r["horizon_h"]: r for r in scores.collect()}
    assert (rows[1]["slots"], rows[1]["served"], rows[1]["n"]) == (5, 2, 1)
    assert abs(rows[1]["brier"] - 0.01) < 1e-9 and abs(rows[1]["mae_frac"] - 0.1) < 1e-9 and rows[1]["served_pct"] == 40.0
    assert (rows[2]["served"], rows[2]["n"], rows[2]["brier"]) == (0, 0, None)


def test_a_fold_without_a_bar_is_no_win(spark):
    fields = "household_id long, horizon_h int, {} string, fold int, n long, base_rate double, brier double, log_loss double, auc double, mae_frac double"
    mine = spark.createDataFrame([(0, 1, "m", fold, 10, 0.5, 0.1, 0.3, 0.8, 0.1) for fold in range(3)], fields.format("kind"))
    bar = spark.createDataFrame([(0, 1, "r", fold, 10, 0.5, 0.2, 0.4, 0.7, 0.2) for fold in range(2)], fields.format("rung"))
    row = gate.verdicts(mine, bar).first()
    assert (row["trials"], row["beat"]) == (3, 2)


def test_families_are_looked_up(spark):
    names = {"state_now": "state", "home_frac": "target", "zone_office": "zone", "other_u1": "cross_subject", "y_24h": "horizon_target",
             "tgt24h_lag1d": "daily_lag", "tgt3h_other_u1_lag1d": "cross_subject_lag", "tgt3h_wclim4": "climatology",
             "tgt3h_wclim4_slope_back": "climatology_slope", "tgt48h_sclim14": "slot_climatology", "slot_sin": "calendar",
             "tgt1h_slot_sin": "target_calendar", "tgt1h_next_alarm_rel_h": "next_alarm", "subject": "key", "lag1d": "unknown", "x": "unknown"}
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", catalog.column_family(F.col("name")).alias("f"))
    assert {r["name"]: r["f"] for r in rows.collect()} == names


def test_points_under_a_unit_or_an_id_are_found_once(spark):
    points = spark.createDataFrame([(0, "m", "a_distance", "value", 1, 1, "5"), (0, "m", "b_distance", "value", 1, 2, "6"),
                                    (0, "sensor.c", "c", "value", 1, 3, "7"), (0, "sensor.c", "c", "state", 1, 4, "8")],
                                   "household_id long, measurement string, object_id string, field string, ts_us long, seq long, value string")
    units = spark.createDataFrame([(0, "sensor.a_distance", "m"), (0, "sensor.c", None)], "household_id long, entity_id string, unit string")
    got = sorted((r["entity_id"], r["number"]) for r in statelog.unit_keyed(points, units).collect())
    assert got == [("sensor.a_distance", 5.0), ("sensor.c", 7.0)]
