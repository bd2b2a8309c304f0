"""Samples of many horizons, and the number of tasks they are dealt to."""

import math

from pyspark.sql import functions as F

from hearthlog.operators import features as f


def grid(spark, first=19, slots=240, ahead=96):
    """Two subjects whose grid begins within a day; some slots are not known."""
    rows = spark.range(2).select(F.col("id").alias("household_id"), F.lit("u").alias("subject")).withColumn(
        "slot", F.explode(F.sequence(F.lit(first), F.lit(first + slots + ahead - 1)))).withColumn(
        "slot", F.col("slot").cast("long"))
    known = (F.col("slot") < first + slots) & (F.col("slot") % 7 != 0)
    return (rows.withColumn("in_grid", F.col("slot") < first + slots)
            .withColumn("home_frac", F.when(known, (F.col("slot") * 37 + F.col("household_id") * 11) % 101 / 101.0))
            .withColumn("coverage", F.lit(1.0)))


def test_samples_read_ahead_without_a_window_per_horizon(spark):
    table = grid(spark)
    out = f.samples(table, origin=("in_grid",))
    # One array column is read ahead, by days; it used to be a struct for each of 48 horizons.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lead(") == 2
    value = {(r.household_id, r.slot): r.home_frac for r in table.collect()}
    rows = out.collect()
    assert len(rows) == 2 * 240 * 48
    assert len({(r.household_id, r.slot, r.horizon_h) for r in rows}) == len(rows)
    for r in rows:
        t = r.slot + 2 * r.horizon_h
        assert r.target_slot == t and r.y == value[r.household_id, t] and r.state_now == value[r.household_id, r.slot]
        assert r.lag1d == (value.get((r.household_id, t - 48)) if r.horizon_h <= 24 else None)
        assert r.near_lag == value.get((r.household_id, t - 48 * r.other_lag_days))
        past = [value.get((r.household_id, t - 48 * k)) for k in range(r.other_lag_days, 15)]
        past = [x for x in past if x is not None]
        assert (r.sclim14 is None) if not past else math.isclose(r.sclim14, sum(past) / len(past))


def test_a_shuffle_is_dealt_to_more_tasks_as_it_grows(spark):
    rows = spark.range(1_000_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
    # 66 MB of text in tasks of about a megabyte; it used to be one task a core.
    assert rows.repartition("id").rdd.getNumPartitions() > 12


def test_j4_reads_the_others_ahead_without_moving_horizons(spark):
    roles = ("a", "b")
    table = grid(spark).withColumn("role", F.lit("a"))
    rows = f.samples(f.with_others_before(table, roles), origin=("role",), near=[f"other_{r}_lag" for r in roles])
    assert f.with_others_lagged(rows, table, roles) is rows
