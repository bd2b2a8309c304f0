from hearthlog.session import new_folder
from hearthlog.sources import forecasts

ROW = "household_id long, subject string, target_slot long, horizon_h int, p double, written_at long"
DAY = 86_400_000_000


def kept(spark, path):
    return sorted((r["target_slot"], r["horizon_h"], r["p"], r["written_at"]) for r in forecasts.read(spark, path).collect())


def cycle(spark, p, at, slots=(40, 50, 100), horizon=1):
    return spark.createDataFrame([(0, "s", s, horizon, p, at) for s in slots], ROW)


def test_the_later_p_stays_in_any_order_and_twice(spark):
    path = new_folder(spark, "forecasts")
    for one in (cycle(spark, 0.7, 2), cycle(spark, 0.2, 1), cycle(spark, 0.7, 2), cycle(spark, 0.9, 3, [50])):
        forecasts.upsert(one, path)
    assert kept(spark, path) == [(40, 1, 0.7, 2), (50, 1, 0.9, 3), (100, 1, 0.7, 2)]


def test_other_horizons_and_days_are_left_alone(spark):
    path = new_folder(spark, "forecasts")
    forecasts.upsert(cycle(spark, 0.5, 1), path)
    before = {f for f in forecasts.read(spark, path).where("target_slot >= 96").inputFiles() if "1970-01-03" in f}
    forecasts.upsert(cycle(spark, 0.6, 1, [40], horizon=2), path)
    after = {f for f in forecasts.read(spark, path).inputFiles() if "1970-01-03" in f}
    assert before == after and before
    assert kept(spark, path) == [(40, 1, 0.5, 1), (40, 2, 0.6, 1), (50, 1, 0.5, 1), (100, 1, 0.5, 1)]


def test_pruning_drops_days_and_cuts_the_one_at_the_bound(spark):
    path, other = new_folder(spark, "forecasts"), new_folder(spark, "state-log")
    spark.range(3).write.parquet(other)
    forecasts.upsert(cycle(spark, 0.5, 1, [40, 50, 60, 100]), path)
    forecasts.prune(spark, path, 10 * DAY, 0)
    assert [r[0] for r in kept(spark, path)] == [40, 50, 60, 100]
    forecasts.prune(spark, path, 2 * DAY + 6 * 3_600_000_000, 1)
    assert [r[0] for r in kept(spark, path)] == [60, 100]
    forecasts.prune(spark, path, 10 * DAY, 1)
    assert kept(spark, path) == []
    forecasts.upsert(cycle(spark, 0.1, 9, [7]), path)
    assert kept(spark, path) == [(7, 1, 0.1, 9)] and spark.read.parquet(other).count() == 3


def test_an_empty_cycle_and_an_empty_store(spark):
    path = new_folder(spark, "forecasts")
    forecasts.prune(spark, path, 10 * DAY, 1)
    forecasts.upsert(cycle(spark, 0.1, 1).where("false"), path)
    assert kept(spark, path) == []
