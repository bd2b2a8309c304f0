import pytest
from pyspark.sql import functions as F

from hearthlog.session import new_folder
from hearthlog.streaming import ingest, slots

MIN = 60_000_000
ROW = "household_id long, entity_id string, ts_us long, value string, seq long"


@pytest.fixture
def source(spark):
    """A folder of files, one per list of rows, in the order they were written."""
    def make(*files):
        folder = new_folder(spark, "source")
        for rows in files:
            spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(folder)
        return folder
    return make


def ingested(spark, folder, path, **options):
    stream = spark.readStream.schema(ROW).options(**options).parquet(folder)
    ingest.run_ingest(stream, path, new_folder(spark, "progress")).awaitTermination()
    return sorted((r["entity_id"], r["ts_us"], r["value"], r["seq"]) for r in ingest.read_log(spark, path).collect())


def test_another_checkpoint_adds_to_the_log(spark, source):
    path = new_folder(spark, "log")
    first = [(0, "a", 1 * MIN, "home", 1), (0, "a", 2 * MIN, "home", 2)]
    assert len(ingested(spark, source(first), path)) == 2
    got = ingested(spark, source([(0, "b", 3 * MIN, "home", 3)]), path)
    assert [g[0] for g in got] == ["a", "a", "b"]


def test_a_late_first_reading_is_kept(spark, source):
    day = 1440 * MIN
    files = [[(0, "a", 20 * day, "home", 3)], [(0, "a", 21 * day, "home", 4)], [(0, "a", 10 * day, "out", 1)]]
    got = ingested(spark, source(*files), new_folder(spark, "log"), maxFilesPerTrigger=1)
    assert [g[1] // day for g in got] == [10, 20, 21]


def test_the_lowest_number_of_a_batch_and_then_the_first_stored_wins(spark, source):
    path = new_folder(spark, "log")
    rows = [(0, "a", MIN, f"v{n}", n) for n in (9, 7, 3, 8)]
    assert ingested(spark, source(rows), path) == [("a", MIN, "v3", 3)]
    assert ingested(spark, source([(0, "a", MIN, "v1", 1)]), path) == [("a", MIN, "v3", 3)]


def test_an_empty_start_and_a_batch_run_again(spark, source):
    path = new_folder(spark, "log")
    assert ingest.read_log(spark, path).count() == 0
    batch = spark.createDataFrame([(0, "a", MIN, "x", 1), (0, "a", MIN + 1, "y", 2)], ROW)
    ingest.insert_or_ignore(batch.where("false"), path)
    for _ in range(2):
        ingest.append_to(path)(batch, 0)
    assert ingest.read_log(spark, path).count() == 2


def test_compaction_leaves_the_rows_and_one_file_a_day(spark):
    path = new_folder(spark, "log")
    for n in range(4):
        ingest.insert_or_ignore(spark.createDataFrame([(0, "a", n * MIN, "x", n), (0, "a", (1440 + n) * MIN, "y", n)], ROW), path)
    before = sorted(map(tuple, ingest.read_log(spark, path).collect()))
    ingest.compact(spark, path, ["1970-01-01"])
    assert sorted(map(tuple, ingest.read_log(spark, path).collect())) == before
    files = ingest.read_days(spark, path, ["1970-01-01", "1970-01-02", "1999-01-01"]).select(F.input_file_name(), "day").distinct()
    assert {r["day"].day: r["count"] for r in files.groupBy("day").count().collect()} == {1: 1, 2: 4}


def test_late_and_open_minutes_are_made_good_from_the_log(spark):
    rows = [(0, "s", "presence", m * MIN + 1, i, v) for i, (m, v) in enumerate([(0, "home"), (0, "not_home"), (5, "home"), (9, "home")])]
    log = spark.createDataFrame(rows, "household_id long, subject string, signal string, ts_us long, seq long, value string")
    whole = {r["minute_us"]: tuple(r) for r in slots.repaired(slots.repaired(log_summary(log), log), log).collect()}
    # What a stream emitted that lost the second reading of minute 0 and never closed minute 9.
    partial = log_summary(log.where("seq not in (1, 3)"))
    got = {r["minute_us"]: tuple(r) for r in slots.repaired(partial, log).collect()}
    assert got == whole and sorted(k // MIN for k in got) == [0, 5, 9]


def log_summary(log):
    return slots._summed(log.withColumn("minute_us", slots._floor(MIN)), F.col("minute_us"), "minute_us")
