import random

import pytest
from pyspark.sql import functions as F

from hearthlog.operators import grid as g
from hearthlog.operators import serve as v
from hearthlog.plans import live
from hearthlog.session import new_folder
from hearthlog.sources import closing

DAY, S = 86_400_000_000, 1_800_000_000
ROW = "household_id long, subject string, ts_us long, seq long, value string"


@pytest.fixture(scope="module")
def log(spark):
    """Three households over ten days: a busy one, one that falls silent and one that begins late."""
    rng = random.Random(1)
    spans = {0: (0, 10), 1: (0, 4), 2: (8, 10)}
    rows = []
    for h, (a, b) in spans.items():
        for seq in range(150):
            who = "rare" if h == 0 and seq == 3 else f"s{rng.randrange(2)}"
            rows.append((h, who, int(rng.uniform(a, b) * DAY) if who != "rare" else DAY, seq, rng.choice(["home", "not_home", "unknown"])))
    return spark.createDataFrame(rows, ROW).coalesce(2).cache()


def whole(log):
    """The build over the whole history."""
    subjects = log.select("household_id", "subject").distinct().unionByName(
        log.select("household_id", F.lit("house").alias("subject")).distinct())
    out = g.integrate(g.presence_signals(log), g.spine(subjects, log), [g.presence({"home_frac": g.equals("home")})])
    out = out.withColumnRenamed("presence_coverage", "coverage").withColumnRenamed("presence_minutes", "minutes_in_state")
    return g.blanked(out.drop("presence_observed_us"), g.live_spans(log), ["home_frac", "minutes_in_state"])


def stored(spark, log):
    days, closed = new_folder(spark, "log-days"), new_folder(spark, "closings")
    closing.store(log, days)
    closing.store(closing.closings(g.presence_signals(log), F.lit("1970-01-10").cast("date")), closed)
    return closing.read(spark, days), closing.read(spark, closed)


def rows_of(table):
    names = ("household_id", "subject", "slot", "home_frac", "coverage", "minutes_in_state", "observable")
    return sorted((tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in r)
                   for r in table.select(*names).collect()), key=str)


def test_the_window_equals_the_whole_build(spark, log):
    days, closed = stored(spark, log)
    for day in (3, 9):
        start = f"1970-01-{day + 1:02d}"
        got = rows_of(live.served_table(days, closed, start, day * DAY))
        wanted = rows_of(whole(log).where(F.col("slot") >= day * 48))
        assert got == wanted and got


def test_only_the_days_asked_for_are_read(spark, log):
    days, closed = stored(spark, log)
    later, held = closing.window(days, closed, "1970-01-08")
    read = {r[0] for r in later.select(F.regexp_extract(F.input_file_name(), r"day=([0-9-]+)", 1)).collect()}
    assert read == {"1970-01-08", "1970-01-09", "1970-01-10"}
    assert {r[0] for r in held.select(F.regexp_extract(F.input_file_name(), r"day=([0-9-]+)", 1)).collect()} == {"1970-01-07"}
    for part in (later, held):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(day" in plan


def test_closings_a_day_at_a_time(spark, log):
    key = lambda df: sorted(map(tuple, df.select("household_id", "subject", "ts_us", "value", "heard_us", "day").collect()))
    people = log.select("household_id", "subject", "ts_us", "seq", "value")
    wanted = closing.closings(people, F.lit("1970-01-10").cast("date"))
    grown = closing.closings(people.where(F.col("ts_us") < DAY), F.lit("1970-01-01").cast("date"))
    for day in range(2, 11):
        fresh = closing.next_closing(grown, people, F.lit(f"1970-01-{day:02d}").cast("date"))
        grown = spark.createDataFrame(grown.unionByName(fresh.select(grown.columns)).collect(), grown.schema)
    assert key(grown) == key(wanted)


def test_look_back_is_sixty_days():
    assert v.lookback_days() == 60
