from hypothesis import given, settings
from hypothesis import strategies as st

from hearthlog.session import new_folder
from hearthlog.streaming import ingest, trigger

SEC = 1_000_000
# The epoch itself would be behind the first watermark.
BASE = 20_000 * 86_400 * SEC
ROW = "household_id long, ts_us long"


def simulated(times, until, floor, poll):
    """The waiting loop, a tick at a time."""
    since, cycles, polls, waiting = min(times), [(min(times), 0)], 0, False
    for now in range(since + 1, until + 1):
        waiting |= now in times
        if (waiting and now - since >= floor) or now - since == poll:
            if waiting:
                cycles.append((now, polls))
            polls = 0 if waiting else polls + 1
            since, waiting = now, False
    return cycles


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=1, max_size=40), st.integers(0, 240))
def test_cycles_are_those_of_the_waiting_loop(times, until):
    heard = sorted(times)
    cycles, since, waiting, due = trigger.woken(heard, trigger.NEVER, until, floor=6, poll=30)
    if until >= heard[0]:
        assert [(c, p) for c, _n, p in cycles] == simulated(set(times), until, 6, 30)
    assert sum(n for _c, n, _p in cycles) + len(waiting) == len(times)
    assert (due is None) == (not waiting) and (due is None or due > until)
    assert all(b - a >= 6 for a, b in zip([c[0] for c in cycles], [c[0] for c in cycles][1:]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=40), st.integers(0, 300))
def test_going_on_from_a_state_changes_nothing(times, cut):
    heard = sorted(times)
    whole = trigger.woken(heard, trigger.NEVER, 1000, floor=6, poll=30)[0]
    first, since, waiting, _due = trigger.woken([t for t in heard if t <= cut], trigger.NEVER, cut, floor=6, poll=30)
    rest = trigger.woken([*waiting, *(t for t in heard if t > cut)], since, 1000, floor=6, poll=30)[0]
    assert first + rest == whole


def cycles_of(stream):
    out = ingest.drained(trigger.debounced(stream, ["household_id"], "1 hour"), "cycles").collect()
    return sorted((r["household_id"], r["cycle_us"] - BASE, r["answered"], r["polls"]) for r in out)


def test_a_stream_in_any_order_of_files(spark):
    times = {0: [0, 5, 70, 71, 700, 700, 1000], 1: [3], 2: [10 * 3600]}
    rows = [(h, BASE + t * SEC) for h, heard in times.items() for t in heard]
    got = []
    for order in (rows, rows[::-1]):
        folder = new_folder(spark, "readings")
        for part in (order[::2], order[1::2]):
            spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(folder)
        # Nothing is late by more than the lateness asked for.
        out = ingest.drained(trigger.debounced(stream, ["household_id"], "11 hours"), "cycles")
        assert out.count() == 0
        wide = spark.readStream.schema(ROW).parquet(folder)
        got.append(cycles_of(wide))
    # Household 2 is as new as the watermark's source: still open.
    assert got[0] == got[1] == [
        (0, 0, 1, 0), (0, 60 * SEC, 1, 0), (0, 120 * SEC, 2, 0), (0, 700 * SEC, 2, 1), (0, 1000 * SEC, 1, 0), (1, 3 * SEC, 1, 0)]


def test_late_readings_within_the_lateness_and_timers(spark):
    files = [[(0, 0)], [(0, 600 * SEC)], [(0, 30 * SEC)], [(0, 7200 * SEC)]]
    folder = new_folder(spark, "readings")
    for rows in files:
        spark.createDataFrame([(h, BASE + t) for h, t in rows], ROW).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(folder)
    got = cycles_of(stream)
    assert got == [(0, 0, 1, 0), (0, 60 * SEC, 1, 0), (0, 600 * SEC, 1, 1)]


def test_no_readings(spark):
    folder = new_folder(spark, "readings")
    spark.createDataFrame([], ROW).write.parquet(folder)
    stream = spark.readStream.schema(ROW).parquet(folder)
    assert ingest.drained(trigger.debounced(stream, ["household_id"]), "cycles").count() == 0
