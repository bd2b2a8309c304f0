"""Hand-computed slots. Minutes count from a slot edge; negative ones lie before the grid."""

import pytest
from pyspark.sql import functions as F

from hearthlog.operators import grid as g

DAY = 1440


def column(df, name, subject="a"):
    return [r[name] for r in df.where(F.col("subject") == subject).orderBy("slot").collect()]


@pytest.fixture
def at(signals, grid_of):
    """Events of subject `a` shifted a day on, and a grid from that day."""
    def make(rows, n):
        s = signals([("a", DAY + m, v) for m, v in rows])
        return s, grid_of(n, "a").withColumn("start_slot", F.col("start_slot") + 48).withColumn("stop_slot", F.col("stop_slot") + 48)
    return make


def test_fraction_and_duration(at):
    s, subjects = at([(-60, "home"), (45, "not_home")], 4)
    assert column(g.slot_fraction(s, subjects), "home_frac") == [1.0, 0.5, 0.0, 0.0]
    assert column(g.minutes_in_state(s, subjects), "minutes_in_state") == [60, 90, 15, 45]


def test_blip_is_weighted_by_time(at):
    s, subjects = at([(-5, "home"), (10, "not_home"), (11.5, "home")], 1)
    assert column(g.slot_fraction(s, subjects), "home_frac")[0] == pytest.approx(0.95)


def test_nothing_before_the_first_event(at):
    out = g.slot_fraction(*at([(90, "home")], 4))
    assert column(out, "home_frac") == [None, None, None, 1.0]
    assert column(out, "coverage") == [0.0, 0.0, 0.0, 1.0]


def test_unknown_is_neither_home_nor_away(at):
    out = g.slot_fraction(*at([(0, "home"), (30, "unknown"), (60, "not_home")], 3))
    assert column(out, "home_frac") == [1.0, None, 0.0]
    assert column(out, "coverage") == [1.0, 0.0, 1.0]


def test_half_covered_slot_counts(at):
    assert column(g.slot_fraction(*at([(15, "home")], 1)), "home_frac") == [1.0]
    assert column(g.slot_fraction(*at([(15.1, "home")], 1)), "home_frac") == [None]


def test_last_of_one_instant_wins(at):
    assert column(g.slot_fraction(*at([(0, "home"), (0, "not_home")], 1)), "home_frac") == [0.0]


def test_repeats_do_not_restart_the_clock(at):
    out = g.minutes_in_state(*at([(-60, "home"), (-10, "home"), (40, " home ")], 3))
    assert column(out, "minutes_in_state") == [60, 90, 120]


def test_stale_number_is_dropped(signals, grid_of):
    s = signals([("a", 40, "7.0"), ("a", 41, "unavailable")]).withColumn("signal", F.lit("distance"))
    assert column(g.numeric_on_grid(s, grid_of(4, "a"), "distance", "m", 30), "m") == [None, None, 7.0, None]
    assert column(g.numeric_on_grid(s, grid_of(4, "a"), "distance", "m"), "m") == [None, None, 7.0, 7.0]


@pytest.mark.parametrize("hours, seen", [([0, 47.5], 0), ([0, 6, 12], 24)])
def test_silence(spark, hours, seen):
    events = spark.createDataFrame([(0, int(h * 3.6e9)) for h in hours], "household_id long, ts_us long")
    n = int(hours[-1] * 2)
    homes = spark.createDataFrame([(0, 0, max(n, 24) - 1)], "household_id long, start_slot long, stop_slot long")
    assert g.observability(homes, events).where("observable").count() == seen


def merged(signals, rows):
    out = g.house_changes(signals(rows)).orderBy("ts_us").collect()
    return [(r.ts_us // 60_000_000, r.value) for r in out]


def test_house_is_home_while_anyone_is(signals):
    assert merged(signals, [("a", 0, "home"), ("b", 0, "unknown")]) == [(0, "home")]
    assert merged(signals, [("a", 0, "not_home"), ("b", 0, "unknown"), ("a", 30, "home")]) == [(0, "unknown"), (30, "home")]


def test_a_person_joins_the_house_when_first_seen(signals):
    assert merged(signals, [("a", 0, "home"), ("a", 60, "not_home"), ("b", 120, "home")]) == [
        (0, "home"), (60, "not_home"), (120, "home")]


def test_zones_share_a_slot(signals, grid_of, spark):
    zones = spark.createDataFrame([(0, "Supermarket", "market", 0)], "household_id long, name string, slug string, position int")
    s = g.resolve_zones(signals([("a", 0, "home"), ("a", 10, "SUPERMARKET"), ("a", 20, "not_home")]), zones)
    out = g.slot_fraction(s.withColumn("value", F.col("zone")), grid_of(1, "a"),
                          {"home_frac": g.equals("home"), **g.zone_matches(["market"])}).first()
    assert (out.home_frac, out.zone_market, out.zone_other) == pytest.approx((1 / 3, 1 / 3, 1 / 3))


def test_cancelled_alarm_is_cleared(signals, grid_of):
    s = signals([("a", 0, "1970-01-01T07:00:00+00:00"), ("a", 225, "absent")]).withColumn("signal", F.lit("alarm"))
    out = g.integrate(s, grid_of(9, "a"), [g.alarm()])
    out = out.withColumn("h", g.next_alarm_h(F.col("slot"), F.col("alarm_us")))
    assert column(out, "h")[6:] == [4.0, 3.5, None]
