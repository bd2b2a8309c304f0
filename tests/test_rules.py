"""Reductions, statistics and labels on small hand-made input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthlog.functions import clock, scores, states
from hearthlog.operators import days as d
from hearthlog.operators import evaluate as e
from hearthlog.operators import explore, serve
from hearthlog.operators.chunks import as_of, with_previous


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("wins, trials, low", [(6, 8, False), (8, 8, True), (12, 15, True)])
def test_sign_test(spark, wins, trials, low):
    assert (value(spark, scores.sign_test(F.lit(wins), F.lit(trials))) < 0.05) is low


def test_sign_test_without_trials(spark):
    assert value(spark, scores.sign_test(F.lit(0), F.lit(0))) is None
    assert value(spark, scores.fold_record_allows(F.lit(0), F.lit(0))) is False


@pytest.mark.parametrize("date, hour, want", [
    ("2026-03-29", 2.5, "2026-03-29 01:00:00"),    # skipped: first moment after the gap
    ("2026-10-25", 2.5, "2026-10-25 00:30:00"),    # repeated: its first occurrence
    ("2026-07-01", 7.5, "2026-07-01 05:30:00")])
def test_wall_clock_hours(spark, date, hour, want):
    got = value(spark, clock.at_hour(F.lit(date).cast("date"), F.lit(hour), "Europe/Amsterdam").cast("string"))
    assert got == want


@pytest.mark.parametrize("text, number", [("1.5", 1.5), (" 2 ", 2.0), ("nan", None), ("inf", None), ("1.5d", None), ("unavailable", None)])
def test_numbers_in_text(spark, text, number):
    assert value(spark, states.real(F.lit(text))) == number


@pytest.mark.parametrize("entity, slug", [("person.Alice Smith", "alice_smith"), ("zone.home", "home"), ("plain", "plain"), ("a._b.c_", "b_c")])
def test_slugs(spark, entity, slug):
    assert value(spark, states.slugify(F.lit(entity))) == slug


def test_auc(spark):
    rows = spark.createDataFrame([(1.0, 0.9), (1.0, 0.4), (0.0, 0.4), (0.0, 0.1)], "y double, p double").withColumn("k", F.lit(1))
    assert e.auc(rows, ["k"], F.col("y"), F.col("p")).first().auc == pytest.approx(0.875)
    flat = rows.withColumn("p", F.lit(0.3))
    assert e.auc(flat, ["k"], F.col("y"), F.col("p")).first().auc == 0.5
    one = rows.withColumn("y", F.lit(1.0))
    assert e.auc(one, ["k"], F.col("y"), F.col("p")).first().auc is None


def test_calibration_edges(spark):
    rows = spark.createDataFrame([(1.0, 0.3), (1.0, 1.0), (0.0, 0.0)], "y double, p double")
    assert sorted(r.bin for r in e.reliability(rows).collect()) == [0, 2, 9]


def test_quantiles_equal_the_definition(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    data = [(k, float(x)) for k in (1, 2) for x in rng.choice(rng.normal(size=300), size=1000 * k)]
    rows = spark.createDataFrame(data, "k int, x double")
    for r in e.quantiles(rows, ["k"], "x", {"q5": 0.5, "q9": 0.9}).collect():
        own = [x for k, x in data if k == r.k]
        assert (r.n, r.q5, r.q9) == (len(own), pytest.approx(np.quantile(own, 0.5)), pytest.approx(np.quantile(own, 0.9)))


@pytest.mark.parametrize("state, curve, min_hours, want", [
    (1.0, [.95, .9, .49, .88, .9, .92], 2, None), (1.0, [.95, .9, .49, .88, .9, .92], 1, 3),
    (1.0, [.9, .9, .45, .9, .9, .2, .1, .1], 2, 6), (1.0, {1: .9, 2: .9, 3: .2, 5: .2, 6: .1}, 2, 5),
    (1.0, {47: .2, 48: .1}, 3, 47), (1.0, {48: .1}, 2, 48), (0.0, [.1, .2], 1, None)])
def test_crossing(spark, state, curve, min_hours, want):
    curve = curve if isinstance(curve, dict) else dict(enumerate(curve, 1))
    rows = spark.createDataFrame([(0, "a", state, h, p) for h, p in curve.items()],
                                 "household_id long, subject string, state_now double, horizon_h int, p double")
    who = rows.select("household_id", "subject").distinct()
    assert serve.crossing(rows, who, False, 0.5, min_hours).first().crossing_h == want


def labels(spark, away=(), missing=()):
    """One day at home but for the half hours named."""
    v = [None if i / 2 in missing else 0.0 if i / 2 in away else 1.0 for i in range(48)]
    grid = spark.createDataFrame([(0, "a", dt.date(2026, 3, 2), v, [0.0] * 48)],
                                 "household_id long, subject string, date date, v array<double>, z array<double>")
    r = d.label_days(grid).first()
    return r.candidate, r.left_today, r.departure_hour, r.return_hour


@pytest.mark.parametrize("away, missing, want", [
    ([7.5], [], (True, False, None, None)), ([7.5, 8], [], (True, True, 7.5, 8.5)),
    ([7, 8], [7.5], (True, False, None, None)), ([], [6 + i / 2 for i in range(8)], (False, False, None, None)),
    ([22.5, 23], [], (True, False, None, None)), ([21.5, 22], [], (True, True, 21.5, 22.5)),
    ([7.5, 8, 17, 17.5], [], (True, True, 7.5, 18.0)), ([21.5, 22, 22.5, 23, 23.5], [], (True, True, 21.5, None))])
def test_day_labels(spark, away, missing, want):
    assert labels(spark, away, missing) == want


def weekdays(spark, hours):
    first = dt.date(2026, 3, 2)
    rows = [(0, "a", first + dt.timedelta(days=7 * i), 0, True, True, h) for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, "household_id long, subject string, date date, dow int, candidate boolean, left_today boolean, departure_hour double")


def test_weekday_history_is_causal(spark):
    out = d.causal(weekdays(spark, [6.0] * 7 + [18.0])).orderBy("date").collect()
    assert [r.wday_hour for r in out] == [None] * 3 + [6.0] * 5
    # Cutting the future off changes nothing in the past.
    part = d.causal(weekdays(spark, [6.0] * 5)).orderBy("date").collect()
    assert [(r.wday_rate, r.recent_hour, r.all_hour) for r in part] == [(r.wday_rate, r.recent_hour, r.all_hour) for r in out[:5]]


def test_forecast_log_keeps_the_last(spark):
    rows = spark.createDataFrame([(0, "a", 10, 1, .1, 1), (0, "a", 10, 1, .9, 2)],
                                 "household_id long, subject string, target_slot long, horizon_h int, p double, written_at long")
    assert [r.p for r in serve.latest_forecasts(rows).collect()] == [0.9]


def test_runs(spark):
    rows = spark.createDataFrame([(0, x) for x in (1, 2, 3, 7, 9, 10)], "k int, x long")
    got = sorted((r.first, r.last) for r in [type("R", (), {"first": r["first"], "last": r["last"]}) for r in explore.runs(rows, ["k"], "x").collect()])
    assert got == [(1, 3), (7, 7), (9, 10)]


def test_chunked_lookups_equal_brute_force(spark):
    """One key holds most rows and crosses many chunks."""
    import random
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < .7 else "cold", rnd.randrange(40) * 900_000_000, i, str(rnd.randrange(5))) for i in range(400)]
    log = spark.createDataFrame(rows, "k string, ts_us long, seq long, value string")
    got = {r.seq: r.was for r in with_previous(log, ["k"], "value", "was").collect()}
    want, last = {}, {}
    for k, _ts, seq, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[seq], last[k] = last.get(k), v
    assert got == want
    points = spark.createDataFrame([(k, i * 700_000_000) for k in ("hot", "cold", "none") for i in range(50)], "k string, ts_us long")
    found = {(r.k, r.ts_us): r.v for r in as_of(points, log, ["k"], "value", "v").collect()}
    for (k, ts), v in found.items():
        seen = [r for r in rows if r[0] == k and r[1] <= ts]
        assert v == (max(seen, key=lambda r: (r[1], r[2]))[3] if seen else None)
    assert len(found) == 150
