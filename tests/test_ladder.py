"""Rungs of the ladder against their definitions, and what their plan moves."""

import math
import random

from pyspark.sql import functions as F

from hearthlog.functions.scores import clip_p
from hearthlog.operators import evaluate as e
from hearthlog.operators import features as f
from hearthlog.operators import ladder

SCHEMA = ("household_id long, horizon_h int, subject string, slot long, y double, label double, state_now double, "
          "near_lag double, dow int, sod int, train_from int, n_folds int, test_fold int")


def sample_rows():
    rng, rows = random.Random(3), []
    for household in (1, 2):
        for horizon in (1, 30):
            for k in range(160):
                y = rng.random()
                # Household 2 trains on nothing before its second fold; two rows come twice.
                first = rng.choice((1, 2, None)) if household == 2 else rng.choice((0, 1, 2, None))
                row = (household, horizon, rng.choice("ab"), k, y, float(y >= 0.5), rng.choice((0.0, 1.0, 0.4)),
                       rng.choice((None, 0.0, 1.0)), rng.randrange(7), rng.randrange(6), first, 3, rng.choice((0, 1, 2, None)))
                rows += [row] * (2 if k < 2 else 1)
    return rows


def test_rungs_equal_their_definitions_and_no_cell_becomes_a_row(spark):
    data = sample_rows()
    rows = spark.createDataFrame(data, SCHEMA)
    out = ladder.predictions(rows)
    # Each cell and fold was a row, spread to folds, summed, ranked in windows and joined to the tested rows.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    got, weight = out.collect(), {(r.household_id, r.horizon_h, r.fold): r for r in ladder.weights(rows).collect()}
    assert len(got) == sum(r[12] is not None for r in data)
    assert any(r.base is None for r in got) and any(r.r_subject is None and r.base is not None for r in got)
    for r in got:
        trained = [t for t in data if t[:2] == (r.household_id, r.horizon_h) and t[10] is not None and t[10] <= r.fold]
        fit = weight.get((r.household_id, r.horizon_h, r.fold))
        assert (fit is None) == (not trained)

        def rate(*same):
            labels = [t[5] for t in trained if all(t[i] == r[name] for i, name in same)]
            return sum(labels) / len(labels) if labels else None
        base = rate()
        cells = {"slot_climatology": rate((9, "sod")), "weekday_slot_climatology": rate((9, "sod"), (8, "dow")),
                 "weekday_slot_subject_climatology": rate((9, "sod"), (8, "dow"), (2, "subject")), "base_rate": base}
        if fit:
            cells["persistence"] = fit.w_state * r.state_now + (1 - fit.w_state) * base
            cells["same_slot_yesterday"] = None if r.near_lag is None else fit.w_lag * r.near_lag + (1 - fit.w_lag) * base
        for rung in ladder.RUNGS:
            want = cells.get(rung)
            want = base if want is None and rung.endswith("climatology") else want
            assert (r[f"p_{rung}"] is None) == (want is None), rung
            assert want is None or math.isclose(r[f"p_{rung}"], want, abs_tol=1e-12), rung


def test_samples_make_only_the_facts_asked_for(spark):
    table = spark.range(1).select(F.lit(1).alias("household_id"), F.lit("u").alias("subject"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(299).cast("long"))).alias("slot")).withColumns({
            "in_grid": F.col("slot") < 204, "coverage": F.lit(1.0), "kind": F.col("slot") % 5,
            "home_frac": F.when(F.col("slot") < 204, F.col("slot") % 7 / 7.0)})
    whole = f.samples(table).select("slot", "horizon_h", "y", "near_lag")
    few = f.samples(table, target=("kind",), facts=("lag1d", "lag2d"))
    assert "wclim4" not in few.columns and "sclim14" not in few.columns
    assert few.where("kind <> target_slot % 5").count() == 0
    assert sorted(few.select(*whole.columns).collect(), key=str) == sorted(whole.collect(), key=str)


def placed_slots(spark):
    """Slots of two households, 48 past the grid, with folds; household 2 trains on nothing before its second."""
    rng, rows = random.Random(5), []
    for household, subjects in ((1, "ab"), (2, "c")):
        for subject in subjects:
            for k in range(340):
                ripe = None if household == 2 and k < 150 else next((i for i, edge in enumerate((120, 200)) if k + 1 < edge), None)
                test = (0 if 120 <= k < 200 else 1 if 200 <= k < 280 else None)
                y = None if rng.random() < 0.1 or k >= 280 else rng.choice((0.0, 1.0, 0.5, rng.random()))
                rows.append((household, subject, 1000 + k, k < 280, y, None if k % 50 == 0 else 1.0, test, ripe, 2))
    return spark.createDataFrame(rows, "household_id long, subject string, slot long, in_grid boolean, home_frac double, "
                                       "coverage double, test_fold int, train_from int, n_folds int")


def long_rows(placed, horizons):
    long = f.usable_rows(f.samples(placed, horizons, origin=("test_fold", "n_folds"), target=("train_from",), facts=("lag1d", "lag2d")))
    t = F.col("target_slot")
    return ladder.labelled(long.withColumns({"sod": (t % 48).cast("int"), "dow": ((F.floor(t / 48) + 3) % 7).cast("int")}))


def test_tied_rungs_equal_the_rungs_row_by_row_and_no_sample_becomes_a_row(spark):
    placed, horizons = placed_slots(spark).cache(), (1, 24, 25, 30)
    got = ladder.tied(placed.withColumn("weight", F.col("slot") % 7.0), horizons=horizons)
    # Horizons fan out inside the call: 48 rows a slot were made twice, sorted and returned.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    rows = ladder.rung_rows(long_rows(placed, horizons)).where("p is not null").collect()
    want = {}
    for r in rows:
        q = min(max(r.p, 1e-6), 1 - 1e-6)
        cell = want.setdefault((r.household_id, r.horizon_h, r.fold, r.rung), {}).setdefault(round(q, 9), [0, 0, 0.0, 0.0, 0.0])
        for i, v in enumerate((1, r.label, abs(r.p - r.y), (r.p - r.y) ** 2, r.p * (r.slot % 7))):
            cell[i] += v
    found = {(r.household_id, r.horizon_h, r.fold, r.rung): {round(t.p, 9): [t.n, t.home, t.off, t.squared, t.total] for t in r.ties}
             for r in got.collect()}
    assert found.keys() == want.keys() and len({k[2] for k in want}) == 2
    for key, cells in want.items():
        assert found[key].keys() == cells.keys(), key
        assert all(math.isclose(a, b, abs_tol=1e-9) for at, c in cells.items() for a, b in zip(found[key][at], c)), key


def test_scores_of_tied_rungs_equal_those_of_rows(spark):
    placed, horizons = placed_slots(spark).cache(), (1, 30)
    keys = ["household_id", "horizon_h", "rung", "fold"]
    rows = ladder.rung_rows(long_rows(placed, horizons)).where("p is not null")
    ties = ladder.tied(placed, horizons=horizons)
    flat = ties.select("rung", F.inline("ties"))
    clipped = clip_p(F.col("p"))
    for a, b in ((e.score(rows, keys), e.score_tied(ties, keys)),
                 (e.score(rows, keys[:2], with_auc=False), e.score_tied(ties, keys[:2], with_auc=False).drop("squared", "total")),
                 (e.auc(rows, ["rung"], F.col("label"), clipped), e.auc(flat, ["rung"], F.col("home"), F.col("p"), n=F.col("n"))),
                 (e.reliability(rows, ["rung"]), e.reliability_tied(flat, ["rung"]))):
        assert a.dtypes == b.dtypes
        a, b = (sorted(x.collect(), key=lambda r: [str(v) for v in r if not isinstance(v, float)]) for x in (a, b))
        assert len(a) == len(b) > 0
        assert all(x == y or math.isclose(x, y, abs_tol=1e-9) for r, s in zip(a, b) for x, y in zip(r, s))


def test_tied_rungs_by_subject(spark):
    placed = placed_slots(spark).cache()
    rows = ladder.rung_rows(long_rows(placed, (1,))).where("rung = 'persistence' and p is not null")
    keys = ["household_id", "horizon_h", "subject"]
    want = {r[:3]: r.s for r in rows.groupBy(*keys).agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("s")).collect()}
    ties = ladder.tied(placed, ["persistence"], (1,), by_subject=True)
    got = {r[:3]: r.squared for r in e.score_tied(ties, keys, with_auc=False).select(*keys, "squared").collect()}
    assert got.keys() == want.keys() and len(want) == 3
    assert all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
