"""Scoring, folds and the baseline ladder over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlog.functions import scores as sc
from hearthlog.operators import evaluate as e
from hearthlog.operators import features as f
from hearthlog.operators import ladder
from hearthlog.plans import build, oracle
from hearthlog.plans.features import samples
from hearthlog.plans.grid import rnd, rounded
from hearthlog.plans.oracle import ALL_ORIGINS, S, SAMPLES, sql
from hearthlog.schema import SHRINK_GRID

QUERIES, ORACLE = {}, {}
# Samples a task of the ladder sorts, and slots a task of the tied ladder sorts.
TASK_SAMPLES, TASK_SLOTS = 500_000, 60_000


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


FOLDS = f"""
geo AS (SELECT household_id, min(slot) AS b, max(slot) AS e, count(DISTINCT subject) AS n, (max(slot) - min(slot)) / 48.0 AS span
        FROM blank GROUP BY ALL),
shape AS (SELECT *, CASE WHEN span >= 52 THEN 7 ELSE greatest(2, CAST(floor(span / 5) AS INT)) END AS td FROM geo),
shape2 AS (SELECT *, CASE WHEN span >= 52 THEN 45 ELSE greatest(5, CAST(floor(span) AS INT) - 3 * td) END AS tr,
                  CASE WHEN span >= 52 THEN 200 ELSE greatest(1, CAST(floor(1.5 * 48 * n) AS INT)) END AS least_rows FROM shape),
wins AS (SELECT household_id, least_rows, unnest(range(b + tr * 48, e, td * 48)) AS start, td FROM shape2),
counted AS (SELECT w.household_id, w.start, w.start + w.td * 48 AS stop, least_rows,
                   count(*) FILTER (o.slot + 97 < w.start) AS n_train,
                   count(*) FILTER (o.slot >= w.start AND o.slot < w.start + w.td * 48) AS n_test
            FROM wins w JOIN blank o USING (household_id) GROUP BY ALL),
folds AS MATERIALIZED (SELECT household_id, row_number() OVER (PARTITION BY household_id ORDER BY start) - 1 AS fold, start, stop, n_train, n_test
          FROM counted WHERE n_train >= least_rows AND n_test >= least_rows)"""

_W = "(VALUES " + ", ".join(f"({w}::DOUBLE, {i})" for i, w in enumerate(SHRINK_GRID)) + ") g(w, place)"

RUNGS_SQL = f"""
use AS MATERIALIZED (SELECT *, CAST(y >= 0.5 AS DOUBLE) AS label FROM smp WHERE (y + state_now + coverage) > -1),
tr AS MATERIALIZED (SELECT u.*, f.fold FROM use u JOIN folds f ON f.household_id = u.household_id AND u.slot + 2 * u.horizon_h + 1 < f.start),
te AS MATERIALIZED (SELECT u.*, f.fold FROM use u JOIN folds f ON f.household_id = u.household_id AND u.slot >= f.start AND u.slot < f.stop),
base AS (SELECT household_id, horizon_h, fold, avg(label) AS base, count(*) AS n_train FROM tr GROUP BY ALL),
loss AS (SELECT t.household_id, t.horizon_h, t.fold, w, place,
                round(avg(pow(w * state_now + (1 - w) * base - label, 2)), 12) AS ls,
                round(avg(pow(w * near_lag + (1 - w) * base - label, 2)), 12) AS ll
         FROM tr t JOIN base USING (household_id, horizon_h, fold) CROSS JOIN {_W} GROUP BY ALL),
wt AS (SELECT household_id, horizon_h, fold, arg_min(w, ls * 1e6 + place * 1e-9) FILTER (ls IS NOT NULL) AS w_state,
              coalesce(arg_min(w, ll * 1e6 + place * 1e-9) FILTER (ll IS NOT NULL), 1.0) AS w_lag FROM loss GROUP BY ALL),
c1 AS (SELECT household_id, horizon_h, fold, sod, avg(label) AS r FROM tr GROUP BY ALL),
c2 AS (SELECT household_id, horizon_h, fold, dow, sod, avg(label) AS r FROM tr GROUP BY ALL),
c3 AS (SELECT household_id, horizon_h, fold, subject, dow, sod, avg(label) AS r FROM tr GROUP BY ALL),
preds AS MATERIALIZED (
  SELECT t.household_id, t.horizon_h, t.fold, t.subject, t.slot, t.y, t.label, base AS p1,
         least(greatest(w_state * state_now + (1 - w_state) * base, 0), 1) AS p2,
         CASE WHEN near_lag IS NOT NULL THEN least(greatest(w_lag * near_lag + (1 - w_lag) * base, 0), 1) END AS p3,
         coalesce(c1.r, base) AS p4, coalesce(c2.r, base) AS p5, coalesce(c3.r, base) AS p6
  FROM te t JOIN base USING (household_id, horizon_h, fold) JOIN wt USING (household_id, horizon_h, fold)
  LEFT JOIN c1 ON c1.household_id = t.household_id AND c1.horizon_h = t.horizon_h AND c1.fold = t.fold AND c1.sod = t.sod
  LEFT JOIN c2 ON c2.household_id = t.household_id AND c2.horizon_h = t.horizon_h AND c2.fold = t.fold AND c2.sod = t.sod AND c2.dow = t.dow
  LEFT JOIN c3 ON c3.household_id = t.household_id AND c3.horizon_h = t.horizon_h AND c3.fold = t.fold AND c3.sod = t.sod AND c3.dow = t.dow AND c3.subject = t.subject)"""

LADDER = SAMPLES + [FOLDS, RUNGS_SQL]
RUNG_COLUMN = dict(zip(ladder.RUNGS, ("p1", "p2", "p3", "p4", "p5", "p6")))

LONG = """
rungs AS (""" + " UNION ALL ".join(
    f"SELECT household_id, horizon_h, fold, y, label, '{r}' AS rung, {c} AS p, least(greatest({c}, 1e-6), 1 - 1e-6) AS q FROM preds WHERE {c} IS NOT NULL"
    for r, c in RUNG_COLUMN.items()) + """),
ranked AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY household_id, horizon_h, fold, rung, q) - 1) / 2.0 AS rk
           FROM rungs WINDOW w AS (PARTITION BY household_id, horizon_h, fold, rung ORDER BY q)),
fold_scores AS (
  SELECT household_id, horizon_h, rung, fold, count(*) AS n, avg(label) AS base_rate, avg(pow(q - label, 2)) AS brier,
         -avg(label * ln(q) + (1 - label) * ln(1 - q)) AS log_loss, avg(abs(p - y)) AS mae_frac,
         CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN
           (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) END AS auc
  FROM ranked GROUP BY ALL)"""


def rows(spark, sf_dir, horizons=None):
    """Labelled samples of every horizon, or of those asked for, with the folds of their
    household, as a written table: models read it once per pass."""
    name = "-".join(map(str, ("samples", *(horizons or ()))))
    return build.table(spark, sf_dir, name, lambda: ladder_rows(spark, sf_dir, horizons))


def known_slots(spark, sf_dir):
    return build.table(spark, sf_dir, "slots", lambda: build.slots(build.events(spark, sf_dir), f.AHEAD_SLOTS).select(
        "household_id", "subject", "slot", "home_frac", "coverage", "in_grid"))


def scores(spark, sf_dir):
    """Fold scores of the six rungs."""
    return build.table(spark, sf_dir, "scores", lambda: ladder.tied_scores(placed_slots(spark, sf_dir)))


def tied(spark, sf_dir, *rungs, weight="1", by_subject=False):
    """Predictions of `rungs`, counted where they are equal."""
    slots = placed_slots(spark, sf_dir).withColumn("weight", F.expr(weight).cast("double"))
    return ladder.tied(slots, rungs, by_subject=by_subject)


def placed_slots(spark, sf_dir, task_slots=TASK_SLOTS):
    """Slots with the fold that tests them and the first that may train on them, lying by
    household. Tasks grow in number with them."""
    slots = known_slots(spark, sf_dir)
    origins = slots.where("in_grid").select("household_id", "subject", (F.col("slot") * S).alias("at_us"))
    cut = e.calendar_folds(origins, e.fold_geometry(origins), F.lit(97 * S))
    tasks = 1 + slots.count() // task_slots
    placed = e.with_folds(slots.withColumn("at_us", F.col("slot") * S), e.fold_lists(cut), F.lit(e.HORIZON_EMBARGO_US))
    return placed.repartition(tasks, "household_id")


def ladder_rows(spark, sf_dir, horizons=None):
    """The same rows, not written: made again from slots that lie by household, they
    feed every sum of the ladder without being moved. Tasks grow in number with the samples."""
    horizons = horizons or oracle.HORIZONS
    placed = placed_slots(spark, sf_dir, min(TASK_SLOTS, TASK_SAMPLES // len(horizons)))
    long = f.usable_rows(f.samples(placed, horizons, origin=("at_us", "test_fold", "n_folds"),
                                   target=("train_from",), facts=("lag1d", "lag2d")))
    target = F.col("target_slot")
    return ladder.labelled(long.select(
        "household_id", "subject", "slot", "horizon_h", "target_slot", "y", "state_now", "near_lag",
        (target % 48).cast("int").alias("sod"),
        ((F.call_function("div", target, F.lit(48)) + 3) % 7).cast("int").alias("dow"),
        "at_us", "test_fold", "train_from", "n_folds"))


def folds(ev):
    origins = build.slots(ev).select("household_id", "subject", (F.col("slot") * S).alias("at_us"))
    return e.calendar_folds(origins, e.fold_geometry(origins), F.lit(97 * S))


@query("e4_fold_geometry", sql(ALL_ORIGINS + [FOLDS], """
SELECT household_id, td AS test_days, tr AS min_train_days, least_rows AS min_rows FROM shape2"""))
def e4_fold_geometry(spark, sf_dir):
    origins = build.slots(build.events(spark, sf_dir)).select("household_id", "subject", (F.col("slot") * S).alias("at_us"))
    return e.fold_geometry(origins).select("household_id", "test_days", "min_train_days", "min_rows")


@query("e5_calendar_folds", sql(ALL_ORIGINS + [FOLDS], f"""
SELECT household_id, fold, start * {S} AS start_us, stop * {S} AS stop_us, n_train, n_test FROM folds"""))
def e5_calendar_folds(spark, sf_dir):
    return folds(build.events(spark, sf_dir))


QUERIES["e10_shared_windows"], ORACLE["e10_shared_windows"] = QUERIES["e5_calendar_folds"], ORACLE["e5_calendar_folds"]


@query("e6_embargo", sql(SAMPLES + [FOLDS, RUNGS_SQL], """
SELECT household_id, horizon_h, fold, count(*) AS n_train, max(t) AS last_target_slot FROM tr GROUP BY ALL"""))
def e6_embargo(spark, sf_dir):
    r = ladder_rows(spark, sf_dir)
    filed = r.groupBy("household_id", "horizon_h", "train_from", "n_folds").agg(
        F.count("*").alias("n"), F.max("target_slot").alias("last"))
    spread = filed.where("train_from is not null").withColumn(
        "fold", F.explode(F.sequence(F.col("train_from"), F.col("n_folds") - 1)))
    return spread.groupBy("household_id", "horizon_h", "fold").agg(
        F.sum("n").alias("n_train"), F.max("last").alias("last_target_slot"))


def _rung(key, rung):
    @query(key, sql(LADDER, f"""
SELECT household_id, horizon_h, fold, count(*) AS n, round(avg(pow(least(greatest({RUNG_COLUMN[rung]}, 1e-6), 1 - 1e-6) - label, 2)), 6) AS brier,
       round(sum({RUNG_COLUMN[rung]} * (slot % 1009)), 3) AS dot_p FROM preds WHERE {RUNG_COLUMN[rung]} IS NOT NULL GROUP BY ALL"""))
    def run(spark, sf_dir):
        out = e.score_tied(tied(spark, sf_dir, rung, weight="slot % 1009"),
                           ["household_id", "horizon_h", "fold"], with_auc=False)
        return out.select("household_id", "horizon_h", "fold", "n", rnd(F.col("brier")).alias("brier"),
                          rnd(F.col("total"), 3).alias("dot_p"))


_rung("b1_base_rate", "base_rate")
_rung("b2_persistence", "persistence")
_rung("b3_same_slot_yesterday", "same_slot_yesterday")
_rung("b4_slot_climatology", "slot_climatology")
_rung("b5_weekday_slot_climatology", "weekday_slot_climatology")
_rung("b6_subject_climatology", "weekday_slot_subject_climatology")
_rung("b8_shrink", "persistence")
_rung("j10_climatology_lookup", "weekday_slot_climatology")


@query("b7_fit_shrink", sql(LADDER, """
SELECT household_id, horizon_h, fold, round(base, 6) AS base, CAST(w_state AS DOUBLE) AS w_state, CAST(w_lag AS DOUBLE) AS w_lag, n_train
FROM wt JOIN base USING (household_id, horizon_h, fold)"""))
def b7_fit_shrink(spark, sf_dir):
    return rounded(ladder.fitted(placed_slots(spark, sf_dir), oracle.HORIZONS), "base").withColumn("n_train", F.col("n_train").cast("long"))


@query("b9_target_calendar", sql(SAMPLES, "SELECT horizon_h, dow, sod, count(*) AS n, count(DISTINCT t) AS slots FROM smp GROUP BY ALL"))
def b9_target_calendar(spark, sf_dir):
    t = f.with_target_calendar(samples(build.events(spark, sf_dir)))
    return t.groupBy("horizon_h", F.col("tgt_dow").cast("long").alias("dow"), F.col("tgt_slot_of_day").cast("long").alias("sod")).agg(
        F.count("*").alias("n"), F.count_distinct("target_slot").alias("slots"))


SCORE_COLS = ["base_rate", "brier", "log_loss", "auc", "mae_frac"]


@query("b10_ladder", sql(LADDER + [LONG], "SELECT household_id, horizon_h, rung, fold, n, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in SCORE_COLS) + " FROM fold_scores"))
def b10_ladder(spark, sf_dir):
    return rounded(ladder.tied_scores(placed_slots(spark, sf_dir)), *SCORE_COLS)


@query("e8_summarize", sql(LADDER + [LONG], "SELECT household_id, horizon_h, rung, " + ", ".join(
    f"round(sum({c} * n) FILTER ({c} IS NOT NULL) / sum(n) FILTER ({c} IS NOT NULL), 6) AS {c}" for c in SCORE_COLS) + """,
  CAST(sum(n) AS BIGINT) AS n, count(*) AS n_folds, round(min(brier), 6) AS brier_fold_min, round(max(brier), 6) AS brier_fold_max
FROM fold_scores GROUP BY ALL"""))
def e8_summarize(spark, sf_dir):
    out = e.summarize(scores(spark, sf_dir), ["household_id", "horizon_h", "rung"]).drop("per_fold")
    return rounded(out, *SCORE_COLS, "brier_fold_min", "brier_fold_max")


@query("e9_skill", sql(LADDER, """
SELECT household_id, horizon_h, round(100 * (1 - b2 / b1), 6) AS skill_pct FROM (
  SELECT household_id, horizon_h, avg(pow(least(greatest(p2, 1e-6), 1 - 1e-6) - label, 2)) AS b2,
         avg(pow(least(greatest(p1, 1e-6), 1 - 1e-6) - label, 2)) AS b1 FROM preds GROUP BY ALL) WHERE b1 > 0"""))
def e9_skill(spark, sf_dir):
    scored = e.score_tied(tied(spark, sf_dir, "persistence", "base_rate"), ["household_id", "horizon_h", "rung"], with_auc=False)
    of = lambda rung: F.max(F.when(F.col("rung") == rung, F.col("brier")))
    out = scored.groupBy("household_id", "horizon_h").agg(of("persistence").alias("b2"), of("base_rate").alias("b1"))
    return out.select("household_id", "horizon_h", rnd(sc.skill_pct(F.col("b2"), F.col("b1"))).alias("skill_pct"))


PERSIST = """
ps AS (SELECT household_id, horizon_h, y, label, p2 AS p, least(greatest(p2, 1e-6), 1 - 1e-6) AS q FROM preds)"""


def persistence(spark, sf_dir):
    return tied(spark, sf_dir, "persistence")


@query("e1_score", sql(LADDER + [PERSIST], """
SELECT household_id, horizon_h, count(*) AS n, round(avg(label), 6) AS base_rate, round(avg(pow(q - label, 2)), 6) AS brier,
       round(-avg(label * ln(q) + (1 - label) * ln(1 - q)), 6) AS log_loss, round(avg(abs(p - y)), 6) AS mae_frac FROM ps GROUP BY ALL"""))
def e1_score(spark, sf_dir):
    out = e.score_tied(persistence(spark, sf_dir), ["household_id", "horizon_h"], with_auc=False).drop("squared", "total")
    return rounded(out, "base_rate", "brier", "log_loss", "mae_frac")


@query("e2_auc", sql(LADDER + [PERSIST, """
rk AS (SELECT *, rank() OVER (PARTITION BY horizon_h ORDER BY q) + (count(*) OVER (PARTITION BY horizon_h, q) - 1) / 2.0 AS rk FROM ps)"""], """
SELECT horizon_h, round((sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) AS auc
FROM rk GROUP BY ALL"""))
def e2_auc(spark, sf_dir):
    ps = persistence(spark, sf_dir).select("horizon_h", F.inline("ties"))
    return rounded(e.auc(ps, ["horizon_h"], F.col("home"), F.col("p"), n=F.col("n")), "auc")


@query("e3_reliability", sql(LADDER + [PERSIST], f"""
SELECT horizon_h, least(len(list_filter({e.EDGES}::DOUBLE[], lambda x: x <= p)) - 1, 9) AS bin, count(*) AS n,
       round(avg(p), 6) AS predicted, round(avg(label), 6) AS observed FROM ps GROUP BY ALL"""))
def e3_reliability(spark, sf_dir):
    out = e.reliability_tied(persistence(spark, sf_dir).select("horizon_h", F.inline("ties")), ["horizon_h"])
    return rounded(out, "predicted", "observed")


SIGN = "least(1.0, 2 * list_sum(list_transform(range({w}, {n} + 1), lambda k: exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1)) * pow(0.5, {n}))))"


@query("e7_sign_test", f"""
WITH c AS (SELECT user_id, count(*) % 37 AS n, count(*) FILTER (value > 50) AS x FROM events GROUP BY ALL),
d AS (SELECT user_id, n, least(x % 37, n) AS w FROM c)
SELECT user_id, n AS trials, w AS wins, CASE WHEN n > 0 THEN round(1e-9 + {SIGN.format(w='w', n='n')}, 6) END AS sign_p FROM d""")
def e7_sign_test(spark, sf_dir):
    raw = build.events(spark, sf_dir).groupBy("user_id").agg(
        (F.count("*") % 37).alias("trials"), F.count_if(F.col("reading") > 50).alias("x"))
    raw = raw.withColumn("wins", F.least(F.col("x") % 37, F.col("trials"))).drop("x")
    return raw.withColumn("sign_p", rnd(sc.sign_test(F.col("wins"), F.col("trials"))))


@query("e11_fold_record", f"""
WITH c AS (SELECT user_id, count(*) % 37 AS n, count(*) FILTER (value > 50) AS x FROM events GROUP BY ALL),
d AS (SELECT user_id, n, least(x % 37, n) AS w FROM c)
SELECT user_id, n AS folds, w AS beat, CASE WHEN n = 0 THEN false ELSE NOT (w * 2 < n AND {SIGN.format(w='n - w', n='n')} < 0.05) END AS allowed,
       CAST(CASE WHEN n <= 4 THEN 15 ELSE 5 END AS DOUBLE) AS skill_bar FROM d""")
def e11_fold_record(spark, sf_dir):
    raw = build.events(spark, sf_dir).groupBy("user_id").agg(
        (F.count("*") % 37).alias("folds"), F.count_if(F.col("reading") > 50).alias("x"))
    raw = raw.withColumn("beat", F.least(F.col("x") % 37, F.col("folds"))).drop("x")
    return (raw.withColumn("allowed", sc.fold_record_allows(F.col("beat"), F.col("folds")))
            .withColumn("skill_bar", sc.min_ship_skill_pct(F.col("folds"))))


QUERIES["e12_skill_bar"], ORACLE["e12_skill_bar"] = QUERIES["e11_fold_record"], ORACLE["e11_fold_record"]


@query("e15_summary", sql(ALL_ORIGINS, """
SELECT household_id, subject, count(*) AS n, count(*) - count(home_frac) AS nulls, round(min(home_frac), 6) AS low, round(max(home_frac), 6) AS high,
       round(avg(home_frac), 6) AS mean, round(arg_max(home_frac, slot) FILTER (home_frac IS NOT NULL), 6) AS last FROM blank GROUP BY ALL"""))
def e15_summary(spark, sf_dir):
    from hearthlog.operators import explore
    out = explore.summary(build.slots(build.events(spark, sf_dir)), ["household_id", "subject"], "home_frac", "slot")
    return rounded(out, "low", "high", "mean", "last")


@query("e13_candidate_verdict", sql(LADDER + [LONG, """
pool AS (SELECT household_id, horizon_h, rung, sum(brier * n) / sum(n) AS brier FROM fold_scores GROUP BY ALL),
best AS (SELECT household_id, horizon_h, arg_min(rung, round(brier, 12) * 1e6 + ascii(substr(rung, 1, 1)) * 0) AS rung0,
                min(brier) AS best_brier FROM pool WHERE rung <> 'persistence' GROUP BY ALL),
b AS (SELECT p.household_id, p.horizon_h, min(p.rung) AS best_rung, best_brier FROM pool p JOIN best USING (household_id, horizon_h)
      WHERE p.rung <> 'persistence' AND round(p.brier, 12) = round(best_brier, 12) GROUP BY ALL),
won AS (SELECT m.household_id, m.horizon_h, count(*) AS trials, count(*) FILTER (m.brier < o.brier - 1e-12) AS beat
        FROM fold_scores m JOIN b USING (household_id, horizon_h)
        LEFT JOIN fold_scores o ON o.household_id = m.household_id AND o.horizon_h = m.horizon_h AND o.fold = m.fold AND o.rung = b.best_rung
        WHERE m.rung = 'persistence' GROUP BY ALL)"""], f"""
SELECT p.household_id, p.horizon_h, best_rung, trials, beat, round(p.brier, 6) AS brier, round(best_brier, 6) AS best_brier,
       (p.brier < best_brier AND NOT (beat * 2 < trials AND {SIGN.format(w='trials - beat', n='trials')} < 0.05)
        AND 100 * (1 - p.brier / best_brier) >= CASE WHEN trials <= 4 THEN 15 ELSE 5 END) AS ships
FROM pool p JOIN b USING (household_id, horizon_h) JOIN won USING (household_id, horizon_h) WHERE p.rung = 'persistence'"""))
def e13_candidate_verdict(spark, sf_dir):
    """Persistence stands as the candidate; the other five rungs are the bar."""
    from hearthlog.operators import gate
    scored = scores(spark, sf_dir)
    mine = scored.where("rung = 'persistence'").drop("rung").withColumn("kind", F.lit("persistence"))
    out = gate.verdicts(mine, scored.where("rung <> 'persistence'"))
    return rounded(out, "brier", "best_brier").select(
        "household_id", "horizon_h", "best_rung", "trials", "beat", "brier", "best_brier", "ships")


@query("e14_choose", sql(LADDER + [LONG, """
pool AS (SELECT household_id, horizon_h, rung, sum(brier * n) / sum(n) AS brier FROM fold_scores GROUP BY ALL),
v AS (SELECT c.household_id, c.horizon_h, c.rung, c.brier, c.brier < b.brier AS ships FROM pool c
      JOIN pool b ON b.household_id = c.household_id AND b.horizon_h = c.horizon_h AND b.rung = 'base_rate'
      WHERE c.rung IN ('persistence', 'same_slot_yesterday')),
r AS (SELECT *, row_number() OVER (PARTITION BY household_id, horizon_h ORDER BY ships DESC, round(brier, 12), rung) AS place FROM v)"""], """
SELECT a.household_id, a.horizon_h, CASE WHEN a.ships THEN a.rung END AS kind, round(a.brier, 6) AS brier, a.ships,
       CASE WHEN a.ships THEN b.rung END AS rival_kind, CASE WHEN a.ships THEN round(b.brier, 6) END AS rival_brier
FROM r a LEFT JOIN r b ON b.household_id = a.household_id AND b.horizon_h = a.horizon_h AND b.place = 2 WHERE a.place = 1"""))
def e14_choose(spark, sf_dir):
    from hearthlog.operators import gate
    pooled = e.summarize(scores(spark, sf_dir), ["household_id", "horizon_h", "rung"])
    bar = F.max(F.when(F.col("rung") == "base_rate", F.col("brier"))).over(
        gate.Window.partitionBy("household_id", "horizon_h"))
    runners = (pooled.withColumn("bar", bar).where("rung in ('persistence', 'same_slot_yesterday')")
               .select("household_id", "horizon_h", F.col("rung").alias("kind"), "brier",
                       (F.col("brier") < F.col("bar")).alias("ships")))
    return rounded(gate.choose(runners), "brier", "rival_brier")
