"""Folds, proper scores and their pooling.

A row is trained on by every fold that starts late enough. Rather than copying the
row to each, it is filed under the first such fold, and sums over folds are running
sums of what was filed: rows never fan out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.functions.scores import clip_p, outcome, sign_test
from hearthlog.schema import SLOT_US

DAY_US = 86_400_000_000
HORIZON_EMBARGO_US = SLOT_US

# Fold geometry once the history is long enough.
FULL_TEST_DAYS, FULL_TRAIN_DAYS, FULL_MIN_ROWS = 7, 45, 200


def embargo_us(horizon_h: Column) -> Column:
    """The horizon plus one slot."""
    return horizon_h.cast("long") * 3_600_000_000 + F.lit(HORIZON_EMBARGO_US)


def fold_geometry(origins: DataFrame, keys: Sequence[str] = ("household_id",)) -> DataFrame:
    """Fold widths the history of each key supports."""
    span = (F.col("end_us") - F.col("begin_us")) / float(DAY_US)
    full = span >= FULL_TRAIN_DAYS + FULL_TEST_DAYS
    test = F.when(full, FULL_TEST_DAYS).otherwise(F.greatest(F.lit(2), F.floor(span / 5)))
    train = F.when(full, FULL_TRAIN_DAYS).otherwise(F.greatest(F.lit(5), F.floor(span) - 3 * F.col("test_days")))
    rows = F.when(full, FULL_MIN_ROWS).otherwise(F.greatest(F.lit(1), F.floor(F.col("n_subjects") * 72.0)))
    return (origins.groupBy(*keys)
            .agg(F.min("at_us").alias("begin_us"), F.max("at_us").alias("end_us"),
                 F.count_distinct("subject").alias("n_subjects"))
            .withColumn("test_days", test.cast("long")).withColumn("min_train_days", train.cast("long"))
            .withColumn("min_rows", rows.cast("long")))


def calendar_folds(rows: DataFrame, geometry: DataFrame, embargo: Column,
                   keys: Sequence[str] = ("household_id",)) -> DataFrame:
    """Expanding test windows with enough rows on both sides, numbered from 0.

    `geometry` carries begin, end, widths and the least rows; rows carry `at_us`.
    """
    keys = list(keys)
    first = F.col("begin_us") + F.col("min_train_days") * DAY_US
    step = F.col("test_days") * DAY_US
    n = F.ceil((F.col("end_us") - F.col("_first")) / F.col("_step")).cast("int")
    shape = geometry.withColumn("_first", first).withColumn("_step", step).withColumn("_n", n)
    placed = rows.join(shape.select(*keys, "_first", "_step"), keys)
    div = lambda a: F.floor(a / F.col("_step")).cast("int")
    tested = F.when(F.col("at_us") >= F.col("_first"), div(F.col("at_us") - F.col("_first")))
    ripe = F.col("at_us") + embargo
    trained = F.when(ripe < F.col("_first"), 0).otherwise(div(ripe - F.col("_first")) + 1)
    counts = (placed.select(*keys, F.explode(F.array(
        F.struct(tested.alias("w"), F.lit(1).alias("test"), F.lit(0).alias("train")),
        F.struct(trained.alias("w"), F.lit(0).alias("test"), F.lit(1).alias("train")))).alias("c"))
        .groupBy(*keys, F.col("c.w").alias("w")).agg(F.sum("c.test").alias("n_test"), F.sum("c.train").alias("n_new")))
    windows = shape.where("_n > 0").withColumn("w", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    w = Window.partitionBy(*keys).orderBy("w")
    filled = (windows.join(counts, [*keys, "w"], "left").na.fill(0, ["n_test", "n_new"])
              .withColumn("n_train", F.sum("n_new").over(w)))
    kept = filled.where((F.col("n_test") >= F.col("min_rows")) & (F.col("n_train") >= F.col("min_rows")))
    start = F.col("_first") + F.col("w") * F.col("_step")
    return kept.select(*keys, (F.row_number().over(w) - 1).alias("fold"), start.alias("start_us"),
                       (start + F.col("_step")).alias("stop_us"), "n_train", "n_test")


def fold_lists(folds: DataFrame, keys: Sequence[str] = ("household_id",)) -> DataFrame:
    """The windows of a key as one array, at most one per test width of history."""
    return folds.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct("fold", "start_us", "stop_us"))).alias("folds"))


def with_folds(rows: DataFrame, lists: DataFrame | None, embargo: Column,
               keys: Sequence[str] = ("household_id",)) -> DataFrame:
    """Add the fold a row is tested in and the first fold that may train on it.

    A row is ripe a slot after its target begins, whatever the horizon, so slots can be
    placed before horizons fan out: `test_fold` of the origin goes with `train_from` of
    the target. Without `lists` the rows carry their `folds`.
    """
    at, ripe = F.col("at_us"), F.col("at_us") + embargo
    tested = F.filter("folds", lambda f: (at >= f["start_us"]) & (at < f["stop_us"]))
    trained = F.filter("folds", lambda f: ripe < f["start_us"])
    rows = rows if lists is None else rows.join(lists, list(keys))
    return (rows.withColumn("test_fold", F.get(tested, F.lit(0))["fold"])
            .withColumn("train_from", F.get(trained, F.lit(0))["fold"])
            .withColumn("n_folds", F.size("folds")).drop("folds"))


def expanding(sums: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums filed under `train_from` as sums over everything each fold trains on."""
    spread = (sums.where("train_from is not null")
              .withColumn("fold", F.explode(F.sequence(F.col("train_from"), F.col("n_folds") - 1))))
    return spread.groupBy(*keys, "fold").agg(*[F.sum(v).alias(v) for v in values])


# --- scores -----------------------------------------------------------------------

def auc(rows: DataFrame, keys: Sequence[str], home: Column, p: Column, buckets: int = 1024,
        n: Column | None = None) -> DataFrame:
    """ROC-AUC by the rank identity, ties sharing their average rank.

    With `n`, a row stands for that many rows, `home` of them at home.

    Equal scores are counted together first. Ranks are then taken inside slices of
    the score axis, and slices are put in order by their totals, so that no task
    sorts a whole group.
    """
    keys = list(keys)
    n = F.lit(1) if n is None else n
    known = rows.select(*keys, home.alias("_y"), p.alias("_p"), n.alias("_n")).where("_y is not null and _p is not null")
    return _ranked(known, keys, {}, {}, buckets).select(*keys, "auc")


def _ranked(rows: DataFrame, keys: list[str], tied: dict[str, Column], sums: dict[str, Column],
            buckets: int = 1024) -> DataFrame:
    """Per key `pos`, `neg` and `auc` of `_y` by `_p`, with `sums` over the tied counts."""
    counted = (rows.withColumn("_slice", F.floor(F.col("_p") * buckets)).groupBy(*keys, "_slice", "_p").agg(
        F.sum("_y").alias("pos"), F.sum(F.col("_n") - F.col("_y")).alias("neg"), *[c.alias(k) for k, c in tied.items()]))
    w = (Window.partitionBy(*keys, "_slice").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    below = F.coalesce(F.sum("neg").over(w), F.lit(0.0)) + F.col("neg") / 2
    sliced = counted.withColumn("_won", F.col("pos") * below).groupBy(*keys, "_slice").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("_won").alias("won"),
        *[F.sum(c).alias(k) for k, c in sums.items()])
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("neg").over(w), F.lit(0.0))
    total = sliced.withColumn("won", F.col("won") + F.col("pos") * lower).groupBy(*keys).agg(
        *[F.sum(k).alias(k) for k in ("won", "pos", "neg", *sums)])
    pairs = F.col("pos") * F.col("neg")
    return total.withColumn("auc", F.when(pairs > 0, F.col("won") / pairs)).drop("won")


def score(rows: DataFrame, keys: Sequence[str], frac: str = "y", p: str = "p", with_auc: bool = True) -> DataFrame:
    """Proper scores of `p` against the share of the slot spent home.

    With the AUC every score is summed from its tied counts, so that rows are read once.
    """
    keys = list(keys)
    both = rows.where(F.col(frac).isNotNull() & F.col(p).isNotNull())
    y, q = outcome(F.col(frac)), clip_p(F.col(p))
    if not with_auc:
        return both.groupBy(*keys).agg(
            F.count("*").alias("n"), F.avg(y).alias("base_rate"), F.avg((q - y) * (q - y)).alias("brier"),
            (-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"),
            F.avg(F.abs(F.col(p) - F.col(frac))).alias("mae_frac"))
    pos, neg, at = F.col("pos"), F.col("neg"), F.col("_p")
    sums = {"n": pos + neg, "brier": pos * (at - 1) * (at - 1) + neg * at * at,
            "log_loss": pos * F.log(at) + neg * F.log(1 - at), "mae_frac": F.col("off")}
    out = _ranked(both.select(*keys, y.alias("_y"), q.alias("_p"), F.lit(1).alias("_n"), F.abs(F.col(p) - F.col(frac)).alias("_off")),
                  keys, {"off": F.sum("_off")}, sums)
    n = F.col("n")
    return out.select(*keys, n.cast("long").alias("n"), (F.col("pos") / n).alias("base_rate"),
                      (F.col("brier") / n).alias("brier"), (-F.col("log_loss") / n).alias("log_loss"),
                      (F.col("mae_frac") / n).alias("mae_frac"), "auc")


def tied_sums(ties: str = "ties") -> Column:
    """Sums over an array of tied scores (`p`, lowest first, `n`, `home`, `off`, `squared`, `total`): what
    `score` takes means of, and the pairs that `auc` counts as won."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "home", "brier", "log_loss", "off", "squared", "total", "won")])

    def step(acc: Column, t: Column) -> Column:
        away = t["n"] - t["home"]
        return F.struct(
            (acc["n"] + t["n"]).alias("n"), (acc["home"] + t["home"]).alias("home"),
            (acc["brier"] + t["home"] * (t["p"] - 1) * (t["p"] - 1) + away * t["p"] * t["p"]).alias("brier"),
            (acc["log_loss"] + t["home"] * F.log(t["p"]) + away * F.log(1 - t["p"])).alias("log_loss"),
            (acc["off"] + t["off"]).alias("off"), (acc["squared"] + t["squared"]).alias("squared"),
            (acc["total"] + t["total"]).alias("total"),
            (acc["won"] + t["home"] * (acc["n"] - acc["home"] + away / 2)).alias("won"))

    return F.aggregate(ties, zero, step)


def score_tied(rows: DataFrame, keys: Sequence[str], with_auc: bool = True) -> DataFrame:
    """`score` of tied scores. With the AUC a row holds all there is of its keys; without it
    `squared`, the squared error against the share itself, and `total` are kept."""
    summed = rows.select(*keys, tied_sums().alias("_s")).select(*keys, "_s.*")
    if not with_auc:
        summed = summed.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "home", "brier", "log_loss", "off", "squared", "total")])
    n, pairs = F.col("n"), F.col("home") * (F.col("n") - F.col("home"))
    return summed.select(*keys, n.cast("long").alias("n"), (F.col("home") / n).alias("base_rate"),
                         (F.col("brier") / n).alias("brier"), (-F.col("log_loss") / n).alias("log_loss"),
                         (F.col("off") / n).alias("mae_frac"),
                         *([F.when(pairs > 0, F.col("won") / pairs).alias("auc")] if with_auc else [(F.col("squared") / n).alias("squared"), F.col("total")]))


# The edges an evenly spaced float axis really has.
EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def bin_of(p: str) -> Column:
    at = F.least(F.size(F.filter(F.lit(EDGES), lambda e: e <= F.col(p))) - 1, F.lit(len(EDGES) - 2))
    return F.greatest(at, F.lit(0))


def reliability(rows: DataFrame, keys: Sequence[str] = (), frac: str = "y", p: str = "p") -> DataFrame:
    """Calibration curve over ten bins; an empty bin is left out."""
    both = rows.where(F.col(frac).isNotNull() & F.col(p).isNotNull()).withColumn("bin", bin_of(p))
    return both.groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(outcome(F.col(frac))).alias("observed"))


def reliability_tied(ties: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`reliability` of tied scores, one a row."""
    n = F.sum("n")
    return ties.withColumn("bin", bin_of("p")).groupBy(*keys, "bin").agg(
        n.cast("long").alias("n"), (F.sum("total") / n).alias("predicted"), (F.sum("home") / n).alias("observed"))


SCORES = ("base_rate", "brier", "log_loss", "auc", "mae_frac")


def summarize(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores of folds pooled by their rows; a fold without rows is still listed."""
    def pooled(name):
        known = F.col(name).isNotNull()
        return (F.sum(F.when(known, F.col(name) * F.col("n"))) / F.sum(F.when(known, F.col("n")))).alias(name)

    per_fold = F.sort_array(F.collect_list(F.struct("fold", "n", *SCORES)))
    return scores.groupBy(*keys).agg(
        *[pooled(name) for name in SCORES], F.sum("n").alias("n"), F.count("*").alias("n_folds"),
        F.min("brier").alias("brier_fold_min"), F.max("brier").alias("brier_fold_max"),
        per_fold.alias("per_fold"))


# --- exact quantiles of groups of any size -------------------------------------------

def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles; a group may be of any size.

    Sketched cut points slice each group, counts tell which slice holds a wanted
    rank, and only the neighbours of that rank are taken. The sketch decides how
    even the slices are, never the answer.
    """
    keys = list(keys)
    known = rows.select(*keys, F.col(value).cast("double").alias("_x")).where("_x is not null")
    counted = known.groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    cuts = known.groupBy(*keys).agg(
        F.percentile_approx("_x", [i / 64 for i in range(1, 64)], 10000).alias("_cuts"))
    joined = counted.join(cuts, keys) if keys else counted.withColumn("_cuts", cuts.scalar())
    sliced = joined.withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).drop("_cuts")
    w = Window.partitionBy(*keys, "_slice").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = sliced.withColumn("_upto", F.sum("_n").over(w))
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_rows"))
    order = Window.partitionBy(*keys).orderBy("_slice")
    totals = totals.select(*keys, "_slice",
                           (F.sum("_rows").over(order) - F.col("_rows")).alias("_below"),
                           F.sum("_rows").over(Window.partitionBy(*keys)).alias("_all"))
    ranked = (inside.join(totals, [*keys, "_slice"])
              .withColumn("_last", F.col("_below") + F.col("_upto") - 1)
              .withColumn("_first", F.col("_last") - F.col("_n") + 1))
    aggs = []
    for name, share in shares.items():
        rank = F.lit(share) * (F.col("_all") - 1)
        def holding(at):
            return F.max(F.when((at >= F.col("_first")) & (at <= F.col("_last")), F.col("_x")))
        low, high = holding(F.floor(rank)), holding(F.ceil(rank))
        part = F.max(rank - F.floor(rank))
        aggs.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*keys).agg(F.max("_all").alias("n"), *aggs)


def arm_record(wins: Column, trials: Column) -> dict[str, Column]:
    return {"wins": wins, "trials": trials, "sign_p": sign_test(wins, trials)}
