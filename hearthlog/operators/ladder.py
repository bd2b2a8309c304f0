"""The ladder of baselines every model has to climb."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hearthlog.functions.scores import EPS, outcome, shrink
from hearthlog.operators.evaluate import expanding, score, score_tied, with_folds, embargo_us
from hearthlog.operators.features import lag_is_legal, target_slots
from hearthlog.schema import HOME_THRESHOLD, HORIZONS_H, SHRINK_GRID, SLOTS_PER_DAY, SLOTS_PER_HOUR

RUNGS = ("base_rate", "persistence", "same_slot_yesterday", "slot_climatology",
         "weekday_slot_climatology", "weekday_slot_subject_climatology")
GROUP = ("household_id", "horizon_h")


def moments(raw: Column, y: Column, prefix: str) -> dict[str, Column]:
    """Sums a shrink weight is fitted from, over rows whose observation is known."""
    known = raw.isNotNull()
    named = {"n": F.lit(1.0), "r": raw, "rr": raw * raw, "ry": raw * y, "y": y}
    return {f"{prefix}_{k}": F.sum(F.when(known, v)) for k, v in named.items()}


def best_weight(prefix: str, base: Column) -> Column:
    """The weight with the least squared error; the largest one on a tie."""
    m = {k: F.coalesce(F.col(f"{prefix}_{k}"), F.lit(0.0)) for k in ("n", "r", "rr", "ry", "y")}

    def loss(w: float) -> Column:
        pull = (1 - w) * base
        total = (w * w * m["rr"] + pull * pull * m["n"] + m["y"] + 2 * w * pull * m["r"]
                 - 2 * w * m["ry"] - 2 * pull * m["y"])
        return F.round(total / m["n"], 12)

    options = [F.struct(loss(w).alias("loss"), F.lit(i).alias("place"), F.lit(w).alias("weight"))
               for i, w in enumerate(SHRINK_GRID)]
    return F.when(m["n"] > 0, F.array_min(F.array(*options))["weight"]).otherwise(F.lit(1.0))


def labelled(samples: DataFrame, fold_lists: DataFrame | None = None) -> DataFrame:
    """Usable rows with their folds; they carry `dow` and `sod` of the target, and where
    no lists are given their `folds`, or what `with_folds` made of them."""
    rows = samples.withColumn("label", outcome(F.col("y")))
    return rows if "test_fold" in rows.columns else with_folds(rows, fold_lists, embargo_us(F.col("horizon_h")))


def weights(rows: DataFrame) -> DataFrame:
    """Per fold: the base rate and how far each single observation is trusted."""
    y = F.col("label")
    named = {"n": F.count("*").cast("double"), "y": F.sum(y), **moments(F.col("state_now"), y, "s"),
             **moments(F.col("near_lag"), y, "l")}
    filed = rows.groupBy(*GROUP, "train_from", "n_folds").agg(*[c.alias(k) for k, c in named.items()])
    sums = expanding(filed, GROUP, list(named))
    base = F.col("y") / F.col("n")
    return (sums.withColumn("base", base)
            .withColumn("w_state", best_weight("s", F.col("base")))
            .withColumn("w_lag", best_weight("l", F.col("base")))
            .select(*GROUP, "fold", "base", "w_state", "w_lag", F.col("n").alias("n_train")))


def columns_of(rows: pa.Table, names: Sequence[str]) -> dict[str, np.ndarray]:
    """Columns as arrays: subjects numbered, folds -1 where there is none."""
    subject = pc.dictionary_encode(rows["subject"].combine_chunks()).indices.to_numpy()
    return {"subject": subject, **{c: rows[c].to_numpy() for c in names},
            **{c: rows[c].fill_null(-1).to_numpy() for c in ("train_from", "test_fold")}}


def cell_rates(column: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The rates of the three climatologies for each tested row of one horizon of a
    household, NaN where its fold trained on nothing in the cell.

    Counts are summed once at the finest key, over the folds one after another, and
    rolled up from there.
    """
    subject, first, tested = (column[c] for c in ("subject", "train_from", "test_fold"))
    shape = (int(column["n_folds"].max()), int(subject.max()) + 1, int(column["dow"].max()) + 1, int(column["sod"].max()) + 1)
    place = np.ravel_multi_index((np.maximum(first, 0), subject, column["dow"], column["sod"]), shape)
    at, label = place[first >= 0], column["label"][first >= 0]
    n, y = (np.bincount(at, w, math.prod(shape)).reshape(shape).cumsum(0) for w in (None, label))
    asked, out = tested >= 0, {}
    for name, over, by in (("r_slot", (1, 2), ()), ("r_dow", (1,), (column["dow"],)), ("r_subject", (), (subject, column["dow"]))):
        key = tuple(k[asked] for k in (tested, *by, column["sod"]))
        total = n.sum(over)[key]
        out[name] = np.where(total > 0, y.sum(over)[key] / np.maximum(total, 1), np.nan)
    return out


READ = [*GROUP, "subject", "slot", "y", "label", "state_now", "near_lag", "dow", "sod", "train_from", "n_folds"]
FITTED = ["base", "w_state", "w_lag"]
RATES = ["r_slot", "r_dow", "r_subject"]


def with_rates(rows: pa.Table, fitted: pa.Table) -> pa.Table:
    """The tested rows of one horizon of a household, with their rates and what their
    fold fitted."""
    tested = rows.filter(pc.is_valid(rows["test_fold"]))
    found = {k: pa.array(v, mask=np.isnan(v)) for k, v in cell_rates(
        columns_of(rows, ["sod", "dow", "label", "n_folds"])).items()}
    at = pc.index_in(tested["test_fold"], fitted["fold"].combine_chunks())
    found |= {k: fitted[k].combine_chunks().take(at.combine_chunks()) for k in FITTED}
    for name, value in found.items():
        tested = tested.append_column(name, value)
    return tested


def predictions(rows: DataFrame) -> DataFrame:
    """The six rungs as probabilities of every tested row.

    All that a climatology counts lies in one horizon of one household, so those rows
    are dealt and sorted once and meet their weights there: no cell becomes a row.
    """
    used = rows.where("test_fold is not null or train_from is not null").select(*READ, "test_fold")
    schema = StructType([*used.schema.fields, *(StructField(c, DoubleType()) for c in (*RATES, *FITTED))])
    keys = [f"_{c}" for c in GROUP]
    fitted = weights(rows).select(*[F.col(c).alias(k) for c, k in zip(GROUP, keys)], "fold", *FITTED)
    out = (used.groupBy(*GROUP).cogroup(fitted.groupBy(*keys)).applyInArrow(with_rates, schema).withColumnRenamed("test_fold", "fold"))
    base = F.col("base")
    return (out.withColumn("p_base_rate", base)
            .withColumn("p_persistence", shrink(F.col("state_now"), F.col("w_state"), base))
            .withColumn("p_same_slot_yesterday", shrink(F.col("near_lag"), F.col("w_lag"), base))
            .withColumn("p_slot_climatology", F.coalesce("r_slot", base))
            .withColumn("p_weekday_slot_climatology", F.coalesce("r_dow", base))
            .withColumn("p_weekday_slot_subject_climatology", F.coalesce("r_subject", base)))


def rung_rows(rows: DataFrame) -> DataFrame:
    """Long form: one row per tested row and rung."""
    rungs = F.array(*[F.struct(F.lit(r).alias("rung"), F.col(f"p_{r}").alias("p")) for r in RUNGS])
    keep = [*GROUP, "subject", "slot", "fold", "y", "label"]
    return predictions(rows).select(*keep, F.explode(rungs).alias("_r")).select(*keep, "_r.*")


def rung_scores(rows: DataFrame) -> DataFrame:
    return score(rung_rows(rows), [*GROUP, "rung", "fold"])


# --- all rungs of a household, counted where they are equal ----------------------------

PLACED = ["household_id", "subject", "slot", "in_grid", "home_frac", "coverage", "lag1d", "lag2d",
          "test_fold", "train_from", "n_folds", "weight"]
TIE = ("p", "n", "home", "off", "squared", "total")
TIED = ("household_id long, horizon_h int, fold int, subject string, rung string, "
        f"ties array<struct<{', '.join(f'{c}: double' for c in TIE)}>>")


def horizon_samples(slots: dict[str, np.ndarray], horizons: Sequence[int]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Each horizon's usable samples that a fold trains on or tests, out of the slots of a
    household: the rows of `features.samples` and `usable_rows`, one horizon at a time."""
    at = slots["slot"] - slots["slot"].min()
    width = int(at.max()) + 1
    place = slots["subject"] * width + at
    row_at = np.full((int(slots["subject"].max()) + 1) * width, -1)
    row_at[place] = np.arange(len(place))
    home = slots["home_frac"]
    usable = np.flatnonzero(slots["in_grid"] & ~np.isnan(home) & ~np.isnan(slots["coverage"]))
    for horizon in horizons:
        ahead = SLOTS_PER_HOUR * horizon
        origin = usable[at[usable] + ahead < width]
        target = row_at[place[origin] + ahead]
        kept = (target >= 0) & ~np.isnan(home[target])
        kept &= (slots["test_fold"][origin] >= 0) | (slots["train_from"][target] >= 0)
        origin, target = origin[kept], target[kept]
        if not len(origin):
            continue
        y, seen = home[target], slots["slot"][target]
        yield horizon, {
            "subject": slots["subject"][origin], "y": y, "label": (y >= HOME_THRESHOLD).astype(float),
            "state_now": home[origin], "near_lag": slots["lag1d" if lag_is_legal(1, horizon) else "lag2d"][target],
            "dow": (seen // SLOTS_PER_DAY + 3) % 7, "sod": seen % SLOTS_PER_DAY, "train_from": slots["train_from"][target],
            "test_fold": slots["test_fold"][origin], "n_folds": slots["n_folds"][origin], "weight": slots["weight"][origin]}


def fold_weights(rows: dict[str, np.ndarray], folds: int) -> dict[str, np.ndarray]:
    """What `weights` fits, for one horizon of a household: NaN where a fold trains on nothing."""
    first, label = rows["train_from"], rows["label"]

    def sums(of: np.ndarray, *values: np.ndarray | None) -> list[np.ndarray]:
        return [np.bincount(first[of], None if v is None else v[of], folds).cumsum() for v in values]

    n, y = sums(first >= 0, None, label)
    base = np.where(n > 0, y / np.maximum(n, 1), np.nan)
    out = {"base": base, "n_train": n}
    w = np.array(SHRINK_GRID)[:, None]
    pull = (1 - w) * base
    for name, raw in (("w_state", rows["state_now"]), ("w_lag", rows["near_lag"])):
        n, r, rr, ry, y = sums((first >= 0) & ~np.isnan(raw), None, raw, raw * raw, raw * label, label)
        loss = (w * w * rr + pull * pull * n + y + 2 * w * pull * r - 2 * w * ry - 2 * pull * y) / np.maximum(n, 1)
        out[name] = np.where(n > 0, w[np.round(loss, 12).argmin(0), 0], 1.0)
    return out


def rung_values(rows: dict[str, np.ndarray], folds: int, rungs: Sequence[str]) -> Iterator[tuple[str, np.ndarray]]:
    """The rungs as probabilities of the tested rows of one horizon of a household, NaN
    where one has none."""
    asked = rows["test_fold"] >= 0
    fit = {k: v[rows["test_fold"][asked]] for k, v in fold_weights(rows, folds).items()}
    rates = cell_rates(rows) if any(r.endswith("climatology") for r in rungs) else {}
    base = fit["base"]
    pulled = lambda raw, w: np.clip(w * raw[asked] + (1 - w) * base, 0, 1)
    for rung in rungs:
        if rung == "base_rate":
            yield rung, base
        elif rung == "persistence":
            yield rung, pulled(rows["state_now"], fit["w_state"])
        elif rung == "same_slot_yesterday":
            yield rung, pulled(rows["near_lag"], fit["w_lag"])
        else:
            rate = rates[dict(zip(RUNGS[3:], RATES))[rung]]
            yield rung, np.where(np.isnan(rate), base, rate)


NUMBERS = ["slot", "in_grid", "home_frac", "coverage", "lag1d", "lag2d", "n_folds", "weight"]


def by_household(slots: DataFrame) -> DataFrame:
    """What a call reads of the slots of a household: those of `features.samples` with their folds."""
    if "weight" not in slots.columns:
        slots = slots.withColumn("weight", F.lit(1.0))
    return target_slots(slots).select(*PLACED)


def fitted(slots: DataFrame, horizons: Sequence[int] = HORIZONS_H) -> DataFrame:
    """`weights` of the samples of `slots`, which fan out inside one call per household."""
    names = ["base", "w_state", "w_lag", "n_train"]

    def called(key: tuple, table: pa.Table) -> pa.Table:
        given, found = columns_of(table, NUMBERS), []
        folds = int(given["n_folds"].max())
        for horizon, rows in horizon_samples(given, horizons):
            fit = fold_weights(rows, folds)
            fold = np.flatnonzero(fit["n_train"] > 0)
            found.append([np.full(len(fold), horizon), fold, *(fit[c][fold] for c in names)])
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * len(out.names[1:])
        return pa.table([pa.array([key[0].as_py()] * len(columns[0]), "int64"), *(pa.array(c).cast(t) for c, t in zip(columns, out.types[1:]))], schema=out)

    out = pa.schema([("household_id", pa.int64()), ("horizon_h", pa.int32()), ("fold", pa.int32()), *((c, pa.float64()) for c in names)])
    return by_household(slots).groupBy("household_id").applyInArrow(
        called, f"household_id long, horizon_h int, fold int, {', '.join(f'{c} double' for c in names)}")


def by_stratum(slots: DataFrame, steep: DataFrame, rungs: Sequence[str], horizons: Sequence[int] = HORIZONS_H) -> DataFrame:
    """Sums over the scored rows of a household's steep cells and of its others, by fold and
    rung: rows, squared errors, those at home.

    `steep` has (household, fold, subject, dow, sod) of the steep cells and a row without a
    subject for each fold that has a cut; a fold that has none is left out.
    """
    def counted(key: tuple, table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows or not marks.num_rows:
            return out.empty_table()
        given = columns_of(table, NUMBERS)
        names = pc.dictionary_encode(table["subject"].combine_chunks()).dictionary
        folds = int(given["n_folds"].max())
        cut, marked = np.zeros(folds, bool), np.zeros((folds, len(names), 7, SLOTS_PER_DAY), bool)
        cut[marks["_fold"].to_numpy()] = True
        cells = marks.filter(pc.is_in(marks["_subject"], names))
        marked[tuple(c.to_numpy() for c in (cells["_fold"], pc.index_in(cells["_subject"], names), cells["_dow"], cells["_sod"]))] = True
        sums = np.zeros((len(rungs), 3, folds * 2))
        for _horizon, rows in horizon_samples(given, horizons):
            asked = rows["test_fold"] >= 0
            fold, subject, dow, sod, label = (rows[c][asked] for c in ("test_fold", "subject", "dow", "sod", "label"))
            at = fold * 2 + marked[fold, subject, dow, sod]
            for i, (_rung, p) in enumerate(rung_values(rows, folds, rungs)):
                known = ~np.isnan(p) & cut[fold]
                off = np.clip(p[known], EPS, 1 - EPS) - label[known]
                for k, v in enumerate((None, off * off, label[known])):
                    sums[i, k] += np.bincount(at[known], v, folds * 2)
        rung, at = np.nonzero(sums[:, 0])
        n, squared, home = sums[rung, :, at].T
        return pa.table([pa.array([key[0].as_py()] * len(at), "int64"), pa.array(at // 2, "int32"),
                         pa.array([("flat", "transition")[k % 2] for k in at], "string"), pa.array([rungs[k] for k in rung], "string"),
                         pa.array(n.astype("int64")), squared, home], schema=out)

    out = pa.schema([("household_id", pa.int64()), ("fold", pa.int32()), ("stratum", pa.string()), ("rung", pa.string()),
                     ("n", pa.int64()), ("squared", pa.float64()), ("home", pa.float64())])
    marks = steep.select(*[F.col(c).alias(f"_{c}") for c in ("household_id", "fold", "subject", "dow", "sod")])
    return (by_household(slots).groupBy("household_id").cogroup(marks.groupBy("_household_id"))
            .applyInArrow(counted, "household_id long, fold int, stratum string, rung string, n long, squared double, home double"))


def tied(slots: DataFrame, rungs: Sequence[str] = RUNGS, horizons: Sequence[int] = HORIZONS_H,
         by_subject: bool = False) -> DataFrame:
    """Per horizon, fold and rung of a household (and subject), what `rung_rows` has of each
    score, lowest first: rows, those at home, sums of what they are off by, of its square
    and of p times `weight`.

    `slots` are those of `features.samples` with their folds and may carry `weight`. A
    household's slots are dealt and sorted once; its horizons fan out inside the call, one
    at a time, so no sample becomes a row.
    """
    def counted(key: tuple, table: pa.Table) -> pa.Table:
        given = columns_of(table, NUMBERS)
        names = pc.dictionary_encode(table["subject"].combine_chunks()).dictionary.to_pylist() if by_subject else [None]
        folds, found, lists = int(given["n_folds"].max()), [], []
        parts = folds * len(names)
        for horizon, rows in horizon_samples(given, horizons):
            asked = rows["test_fold"] >= 0
            part, subject, y, label, weight = (rows[c][asked] for c in ("test_fold", "subject", "y", "label", "weight"))
            if by_subject:
                part = part * len(names) + subject
            for rung, p in rung_values(rows, folds, rungs):
                known = ~np.isnan(p)
                score_at, cell = np.unique(np.clip(p[known], EPS, 1 - EPS), return_inverse=True)
                cell = cell + part[known] * len(score_at)
                values = (None, label[known], np.abs(p - y)[known], ((p - y) ** 2)[known], (p * weight)[known])
                sums = np.array([np.bincount(cell, v, parts * len(score_at)) for v in values])
                there = sums[0] > 0
                found += [(horizon, k // len(names), names[k % len(names)], rung, size)
                          for k, size in enumerate(there.reshape(parts, -1).sum(1)) if size]
                lists.append(np.vstack([np.tile(score_at, parts), sums])[:, there])
        if not found:
            return out.empty_table()
        horizon, fold, subject, rung, size = zip(*found)
        ties = pa.StructArray.from_arrays([pa.array(c) for c in np.hstack(lists)], names=list(TIE))
        ties = pa.ListArray.from_arrays(np.cumsum([0, *size]).astype("int32"), ties)
        return pa.table([pa.array([key[0].as_py()] * len(size)), pa.array(horizon, "int32"), pa.array(fold, "int32"),
                         pa.array(subject, "string"), rung, ties], schema=out)

    out = pa.schema([("household_id", pa.int64()), ("horizon_h", pa.int32()), ("fold", pa.int32()), ("subject", pa.string()),
                     ("rung", pa.string()), ("ties", pa.list_(pa.struct([(c, pa.float64()) for c in TIE])))])
    found = by_household(slots).groupBy("household_id").applyInArrow(counted, TIED)
    return found if by_subject else found.drop("subject")


def tied_scores(slots: DataFrame) -> DataFrame:
    """`rung_scores` from what is tied."""
    return score_tied(tied(slots), [*GROUP, "rung", "fold"])
