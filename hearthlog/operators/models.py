"""Boosted trees over the sample table.

One model learns from all households; a household tells itself apart by its own
columns. Spark's trees refuse missing values, so each column comes with a flag.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = ("household_id", "horizon_h")
ROW = ("household_id", "subject", "slot", "horizon_h")

# Boosting rounds of a full fit, and the share of rows a pooled one sees.
DEDICATED_ROUNDS, POOLED_ROUNDS, POOLED_RATE = 200, 300, 12 / 48


def change(y, state_now):
    return y - state_now


def residual(rows: DataFrame) -> DataFrame:
    """The change from the present state, which is what is learned."""
    return rows.withColumn("residual", change(F.col("y"), F.col("state_now")))


def with_prediction(rows: DataFrame) -> DataFrame:
    p = F.least(F.greatest(F.col("state_now") + F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("p", p)


def horizon_weights(rows: DataFrame) -> DataFrame:
    """Rows weighted by the inverse squared residual of their horizon, mean one."""
    scale = rows.groupBy("horizon_h").agg(F.avg(F.col("residual") * F.col("residual")).alias("_s"), F.count("*").alias("_n"))
    scale = scale.withColumn("_w", 1.0 / F.greatest("_s", F.lit(1e-4)))
    mean = scale.agg((F.sum(F.col("_w") * F.col("_n")) / F.sum("_n")).alias("m")).scalar()
    weights = scale.withColumn("_m", mean).select("horizon_h", (F.col("_w") / F.col("_m")).alias("weight"))
    return rows.join(weights, "horizon_h")


def sampled(keys: Sequence[Column], rate: float, seed: int = 0) -> Column:
    """Whether a row is drawn: a function of its key alone, whatever the row order."""
    draw = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(2 ** 53)) / float(2 ** 53)
    return draw < rate


PRIMES = tuple(map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5 + 4)))


def hashed(value: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int after keys that hash to `before`."""
    first, second, third, fifth = PRIMES
    x = (before + fifth) ^ (np.asarray(value).astype("uint32").astype("uint64") * first)
    x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * second + third
    x = (x ^ (x >> np.uint64(33))) * second
    x = (x ^ (x >> np.uint64(29))) * third
    return x ^ (x >> np.uint64(32))


def drawn(before: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
    """What `sampled` compares with its rate, for keys of which the `last` is an int and the
    others hash to `before`."""
    x = hashed(np.array([seed]), hashed(last, before.astype("uint64")))
    return (x & np.uint64(2 ** 53 - 1)) / 2.0 ** 53


def filled(rows: DataFrame, columns: Sequence[str], always: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Missing values as zero plus a flag; an empty column is zero throughout. Columns
    that are `always` known get no flag."""
    flagged = [c for c in columns if c not in always]
    out = rows.withColumns({f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
                           | {f"m_{c}": F.col(c).isNull().cast("double") for c in flagged})
    return out, [f"x_{c}" for c in columns] + [f"m_{c}" for c in flagged]


def _stages(names: Sequence[str], category: str | None):
    if category is None:
        return [VectorAssembler(inputCols=list(names), outputCol="features")]
    return [StringIndexer(inputCol=category, outputCol="_code", handleInvalid="keep"),
            OneHotEncoder(inputCol="_code", outputCol="_who", handleInvalid="keep"),
            VectorAssembler(inputCols=[*names, "_who"], outputCol="features")]


def fit_regressor(rows: DataFrame, columns: Sequence[str], label: str, *, iterations: int = 20, depth: int = 4,
                  min_rows: int = 50, weight: str | None = None, loss: str = "squared",
                  category: str | None = None, always: Sequence[str] = ()) -> PipelineModel:
    ready, names = filled(rows.where(F.col(label).isNotNull()), columns, always)
    tree = GBTRegressor(labelCol=label, maxIter=iterations, stepSize=0.05, maxDepth=depth, lossType=loss,
                        minInstancesPerNode=min_rows, seed=0)
    if weight:
        tree = tree.setWeightCol(weight)
    return Pipeline(stages=[*_stages(names, category), tree]).fit(ready)


def fit_classifier(rows: DataFrame, columns: Sequence[str], label: str, *, iterations: int = 20,
                   depth: int = 3, min_rows: int = 15) -> PipelineModel:
    ready, names = filled(rows, columns)
    tree = GBTClassifier(labelCol=label, maxIter=iterations, stepSize=0.05, maxDepth=depth,
                         minInstancesPerNode=min_rows, seed=0)
    return Pipeline(stages=[*_stages(names, None), tree]).fit(ready)


def predict(model: PipelineModel, rows: DataFrame, columns: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    ready, names = filled(rows, columns, always)
    drop = [*names, "features", "_code", "_who", "rawPrediction"]
    return model.transform(ready).drop(*drop)


def out_of_fold(rows: DataFrame, columns: Sequence[str], folds: int, fit) -> DataFrame:
    """Predictions of each fold's tested rows by a model of its training rows."""
    out = None
    for fold in range(folds):
        model = fit(rows.where(F.col("train_from") <= fold))
        part = with_prediction(predict(model, rows.where(F.col("test_fold") == fold), columns))
        part = part.withColumn("fold", F.lit(fold))
        out = part if out is None else out.unionByName(part)
    return out


# --- families ----------------------------------------------------------------------

@dataclass(frozen=True)
class Family:
    """A way to learn the residual: one model for each of `horizons`, or, where that
    is None, one for all of them with the horizon among its columns."""

    kind: str
    columns: tuple[str, ...]
    horizons: tuple[int, ...] | None = None
    rounds: int = DEDICATED_ROUNDS
    depth: int = 4
    min_rows: int = 50
    rate: float = 1.0
    weighted: bool = False
    category: str | None = None
    always: tuple[str, ...] = ()

    def heads(self) -> tuple[int | None, ...]:
        return (None,) if self.horizons is None else self.horizons


def of_head(rows: DataFrame, head: int | None) -> DataFrame:
    return rows if head is None else rows.where(F.col("horizon_h") == head)


def fit_head(rows: DataFrame, family: Family, head: int | None) -> PipelineModel | None:
    """A model of one head; None where no row is left to learn from."""
    part = residual(of_head(rows, head))
    if family.rate < 1:
        part = part.where(sampled([F.col(c) for c in ROW], family.rate))
    if part.isEmpty():
        return None
    if family.weighted:
        part = horizon_weights(part)
    return fit_regressor(part, family.columns, "residual", iterations=family.rounds, depth=family.depth,
                         min_rows=family.min_rows, weight="weight" if family.weighted else None,
                         category=family.category, always=family.always)


def at_once(jobs: Sequence[Callable], threads: int = 4) -> list:
    """Fits that do not wait for each other; each is Spark jobs of its own."""
    with ThreadPool(threads) as pool:
        return pool.map(lambda job: job(), jobs)


def told(model: PipelineModel, rows: DataFrame, family: Family) -> DataFrame:
    out = with_prediction(predict(model, rows, family.columns, family.always))
    return out.withColumn("kind", F.lit(family.kind))


def families_out_of_fold(rows: DataFrame, families: Sequence[Family], folds: int) -> DataFrame | None:
    """Each tested row once for each family that reaches it, by a model of the rows its
    fold trains on. A fold without training rows foretells nothing."""
    parts = [(family, head, fold) for family in families for head in family.heads() for fold in range(folds)]
    models = at_once([lambda p=p: fit_head(rows.where(F.col("train_from") <= p[2]), p[0], p[1]) for p in parts])
    out = None
    for (family, head, fold), model in zip(parts, models):
        if model is None:
            continue
        tested = of_head(rows, head).where(F.col("test_fold") == fold)
        part = told(model, tested, family).select(*ROW, F.lit(fold).alias("fold"), "y", "p", "kind")
        out = part if out is None else out.unionByName(part)
    return out


def store_families(rows: DataFrame, families: Sequence[Family], folder: str) -> list[tuple[Family, int | None, str]]:
    """Fit every head on all labelled rows and save it; the paths of those there are."""
    heads = [(family, head) for family in families for head in family.heads()]
    models = at_once([lambda p=p: fit_head(rows, *p) for p in heads])
    kept = []
    for (family, head), model in zip(heads, models):
        if model is not None:
            path = f"{folder}/{family.kind}-{'all' if head is None else head}"
            model.write().overwrite().save(path)
            kept.append((family, head, path))
    return kept


def serve_families(rows: DataFrame, stored: Sequence[tuple[Family, int | None, str]], chosen: DataFrame) -> DataFrame:
    """Forecasts of the stored models, each only for the (household, horizon) it was
    chosen for. `chosen` holds `kind` and `ships`."""
    serves = chosen.where("ships").select(*GROUP, "kind")
    out = None
    for family, head, path in stored:
        mine = serves.where(F.col("kind") == family.kind).drop("kind")
        asked = of_head(rows, head).join(mine, list(GROUP), "left_semi")
        part = told(PipelineModel.load(path), asked, family).select(*ROW, "kind", "p")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.limit(0).select(*ROW, F.lit("").alias("kind"), F.lit(0.0).alias("p"))
    return out
