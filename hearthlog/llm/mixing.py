"""Sources mixed to target weights by counting documents of each exact length.

Each source takes all of its documents a whole number of times and fills what is
left of its target from a histogram of lengths: of a large rest a share of every length
first, then a bounded knapsack over all that is left. Which documents of a length
are taken is decided by a seeded hash, so the documents themselves never meet.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.llm.common import WORD, Store, carried, ranked, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5         # of all words, for the whole mix
MOST = 2.0          # times a source's own words, at most
SEED = 17
HELD = 1 << 16      # words of a budget that the knapsack decides about, at least
RANGES = 64         # of sources, numbered apart


def placed(sources: DataFrame, store: Store) -> DataFrame:
    """`sources` (source, ...) with their `place` from 0 by code point, null last.

    Ranges of sources are numbered apart, each after the counts of those before it.
    """
    # UTF-8 order is code point order.
    order = [F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_source")]
    keys = ["_null", "_source"]
    parted = sources.select("*", *order).repartitionByRange(RANGES, *keys).withColumn("_part", F.spark_partition_id())
    parted = store.put(parted, "sources")
    first = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(first), F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return parted.withColumn("_n", nth).join(parts, "_part").withColumn("place", F.col("_first") + F.col("_n")).drop("_part", "_first", "_n", *keys)


def targets(sources: DataFrame, weights: tuple[float, ...], share: float = SHARE, most: float = MOST) -> DataFrame:
    """`sources` (source, source_size, place) with the words each is to give: shares of
    all words by weight, what exceeds `most` times a source's words shared again among
    those below, until none is above. A source of no words has target 0.

    As sources are filled, the words of one weight can only grow, so the sources that
    are full at a level stay so; a few sums over all of them find the next level.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("_weight", weight)

    def full(level: float):
        return F.lit(level) * F.col("_weight") >= F.lit(float(most)) * F.col("source_size")
    level, filled = 0.0, -1
    while True:
        some = F.col("source_size") > 0
        now = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(full(level) & some, F.col("source_size"))).alias("full"),
                          F.count(F.when(full(level) & some, 1)).alias("n"), F.sum(F.when(~full(level) & some, F.col("_weight"))).alias("open")).first()
        rest = share * (now["all"] or 0) - most * (now["full"] or 0)
        if now["n"] == filled or not now["open"] or rest <= 0:
            break
        level, filled = rest / now["open"], now["n"]
    unit = level if rest > 0 else 0.0
    target = F.when(F.col("source_size") <= 0, 0.0).when(full(level), F.col("source_size") * F.lit(float(most))).otherwise(F.col("_weight") * F.lit(unit))
    return sources.withColumn("target", target).drop("_weight")


def fit(lengths: list[int], counts: list[int], budget: int, seed: int = SEED) -> list[int]:
    """How many documents of each length to take, so that their words come as near
    to `budget` as can be without exceeding it.

    Of a large budget all but HELD words (or twice the longest length) are taken as a
    fair share of every length, rounded up in a scattered order as far as that goes.
    What is left is a bounded knapsack over all documents left: a bitset holds every
    sum that those looked at so far can make, in the same order, which has nothing to
    do with the lengths themselves.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    back = max(HELD, 2 * max(lengths))
    part = max(0, budget - back)
    take = [c * part // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted(range(len(lengths)), key=lambda i: xxhash.xxh64_intdigest(lengths[i].to_bytes(8, "little"), seed))
    for i in order:
        if take[i] < counts[i] and 0 < lengths[i] <= left - back:
            take[i] += 1
            left -= lengths[i]
    step = math.gcd(*(n for n, c, t in zip(lengths, counts, take) if c > t))
    goal = left - left % step if step else 0
    # Every sum up to what is left, one bit each; copies by doubling.
    reach, steps, mask = 1, [], (1 << (left + 1)) - 1
    for i in order:
        spare, size = counts[i] - take[i], 1
        while spare > 0 and 0 < lengths[i] * size <= left and not reach >> goal & 1:
            size = min(size, spare)
            grown = (reach | reach << lengths[i] * size) & mask
            if grown != reach:
                steps.append((i, size, reach))
                reach = grown
            spare, size = spare - size, size * 2
    at = reach.bit_length() - 1
    for i, size, before in reversed(steps):
        if not before >> at & 1:
            take[i] += size
            at -= lengths[i] * size
    return take


def fitted(part: pd.DataFrame) -> pd.DataFrame:
    """`fit` for the histogram of one source."""
    part = part.sort_values("size")
    budget = max(0, round(float(part["target"].iloc[0])))
    words = int(part["source_size"].iloc[0])
    epochs = budget // words if words else 0
    take = fit(part["size"].tolist(), part["n"].tolist(), budget - epochs * words)
    return pd.DataFrame({"source": part["source"], "size": part["size"], "epochs": np.int64(epochs), "take": take})


FITTED = "source string, size long, epochs long, take long"


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, source, text_hash, size,
    source_size, target, times (copies in the mix), taken (words).

    Sizes are words of the whole text, none for null. Sources come by code point,
    null last, a source of its own; weights repeat over them. A source of no words
    has target 0. Equal rows are separate documents, numbered apart. No rows give no
    rows. The driver sees sums over all sources; a source's histogram has at most a
    row per distinct length.
    """
    store = Store(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = store.put(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")
    per = placed(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), store)
    goals = store.put(targets(store.put(per, "places"), weights, share, most).drop("place"), "targets")
    histogram = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    histogram = histogram.join(goals, histogram["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    plan = store.put(histogram.groupBy("source").applyInPandas(fitted, FITTED), "mix-plan")
    order = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    numbered = ranked(sizes.withColumn("order", order), ["source", "size"], ["order", "doc_id", "text_hash"])
    out = numbered.join(plan, numbered["source"].eqNullSafe(plan["source"]) & (numbered["size"] == plan["size"]))
    out = out.drop(plan["source"]).drop(plan["size"])
    out = out.join(goals, out["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    times = F.col("epochs") + (F.col("rank") < F.col("take")).cast("long")
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", times.alias("times"),
                      (times * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """`docs` with each row as often as the mix takes it; rows it does not take go.

    Rows equal in doc_id, source and text share what the mix takes of them all.
    """
    key = [F.coalesce("doc_id", F.lit(-2 ** 63).cast("long")).alias("_id"), F.xxhash64("source").alias("_source")]
    same = ["_id", "_source", "_text"]
    taken = mixed(docs, **options).select(*key, F.col("text_hash").alias("_text"), "times")
    taken = taken.groupBy(*same).agg(F.sum("times").alias("_times"), F.count("*").alias("_rows")).where("_times > 0")
    rows = docs.select(*key, F.xxhash64("text").alias("_text"), *carried(docs))
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
    times = F.call_function("div", F.col("_times"), F.col("_rows")) + (nth <= F.col("_times") % F.col("_rows")).cast("long")
    out = rows.join(taken.hint("merge"), same).withColumn("_copies", times).where("_copies > 0")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    out = out.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return out.select(*(F.col(name).alias(c) for name, c in zip(names, docs.columns)))


def op10_mix(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op10_mix": op10_mix}
ORACLE = {}
