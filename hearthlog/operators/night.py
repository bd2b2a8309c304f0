"""When a weekly state is off, read from a week of its changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.functions import clock
from hearthlog.operators.chunks import as_of

STEP_US = 15 * 60_000_000
SAMPLES = 7 * 96


def weekly_pattern(changes: DataFrame, asked: DataFrame, keys: Sequence[str], tz: str = "UTC") -> DataFrame:
    """Per (local weekday, quarter hour): is it on. The latest sample of a cell wins."""
    keys = list(keys)
    points = asked.select(*keys, F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(SAMPLES - 1)),
        lambda i: F.col("now_us") - F.lit(SAMPLES * STEP_US) + i.cast("long") * F.lit(STEP_US))).alias("ts_us"))
    seen = as_of(points, changes, keys, "value", "state")
    local = clock.localise(F.col("ts_us"), tz)
    cell = F.call_function("div", F.hour(local) * 60 + F.minute(local), F.lit(15))
    return (seen.where(F.col("state").isNotNull() & ~F.col("state").isin("unavailable", "unknown"))
            .groupBy(*keys, F.weekday(local).alias("dow"), cell.alias("cell"))
            .agg(F.max_by(F.col("state") == "on", "ts_us").alias("awake")))


def bands(pattern: DataFrame, asked: DataFrame, keys: Sequence[str], hours: int = 48, tz: str = "UTC") -> DataFrame:
    """Runs of off cells as hours from now; a cell never seen counts as on."""
    keys = list(keys)
    steps = hours * 4
    ahead = asked.select(*keys, "now_us", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    local = clock.localise(F.col("now_us") + F.col("i").cast("long") * F.lit(STEP_US), tz)
    placed = (ahead.withColumn("dow", F.weekday(local))
              .withColumn("cell", F.call_function("div", F.hour(local) * 60 + F.minute(local), F.lit(15)))
              .join(pattern, [*keys, "dow", "cell"], "left")
              .where(~F.coalesce("awake", F.lit(True))))
    w = Window.partitionBy(*keys).orderBy("i")
    islands = placed.withColumn("_g", F.col("i") - F.row_number().over(w))
    out = islands.groupBy(*keys, "_g").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    return out.select(*keys, (F.col("a") / 4.0).alias("from_h"), (F.least(F.col("b") + 1, F.lit(steps)) / 4.0).alias("to_h"))
