"""A log by days, and what every entity held when each of them ended.

A serving pass reads the days it looks back over and the one closing before them,
not the history: a closing row says since when the state has been held and when the
entity was last heard of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlog.operators.chunks import upto, with_previous
from hearthlog.schema import SID

DAY = "day"
STORED = T.StructType([
    T.StructField("household_id", T.LongType()), T.StructField("subject", T.StringType()), T.StructField("ts_us", T.LongType()),
    T.StructField("seq", T.LongType()), T.StructField("value", T.StringType()), T.StructField("heard_us", T.LongType()),
    T.StructField(DAY, T.DateType())])


def day_of(us: Column) -> Column:
    return F.to_date(F.timestamp_micros(us))


def closings(rows: DataFrame, until: Column) -> DataFrame:
    """One row for each entity and day from its first reading to `until`: `ts_us` is the
    start of the state it ends the day in. Rows that are closings themselves go on
    from there."""
    heard = F.coalesce("heard_us", "ts_us") if "heard_us" in rows.columns else F.col("ts_us")
    rows = rows.select(*SID, "ts_us", "seq", "value", heard.alias("heard_us"))
    turns = with_previous(rows, SID, "value", "_was")
    turned = F.col("_was").isNull() | (F.col("_was") != F.col("value"))
    days = turns.groupBy(*SID, day_of(F.col("ts_us")).alias(DAY)).agg(
        F.max(F.when(turned, F.struct("ts_us", "seq", "value"))).alias("_run"), F.max("heard_us").alias("heard_us"))
    w = Window.partitionBy(*SID).orderBy(DAY)
    days = (days.withColumn("_run", F.last("_run", ignorenulls=True).over(upto(w)))
            .withColumn("_next", F.lead(DAY).over(w)).where(F.col(DAY) <= until))
    last = F.least(F.coalesce(F.date_sub("_next", 1), until), until)
    return days.select(*SID, "_run.*", "heard_us", F.explode(F.sequence(F.col(DAY), last)).alias(DAY))


def next_closing(before: DataFrame, rows: DataFrame, day: Column) -> DataFrame:
    """The closing of `day` from the one before it and the rows of that day."""
    opened = before.where(F.col(DAY) == F.date_sub(day, 1)).drop(DAY)
    fresh = rows.where(day_of(F.col("ts_us")) == day).select(*SID, "ts_us", "seq", "value")
    return closings(opened.unionByName(fresh, allowMissingColumns=True), day).where(F.col(DAY) == day)


def store(rows: DataFrame, path: str) -> None:
    """Rows as folders of days; a closing has its `day`, a log gets it from its readings."""
    named = rows if DAY in rows.columns else rows.withColumn(DAY, day_of(F.col("ts_us")))
    named = named if "heard_us" in named.columns else named.withColumn("heard_us", F.col("ts_us"))
    named.select(STORED.names).repartition(DAY, F.pmod(F.xxhash64(*SID), F.lit(16))).write.mode("append").partitionBy(DAY).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def window(log: DataFrame, closed: DataFrame, start: str) -> tuple[DataFrame, DataFrame]:
    """The log from the day `start` on and what was held when it began. Both bounds
    are literals, so other days' folders are not listed into the scan."""
    first = F.lit(start).cast("date")
    return log.where(F.col(DAY) >= first).drop(DAY), closed.where(F.col(DAY) == F.date_sub(first, 1)).drop(DAY)
