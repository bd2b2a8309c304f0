"""The forecast log as a store: one folder a target day, the last p written wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hearthlog.operators.serve import LOG_KEY
from hearthlog.schema import FORECASTS, SLOT_US
from hearthlog.session import new_folder, removed

DAY = "target_day"
STORED = T.StructType([*FORECASTS.fields, T.StructField(DAY, T.DateType())])
DAY_US = 86_400_000_000


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _folder(path: str, day) -> str:
    return f"{path}/{DAY}={day}"


def _days(spark: SparkSession, path: str) -> list[str]:
    """The target days the store has."""
    where, fs = _path(spark, path)
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory()]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(DAY + "="))


def read(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame:
    """The store, or some of its days; only their folders are listed."""
    there = _days(spark, path)
    found = [_folder(path, d) for d in there if days is None or d in set(days)]
    reader = spark.read.schema(STORED).option("basePath", path)
    return reader.parquet(*found) if found else spark.createDataFrame([], STORED)


def _replace_days(rows: DataFrame, path: str) -> None:
    """Overwrite the days of `rows`. They are copied aside first, so a failure half way
    leaves a whole copy."""
    spark, aside = rows.sparkSession, new_folder(rows.sparkSession, "forecasts-aside")
    rows.select(STORED.names).write.parquet(aside)
    (spark.read.schema(STORED).parquet(aside).repartition(DAY, F.pmod(F.xxhash64("household_id"), F.lit(16)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path))
    removed(spark, aside)


def upsert(rows: DataFrame, path: str) -> None:
    """Insert or replace by (subject, target, horizon). Reads and rewrites the target
    days that `rows` touch, which for a cycle are the three its horizons reach; run
    twice it changes nothing. One writer at a time."""
    spark = rows.sparkSession
    fresh = rows.select(FORECASTS.names).withColumn(DAY, F.to_date(F.timestamp_micros(F.col("target_slot") * SLOT_US)))
    days = [str(r[0]) for r in fresh.select(DAY).distinct().collect()]
    both = read(spark, path, days).unionByName(fresh)
    newest = F.max(F.struct("written_at", "p"))
    kept = both.groupBy(DAY, *LOG_KEY).agg(newest.alias("_v")).select(DAY, *LOG_KEY, "_v.p", "_v.written_at")
    _replace_days(kept, path)


def record(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Cycles from a stream into the store, whatever there is now."""
    writer = stream.writeStream.foreachBatch(lambda batch, _number: upsert(batch, path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def prune(spark: SparkSession, path: str, now_us: int, keep_days: int) -> None:
    """Drop what was foretold for before `keep_days` ago; 0 keeps everything. Whole days
    go as folders, the day the bound falls in is rewritten. No other log is touched."""
    if keep_days == 0:
        return
    bound = now_us - keep_days * DAY_US
    edge = spark.range(1).select(F.to_date(F.timestamp_micros(F.lit(bound))).cast("string")).first()[0]
    for day in _days(spark, path):
        if day < edge:
            removed(spark, _folder(path, day))
    if bound % DAY_US and edge in _days(spark, path):
        kept = read(spark, path, [edge]).where(F.col("target_slot") * SLOT_US >= bound)
        if kept.isEmpty():
            removed(spark, _folder(path, edge))
        else:
            _replace_days(kept, path)
