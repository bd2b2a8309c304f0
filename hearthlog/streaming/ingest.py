"""Continuous ingest: a log that keeps the first reading of every instant.

The log is a folder of days. Repeats are told by the log itself, never by a
watermark, so a reading may be as late as it likes and still arrive; a batch reads
the days it touches and no others. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hearthlog.session import new_folder, removed
from hearthlog.sources import statelog

# Fixed value: how late a reading may be for a window that closes.
LATENESS = "90 minutes"
PARTITION = "day"
STORED = T.StructType([
    T.StructField("household_id", T.LongType()), T.StructField("entity_id", T.StringType()), T.StructField("ts_us", T.LongType()),
    T.StructField("value", T.StringType()), T.StructField("seq", T.LongType()), T.StructField(PARTITION, T.DateType())])


def _partitioned(rows: DataFrame) -> DataFrame:
    columns = [c for c in STORED.names if c != PARTITION]
    return rows.select(*columns, F.to_date(F.timestamp_micros("ts_us")).alias(PARTITION))


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_days(spark: SparkSession, path: str, days: list) -> DataFrame:
    """The log's rows of some days; only their folders are listed."""
    found = [one for one in (f"{path}/{PARTITION}={day}" for day in days) if _there(spark, one)]
    reader = spark.read.schema(STORED).option("basePath", path)
    return reader.parquet(*found) if found else spark.createDataFrame([], STORED)


def insert_or_ignore(rows: DataFrame, path: str) -> None:
    """Append the rows whose (entity, time) the log does not have; of several in
    `rows` the lowest seq. What a failed attempt has left is known to the next, so
    writing again adds nothing twice. The days touched are few: those of one batch."""
    spark = rows.sparkSession
    first = _partitioned(statelog.first_rows(rows))
    days = [r[0] for r in first.select(PARTITION).distinct().collect()]
    known = read_days(spark, path, days)
    fresh = first.join(known.select(PARTITION, *statelog.KEY), [PARTITION, *statelog.KEY], "left_anti")
    # A day's rows of one batch make one file, more only where they are many.
    fresh.repartition(PARTITION).write.mode("append").partitionBy(PARTITION).parquet(path)


def append_to(path: str):
    """A sink for `foreachBatch`. The batch number is not used: another stream, or
    this one from a new checkpoint, may write to the same log."""
    def write(batch: DataFrame, batch_id: int) -> None:
        insert_or_ignore(batch, path)
    return write


def run_ingest(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start ingesting; without `every` whatever is there is read once."""
    writer = stream.writeStream.foreachBatch(append_to(path)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    if not _there(spark, path):
        return spark.createDataFrame([], STORED).drop(PARTITION)
    return spark.read.schema(STORED).parquet(path).drop(PARTITION)


def compact(spark: SparkSession, path: str, days: list) -> None:
    """Rewrite the files of some days as one each, while nothing is writing.

    The rows are first copied aside, so a failure half way leaves a whole copy.
    """
    aside = new_folder(spark, "compact")
    read_days(spark, path, days).write.parquet(aside)
    copy = spark.read.schema(STORED).parquet(aside)
    (copy.repartition(PARTITION).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(PARTITION).parquet(path))
    removed(spark, aside)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over what is available now; its output as a table."""
    spark = stream.sparkSession
    out = new_folder(spark, name)
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", new_folder(spark, name + "-progress"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
