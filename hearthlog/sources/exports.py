"""Readers of exported history: annotated CSV and nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def annotated_csv(spark: SparkSession, path: str, columns: str, timed: bool = True) -> DataFrame:
    """Rows of annotated CSV files, without annotations and repeated headers.

    `columns` is the schema, all text. An aggregate has no `_time`: `timed=False`.
    """
    rows = spark.read.csv(path, schema=columns, header=False, comment="#")
    rows = rows.where("not (result <=> 'result') and not (_time <=> '_time')")
    if timed:
        rows = rows.where("_time is not null and _time <> ''")
    return rows.where("_value is not null and _value <> ''")


HISTORY = """array<array<struct<entity_id: string, state: string, last_changed: string, last_updated: string>>>"""


def history_json(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """A history response, a list per entity, to log rows.

    Only the first entry of a list names its entity, so the name is carried along
    the list. `rows` holds one response per row, told apart by `keys`.
    """
    entries = (rows.withColumn("_lists", F.from_json(column, HISTORY))
               .select(*keys, F.posexplode("_lists").alias("list_at", "_list"))
               .select(*keys, "list_at", F.posexplode("_list").alias("entry_at", "_e"))
               .select(*keys, "list_at", "entry_at", "_e.*"))
    w = (Window.partitionBy(*keys, "list_at").orderBy("entry_at")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    named = F.last(F.when(F.col("entity_id") != "", F.col("entity_id")), ignorenulls=True).over(w)
    when = F.coalesce("last_changed", "last_updated")
    return (entries.withColumn("entity_id", named).withColumn("_when", when)
            .where("entity_id is not null and _when is not null")
            .select(*keys, "list_at", "entry_at", "entity_id",
                    F.unix_micros(F.to_timestamp("_when")).alias("ts_us"), F.col("state").alias("value")))
