"""What the training-data operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthlog.session import new_folder, removed

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Store:
    """Tables between phases, in the folder all executors share.

    A written table cuts lineage, makes what was random or sampled the same for
    every later reader, and outlives the executor that made it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Only once nothing that is still to run reads them."""
        for df in tables:
            removed(self.spark, self.paths.pop(id(df)))


# A document is known by its doc_id and a hash of its text.
KEY = ["_id", "_text"]


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """KEY and what else is asked for. Null doc_ids count as the smallest; rows equal
    in both are one document, whose copies are treated alike."""
    least = F.lit(-2 ** 63).cast("long")
    return docs.select(F.coalesce("doc_id", least).alias("_id"), F.xxhash64("text").alias("_text"), *more)


def carried(docs: DataFrame) -> list[Column]:
    """Every column of `docs` under a name no operator uses, in order: `_c0`, `_c1`, ..."""
    return [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]


def once(column: Column, name: str, *keep: str, source: DataFrame) -> DataFrame:
    """`source` with `column` worked out once per row, however often it is read.

    Expressions inside a lambda, or read by several others, are otherwise worked
    out again at each use; a generator is not merged into its readers.
    """
    return source.select(*keep, F.explode(F.array(column)).alias(name))


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank", salts: int = 64) -> DataFrame:
    """`df` with a gapless rank from 0 within each group of `by`.

    The order is by a hash of `order` and then by `order`, so a group that holds a
    third of all rows is cut into `salts` ranges of that hash which are numbered
    apart; the range counts, at most `salts` a group, give each its first number.
    `df` is read twice and must be the same both times: write it first.
    Rows equal in `order` are numbered in any order.
    """
    salt = F.shiftrightunsigned(F.xxhash64(*order), 48) * F.lit(salts)
    salted = df.withColumn("_salt", F.shiftright(salt, 16).cast("int"))
    keyed = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias(f"_k{i}") for i, c in enumerate(by)]
    keys = [f"_k{i}" for i in range(len(by))]
    salted = salted.select("*", *keyed)
    first = salted.groupBy(*keys, "_salt").count()
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select(*keys, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    numbered = salted.withColumn("_n", F.row_number().over(within) - 1)
    return (numbered.join(first, [*keys, "_salt"])
            .withColumn(name, F.col("_first") + F.col("_n")).drop(*keys, "_salt", "_first", "_n"))
