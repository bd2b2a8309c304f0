"""From raw documents to packed sequences: five stages, each on all the last one kept."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthlog.llm import lines, mixing, near, packing, quality
from hearthlog.llm.common import KEY, Store, keyed, table

# Near copies share shingles of five words; fingerprints within so many bits propose them.
NEAR = {"radius": 11, "words": 5, "similarity": 0.8}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules and the line labels keep; the labeller is fitted on
    a bounded sample of the labelled documents that are there."""
    docs = docs.select(*COLUMNS)
    return quality.rated(docs, table(spark, sf_dir, "labels")).where("kept").select("_row.*")


def line_dedup(spark, docs, sf_dir):
    """Every document, without the passages that came before."""
    left = lines.passage_dedup(docs.select(*COLUMNS))
    changed = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return changed.select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """Of each component of near copies the document with the smallest doc_id; of
    equal rows any one. Null doc_ids count as the smallest."""
    docs = docs.select(*COLUMNS)
    found = near.near_copies(docs, **NEAR)
    best = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("best")).select(
        F.coalesce("best.doc_id", F.lit(-2 ** 63).cast("long")).alias("_id"), F.col("best.text_hash").alias("_text"))
    best = Store(spark).put(best, "kept")
    rows = keyed(docs, F.struct("*").alias("_row")).join(best.hint("merge"), KEY)
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.lit(0)))
    return rows.withColumn("_nth", nth).where("_nth = 1").select("_row.*")


def mix_sources(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    return mixing.mix(docs.select(*COLUMNS))


def pack(spark, docs, sf_dir):
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("mix sources", mix_sources), ("pack", pack)]
# Viterbi labels, contraction of near copies and knapsacks are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage; each stage is written and read again."""
    store, docs = Store(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
