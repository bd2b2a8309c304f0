"""Exact deduplication with the frequent texts taken out of the shuffle.

Misra-Gries summaries of each partition propose frequent digests, an exact count
verifies them, and the winners are joined on the map side. No digest left for the
shuffle holds more than two parts in `counters` of the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.llm.common import Store, table

COUNTERS = 1024


def trimmed(counts: Counter, counters: int) -> Counter:
    """The Misra-Gries step: at most `counters` left, each lessened alike."""
    if len(counts) <= counters:
        return counts
    least = sorted(counts.values(), reverse=True)[counters]
    return Counter({key: n - least for key, n in counts.items() if n > least})


def summarise(counters: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, rows = Counter(), 0
        for batch in batches:
            rows += len(batch)
            counts = trimmed(counts + Counter(batch["digest"]), counters)
        yield pd.DataFrame({"digest": [*counts, None], "n": [*counts.values(), rows]})
    return run


def frequent(base: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that may hold over 2 / (counters + 1) of the rows: all that do, and
    `counters` + 1 in all at most, since the counts left sum to the rows at most."""
    summary = base.select("digest").mapInPandas(summarise(counters), "digest binary, n long")
    summed = summary.groupBy("digest").agg(F.sum("n").alias("n"))
    rows = base.count()
    return summed.where(F.col("digest").isNotNull() & (F.col("n") * (counters + 1) > rows)).select("digest")


def exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the largest doc_id stays;
    null doc_ids are the smallest, and of rows equal in both any one stays. Other
    columns of `docs` are not read. No rows give no rows.
    """
    store = Store(docs.sparkSession)
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    base = store.put(docs.select("doc_id", digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    proposed = store.put(frequent(base, counters), "frequent")
    best = F.max(F.struct("doc_id", "row")).alias("best")
    # At most `counters` + 1 rows of 60 bytes, so the broadcasts have a bound.
    winners = store.put(base.join(F.broadcast(proposed), "digest", "left_semi").groupBy("digest")
                        .agg(F.count("*").alias("group_size"), best), "winners")
    hot = base.join(F.broadcast(winners), "digest")
    rest = base.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    rest = rest.select("digest", "doc_id", "row", F.count("*").over(group).alias("group_size"),
                       F.max(F.struct("doc_id", "row")).over(group).alias("best"))
    return hot.select(*rest.columns).unionByName(rest).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op5_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE = {"op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents"""}
