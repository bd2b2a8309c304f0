"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import Store


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); equal roots mean connected.

    Each round every node points at the first of its closed neighbourhood in an order
    drawn anew for the round, and edges are carried over to what their ends point at,
    so the graph shrinks by a constant share a round whatever its shape, chains and
    stars included. A node's pointers are then followed through the rounds. Maps and
    edges are tables; only the number of edges left comes to the driver. Edges from
    a node to itself give it a row; no edges give no rows.
    """
    edges = store.put(edges.select("a", "b").distinct(), "edges")
    maps, left, number = [], edges, 0
    while True:
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        draw = F.struct(F.xxhash64("b", F.lit(number)), "b")
        own = F.struct(F.xxhash64("a", F.lit(number)), F.col("a").alias("b"))
        pointed = both.groupBy("a").agg(F.min(F.least(draw, own)).alias("best")).select("a", F.col("best.b").alias("to"))
        step = store.put(pointed, f"pointers-{number}")
        maps.append(step)
        ends = step.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        after = left.join(step, "a").join(ends, "b").where("to <> to_b")
        after = after.select(F.least("to", "to_b").alias("a"), F.greatest("to", "to_b").alias("b")).distinct()
        grown = store.put(after, f"edges-{number}")
        store.drop(left)
        left, number = grown, number + 1
        if left.isEmpty():
            break
    out = maps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for step in maps[1:]:
        further = step.select(F.col("a").alias("root"), "to")
        out = out.join(further, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = store.put(out, "roots")
    store.drop(left, *maps)
    return out
