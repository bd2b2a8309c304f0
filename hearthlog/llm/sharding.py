"""Documents dealt to shards of equal row counts by balanced label propagation.

Documents that share a text, or a long line, are linked. Shards start as equal ranges
of the order by text, which already keeps most copies together. In each round every
document looks at where those it is linked to lie and wishes to move to the shard that
holds most of them; wishes are granted in pairs of equal counts, or against documents
with no links, so every shard keeps its number of rows. Links run through what is
shared: a document meets one row of counts for each shared thing, never its partners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.llm.common import Store, ranked, table

SHARDS = 8
ROUNDS = 4
LONG_LINE = 80      # bytes of a line that links those who share it
TEXT_WEIGHT = 4     # of a shared text against a shared line
ORDERS = 16         # classes of gain, by powers of two; the greater moves first


def shares(links: DataFrame, where: DataFrame, shards: int) -> DataFrame:
    """For each shared thing, how many that share it lie in each shard."""
    count = [F.count_if(F.col("shard") == s).alias(f"s{s}") for s in range(shards)]
    return links.join(where, "row").groupBy("thing").agg(*count)


def wishes(links: DataFrame, where: DataFrame, shards: int) -> DataFrame:
    """row, shard, to, gain: where the weight of what a row shares lies most, for rows
    to which that is better than where they are. Ties go to the lowest shard, which is
    the same one for all who share."""
    per = shares(links, where, shards)
    pull = links.join(per, "thing").groupBy("row").agg(*(
        F.sum(F.col(f"s{s}") * F.col("weight")).alias(f"s{s}") for s in range(shards)))
    pulls = F.array(*(F.col(f"s{s}") for s in range(shards)))
    best = F.array_position(pulls, F.array_max(pulls)).cast("int") - 1
    found = pull.select("row", pulls.alias("pulls"), best.alias("to")).join(where, "row")
    gain = F.get("pulls", F.col("to")) - F.get("pulls", F.col("shard"))
    found = found.select("row", "shard", "to", gain.alias("gain"))
    # A tie moves rows too, but only downwards, so two halves do not change places.
    return found.where((F.col("to") != F.col("shard")) & ((F.col("gain") > 0) | (F.col("to") < F.col("shard"))))


def granted(wish: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> tuple[dict, dict]:
    """How many wishes (from, to) come true, and how many free rows (from, to) make
    room for those that no opposite wish does."""
    move, fill, spare = {}, {}, dict(free)
    for a in range(shards):
        for b in range(shards):
            if a == b:
                continue
            there, back = wish.get((a, b), 0), wish.get((b, a), 0)
            more = min(max(0, there - back), spare.get(b, 0))
            move[a, b] = min(there, back) + more
            fill[b, a] = more
            spare[b] = spare.get(b, 0) - more
    return move, fill


def table_of(values: dict[tuple[int, int], int], a: Column, b: Column) -> Column:
    """A value by two shards, from `values`, which has at most shards squared."""
    flat = F.create_map(*(x for (i, j), n in values.items() for x in (F.lit(i * 1000 + j), F.lit(n))))
    return F.coalesce(F.try_element_at(flat, a * 1000 + b), F.lit(0))


def assigned(rows: DataFrame, links: DataFrame, store: Store, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """row and shard. `rows`: row, first (the shard at the start), both written;
    `links`: row, thing, weight."""
    where = store.put(rows.select("row", F.col("first").alias("shard")), "shards-0")
    linked = store.put(links.select("row").distinct(), "linked")
    for number in range(1, rounds + 1):
        want = store.put(wishes(links, where, shards), f"wishes-{number}")
        wish = {(r["shard"], r["to"]): r["count"] for r in want.groupBy("shard", "to").count().collect()}
        if not wish:
            break
        loose = store.put(where.join(linked, "row", "left_anti"), f"loose-{number}")
        free = {r["shard"]: r["count"] for r in loose.groupBy("shard").count().collect()}
        move, fill = granted(wish, free, shards)
        # Greater gains first, in classes that are numbered apart.
        order = F.least(F.floor(F.log2(F.col("gain") + 1)), F.lit(ORDERS - 1)).cast("int")
        classed = store.put(want.withColumn("order", order), f"classed-{number}")
        sizes = classed.groupBy("shard", "to", "order").count().collect()
        before = {(r["shard"] * 1000 + r["to"], r["order"]): sum(
            s["count"] for s in sizes if (s["shard"], s["to"]) == (r["shard"], r["to"]) and s["order"] > r["order"]) for r in sizes}
        nth = ranked(classed, ["shard", "to", "order"], ["row"])
        nth = nth.withColumn("rank", F.col("rank") + table_of(before, F.col("shard") * 1000 + F.col("to"), F.col("order")))
        moved = nth.where(F.col("rank") < table_of(move, F.col("shard"), F.col("to"))).select("row", "to")
        # Free rows of a shard, by rank: a run of them for each shard that sends some.
        fillers = ranked(loose, ["shard"], ["row"], salts=1024)
        to, cases = F.lit(None).cast("int"), {}
        for b in range(shards):
            at = 0
            for a in range(shards):
                n = fill.get((b, a), 0)
                if n:
                    cases.setdefault(b, []).append((at, at + n, a))
                    at += n
        for b, runs in cases.items():
            for lo, hi, a in runs:
                to = F.when((F.col("shard") == b) & F.col("rank").between(lo, hi - 1), a).otherwise(to)
        filled = fillers.withColumn("to", to).where(F.col("to").isNotNull()).select("row", "to")
        new = where.join(moved.unionByName(filled), "row", "left").select("row", F.coalesce("to", "shard").alias("shard"))
        new = store.put(new, f"shards-{number}")
        store.drop(where, want, loose, classed)
        where = new
    return where


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, long_line: int = LONG_LINE) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, size, text_crc32, shard, slot.

    Row counts of shards differ by one at most. Size: bytes of the text, none for
    null, plus one. Null texts are linked among themselves as equal ones, apart from
    empty ones. Equal rows are separate and numbered apart; a group of copies larger
    than a shard fills several. Slots count from 0 in each shard without gaps. Other
    columns are not read; no rows give no rows.
    """
    store = Store(docs.sparkSession)
    digest = F.xxhash64(F.lit(1), "text", F.octet_length("text"))
    lines = F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda s: F.octet_length(s) >= long_line))
    # An unsigned checksum of no bytes is 0.
    base = store.put(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), digest.alias("digest"),
        F.transform(lines, lambda s: F.xxhash64(s)).alias("lines")), "documents")
    each = base.select("row", F.col("digest").alias("thing"), F.lit(TEXT_WEIGHT).alias("weight")).union(
        base.select("row", F.explode("lines").alias("thing"), F.lit(1)))
    shared = each.groupBy("thing").count().where("count > 1").select("thing")
    links = store.put(each.join(shared, "thing", "left_semi"), "links")
    # Equal ranges of the order by digest; within a digest, of a hash of the row.
    total = base.count()
    texts = store.put(base.groupBy("digest").count(), "texts")
    at = place_of(texts)
    nth = ranked(base.select("row", "digest"), ["digest"], ["row"], salts=1024)
    first = F.floor((F.col("start") + F.col("rank")) * shards / F.lit(max(1, total))).cast("int")
    rows = store.put(nth.join(at, "digest").select("row", F.least(first, F.lit(shards - 1)).alias("first")), "first")
    where = assigned(rows, links, store, shards, rounds)
    dealt = store.put(base.drop("lines", "digest").join(where, "row"), "dealt")
    return ranked(dealt, ["shard"], ["row"], "slot", salts=1024)


def place_of(texts: DataFrame) -> DataFrame:
    """digest and start: how many rows come before a digest's, in the order of digests.

    Digests are hashes, so ranges of their values hold like numbers of them; the
    rows of whole ranges are summed over 4096 rows, then within each range.
    """
    part = F.shiftrightunsigned("digest", 52).cast("int").alias("part")
    texts = texts.select("digest", "count", part)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = texts.groupBy("part").agg(F.sum("count").alias("rows")).select(
        "part", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    texts = texts.withColumn("inside", F.coalesce(F.sum("count").over(inside), F.lit(0)))
    return texts.join(before, "part").select("digest", (F.col("before") + F.col("inside")).alias("start"))


def op2_sharding(spark, sf_dir):
    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_sharding": op2_sharding}
ORACLE = {}
