"""SimHash near-duplicates: fingerprints compared exactly, tile by tile.

Two fingerprints within the radius agree on some of the blocks their bits are cut
into, so distinct fingerprints meet under the values of every choice of that many
blocks. Fingerprints that meet are sorted by how many bits they have set and compared
in square tiles by exclusive-or and bit count; a pair of tiles whose bit counts lie
further apart than the radius is skipped. Groups over a bound are cut by further
blocks of the bits that are left, which loses no pair either.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import Store, table
from hearthlog.llm.graph import components

WORDS = 3
RADIUS = 3
SEED = 42
AGREE = 2           # blocks a key is made of: with the radius, how many blocks there are
TILE = 512
GROUP = 8192        # fingerprints compared in one group at most, as far as bits are left


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Bits set in over half of the hashes of the text's shingles, as a signed number."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        whole = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = [0, *ends[:-words].tolist()]
        shingles = [whole[a:b] for a, b in zip(starts, (ends[words - 1:] - 1).tolist())]
    digests = b"".join([xxhash.xxh64_digest(s, seed) for s in shingles])
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        set_ += np.unpackbits(hashes[at:at + 65536], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash and fp of every row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or b"", words, seed) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp"])
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def blocks(mask: int, n: int) -> list[int]:
    """The bits of `mask` cut into `n` runs of nearly equal size, as masks."""
    bits = [i for i in range(64) if mask >> i & 1]
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """`fps` once for each mask, with the bits under it."""
    each = F.explode(F.array(*(F.lit(signed(m)).cast("long") for m in masks)))
    return fps.select("fp", each.alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def near(fps: np.ndarray, radius: int, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of distinct uint64 `fps` that differ in `radius` bits at most."""
    count = np.bitwise_count(fps)
    order = np.argsort(count, kind="stable")
    fps, count = fps[order], count[order].astype(np.int64)
    for i in range(0, len(fps), tile):
        most = count[min(i + tile, len(fps)) - 1]
        for j in range(i, len(fps), tile):
            if count[j] - most > radius:
                break
            there = np.bitwise_count(fps[i:i + tile, None] ^ fps[None, j:j + tile]) <= radius
            a, b = np.nonzero(np.triu(there, 1) if i == j else there)
            yield fps[i + a], fps[j + b]


def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
    """The fingerprints of each (mask, key) of rows sorted by both, some groups at a
    time; a group may lie across batches."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch])
        mask, key = rest["mask"].to_numpy(), rest["key"].to_numpy()
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        if len(cuts):
            done, rest = rest.iloc[:cuts[-1]], rest.iloc[cuts[-1]:]
            yield np.split(done["fp"].to_numpy().view(np.uint64), cuts[:-1])
    if rest is not None and len(rest):
        yield [rest["fp"].to_numpy().view(np.uint64)]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what (a, b) connect, one for each node but one of a class."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def links(fps: DataFrame, store: Store, radius: int = RADIUS, agree: int = AGREE, group: int = GROUP) -> DataFrame:
    """Pairs (a, b) of distinct `fps` that connect all within `radius` bits of each other."""
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for values in grouped(batches):
            found = [(np.empty(0, np.uint64),) * 2]
            for one in values:
                found.extend(near(one, radius))
            a, b = spanning(*(np.concatenate(side) for side in zip(*found)))
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    masks = [sum(pick) for pick in combinations(blocks((1 << 64) - 1, radius + agree), agree)]
    todo, out = store.put(keyed(fps, masks), "keyed"), []
    while True:
        sizes = todo.groupBy("mask", "key").count()
        # Where no more bits are left than the radius, a key has 2 ** radius at most.
        over = (F.col("count") > group) & (F.bit_count("mask") < 64 - radius)
        large = store.put(sizes.where(over).select("mask", "key"), "large")
        several = sizes.where((F.col("count") > 1) & ~over).select("mask", "key")
        meeting = todo.join(several, ["mask", "key"]).repartition("mask", "key").sortWithinPartitions("mask", "key")
        out.append(meeting.select("mask", "key", "fp").mapInPandas(compare, "a long, b long"))
        used = [r["mask"] % (1 << 64) for r in large.select("mask").distinct().collect()]  # few: masks of one round
        if not used:
            break
        finer = [(signed(mask), signed(mask | more)) for mask in used
                 for more in blocks(((1 << 64) - 1) ^ mask, radius + 1)]
        finer = F.broadcast(fps.sparkSession.createDataFrame(finer, "mask long, finer long"))  # a few rows a mask
        rest = todo.join(large, ["mask", "key"], "left_semi").join(finer, "mask")
        rest = rest.select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"))
        todo = store.put(rest.distinct(), "keyed")
    pairs = out[0]
    for more in out[1:]:
        pairs = pairs.union(more)
    return pairs


def near_duplicates(docs: DataFrame, radius: int = RADIUS, agree: int = AGREE, group: int = GROUP) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text_hash, fp, component_id
    and `root`, which names the component even where its doc_ids are null.

    Documents whose fingerprints differ in `radius` bits at most are linked; the
    component is the smallest doc_id reachable, itself included (null only if all are
    null). Null and wordless texts have fingerprint zero and are linked like any other.
    Equal fingerprints are compared once, so copies cost nothing; equal rows give
    equal rows; other columns are not read; no rows give no rows.
    """
    store = Store(docs.sparkSession)
    marked = store.put(fingerprints(docs), "fingerprints")
    least = store.put(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    roots = components(links(least.select("fp"), store, radius, agree, group), store)
    placed = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_fp = placed.join(lowest, "root").select("fp", "component_id", "root")
    return marked.join(by_fp, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones, 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def op8_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLE = {}
