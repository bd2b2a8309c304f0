"""Benchmark decontamination by winnowing.

A span of t words shared by two texts holds w runs of k words (t = w + k - 1). Of every
w neighbouring runs the one of the smallest hash is kept, the last of equal ones, so
both texts keep the same run of the span. The kept hashes of documents and items are
joined, and each hit is extended to every window that holds it, whose words are then
compared with the items' windows: no window that occurs is missed, none is made up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import KEY, Store, keyed, table

WORDS = 10          # of a window; an item of fewer words is one window
SEED = 7
KNOWN = 1 << 18     # words whose hashes a task remembers

# A word is a run of ASCII letters and digits and of anything beyond ASCII.
KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(KEEP).split()


class Hashes(dict):
    """Hash of each word; forgets all once it knows too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value

    def of(self, parts: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, parts), np.uint64, len(parts))


def shape(size: int) -> tuple[int, int]:
    """Words of a run, and neighbouring runs one is kept of, for windows of `size` words."""
    run = (size + 1) // 2
    return run, size - run + 1


def fingerprints(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the kept runs of a text begin, and their hashes, for windows of `size` words."""
    run, many = shape(size)
    if len(hashes) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(hashes) - run + 1
    grams = np.full(n, size, np.uint64)
    for i in range(run):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n]
        grams ^= grams >> np.uint64(29)
    grams = grams * np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    seen = np.lib.stride_tricks.sliding_window_view(grams, many)[:, ::-1]
    at = np.arange(len(seen)) + (many - 1 - seen.argmin(1))
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, grams[at].view(np.int64)


def kept_runs(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """KEY, size, at and h of the kept runs of `rows` (KEY, text) for windows of each
    size; and for each row one of size 0 that has its number of words as `at`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            own = batch.column(1).to_pylist()
            out = {name: [np.empty(0, np.int64)] for name in ("row", "size", "at", "h")}
            for row, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                hashes = known.of(words(text))
                # The hash only spreads these rows: no item has a window of no words.
                found = [(np.array([0]), np.array([len(hashes)]), np.array([own[row]]))]
                for size in sizes:
                    at, h = fingerprints(hashes, size)
                    found.append((np.full(len(at), size), at, h))
                for parts in found:
                    for name, part in zip(out, (np.full(len(parts[0]), row), *parts)):
                        out[name].append(part)
            whole = {name: pa.array(np.concatenate(parts)) for name, parts in out.items()}
            yield pa.RecordBatch.from_arrays([batch.column(0).take(whole["row"]), batch.column(1).take(whole["row"]),
                                              whole["size"], whole["at"], whole["h"]], names=[*KEY, "size", "at", "h"])
    return rows.mapInArrow(run, "_id long, _text long, size long, at long, h long")


def windows_around(rows: DataFrame) -> DataFrame:
    """KEY, start, size and words of every window of `rows` (KEY, text, hits) that holds a hit (size, at)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, (text, hits) in enumerate(zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist())):
                parts = words(text)
                starts = {(start, hit["size"]) for hit in hits
                          for start in range(max(0, hit["at"] - shape(hit["size"])[1] + 1), min(hit["at"], len(parts) - hit["size"]) + 1)}
                out += [(row, start, size, b" ".join(parts[start:start + size])) for start, size in starts]
            row, start, size, window = map(list, zip(*out)) if out else ([], [], [], [])
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(window, pa.binary()).cast(pa.string())], names=[*KEY, "start", "size", "window"])
    return rows.mapInArrow(run, "_id long, _text long, start long, size long, window string")


def item_windows(items: DataFrame, size: int = WORDS) -> DataFrame:
    """item (its id as text, none for null) and words of each window of `items` (item_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                parts = words(text)
                each = [b" ".join(parts[i:i + size]) for i in range(max(1, len(parts) - size + 1))] if parts else []
                rows += [row] * len(each)
                found += each
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.binary()).cast(pa.string())],
                                             names=["item", "window"])
    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").mapInArrow(
        run, "item string, window string").distinct()


def covered(spans):
    """How many words lie in any of the sorted (start, size)."""
    def step(done, span):
        end = span["start"] + span["size"]
        return F.struct((done["n"] + F.greatest(F.lit(0), end - F.greatest(done["end"], span["start"]))).alias("n"),
                        F.greatest(done["end"], end).alias("end"))
    zero = F.lit(0).cast("long")
    return F.aggregate(spans, F.struct(zero.alias("n"), zero.alias("end")), step)["n"]


def contaminated(docs: DataFrame, items: DataFrame, size: int = WORDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text_hash, n_words, n_hit,
    n_items, items (sorted ids as text) and contaminated.

    A window is `size` neighbouring words of an item, or all words of a shorter one; a
    document's word is hit if it lies in any occurrence of a window. Null and wordless
    texts and items have no windows. Rows of one item_id are one item; a null id is
    written as an empty text. Equal rows give equal rows; other columns are not read;
    no rows, or no items, give no hits.

    Windows and hashes of the items are tables joined by Spark, which broadcasts them
    only where they are small. Documents that hold the same windows share one list.
    """
    store = Store(docs.sparkSession)
    windows = store.put(item_windows(items, size), "item-windows")
    texts = windows.select("window").distinct().withColumn("w", F.monotonically_increasing_id())
    texts = store.put(texts.withColumn("size", F.size(F.split("window", " ")).cast("long")), "windows")
    sizes = sorted(r["size"] for r in texts.select("size").distinct().collect())  # at most `size` numbers
    rows = keyed(docs, "text")
    kept = kept_runs(texts.select(F.col("w").alias("_id"), F.col("w").alias("_text"), "window"), sizes)
    # A window of n words keeps one run, the same as wherever it occurs.
    kept = store.put(kept.join(texts.select("w", "size"), (F.col("_id") == F.col("w")) & (kept["size"] == texts["size"]), "left_semi")
                     .select(kept["size"], "h").distinct(), "item-runs")
    met = kept_runs(rows, sizes).join(kept.withColumn("met", F.lit(True)), ["size", "h"], "left").where("met OR size = 0")
    counted = store.put(met.groupBy(*KEY).agg(
        F.max(F.when(F.col("size") == 0, F.col("at"))).alias("n_words"),
        F.collect_set(F.when(F.col("size") > 0, F.struct("size", "at"))).alias("hits")), "words")
    # Written first, so that Spark knows its size and moves texts only if it is large.
    hits = store.put(counted.where(F.size("hits") > 0).select(*KEY, "hits"), "met-runs")
    around = windows_around(rows.join(hits, KEY).select(*KEY, "text", "hits"))
    found = around.join(texts.select("window", "w"), "window").groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"), F.sort_array(F.collect_set("w")).alias("ws"))
    found = store.put(found.select(*KEY, covered(F.col("spans")).alias("n_hit"), "ws"), "hits")
    items_of = windows.join(texts.select("window", "w"), "window").select("w", "item")
    lists = found.select("ws").distinct().select("ws", F.explode("ws").alias("w")).join(items_of, "w")
    lists = lists.groupBy("ws").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = found.join(lists, "ws").select(*KEY, "n_hit", "items")
    out = keyed(docs, "doc_id").join(counted.select(*KEY, "n_words"), KEY).join(found, KEY, "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0).cast("long")), F.array().cast("array<string>")
    listed = F.coalesce("items", none)
    return out.select("doc_id", F.col("_text").alias("text_hash"), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                      listed.alias("items"), (n_hit > 0).alias("contaminated"))


def op13_decontaminate(spark, sf_dir):
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op13_decontaminate": op13_decontaminate}
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PARTS = rf"regexp_extract_all({LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {"op13_decontaminate": rf"""
WITH it AS (SELECT item_id, {PARTS} AS ws FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(ws), {WORDS}) AS size, array_to_string(ws[i:i + least(len(ws), {WORDS}) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WORDS} + 1, 1) + 1)) AS i FROM it WHERE len(ws) > 0)),
d AS (SELECT doc_id, coalesce({PARTS}, []) AS ws FROM documents),
dw AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win
       FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM iw) WHERE len(ws) >= size)),
hit AS (SELECT DISTINCT doc_id, i, dw.size, item_id FROM dw JOIN iw USING (win)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY 1),
lists AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN lists USING (doc_id)"""}
