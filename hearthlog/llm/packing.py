"""Documents packed into sequences of a fixed number of tokens.

Only how many pieces have each length matters for the plan, so the plan is made from
a histogram: minimum bin slack takes the longest piece left, finds by a bitset
subset sum the fullest set that fits beside it, and uses that pattern as often as
the counts allow. Pieces then find their place by their rank among those of equal
length, which is worked out in parallel.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import Store, ranked, table

CAPACITY = 1024
END = 2                     # id after every document
CACHED = 400_000            # words whose ids a task remembers
LONG = 64                   # code points of a word that is not remembered

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder(dict):
    """Ids of a text as little-endian bytes, word by word.

    The vocabulary's split never joins a word to the single space before it with what
    comes earlier, so ids of a space and a word are remembered. Texts with any other
    white space after a space are encoded whole.
    """

    gap = re.compile(r" (?:\s|\Z)")

    def __init__(self, path: str | None):
        super().__init__()
        import public_tokenizers
        import tiktoken

        # The same vocabulary as byte_bpe_50k.json, as ranks.
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={"<|endoftext|>": len(ranks)})

    def whole(self, text: str) -> bytes:
        return np.array(self.coder.encode(text, allowed_special="all"), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.whole(" " + word)
        if len(word) <= LONG:
            if len(self) >= CACHED:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.gap.search(text):
            return self.whole(text)
        first, *words = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, words))


def cut(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """Start and end of each piece of `n` tokens; the first takes what is over."""
    start, end = 0, n % capacity or min(n, capacity)
    while start < n:
        yield start, end
        start, end = end, end + capacity


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """The pieces of every row of `docs` (doc_id, text), with their ids if asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path), np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = {name: [] for name in names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = memoryview(encoder.encode(text or "") + end)
                for i, (start, stop) in enumerate(cut(len(data) // 4, capacity)):
                    part = data[4 * start:4 * stop]
                    for name, value in zip(names, (doc_id, i, start, stop - start, zlib.crc32(part))):
                        rows[name].append(value)
                    if ids:
                        rows["ids"].append(np.frombuffer(part, "<u4").tolist())
            yield pa.RecordBatch.from_pydict(rows, schema)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * ids]
    schema = pa.schema(list(zip(names, kinds)))
    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids array<long>" * ids)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill `room` best; `counts` is ordered, longest first."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length, count in counts.items():
        size, spare = 1, min(count, room // length)
        while spare > 0:
            size = min(size, spare)
            grown = (reach | reach << length * size) & mask
            if grown != reach:
                steps.append((length, size, reach))
                reach = grown
            spare, size = spare - size, size * 2
        if reach >> room & 1:
            break
    at, use = reach.bit_length() - 1, {}
    for length, size, before in reversed(steps):
        if not before >> at & 1:
            use[length] = use.get(length, 0) + size
            at -= length * size
    return use


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns, each a number of every length, and how many sequences have it.

    A pattern is used as often as the counts allow, which is what finding it anew for
    every sequence would come to. Each use leaves fewer of some length than it needs,
    so there are at most a few patterns per length, however many pieces.
    """
    counts = dict(sorted(((k, v) for k, v in histogram.items() if v), reverse=True))
    out = []
    while counts:
        longest = next(iter(counts))
        counts[longest] -= 1
        use = fullest(counts, capacity - longest)
        counts[longest] += 1
        use[longest] = use.get(longest, 0) + 1
        times = min(counts[length] // k for length, k in use.items())
        out.append((use, times))
        for length, k in use.items():
            counts[length] -= k * times
            if not counts[length]:
                del counts[length]
    return out


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, pieces per sequence, first sequence, offset)."""
    rows, first, sequence = {}, {}, 0
    for use, times in patterns:
        offset = 0
        for length, k in use.items():
            rows.setdefault(length, []).append((first.get(length, 0), k, sequence, offset))
            first[length] = first.get(length, 0) + k * times
            offset += k * length
        sequence += times
    return {length: np.array(found, np.int64) for length, found in rows.items()}


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`found` (pieces, written) with sequence_id and offset."""
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # `capacity` rows at most
    where = found.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for one in np.unique(length):
                mine, rows = length == one, where.value[int(one)]
                first, k, base, start = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1].T
                sequence[mine] = base + (rank[mine] - first) // k
                offset[mine] = start + (rank[mine] - first) % k * one
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    numbered = ranked(found, ["length"], ["doc_id", "piece", "ids_crc32"]).select(*found.columns, "rank")
    schema = ", ".join(f"{c} {t}" for c, t in found.dtypes) + ", sequence_id long, offset long"
    return numbered.mapInPandas(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    A document is its ids and the end id; null text is empty and so one token. Longer
    ones are cut into `capacity` tokens, the first piece taking what is over. Equal
    rows are separate documents; null doc_ids stay null; other columns are not read;
    no rows give no rows. `path`: ranks of the vocabulary, as on every executor.
    """
    store = Store(docs.sparkSession)
    return packed(store.put(pieces(docs, capacity, path, ids), "pieces"), capacity)


def op9_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op9_pack": op9_pack}
ORACLE = {}
