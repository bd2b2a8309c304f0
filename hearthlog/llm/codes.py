"""Vectors compressed to one entry number per part, the entries found by GNAT.

Each part position has a codebook of integer entries. A tree over the entries has a few
split points at each node and, for every split point and every subtree, the range of
distances between them. A part's distances to the split points rule out each subtree
that lies strictly further than the best entry so far: by the triangle inequality on
square roots rounded outwards, so that no tie is lost; integers then decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import Store, table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
SPLITS = 8          # split points of a node
LEAF = 12           # entries under which a node is no longer split
MOST = 2.0 ** 36    # components beyond count as this far; keeps the sums of a batch within 64 bits
QUERIES_AT_ONCE = 10_000


@dataclass
class Node:
    """Some entries: all of a leaf, or the split points of an inner node, with the
    lowest and highest distance of each of them to each child's entries."""
    entries: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)


def exact(points: np.ndarray, *others: np.ndarray) -> bool:
    """Whether squared distances fit a double's 53 bits."""
    top = max((int(np.abs(p).max()) if p.size else 0) for p in (points, *others))
    return points.shape[1] * (2 * top + 1) ** 2 < 2 ** 53


def squared(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of all `queries` to all `points`, exact: as doubles where they
    are whole numbers below 2 ** 53, as Python's integers otherwise."""
    if queries.dtype != object:
        return (queries ** 2).sum(1)[:, None] + (points ** 2).sum(1)[None, :] - 2.0 * (queries @ points.T)
    return ((queries[:, None, :] - points[None, :, :]) ** 2).sum(2)


def rooted(square: np.ndarray, up: bool) -> np.ndarray:
    """Square roots that are not below (or not above) the true ones."""
    root = np.sqrt(square.astype(float))
    return root * (1 + 2.0 ** -48) if up else root * (1 - 2.0 ** -48)


def gnat(points: np.ndarray, entries: np.ndarray) -> Node:
    """A tree over the rows `entries` of `points`. The first split point is the first
    entry, each next one the entry furthest from those before."""
    if len(entries) <= LEAF:
        return Node(entries)
    near, splits = squared(points[entries], points[entries[:1]])[:, 0], [0]
    while len(splits) < SPLITS and near.max() > 0:
        splits.append(int(near.argmax()))
        near = np.minimum(near, squared(points[entries], points[entries[splits[-1:]]])[:, 0])
    far = squared(points[entries], points[entries[splits]])
    if len(splits) == 1:        # all are equal
        return Node(entries)
    owner, rest = far.argmin(1), np.setdiff1d(np.arange(len(entries)), splits)
    low, high, children = [], [], []
    for i in range(len(splits)):
        mine = rest[owner[rest] == i]
        if len(mine):
            low.append(rooted(far[mine].min(0), False))
            high.append(rooted(far[mine].max(0), True))
            children.append(gnat(points, entries[mine]))
    shape = (len(children), len(splits))
    return Node(entries[splits], np.array(low).reshape(shape), np.array(high).reshape(shape), children)


class Finder:
    """The nearest of some points, the first of equally near ones."""

    def __init__(self, points: np.ndarray, as_integers: bool = False):
        self.points = points.astype(object if as_integers else float)
        self.tree = gnat(self.points, np.arange(len(points)))

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which point, and its squared distance."""
        queries = queries.astype(self.points.dtype)
        self.queries, self.seen = queries, 0
        self.best = np.full(len(queries), -1)
        self.square = np.full(len(queries), np.inf).astype(queries.dtype)
        self.visit(self.tree, np.arange(len(queries)))
        return self.best, self.square

    def visit(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        squares = squared(self.queries[rows], self.points[node.entries])
        self.seen += squares.size
        # Entries are in ascending order only in leaves; ties go to the lowest number.
        order = np.argsort(node.entries)
        at = order[squares[:, order].argmin(1)]
        found, which = squares[np.arange(len(rows)), at], node.entries[at]
        better = (found < self.square[rows]) | ((found == self.square[rows]) & (which < self.best[rows]))
        self.best[rows[better]], self.square[rows[better]] = which[better], found[better]
        if not node.children:
            return
        low, high = rooted(squares, False), rooted(squares, True)
        # A query goes down to the child that may be nearest first, which narrows its radius.
        short = np.stack([np.maximum(low - child_high, child_low - high).max(1)
                          for child_low, child_high in zip(node.low, node.high)], 1)
        first = short.argmin(1)
        for again in (False, True):
            for i, child in enumerate(node.children):
                radius = rooted(self.square[rows], True)
                # Strictly further is out: an equal distance may be a tie.
                self.visit(child, rows[((first == i) != again) & (short[:, i] <= radius)])


def whole(vectors: DataFrame, store: Store) -> DataFrame:
    """vec_id, label and parts (integers) of the rows of `vectors` that are kept."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select("vec_id", "embedding", "label").where(F.col("embedding").isNotNull() & finite)
    most = F.lit(MOST)
    ints = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double"), most), -most) * SCALE))
    return store.put(kept.select("vec_id", "label", ints.alias("parts")), "vectors")


def batches_of(rows: DataFrame, size: int, books: list[np.ndarray], result) -> DataFrame:
    """`result` of each batch: its columns before the last, the integers of each part,
    and the nearest entry of each part with its squared distance."""
    width = size // len(books)
    names, schema, finish = result
    schema = schema.format(**dict(rows.dtypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders: dict[bool, list[Finder]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(at, QUERIES_AT_ONCE)
                vectors = part.column(part.num_columns - 1)
                ints = np.zeros((part.num_rows, size), np.int64)
                lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
                where = np.repeat(np.arange(part.num_rows), lengths)
                ints[where, np.arange(len(where)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = vectors.flatten().to_numpy(zero_copy_only=False)
                ints = ints.reshape(part.num_rows, len(books), width)
                small = all(exact(ints[:, p], book) for p, book in enumerate(books))
                if small not in finders:
                    finders[small] = [Finder(book, not small) for book in books]
                found = [finder.nearest(ints[:, p]) for p, finder in enumerate(finders[small])]
                yield pa.RecordBatch.from_arrays(finish(part, ints, found), names=names)
    return rows.mapInArrow(run, schema)


def sums(part, ints, found):
    """Count and component sums of each entry of each part position, over one batch."""
    out: list[list] = [[], [], [], [], []]
    for p, (entry, _) in enumerate(found):
        used, back = np.unique(entry, return_inverse=True)
        total = np.zeros((len(used), ints.shape[2]), np.int64)
        np.add.at(total, back, ints[:, p])      # below 2 ** 47 each
        n = np.bincount(back, minlength=len(used))
        for i, values in enumerate((np.full(total.size, p), np.repeat(used, total.shape[1]), np.tile(np.arange(total.shape[1]), len(used)),
                                    np.repeat(n, total.shape[1]), total.ravel())):
            out[i].append(values)
    return [pa.array(np.concatenate(values).astype(np.int64)) for values in out]


SUMS = (["part", "entry", "at", "n", "total"], "part long, entry long, at long, n long, total long", sums)


def codes(part, ints, found):
    text = ["".join(f"{e:02x}" for e in row) for row in np.stack([entry for entry, _ in found], 1).tolist()]
    errors = [sum(map(int, row)) for row in zip(*(square.tolist() for _, square in found))]
    return [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([e if e < 2 ** 63 else None for e in errors], pa.int64())]


CODES = (["vec_id", "label", "code", "error"], "vec_id {vec_id}, label {label}, code string, error long", codes)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code and error of the rows of `vectors` (vec_id, embedding, label)
    that hold no null and nothing infinite or not a number, and the codebooks.

    The first entries are those of the `entries` smallest vec_ids, null first and ties
    by components; with fewer rows there are fewer entries. Vectors are filled up with
    zeros to the length of the longest, made divisible by `parts`; empty ones too.
    Components beyond MOST count as MOST, and an error beyond 64 bits is null. Equal
    rows give equal rows, other columns are not read, no rows give no rows and empty
    codebooks. What reaches the driver is `entries` vectors, and a sum for each
    component of each entry, whatever the number of rows.
    """
    store = Store(vectors.sparkSession)
    rows = whole(vectors, store)
    longest = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    size = max(parts, -(-longest // parts) * parts)
    first = rows.orderBy("vec_id", "parts").limit(entries).select("parts").collect()
    start = np.zeros((len(first), size), np.int64)
    for i, r in enumerate(first):
        start[i, :len(r["parts"])] = r["parts"]
    books = [start[:, i:i + size // parts].copy() for i in range(0, size, size // parts)]
    if not first:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    for _ in range(rounds):
        summed = batches_of(rows.select("parts"), size, books, SUMS).groupBy("part", "entry", "at").agg(
            F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        books = [book.copy() for book in books]
        for r in summed.collect():      # at most entries * size rows
            books[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return batches_of(rows.select("vec_id", "label", "parts"), size, books, CODES), books


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir):
    found, books = compressed(table(spark, sf_dir, "embeddings"))
    found = Store(spark).put(found, "codes")
    per = found.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return found.join(per, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """The same by comparing every part with every entry."""
    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT vec_id, part, v, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (
  SELECT vec_id, p.part, v, entry, list_sum(list_transform(list_zip(v, e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d
  FROM p JOIN b{k} b ON p.part = b.part) GROUP BY vec_id, part, v)"""

    def moved(k: int) -> str:
        return f"""s{k} AS (SELECT part, entry, list(CASE WHEN n IS NULL THEN old ELSE (s - ((s % n) + n) % n) // n END ORDER BY i) AS e FROM (
  SELECT part, entry, unnest(e) AS old, unnest(range(1, len(e) + 1)) AS i FROM b{k}) LEFT JOIN (
  SELECT part, entry, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM a{k})
  GROUP BY ALL) USING (part, entry, i) GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT * FROM s{k})"""
    steps = [text for k in range(rounds) for text in (assigned(k), moved(k))] + [assigned(rounds)]
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS v
  FROM (SELECT *, unnest(range({PARTS})) AS part FROM kept)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS e FROM p QUALIFY entry < {ENTRIES}),
{", ".join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(x, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (
  SELECT part, entry, unnest(e)::VARCHAR AS x, unnest(range(len(e))) AS i FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM c JOIN kept USING (vec_id), h"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLE = {"op11_vector_codes": oracle()}
