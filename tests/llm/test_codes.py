import math
import random

import numpy as np
import pytest

from hearthlog.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    kept = [(i, v + [0] * (size - len(v)), label) for i, v, label in sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    width = size // parts
    books = [[v[p * width:(p + 1) * width] for _, v, _ in kept[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p * width:(p + 1) * width], e)), k) for k, e in enumerate(books[p])) for p in range(parts)]
                for _, v, _ in kept]
    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p * width:(p + 1) * width] for (_, v, _), n in zip(kept, near) if n[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, label, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n)) for (i, _, label), n in zip(kept, assign())]
    return sorted(out, key=str), books


@pytest.mark.parametrize("scale", [1.0, 2e6])
def test_equals_brute_force(spark, scale):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) * scale for _ in range(8)], rng.choice([1, 2, None])) for i in range(150)]
    rows += [(i + 200, rows[i][1], 7) for i in range(30)] + [(5, rows[9][1], 1), (None, [1.0] * 8, None), (None, None, 1), (900, [], 2)]
    rows += [(901, [0.5] * 3, 2), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, 1), (904, [None] + [0.0] * 7, 1)]
    rng.shuffle(rows)
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want, books = brute(rows, 4, 20, 3)
    got, found = codes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=20, rounds=3)
    assert sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in got.collect()), key=str) == want
    assert [book.tolist() for book in found] == books


def test_the_tree_finds_the_first_nearest_and_leaves_subtrees_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-1000, 1000, (40, 16))
    points = centres[rng.integers(0, 40, 256)] + rng.integers(-40, 40, (256, 16))
    points[50:60] = points[20]
    queries = np.concatenate([centres[rng.integers(0, 40, 500)] + rng.integers(-40, 40, (500, 16)), points])
    for as_integers in (False, True):
        finder = codes.Finder(points, as_integers)
        best, square = finder.nearest(queries)
        far = ((queries[:, None, :] - points[None]) ** 2).sum(2)
        assert (best == far.argmin(1)).all() and (square.astype(np.int64) == far.min(1)).all()
        assert finder.seen < 0.5 * far.size
    lattice = np.array([[x, y] for x in range(8) for y in range(8)] * 2)
    halves = rng.integers(0, 15, (300, 2))
    best, _ = codes.Finder(2 * lattice).nearest(halves)
    assert (best == ((halves[:, None, :] - 2 * lattice[None]) ** 2).sum(2).argmin(1)).all()


def test_no_rows_and_huge_components(spark):
    got, books = codes.compressed(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and sum(map(len, books)) == 0
    rows = [(1, [3e38, -3e38, 0.0, 1.0], 1), (2, [0.0, 0.0, 0.0, 1.0], 1), (2, [0.0, 0.0, 0.0, 1.0], 1)]
    got, _ = codes.compressed(spark.createDataFrame(rows, SCHEMA), rounds=1, entries=2)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got.collect()) == [(1, "00000000", 0), (2, "01010000", 0), (2, "01010000", 0)]
    clash = spark.createDataFrame([("a", [1.0, 2.0], "x", "y")], "vec_id string, embedding array<double>, label string, parts string")
    assert [tuple(r) for r in codes.compressed(clash)[0].collect()] == [("a", "x", "00000000", 0)]
