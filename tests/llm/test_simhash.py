import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hearthlog.llm import graph, simhash
from hearthlog.llm.common import Store


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprints_are_the_definition():
    rng = random.Random(1)
    texts = ["", " \t", "A", "É x", "one two", "a b c", "A B  c\nd"] + [
        " ".join(rng.choices(["The", "cat", "sat", "É", "on", "1"], k=rng.randrange(40))) for _ in range(200)]
    for text in texts:
        assert simhash.fingerprint(text.encode()) % 2 ** 64 == plain(text), text
    long = "x y z w " * 50000
    assert simhash.fingerprint(long.encode()) % 2 ** 64 == plain(long)


def clusters(rng, n):
    out = set()
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.add(centre)
            for _ in range(rng.randrange(1, 5)):
                centre ^= 1 << rng.randrange(64)
    return sorted(out)


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(2)
    fps = clusters(rng, 400)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if (a ^ b).bit_count() <= 3]
    want = classes(fps, pairs)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    # Larger groups are cut by further blocks.
    for group, agree in ((8192, 2), (12, 1), (12, 2)):
        found = simhash.links(df, Store(spark), agree=agree, group=group).collect()
        got = classes(fps, [(r["a"] % 2 ** 64, r["b"] % 2 ** 64) for r in found])
        assert got == want


def test_tiles_find_every_pair():
    rng = random.Random(3)
    fps = np.array(clusters(rng, 300), np.uint64)
    want = {frozenset((int(a), int(b))) for i, a in enumerate(fps) for b in fps[i + 1:] if int(a ^ b).bit_count() <= 3}
    for tile in (1, 7, 64, 1000):
        got = [frozenset((int(a), int(b))) for x, y in simhash.near(fps, 3, tile) for a, b in zip(x, y)]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    pairs += [(rng.randrange(6000, 6300), rng.randrange(6000, 6300)) for _ in range(150)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), Store(spark)).collect()}
    want = classes({n for p in pairs for n in p}, pairs)
    assert set(got) == set(want)
    assert len(set(zip(want.values(), (got[n] for n in want)))) == len(set(want.values())) == len(set(got.values()))
    assert graph.components(spark.createDataFrame([], "a long, b long"), Store(spark)).count() == 0


def test_documents_get_the_smallest_id_they_reach(spark, documents):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(300)) for _ in range(8)]
    rows = [(9, None), (8, ""), (7, " ")]
    for i in range(80):
        words = base[i % 8].split()
        for _ in range(i % 3):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 - i, " ".join(words)))
    rows += [(200, rows[5][1]), (200, rows[5][1])]
    got = simhash.near_duplicates(documents(rows)).collect()
    fps = {doc: plain(text) for doc, text in rows}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = classes(sorted(fps), pairs)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["fp"] % 2 ** 64 == fps[r["doc_id"]]
    assert len(set(want.values())) < len(fps) / 3


def test_null_ids_no_rows_and_other_columns(spark, documents):
    assert simhash.near_duplicates(documents([(1, "a")]).where("false")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d", 1), (3, "a b c d", 2), (None, "z", 3)], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(str, ((r["doc_id"], r["component_id"]) for r in got))) == ["(3, 3)", "(None, 3)", "(None, None)"]
    hexed = docs.select(F.lpad(F.lower(F.hex(F.lit(-1).cast("long"))), 16, "0")).first()[0]
    assert hexed == "f" * 16
