import random
import zlib
from collections import Counter, defaultdict

from hearthlog.llm import sharding


def corpus():
    rng = random.Random(6)
    line = "a line that is long enough to link the documents that share it, whatever else they say in it"
    rows = [(i, "hot text") for i in range(160)]
    rows += [(200 + i, f"own {rng.random()}") for i in range(150)]
    rows += [(400 + i, f"copies {i % 20}") for i in range(60)]
    rows += [(500 + i, f"{rng.random()}\n{line} {i % 4}\n{rng.random()}") for i in range(40)]
    return rows + [(600, None), (601, None), (602, ""), (603, "é" * 50000), (604, "x"), (604, "x"), (None, "x")]


def check(rows, got, shards):
    texts = defaultdict(list)
    for doc, text in rows:
        texts[doc].append(text)
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    for r in got:
        text = texts[r["doc_id"]][0]
        assert r["size"] == len((text or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text or "").encode())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, ())) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    return counts


def cut(rows, got):
    by, group = {r["doc_id"]: r["shard"] for r in got}, defaultdict(set)
    for doc, text in rows:
        group[text].add(by[doc])
    return sum(len(s) - 1 for s in group.values())


def test_counts_are_even_and_copies_stay_together(documents):
    rows = corpus()
    docs = documents(rows).repartition(5)
    got = sharding.shard(docs).collect()
    check(rows, got, 8)
    before = cut(rows, sharding.shard(docs, rounds=0).collect())
    # The hot text fills at least two and touches at most three more.
    assert cut(rows, got) <= before and cut(rows, got) <= 5
    lines = defaultdict(set)
    by = {r["doc_id"]: r["shard"] for r in got}
    for i in range(40):
        lines[i % 4].add(by[500 + i])
    assert sum(map(len, lines.values())) <= 6


def test_other_numbers_of_shards(documents):
    rows = corpus()[140:177]
    for shards in (1, 50):
        check(rows, sharding.shard(documents(rows), shards, rounds=1).collect(), shards)


def test_grants_keep_counts():
    rng = random.Random(1)
    for _ in range(200):
        wish = {(a, b): rng.randrange(20) for a in range(4) for b in range(4) if a != b}
        free = {a: rng.randrange(15) for a in range(4)}
        move, fill = sharding.granted(wish, free, 4)
        for a in range(4):
            out = sum(n for (x, _), n in move.items() if x == a) + sum(n for (x, _), n in fill.items() if x == a)
            into = sum(n for (_, y), n in move.items() if y == a) + sum(n for (_, y), n in fill.items() if y == a)
            assert out == into
            assert sum(n for (x, _), n in fill.items() if x == a) <= free[a]
        assert all(n <= wish[k] for k, n in move.items())


def test_no_rows_and_other_columns(documents, spark):
    assert sharding.shard(documents([(1, "a")]).where("false")).count() == 0
    docs = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "doc_id long, text string, row int")
    assert sorted(r["doc_id"] for r in sharding.shard(docs, 2).collect()) == [1, 2]
