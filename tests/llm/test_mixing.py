import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from hearthlog.llm import mixing
from hearthlog.llm.common import Store


def level(sizes, weights, share=1.5, most=2.0):
    """Targets by refilling one round at a time."""
    out, rest, open_ = [0.0] * len(sizes), share * sum(sizes), [i for i, n in enumerate(sizes) if n]
    while open_ and rest > 0:
        unit = rest / sum(weights[i % len(weights)] for i in open_)
        full = [i for i in open_ if unit * weights[i % len(weights)] >= most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else unit * weights[i % len(weights)]
        rest -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full] if full else []
    return out


def test_targets_stop_at_twice_a_source_and_reshare(spark):
    def found(sizes, weights, **more):
        rows = spark.createDataFrame([(f"s{i:03}", n, i) for i, n in enumerate(sizes)], "source string, source_size long, place long")
        return [r["target"] for r in mixing.targets(rows, weights, **more).orderBy("source").collect()]
    assert level([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    rng = random.Random(2)
    cases = [([100, 100, 100], (3, 1, 2)), ([10, 1000, 10], (3, 1, 2)), ([0, 0], (3, 1)), ([], (3, 1)), ([0, 8], (3, 1)),
             ([rng.choice([0, 1, 5, 50, 5000]) for _ in range(60)], (3, 1, 2))]
    for sizes, weights in cases:
        assert found(sizes, weights) == pytest.approx(level(sizes, weights)), sizes
    assert found([5, 5], (1, 1), share=3.0) == [10, 10]


def test_sources_are_numbered_by_code_point_null_last(spark):
    names = ["b", "a", "", "\U0001F600", "\uffff", "Z", "é", None, *(f"n{i}" for i in range(300))]
    rows = spark.createDataFrame([(n,) for n in names], "source string").repartition(5)
    got = [r["source"] for r in mixing.placed(rows, Store(spark)).orderBy("place").collect()]
    assert got == sorted(names[:7] + names[8:], key=str.encode) + [None]


def test_fit_meets_the_best_a_subset_can():
    rng = random.Random(1)
    for k in range(300):
        lengths = sorted(rng.sample(range(0, 30), 5))
        counts = [rng.randrange(1, 5) for _ in lengths]
        budget = rng.randrange(sum(n * c for n, c in zip(lengths, counts)) + 3)
        mixing.HELD = 1 << 16 if k % 2 else 4
        take = mixing.fit(lengths, counts, budget)
        mixing.HELD = 1 << 16
        assert all(0 <= t <= c for t, c in zip(take, counts))
        got = sum(n * t for n, t in zip(lengths, take))
        sums = {sum(n * t for n, t in zip(lengths, pick)) for pick in itertools.product(*(range(c + 1) for c in counts))}
        best = max(s for s in sums if s <= budget)
        assert got == best if k % 2 else best - 2 * max(lengths) <= got <= best


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_source_takes_the_best_a_subset_can(sf):
    """All subsets' sums by a bitset over every document, against what `fit` takes."""
    sizes = defaultdict(list)
    for text, source in duckdb.sql(f"SELECT text, source FROM '/root/testdata/{sf}/documents.parquet'").fetchall():
        sizes[source].append(len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))
    for source, each in sizes.items():
        words, count = sum(each), Counter(each)
        for share in (0.999, 0.7, 0.31):
            budget, reach = int(words * share), 1
            for n in each:
                reach |= reach << n
                if reach >> budget & 1:
                    break
            best = (reach & ((1 << budget + 1) - 1)).bit_length() - 1
            lengths = sorted(count)
            take = mixing.fit(lengths, [count[n] for n in lengths], budget)
            assert sum(n * t for n, t in zip(lengths, take)) == best, (source, share)


def test_fit_is_exact_when_small_lengths_are_plenty():
    lengths, counts = [1, 2, 37, 80], [900, 90, 40, 40]
    for budget in range(1, 6000, 61):
        take = mixing.fit(lengths, counts, budget)
        assert sum(n * t for n, t in zip(lengths, take)) == min(budget, sum(n * c for n, c in zip(lengths, counts)))


ROWS = [(i, " ".join(["w"] * (i % 13)), f"s{i % 4}") for i in range(400)] + [
    (500, None, "s1"), (501, "", "s1"), (502, "a b c\td\ne", None), (503, "x " * 40000, "s2"), (504, "x", ""), (504, "x", "")]


def check(rows, got):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    per = defaultdict(int)
    for (_, _, source), size in zip(rows, sizes):
        per[source] += size
    names = sorted(per, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, level([per[n] for n in names], mixing.WEIGHTS)))
    taken = defaultdict(int)
    by = {r[0]: (size, r[2]) for r, size in zip(rows, sizes)}
    for r in got:
        size, source = by[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size, per[source]) and r["target"] == pytest.approx(goal[source])
        assert 0 <= r["taken"] <= 2 * size and (size == 0 or r["taken"] % size == 0)
        taken[source] += r["taken"]
    return taken, goal


def test_every_source_comes_near_its_target(documents):
    docs = documents(ROWS).repartition(4)
    got = mixing.mixed(docs).collect()
    taken, goal = check(ROWS, got)
    for source in ("s0", "s1", "s3"):
        assert abs(taken[source] - goal[source]) <= 1
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_rows_come_as_often_as_they_are_taken(documents):
    docs = documents(ROWS)
    want = Counter()
    for r in mixing.mixed(docs).collect():
        want[r["doc_id"]] += r["times"]
    rows = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({k: v for k, v in want.items() if v})
    assert rows[0].__fields__ == docs.columns


def test_no_rows_no_words_and_other_columns(documents, spark):
    assert mixing.mixed(documents([(1, "a")]).where("false")).count() == 0
    assert mixing.mix(documents([(1, "a")]).where("false")).count() == 0
    got = mixing.mixed(documents([(1, None), (2, " ")])).collect()
    assert [(r["target"], r["taken"]) for r in got] == [(0, 0), (0, 0)]
    docs = spark.createDataFrame([(None, "a b", None, 5), (None, "a b", None, 6)], "doc_id long, text string, source string, rank int")
    assert mixing.mixed(docs).count() == 2
    assert sum(len((r["text"]).split()) for r in mixing.mix(docs).collect()) == 6
