import random

import numpy as np

import corpus_pipeline
from hearthlog.llm import near, simhash


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    """Texts of some 200 words, copies of them with one to four words changed, and texts
    that share half their words."""
    rng = random.Random(11)
    rows = []
    for k in range(25):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(rng.randrange(150, 260))]
        rows.append(" ".join(words))
        for n in range(1, 5):
            copy = list(words)
            for at in rng.sample(range(len(copy)), n):
                copy[at] = f"new{rng.random()}"
            rows.append(" ".join(copy))
        rows.append(" ".join(words[:len(words) // 2] + [f"z{rng.randrange(900)}" for _ in words[len(words) // 2:]]))
    rows += [rows[0], rows[0].upper(), "", " \n", None, "one two", "one  TWO", "one three"]
    return list(enumerate(rows))


def test_only_texts_of_enough_shared_shingles_are_linked_and_nearly_all_of_them(documents):
    rows = corpus()
    sets = [grams(text) for _, text in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b]) >= 0.8]
    true = list(range(len(rows)))
    for _ in rows:
        for a, b in pairs:
            true[a] = true[b] = min(true[a], true[b])
    found = near.near_copies(documents(rows).repartition(5), **corpus_pipeline.NEAR).collect()
    root = {r["doc_id"]: r["root"] for r in found}
    # No text is linked to one that no chain of similar texts leads to.
    assert len({(root[i], true[i]) for i in root}) == len(set(root.values()))
    linked = sum(root[a] == root[b] for a, b in pairs)
    print(linked, "of", len(pairs), "pairs")
    assert linked >= 0.95 * len(pairs)
    # The query's radius leaves copies apart.
    narrow = {r["doc_id"]: r["root"] for r in simhash.near_duplicates(documents(rows)).collect()}
    assert sum(narrow[a] == narrow[b] for a, b in pairs) < 0.8 * linked
    # The smallest doc_id of each component stays.
    got = corpus_pipeline.near_dedup(documents(rows).sparkSession, documents(rows), None)
    first = {root[i]: i for i in sorted(root, reverse=True)}
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(first.values())


def test_large_groups_are_cut_without_loss(documents):
    rows = corpus()
    whole, cut = (near.near_copies(documents(rows), **corpus_pipeline.NEAR, group=group).groupBy("root").count() for group in (8192, 16))
    assert sorted(r["count"] for r in whole.collect()) == sorted(r["count"] for r in cut.collect())


def test_two_families_joined_by_few_pairs_are_one_component(documents):
    """Nearly all pairs across the families are too far apart in words; no cap may hide the few that are not."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]

    def family(start, n):
        out = []
        for _ in range(n):
            copy = list(start)
            for at in rng.sample(range(300), 1):
                copy[at] = f"n{rng.random()}"
            out.append(copy)
        return out
    other = list(base)
    for at in range(7, 300, 29):
        other[at] = f"o{at}"
    bridge = list(base)
    for at in range(7, 150, 29):
        bridge[at] = f"o{at}"
    rows = list(enumerate(" ".join(ws) for ws in family(base, 60) + family(other, 60) + [bridge]))
    sets = [grams(text) for _, text in rows]
    across = [(a, b) for a in range(60) for b in range(60, 120) if alike(sets[a], sets[b]) >= 0.8]
    found = near.near_copies(documents(rows).repartition(3), 14, 5, 0.8).collect()
    assert not across and len({r["root"] for r in found}) == 1
    found = near.near_copies(documents(rows[:120]).repartition(3), 14, 5, 0.8).collect()
    assert len({r["root"] for r in found}) == 2


def test_forests_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 200))
        fps = rng.integers(0, 1 << 8, n).astype(np.uint64)
        node = rng.permutation(1000)[:n]
        radius = int(rng.integers(0, 4))
        a, b = near.forest(node, fps, radius, [])
        place = {int(x): i for i, x in enumerate(node)}
        apart = [[(int(x) ^ int(y)).bit_count() for y in fps] for x in fps]
        pairs = sorted((apart[i][j], i, j) for i in range(n) for j in range(i) if apart[i][j] <= radius)

        def spanned(label, pairs):
            cost = many = 0
            for d, i, j in pairs:
                if label[i] != label[j]:
                    label, cost, many = [label[i] if x == label[j] else x for x in label], cost + d, many + 1
            return label, cost, many
        label, cost, many = spanned(list(range(n)), pairs)
        assert sum(apart[place[int(x)]][place[int(y)]] for x, y in zip(a, b)) == cost and len(a) == many
        root = rng.integers(0, 50, n)
        met = near.outside(node, fps, root, radius, [])[0]
        assert set(met.tolist()) == {int(node[k]) for _, i, j in pairs if root[i] != root[j] for k in (i, j)}
        sets = [np.unique(rng.integers(0, 12, rng.integers(0, 9))).astype("<u4") for _ in range(n)]
        a, b = near.alike_edges(node, fps, root, [x.tobytes() for x in sets], radius, [], 0.5)
        good = [(0, i, j) for _, i, j in pairs if near.alike(sets[i], sets[j]) >= 0.5]
        want, _, many = spanned([int(r) for r in root], good)
        got, _, _ = spanned([int(r) for r in root], [(0, place[int(x)], place[int(y)]) for x, y in zip(a, b)])
        assert len(a) == many and len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_every_pair_meets_first_in_one_group():
    rng = np.random.default_rng(2)
    cut = near.blocks((1 << 64) - 1, 13)
    masks = [cut[p] | cut[q] for p in range(13) for q in range(p + 1, 13)]
    for _ in range(200):
        x = int(rng.integers(0, 1 << 63))
        y = x ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 12), replace=False))
        pair = np.array([x, y], np.uint64)
        there = [m for m in masks if x & m == y & m]
        assert sum(bool(near.own(pair, np.array([0]), np.array([1]), near.earlier(near.signed(m), cut))[0]) for m in there) == 1


def test_no_rows(documents):
    assert corpus_pipeline.near_dedup(documents([(1, "a")]).sparkSession, documents([(1, "a")]).where("false"), None).count() == 0


def test_only_texts_that_a_forest_reaches_are_looked_at_again(documents, monkeypatch):
    """All members of a group were, so the rows grew with the square of the density of the corpus."""
    put, groups = near.Store.put, {}

    def seen(self, df, name):
        out = put(self, df, name)
        for r in out.collect() if name == "rows-again" else []:
            groups.setdefault((r["mask"], r["key"], r["class"]), []).append(r["fp"] % (1 << 64))
        return out
    monkeypatch.setattr(near.Store, "put", seen)
    rng = random.Random(5)
    rows = [" ".join(rng.choice(("aa", "bb", "cc", "dd")) for _ in range(12)) for _ in range(300)]
    near.near_copies(documents(list(enumerate(rows))), **corpus_pipeline.NEAR).count()
    assert groups
    for fps in groups.values():
        for at, fp in enumerate(fps):
            assert any((fp ^ other).bit_count() <= corpus_pipeline.NEAR["radius"] for k, other in enumerate(fps) if k != at)
