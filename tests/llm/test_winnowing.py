import random
import re

import numpy as np
import pytest

from hearthlog.llm import winnowing

ITEMS = "item_id long, text string"


def parts(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, size):
    windows = {}
    for item, text in items:
        ws = parts(text)
        for i in range(max(1, len(ws) - size + 1) if ws else 0):
            windows.setdefault(tuple(ws[i:i + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        ws, hit, found = parts(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(ws) - n + 1):
                there = windows.get(tuple(ws[i:i + n]))
                if there:
                    hit.update(range(i, i + n))
                    found |= there
        out.append((doc, len(ws), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def found(documents, spark, docs, items, size):
    rows = winnowing.contaminated(documents(docs).repartition(3), spark.createDataFrame(items, ITEMS), size).collect()
    assert all(r["n_items"] == len(r["items"]) and r["contaminated"] == (r["n_hit"] > 0) for r in rows)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in rows), key=str)


@pytest.mark.parametrize("size, letters", [(10, "ab"), (4, "abcdef"), (1, "abcdefgh")])
def test_equals_brute_force(documents, spark, size, letters):
    rng = random.Random(size)

    def text(n):
        return "".join(rng.choice(letters) + rng.choice([" ", ", ", "\n", "--", "é ", "'"]) for _ in range(n))
    items = [(i, text(rng.randrange(0, 3 * size))) for i in range(20)]
    items += [(3, text(size)), (None, text(size + 1)), (30, None), (31, ""), (32, " .,"), (33, items[2][1])]
    docs = [(i, text(rng.randrange(40))) for i in range(60)]
    docs += [(100 + i, text(5) + items[i][1].upper() + text(5)) for i in range(10)]
    docs += [(200, None), (201, ""), (202, "x"), (203, text(3000)), (100, docs[60][1]), (100, docs[60][1]), (None, items[1][1])]
    want = brute(docs, items, size)
    assert sum(n for _, _, n, _ in want) > 50
    assert found(documents, spark, docs, items, size) == want


def test_a_short_item_is_one_window(documents, spark):
    docs = [(1, "So Alpha beta, gamma delta."), (2, "alpha beta gamma"), (3, "alpha beta"), (4, "beta gamma alpha beta gamma delta alpha beta gamma")]
    got = found(documents, spark, docs, [(7, "ALPHA beta gamma")], 10)
    assert got == [(1, 5, 3, ("7",)), (2, 3, 3, ("7",)), (3, 2, 0, ()), (4, 9, 6, ("7",))]


def test_every_span_of_enough_words_keeps_a_run_in_common():
    rng = np.random.default_rng(4)
    for size in range(1, 14):
        for _ in range(30):
            span = rng.integers(0, 3, size).astype(np.uint64)
            sides = [np.concatenate([rng.integers(0, 3, rng.integers(0, 9)), span, rng.integers(0, 3, rng.integers(0, 9))]).astype(np.uint64) for _ in "ab"]
            a, b = (set(winnowing.fingerprints(side, size)[1].tolist()) for side in sides)
            assert a & b


def test_no_rows_no_items_and_clashing_columns(documents, spark):
    none, items = spark.createDataFrame([], ITEMS), [(1, "one two three")]
    assert found(documents, spark, [(1, "a b")], [], 10) == [(1, 2, 0, ())]
    assert winnowing.contaminated(documents([(1, "a")]).where("false"), none).count() == 0
    clash = spark.createDataFrame([(5, "one two three four", 9, "x")], "doc_id long, text string, n_hit int, window string")
    more = spark.createDataFrame([(1, "one two three", 2)], "item_id long, text string, size int")
    assert [(r["n_hit"], r["items"]) for r in winnowing.contaminated(clash, more).collect()] == [(3, ["1"])]
    assert found(documents, spark, [(1, "one two three")], items, 3) == [(1, 3, 3, ("1",))]
