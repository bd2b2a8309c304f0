import hashlib
import random

import numpy as np
import pytest

from hearthlog.llm import suffixes


def brute(rows, length):
    """Rows are (id, hash of the text, text); equal ids and hashes are one document."""
    seen, out = {}, {}
    for doc, key, text in sorted(set(rows)):
        cover = bytearray(len(text))
        for at in range(len(text) - length + 1):
            string = text[at:at + length]
            if string in seen:
                cover[at:at + length] = b"\1" * length
            seen[string] = True
        left = bytes(b for b, c in zip(text, cover) if not c)
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out[doc, key] = (len(text), sum(cover), spans, hashlib.sha256(left).hexdigest())
    return out


def text_of(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    passage = text_of(rng, words, 120)
    rows = []
    for doc in range(60):
        text = text_of(rng, words, rng.randrange(1, 150))
        if doc % 3 == 0:
            at, lo = rng.randrange(len(text)), rng.randrange(len(passage) // 2)
            text = text[:at] + passage[lo:lo + rng.randrange(90, 400)] + text[at:]
        if doc % 10 == 4:
            edited = rows[-1][1].split()
            for _ in range(3):
                edited[rng.randrange(len(edited))] = "changed"
            text = " ".join(edited)
        rows.append((doc, text))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, None), (103, ""), (104, "é" * 300), (105, "ab" * 400),
             (106, "x" * 99), (107, "x" * 100), (108, "x" * 100), (109, "y" * 100 + passage), (3, rows[3][1])]
    return rows


def test_columns_are_in_sorted_order():
    rng = random.Random(1)
    for n in range(60):
        width, count = rng.randrange(1, 25), rng.randrange(1, 30)
        rows = []
        for _ in range(count):
            lo = rng.randrange(width)
            hi = rng.randrange(lo, width + 1)
            rows.append(bytes(lo) + bytes(rng.choices(b"ab" if n % 2 else b"abcdefgh", k=hi - lo)) + bytes(width - hi))
        cells = np.array([list(r) for r in rows], np.uint8).reshape(count, width).T
        for column, order, shared in suffixes.columns(np.ascontiguousarray(cells)):
            found = [rows[i][column:].split(b"\0")[0] for i in order]
            assert found == sorted(found) and sorted(order.tolist()) == list(range(count))
            for i in range(1, count):
                a, b = found[i - 1], found[i]
                assert shared[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert shared[0] == 0


def test_blocks_cover_every_string_once_and_equal_ones_share_an_anchor():
    texts = [(t or "").encode() for _, t in corpus()]
    found = suffixes.blocks(texts, 100)
    anchors = {}
    count = 0
    for b in found.tolist():
        anchor, content, doc, at, n, off = b
        for start in range(at, at + n):
            string = texts[doc][start:start + 100]
            assert len(string) == 100 and 0 <= off - (start - at) <= 100 - suffixes.KMER
            assert anchors.setdefault(string, anchor) == anchor
            count += 1
    assert count == sum(max(0, len(t) - 99) for t in texts)


def check(spark, rows, hot):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {doc: found for (doc, _), found in brute([(d, 0, (t or "").encode()) for d, t in rows], 100).items()}
    got = suffixes.without_repeats(docs, hot=hot).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    assert sum(w[1] for w in want.values()) > 5000


@pytest.mark.parametrize("hot", [2048, 2])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "SLICE", 3000)
    monkeypatch.setattr(suffixes, "ANCHOR_GROUP", 4000)
    monkeypatch.setattr(suffixes, "STRING_GROUP", 20000)
    check(spark, corpus(), hot)


def test_null_ids_no_rows_and_other_columns(spark):
    text = "".join(random.Random(2).choices("abcdefg ", k=500))
    docs = spark.createDataFrame([(None, text, 1), (None, text, 1), (4, text + "!", 2)], "doc_id long, text string, gone int")
    got = sorted((str(r["doc_id"]), r["n_removed"], r["n_spans"]) for r in suffixes.without_repeats(docs).collect())
    assert got == [("4", 500, 1), ("None", 0, 0), ("None", 0, 0)]
    assert suffixes.without_repeats(docs.where("false")).count() == 0
