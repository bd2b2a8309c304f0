import random
from collections import Counter

from hearthlog.llm import lines
from hearthlog.llm.common import KEY, keyed
from pyspark.sql import functions as F


def chunks(docs):
    rows = lines.chunked(keyed(docs, "doc_id", F.col("text").alias("_body")), "_body", "doc_id")
    return rows.select("doc_id", F.inline("_chunks")).collect()


def test_chunks_cover_every_two_neighbours_once(documents):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["", " ", "word " * 60, f"line {rng.randrange(30)}"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    found = chunks(documents(list(enumerate(texts + ["", "one", "word " * 60]))))
    for doc, text in enumerate(texts):
        full = [i for i, line in enumerate(text.split("\n")) if line.strip()]
        mine = sorted((r["start"], r["end"], r["spans"]) for r in found if r["doc_id"] == doc)
        assert not full[1:] or (mine[0][0], mine[-1][1]) == (full[0], full[-1])
        assert all(a[1] == b[0] for a, b in zip(mine, mine[1:])) and all(a < b for a, b, _ in mine if full[1:])
        long = {i for i in full if len(text.split("\n")[i].split()) > lines.LONG_WORDS}
        want = Counter([(a, b) for a, b in zip(full, full[1:]) if not {a, b} <= long] + [(i, i) for i in long])
        assert Counter((s["start"], s["end"]) for _, _, spans in mine for s in spans) == want
    assert [len(r["spans"]) for r in found if r["doc_id"] >= len(texts)] == [0, 1]


def test_inserted_lines_do_not_shift_the_chunks_below(documents):
    body = [f"line {i} {i * 7919 % 100}" for i in range(200)]
    found = chunks(documents([(1, "\n".join(body)), (2, "\n".join(["x", "y", "z", *body])), (3, "\n".join([*body[:90], "new", *body[90:]]))]))
    hashes = {doc: {r["h"] for r in found if r["doc_id"] == doc} for doc in (1, 2, 3)}
    assert 20 < len(hashes[1]) < 90
    assert len(hashes[1] - hashes[2]) <= 1 and len(hashes[1] - hashes[3]) <= 2


def test_equal_hashes_of_different_bytes_are_told_apart(spark):
    rows = [(i, 0, 0, 1, 7, body) for i, body in enumerate(["a", "b", "a", "b", "c"])] + [(9, 0, 0, 1, 8, "d"), (10, 0, 0, 1, 8, "d")]
    found = spark.createDataFrame(rows, "_id long, _text long, start int, end int, h long, body string")
    got = {r["_id"]: r["first"]["_id"] for r in lines.with_first(found, KEY).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 4, 9: 9, 10: 9}
