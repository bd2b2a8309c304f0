import hashlib
from collections import Counter

from hearthlog.llm import exact


def brute(rows):
    best, size = {}, Counter()
    for i, (doc, text) in enumerate(rows):
        key = text or ""
        size[key] += 1
        best[key] = max(best.get(key, (-1, -1)), (-1 if doc is None else doc, i))
    return best, size


ROWS = [(i, "hot") for i in range(60)] + [(100 + i, f"t{i % 17}") for i in range(40)] + [
    (200, None), (201, ""), (202, " "), (203, "é"), (204, "é"), (205, "x" * 300000), (206, "x" * 300000)]


def check(docs, rows, counters):
    got = exact.exact_duplicates(docs, counters).collect()
    best, size = brute(rows)
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for doc, text in rows:
        key = text or ""
        r = by[doc]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best[key][0], size[key], best[key][0] == doc)
        assert r["text_sha256"] == hashlib.sha256(key.encode()).hexdigest()


def test_all_summaries_give_the_same_groups(documents):
    docs = documents(ROWS).repartition(5)
    for counters in (1, 3, 1024):
        check(docs, ROWS, counters)


def test_a_digest_over_the_bound_is_always_proposed(documents, spark):
    docs = documents(ROWS).repartition(4)
    base = docs.selectExpr("unhex(sha2(coalesce(text, ''), 256)) AS digest")
    for counters in (1, 2, 5):
        found = {bytes(r[0]) for r in exact.frequent(base, counters).collect()}
        assert len(found) <= counters + 1
        if 60 > 2 * len(ROWS) / (counters + 1):
            assert hashlib.sha256(b"hot").digest() in found


def test_summary_keeps_the_guarantee():
    counts = exact.trimmed(Counter("aaaaabbbccd"), 2)
    assert set(counts) <= {"a", "b"} and counts["a"] >= 5 - 11 / 3


def test_null_ids_and_repeated_rows_keep_one(spark):
    rows = [(None, "a"), (None, "a"), (7, "b"), (7, "b"), (3, "b")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, row int")
    got = exact.exact_duplicates(docs).collect()
    assert len(got) == 5 and sum(r["kept"] for r in got) == 2
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(None, 2), (7, 3)}


def test_no_rows(documents):
    assert exact.exact_duplicates(documents([(1, "a")]).where("false")).count() == 0
