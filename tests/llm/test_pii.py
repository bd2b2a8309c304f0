import hashlib
import re

import pytest

from hearthlog.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits(found):
    return re.sub("[^0-9]", "", found)


PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15))


def brute(text):
    text = text or ""
    found = [(m.start(), i, name, m.end()) for i, (name, pattern, good) in enumerate(PLAIN)
             for m in re.finditer(pattern, text) if good(m.group())]
    return [f"{name}:{start}:{end}" for start, _, name, end in sorted(found)]


def base(row):
    return [s for s in row["spans"].split(",") if s.split(":")[0] in pii.BASE]


TEXTS = [
    None, "", "no data here", "mail a.b+c@x.example.com, or é😀 q@w.co", "a@b.c_d@e.f.", "a@b@c.d e@f", "@x.y a@ .a@b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3 9.9.9.9999", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "41111111111111114111111111111111", "4111  1111 1111 1111", "+1 (348) 555-4944 +49(0)30 1234567 +1 2 +(12) 3456789012",
    "+1 (348) 555-4944 4111 1111 1111 1111 10.0.0.1 a@b.cd", "++1234567890-", "12.34.56.78@9.9.9.9 +12.34.56.78.90",
    "line\n1.1.1.1\n2.2.2.2\r\n", "GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789 or 123-45-6789",
    "x" * 10000 + "@a.b", "1" * 20000, "1." * 20000, "a@" + "b." * 9000 + "c", "+" + "(" * 100000, "9 " * 20000]


def test_base_spans_equal_plain_regular_expressions(documents):
    docs = documents(enumerate_rows(TEXTS)).repartition(4)
    got = {r["doc_id"]: r for r in columns(docs).collect()}
    for i, text in enumerate(TEXTS):
        want = brute(text)
        assert base(got[i]) == want, (i, text and text[:80])
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        for name, _, _ in PLAIN:
            assert got[i][f"n_{name}"] == sum(s.startswith(name + ":") for s in want)


def enumerate_rows(texts):
    return [(i, t) for i, t in enumerate(texts)]


def columns(docs):
    return pii.digest(pii.personal_data(docs))


def test_checksums_and_context_decide_on_added_spans(documents):
    rows = {r["doc_id"]: r for r in columns(documents(enumerate_rows(TEXTS[16:18] + TEXTS[:2]))).collect()}
    assert rows[0]["n_iban"] == 1 and "iban:0:27" in rows[0]["spans"]
    assert rows[1]["n_ssn"] == 1 and rows[1]["spans"] == "ssn:4:15"


def test_empty_table_null_ids_repeats_and_other_columns(spark, documents):
    assert columns(documents([(1, "a@b.cd")]).where("false")).count() == 0
    docs = spark.createDataFrame([(None, "a@b.cd", "x"), (None, "a@b.cd", "x")], "doc_id long, text string, found string")
    rows = columns(docs).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["n_email"] == 1


def test_generated_texts(documents):
    hypothesis = pytest.importorskip("hypothesis")
    from hypothesis import strategies as st
    texts = []

    @hypothesis.settings(max_examples=300, deadline=None, derandomize=True, database=None)
    @hypothesis.given(st.lists(st.sampled_from(list("a1@.+- ()_9é\n") + ["12.3", "@b.c", "4111111111111111", "+123456789"]), max_size=25))
    def grow(parts):
        texts.append("".join(parts))
    grow()
    got = {r["doc_id"]: r for r in columns(documents(enumerate_rows(texts)).repartition(4)).collect()}
    for i, text in enumerate(texts):
        assert base(got[i]) == brute(text), text
