import random

from hearthlog.llm import lines


def brute(rows):
    """Text and removed lines of each document, from every chunk there is."""
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        rows_ = (text or "").split("\n")
        full = [i for i, line in enumerate(rows_) if line.strip(" \t\n\r\v\f")]
        long = [i for i in full if len(rows_[i].split()) > lines.LONG_WORDS]
        spans = [(i, i) for i in long] + [(a, b) for a, b in zip(full, full[1:]) if not (a in long and b in long)]
        gone = set()
        for start, end in sorted(spans):
            body = tuple(rows_[start:end + 1])
            there, last = seen.setdefault(body, (doc, end))
            if (there, last) != (doc, end):
                gone.update(range(max(start, last + 1) if there == doc else start, end + 1))
        left = "\n".join(line for i, line in enumerate(rows_) if i not in gone)
        out[doc] = (None if text is None else left, len(gone), sum(i - 1 not in gone for i in gone))
    return out


def planted():
    rng = random.Random(5)
    passages = [[f"passage {k} line {i}" for i in range(2 + k % 4)] for k in range(20)]
    lone = " ".join(f"w{i}" for i in range(lines.LONG_WORDS + 1))
    rows = []
    for doc in range(60):
        own = [f"own {doc} {i} {rng.random()}" for i in range(rng.randrange(1, 12))]
        at = rng.randrange(len(own) + 1)
        own[at:at] = passages[doc % 20] if doc < 40 else [lone] if doc < 50 else ["short line by itself"]
        rows.append((doc, "\n".join(own)))
    return rows, passages, lone


def test_short_passages_in_different_documents_go(documents):
    rows, passages, lone = planted()
    got = {r["doc_id"]: r for r in lines.passage_dedup(documents(rows).repartition(5)).collect()}
    for doc in range(60):
        want = (len(passages[doc % 20]) if 20 <= doc < 40 else 0) + (40 < doc < 50)
        assert got[doc]["n_removed"] == want, doc
        assert got[doc]["n_chunks_removed"] == bool(want)
    assert sum(lone in r["text"] for r in got.values()) == 1
    assert sum("short line by itself" in r["text"] for r in got.values()) == 10


def test_equals_brute_force(documents):
    rng = random.Random(7)
    words = ["a", "b", "c", "d", "", " ", "e" * 9, " ".join("xyz" * 20)]
    rows = planted()[0] + [(100 + i, "\n".join(rng.choices(words, k=rng.randrange(12)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n \n\n"), (203, "\n \n\n"), (204, "same\n" * 3000), (205, "same\n" * 3000),
             (206, "\n".join(f"long {i}" for i in range(20000))), (207, "new\n" + rows[3][1]), (208, "p\n\nq"), (209, "p\n\nq\n\nr")]
    got = {r["doc_id"]: r for r in lines.passage_dedup(documents(rows).repartition(5)).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    for doc, text in rows:
        assert (got[doc]["text"], got[doc]["n_removed"], got[doc]["n_chunks_removed"]) == want[doc], doc
        assert got[doc]["n_lines"] == (text or "").count("\n") + 1
    assert got[204]["n_removed"] > 2990


def test_no_rows_nulls_and_repeated_rows(spark, documents):
    assert lines.passage_dedup(documents([(1, "a")]).where("false")).count() == 0
    text = "\n".join(f"line {i}" for i in range(30))
    docs = spark.createDataFrame([(None, text, 1), (None, text, 1), (5, text, 2)], "doc_id long, text string, removed int")
    got = {(r["doc_id"], r["removed"]): r["n_removed"] for r in lines.passage_dedup(docs).collect()}
    assert got == {(None, 1): 0, (5, 2): 30} and lines.passage_dedup(docs).count() == 3
