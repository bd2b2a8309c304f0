import random

from hearthlog.llm import wordpiece


def greedy(word, pieces, longest=None):
    count, at = 0, 0
    longest = max(map(len, pieces), default=0) if longest is None else longest
    while at < len(word):
        size = next((n for n in range(min(longest, len(word) - at), 0, -1) if word[at:at + n] in pieces), 0)
        if not size:
            return 1
        count, at = count + 1, at + size
    return count


def test_equals_greedy_matching_on_random_vocabularies():
    rng = random.Random(8)
    for _ in range(300):
        pieces = {bytes(rng.choices(b"abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 14))}
        automaton = wordpiece.Automaton(pieces)
        for _ in range(40):
            word = bytes(rng.choices(b"abc", k=rng.randrange(0, 14)))
            assert automaton.pieces(word) == greedy(word, pieces), (pieces, word)


def test_equals_greedy_matching_on_documents(spark, documents):
    pieces = set(wordpiece.vocabulary())
    longest = max(map(len, pieces))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in wordpiece.token_counts(docs).collect():
        words = texts[r["doc_id"]].encode().split()
        assert (r["n_words"], r["n_bytes"]) == (len(words), len(texts[r["doc_id"]].encode()))
        assert r["n_tokens"] == sum(greedy(b" " + w, pieces, longest) for w in words)


def test_edges(spark, documents):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "é 漢 x"), (5, "a" * 300000), (6, "a b " * 100000), (6, "x")]
    got = {(r["doc_id"], r["n_words"]): r["n_tokens"] for r in wordpiece.token_counts(documents(rows)).collect()}
    pieces = set(wordpiece.vocabulary())
    assert got[1, 0] == got[2, 0] == got[3, 0] == 0 and (6, 1) in got
    assert got[4, 2] == greedy(" é 漢".encode(), pieces) + 1
    assert got[5, 1] == greedy(b" " + b"a" * 300000, pieces) and got[6, 200000] == 200000
    assert wordpiece.token_counts(documents(rows).where("false")).count() == 0
    docs = spark.createDataFrame([(None, "a", 9)], "doc_id long, text string, n_tokens int")
    assert wordpiece.token_counts(docs).collect()[0]["n_tokens"] == 1
