import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hearthlog.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = [None, "", " ", "a", "Hello world", "two  spaces", "tab\t x", " lead", "trail ", "a\n b\n\nc \n d", "é ü 漢字 😀 ½ ² x",
         "it's we'll THEY'VE 12 345", "x<|endoftext|>y <|endoftext|>", "a" * 5000, "word " * 3000, "  nb sp \x1c y",
         "\x85 next", "under_score a_b 1_2", "The quick brown fox. " * 900]


def test_ids_are_the_tokenizers(tokenizer):
    encoder = packing.Encoder(None)
    rng = random.Random(5)
    alphabet = ["a", "B", " ", " ", "\n", "\t", "'s", "é", "1", "²", "_", "-", " ", "\x1c", "the", "漢"]
    texts = [t for t in TEXTS if t] + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, text


def test_the_fullest_set_is_found():
    rng = random.Random(2)
    for _ in range(300):
        counts = dict(sorted(((n, rng.randrange(1, 4)) for n in rng.sample(range(1, 25), 4)), reverse=True))
        room = rng.randrange(60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        use = packing.fullest(counts, room)
        assert sum(n * k for n, k in use.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in use.items())


def test_plans_use_every_piece_once_and_nearly_fill():
    rng = random.Random(4)
    histogram = {n: rng.randrange(1, 2000) for n in range(1, 1025)}
    patterns = packing.plan(histogram)
    used = defaultdict(int)
    for use, times in patterns:
        assert sum(n * k for n, k in use.items()) <= 1024 and times > 0
        for n, k in use.items():
            used[n] += k * times
    assert used == histogram
    total = sum(n * c for n, c in histogram.items())
    least = max(-(-total // 1024), sum(c for n, c in histogram.items() if n > 512))
    # Lengths spread evenly are hard to pair: 1.5 per cent above the bound here.
    assert sum(times for _, times in patterns) <= least * 1.02 and len(patterns) < 5000
    assert packing.plan({}) == []


def test_pieces_cover_documents_and_sequences_have_no_gaps(documents, tokenizer):
    rows = list(enumerate(TEXTS)) + [(3, "a")] * 3 + [(100 + i, "w " * (i * 7 % 50)) for i in range(150)]
    docs = documents(rows).repartition(4)
    got = packing.pack(docs, ids=True).collect()
    texts = defaultdict(list)
    for doc, text in rows:
        texts[doc].append(text)
    count = defaultdict(int)
    for r in got:
        count[r["doc_id"], r["piece"]] += 1
        ids = tokenizer.encode(texts[r["doc_id"]][0] or "", add_special_tokens=False).ids + [2]
        part = ids[r["start"]:r["start"] + r["length"]]
        assert r["ids"] == part and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        first = len(ids) % 1024 or min(len(ids), 1024)
        assert (r["start"], r["length"]) == ((0, first) if r["piece"] == 0 else (first + 1024 * (r["piece"] - 1), 1024))
    for doc, all_ in texts.items():
        n = len(tokenizer.encode(all_[0] or "", add_special_tokens=False).ids) + 1
        assert {p: c for (d, p), c in count.items() if d == doc} == {p: len(all_) for p in range(-(-n // 1024))}
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 1024) + 1


def test_null_ids_no_rows_and_other_columns(spark, documents):
    assert packing.pack(documents([(1, "a")]).where("false")).count() == 0
    docs = spark.createDataFrame([(None, "a", 1), (None, None, 2)], "doc_id long, text string, length long")
    got = packing.pack(docs).collect()
    assert sorted(r["length"] for r in got) == [1, 2] and {r["doc_id"] for r in got} == {None}
    assert {r["sequence_id"] for r in got} == {0} and sorted(r["offset"] for r in got) in ([0, 1], [0, 2])
