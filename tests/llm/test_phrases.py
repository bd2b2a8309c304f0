import random
import re
from collections import Counter, defaultdict

import numpy as np

from hearthlog.llm import phrases


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [ws for ws in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)) if ws]


def brute(rows, least, covered, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for ws in pieces(text):
            totals[lang or "und"] += len(ws)
            for n in range(1, 5):
                counts[lang or "und"].update(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, f in counts.items():
        there, found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, []
        for p, a in there.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in there.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= covered * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -score)
                for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    words = ["New", "york", "city", "é", "of", "The", "state", "a", "b", "漢字", "x-1", " "]
    rows = []
    for i in range(300):
        text = "".join(rng.choices(words, [9, 8, 7, 2, 9, 9, 3, 3, 3, 2, 1, 1])[0] + rng.choice([" "] * 12 + ["\t", ". ", "\n", "  ", "!?", "\x0b"])
                       for _ in range(rng.randrange(80)))
        rows.append((rng.choice(["en", "de", None, "und"]), text + rng.choice(["", " new york city of the", " . "])))
    return rows + [("en", "one two three four five six " * 400), ("en", None), ("en", ""), ("fr", "too few words"), ("de", " , ")] + [("en", rows[0][1])] * 50


def found(documents, rows, **options):
    docs = documents([(i, text) for i, (_, text) in enumerate(rows)]).sparkSession.createDataFrame(
        [(i, text, lang, "x") for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string, phrase string")
    got = phrases.collocations(docs.repartition(4), **options).collect()
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got)


def test_equals_brute_force(documents, monkeypatch):
    rows = corpus()
    want = brute(rows, 10, 80, 40)
    assert len(want) > 60 and len({r[0] for r in want}) == 3
    assert found(documents, rows, least=10, top=40) == want
    # A full filter only lets more through.
    assert found(documents, rows, least=10, top=40, filter_bits=64) == want


def test_no_rows(documents):
    assert found(documents, []) == [] and found(documents, [("en", None), (None, "a b")]) == []


def test_chunks_overlap_and_own_every_phrase_once():
    rng = np.random.default_rng(2)
    for every in (1, 2, 5, 1000):
        sizes = rng.integers(1, 30, 60)
        word = rng.integers(0, 6, sizes.sum())
        start, end, last = phrases.chunk_edges(word.astype(np.uint64) * np.uint64(77777777777), sizes, every)
        stops = np.cumsum(sizes)
        want = Counter((i, n) for a, b in zip(stops - sizes, stops) for n in range(1, 5) for i in range(a, b - n + 1))
        got = Counter((i, n) for a, b, whole in zip(start, end, last) for n in range(1, 5)
                      for i in range(a, b - n + 1) if i < (b if whole else b - 3))
        assert got == want
        assert every > 1 or len(start) > len(sizes)


def test_equal_text_is_cut_alike():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    sides = [np.concatenate([rng.integers(0, 1 << 60, n).astype(np.uint64), shared]) for n in (7, 90)]
    cuts = []
    for side in sides:
        start, end, _ = phrases.chunk_edges(side, np.array([len(side)]))
        cuts.append({(a - len(side), b - len(side)) for a, b in zip(start, end) if a >= len(side) - 350})
    assert cuts[0] == cuts[1] and len(cuts[0]) > 5
