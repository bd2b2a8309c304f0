import itertools
import random
import re

import numpy as np
import pytest

from hearthlog.llm import quality
from hearthlog.llm.common import Store


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    dup, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            inside.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


TEXTS = ["", " \n\t", "one", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n\nx ", "é漢 | # <b> $5\n\n\n", "a b c d e f " * 3, "q w e r t y u i o p a s d"]


def test_counts_equal_brute_force():
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choices("abcd", k=rng.randrange(40))) + rng.choice(["", "\nx\nx", " é"]) for _ in range(300)]
    for text in texts:
        assert quality.measures(text.encode(), quality.ALL_CONTENT, [])[:5] == brute(text), text


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(1)
    for _ in range(100):
        model = quality.Model(rng.normal(size=quality.FEATURES), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.normal(size=(rng.integers(1, 8), quality.FEATURES))
        score = x @ model.emit

        def total(labels):
            return (model.first[labels[0]] + sum(s for s, y in zip(score, labels) if y)
                    + sum(model.move[a, b] for a, b in zip(labels, labels[1:])))
        best = max(itertools.product((0, 1), repeat=len(x)), key=total)
        assert tuple(model.decode(x)) == best


def test_the_gradient_climbs_the_likelihood():
    rng = np.random.default_rng(2)
    examples = []
    for q in (0, 1) * 20:
        labels = rng.integers(0, 2, rng.integers(1, 6)) if q else np.zeros(rng.integers(1, 6), int)
        examples.append((rng.normal(labels[:, None], 1, (len(labels), quality.FEATURES)), labels, q))

    def likelihood(model):
        total = 0.0
        for x, labels, _ in examples:
            score = x @ model.emit
            def path(ys):
                return (model.first[ys[0]] + sum(s for s, y in zip(score, ys) if y)
                        + sum(model.move[a, b] for a, b in zip(ys, ys[1:])))
            paths = np.array([path(p) for p in itertools.product((0, 1), repeat=len(x))])
            total += (path(tuple(labels)) - np.logaddexp.reduce(paths)) / len(x)
        return total
    fits = [likelihood(quality.fit(examples, rounds)) for rounds in (0, 5, 60)]
    assert fits[0] < fits[1] < fits[2]
    one = (np.ones((1, quality.FEATURES)), np.ones(1, int), 1)
    assert quality.fit([one]) is quality.ALL_CONTENT and quality.fit([]) is quality.ALL_CONTENT
    # The slope is that of the likelihood itself.
    model = quality.Model(rng.normal(size=quality.FEATURES), rng.normal(size=(2, 2)), rng.normal(size=2))
    ups = [sum(parts) for parts in zip(*(quality.uphill(model, *array) for array in quality.segments(examples)))]
    for param, up in zip((model.emit, model.move, model.first), ups):
        param.flat[0] += 1e-4
        after = likelihood(model)
        param.flat[0] -= 2e-4
        assert (after - likelihood(model)) / 2e-4 == pytest.approx(up.flat[0] * 40, abs=1e-3)
        param.flat[0] += 1e-4


def test_long_texts_are_cut_for_the_fit_only():
    x = np.random.default_rng(1).normal(size=(300, quality.FEATURES))
    arrays = list(quality.segments([(x, np.ones(300, int), 1), (x[:3], np.zeros(3, int), 0)]))
    assert sum(there.sum() for _, _, there, _, _ in arrays) == 303 and sum(begins.sum() for *_, begins in arrays) == 2


def planted(rng, n):
    """Good pages with a frame of lines from a small stock around their own lines, and junk pages."""
    stock = [" ".join(f"frame{rng.randrange(10 ** 6)}" for _ in range(9)) + "." for _ in range(30)]
    rows, labels = [], []
    for i in range(n):
        own = [" ".join(f"word{rng.randrange(10 ** 6)}" for _ in range(12)) + "." for _ in range(6)]
        if i % 3:
            frame = rng.sample(stock, 6)
            rows.append((i, "\n".join(frame[:3] + own + frame[3:])))
        else:
            rows.append((i, "\n".join(" | ".join(f"Item{rng.randrange(10 ** 6)}" for _ in range(12)) for _ in range(8))))
        labels.append((i, int(i % 3 > 0), 0))
    return rows, labels


def test_a_framed_page_is_split_at_the_right_lines(spark, documents):
    rows, labels = planted(random.Random(6), 240)
    docs = documents(rows)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    common = quality.common_lines(docs, Store(spark))
    places = {r["_id"]: sorted(r["common"]) for r in common.collect()}
    assert all(places[i] == [0, 1, 2, 9, 10, 11] for i, _ in rows if i % 3)
    model = quality.fit_from(docs, labels.where("doc_id < 120"), common, sample=60)
    for i, text in rows[120:]:
        features = quality.line_features(text.encode().split(b"\n"), places.get(i, []))[0]
        assert model.decode(features).tolist() == ([0] * 3 + [1] * 6 + [0] * 3 if i % 3 else [0] * 8)
    got = {r["_row"]["doc_id"]: r for r in quality.judged(docs, model, common, ["doc_id"]).collect()}
    assert all(got[i]["kept"] == bool(i % 3) for i in range(240))
    assert all(0 < got[i]["n_content_words"] < got[i]["n_words"] for i in range(240) if i % 3)


def test_copies_make_no_line_common(spark, documents):
    text = "\n".join(f"a line of its own {i}" for i in range(9))
    rows = [(i, text) for i in range(50)] + [(60 + i, text.replace("own 4", f"own x{i}")) for i in range(9)] + [(80 + i, f"{i}\ntold thrice\n{i * i}") for i in range(3)]
    found = quality.common_lines(documents(rows + [(None, None), (99, "")]), Store(spark)).collect()
    assert {(r["_id"], tuple(r["common"])) for r in found} == {(80 + i, (1,)) for i in range(3)}


def test_held_out_labels_are_found(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    common = quality.common_lines(docs, Store(spark))
    model = quality.fit_from(docs, labels.where("doc_id % 2 = 0"), common, sample=100)
    rows = quality.judged(docs, model, common, ["doc_id"]).selectExpr("_row.doc_id AS doc_id", "kept", "base_failed", "n_content_words / n_words AS share")
    held = rows.join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good, bad = [r for r in held if r["quality"] == 1], [r for r in held if r["quality"] == 0]
    print(sum(r["kept"] for r in good), len(good), sum(not r["kept"] for r in bad), len(bad), sum(0 < r["share"] < 1 for r in held), len(held))
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(not r["kept"] for r in bad) >= 0.8 * len(bad)
    assert sum(0 < r["share"] < 1 for r in good) >= 0.1 * len(good)


def test_rows_pass_whole(spark, documents):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (51, "word " * 200000), (51, "w x y z a b c d e f g"), (51, "w x y z a b c d e f g")]
    docs = documents(rows)
    common = quality.common_lines(docs, Store(spark))
    out = quality.judged(docs, quality.ALL_CONTENT, common)
    assert out.select("_row.*").columns == docs.columns and out.count() == len(rows)
    by = {(r["_row"]["doc_id"], r["n_words"]): r for r in out.collect()}
    assert by[50, 0]["base_failed"] and not by[50, 0]["kept"]
    assert by[51, 200000]["base_failed"] and by[51, 11]["kept"] and by[8, 13]["kept"] and by[3, 10]["base_failed"]
    assert quality.judged(docs.where("false"), quality.ALL_CONTENT, common).count() == 0
    clash = spark.createDataFrame([(None, "a", 3)], "doc_id long, text string, n_words int")
    assert quality.judged(clash, quality.ALL_CONTENT, common).select("_row.n_words", "n_words").first() == (3, 1)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit_from(docs, empty, common) is quality.ALL_CONTENT
    assert quality.fit_from(docs, spark.createDataFrame([(1, 1, 0), (None, 0, 0)], empty.schema), common) is quality.ALL_CONTENT


def test_ties_go_to_content():
    model = quality.Model(np.zeros(quality.FEATURES), np.zeros((2, 2)), np.zeros(2))
    assert pytest.approx(1) == model.decode(np.ones((4, quality.FEATURES))).mean()
