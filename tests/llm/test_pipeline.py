from collections import Counter

import corpus_pipeline
import numpy as np
import xxhash

from hearthlog.llm import lines, mixing, near, quality
from hearthlog.llm.common import Store

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_every_stage_works_on_all_the_last_one_kept(spark):
    """Each stage against its operator's result, applied row by row on the driver."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    store, done = Store(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        done[name] = docs = store.put(stage(spark, docs, FOLDER), name.replace(" ", "-"))
    whole = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    common = quality.common_lines(raw, store)
    model = quality.fit_from(raw, labels, common)
    places = {r["_id"]: r["common"] for r in common.collect()}
    kept = []
    for r in whole:
        n, _, _, _, repeat, content = quality.measures((r["text"] or "").encode(), model, places.get(r["doc_id"], []))
        if not (n < 10 or 100 * repeat > 20 * n) and content >= quality.SHARE * n:
            kept.append(tuple(r))
    assert rows(done["quality rules"]) == Counter(kept)
    assert done["line dedup"].count() == len(kept)
    after = {r["doc_id"]: r for r in done["line dedup"].collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    # One document of each component of pairs near in bits and in words: the smallest id.
    seen = {d: (np.array([xxhash.xxh64_intdigest(w, 42) for w in r["text"].encode().lower().split()], np.uint64),
                r["text"].lower().split()) for d, r in after.items()}
    fps = {d: near.fingerprint(hashes) for d, (hashes, _) in seen.items()}
    sets = {d: {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set() for d, (_, ws) in seen.items()}
    pairs = [(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) % 2 ** 64).bit_count() <= corpus_pipeline.NEAR["radius"]
             and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    root = {d: d for d in fps}
    for _ in fps:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"] for r in done["near dedup"].collect()} == {d for d in root if root[d] == d}
    taken = {r["doc_id"]: r["times"] for r in mixing.mixed(done["near dedup"]).collect()}
    assert Counter(r["doc_id"] for r in done["mix sources"].collect()) == Counter({d: n for d, n in taken.items() if n})
    assert Counter(r["doc_id"] for r in done["pack"].where("piece = 0").collect()) == Counter({d: n for d, n in taken.items() if n})
    assert {c for name in list(done)[:-1] for c in done[name].columns} == set(corpus_pipeline.COLUMNS)


def test_empty_and_repeated_rows(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "a", 0)] + [
        (7, "some words that make a text of eleven words in all", "en", None, 50)] * 2, schema)
    for some in (docs, docs.where("false")):
        out = some
        for _, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, out, FOLDER)
        out.collect()
    assert lines.passage_dedup(docs).count() == 4
    assert corpus_pipeline.near_dedup(spark, docs, FOLDER).count() == 2
