"""Quality rules: counts of the whole text, and lines labelled content or boilerplate.

A linear-chain conditional random field over the lines is fitted on a bounded sample
of labelled documents. Its truth differs from line to line: lines of bad documents are
boilerplate, and so are lines that the corpus repeats in ever other surroundings; the
rest is content. Viterbi decoding finds each document's likeliest labels, and the share
of its words that lie in content lines decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import KEY, WORD, Store, keyed, table

# The rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
WINDOW = 5
MOST_REPEATED = 20      # per cent of words

# Parameters of the fit and of the verdict.
SAMPLE = 400            # labelled documents of each class, by a hash of their id
SEGMENT = 128           # lines of a text that the fit pads and passes together; it sees all of them
PLACES = 3              # different surroundings that make a repeated line boilerplate,
MOVING = 50             # if they are at least so many per cent of the different texts that have it
ROUNDS = 150
STEP = 0.3
PENALTY = 1e-3
SHARE = 0.25            # of words in content lines: a page may be mostly frame, not nearly all of it
DIGITS, UPPER, STOPS = b"0123456789", bytes(range(65, 91)), b".!?:;,\"')"
FEATURES = 10


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    each = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    # Windows are named pair by pair, so equal numbers mean equal words.
    name, width = each, 1
    while width < window:
        step = min(width, window - width)
        pair = name[:len(name) - step] * (int(name.max()) + 1) + name[step:]
        name, width = np.unique(pair, return_inverse=True)[1], width + step
    again = np.bincount(name)[name] > 1
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:n])))


def line_features(lines: list[bytes], common: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Features and words of each line, and how many lines with a word equal an earlier
    one; `common` are the places of lines the corpus repeats in other surroundings."""
    rows, counts, seen, again, common = [], [], set(), 0, set(common)
    for at, line in enumerate(lines):
        words = line.split()
        n, size = len(words), max(1, len(line))
        repeat = n > 0 and line in seen
        again += repeat
        seen.add(line)
        counts.append(n)
        if not n:
            rows.append((1.0,) + (0.0,) * (FEATURES - 1))
            continue
        rows.append((
            1.0, len(set(words)) / n, 10.0 * (size - len(line.translate(None, SYMBOLS))) / size,
            (size - len(line.translate(None, DIGITS))) / size, (size - len(line.translate(None, UPPER))) / size,
            float(line.rstrip()[-1:] in STOPS), float(repeat), float(at in common), min(n, 40) / 40.0, min(size / n, 40.0) / 20.0))
    return np.array(rows), np.array(counts, np.int64), again


@dataclass
class Model:
    """Scores of content over boilerplate by feature, of moving between the two, and
    of the first line."""
    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The likeliest labels, 1 for content; ties go to content."""
        score = features @ self.emit
        (bb, bc), (cb, cc) = self.move.tolist()
        best_b, best_c = self.first.tolist()
        best_c += float(score[0])
        back = []
        for s in score[1:].tolist():
            from_b, from_c = best_b + bc > best_c + cc, best_b + bb > best_c + cb
            back.append((from_c, from_b))
            best_b, best_c = (best_b + bb if from_c else best_c + cb), (best_b + bc if from_b else best_c + cc) + s
        at, labels = int(best_c >= best_b), []
        labels.append(at)
        for b_from_b, c_from_b in reversed(back):
            at = int(not (c_from_b if at else b_from_b))
            labels.append(at)
        return np.array(labels[::-1])


ALL_CONTENT = Model(np.array([1e3] + [0.0] * (FEATURES - 1)), np.zeros((2, 2)), np.zeros(2))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def segments(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Lines of like many in arrays: features, truth, which are there, weight of a line
    of each row, and whether the row begins its text. Classes of texts weigh alike."""
    count = np.bincount([quality for _, _, quality in examples], minlength=2)
    cut = [(x[i:i + SEGMENT], y[i:i + SEGMENT], 0.5 / count[quality] / len(x), i == 0)
           for x, y, quality in examples for i in range(0, len(x), SEGMENT)]
    for power in range(SEGMENT.bit_length()):
        some = [one for one in cut if (len(one[0]) - 1).bit_length() == power]
        if some:
            x, y = np.zeros((len(some), 1 << power, FEATURES)), np.zeros((len(some), 1 << power), np.int64)
            there = np.zeros(y.shape, bool)
            for i, (features, truth, _, _) in enumerate(some):
                x[i, :len(features)], y[i, :len(truth)], there[i, :len(truth)] = features, truth, True
            yield x, y, there, np.array([one[2] for one in some]), np.array([one[3] for one in some])


def uphill(model: Model, x, y, there, weight, begins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradient of the likelihood of one array of lines."""
    longest = x.shape[1]
    score = np.stack([np.zeros(x.shape[:2]), x @ model.emit], 2)
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[:, 0] = begins[:, None] * model.first + score[:, 0]
    for t in range(1, longest):
        new = log_sum(ahead[:, t - 1, :, None] + model.move, 1) + score[:, t]
        ahead[:, t] = np.where(there[:, t, None], new, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        new = log_sum(model.move + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(there[:, t + 1, None], new, 0.0)
    total = log_sum(ahead[:, -1], 1)
    mean = np.exp(ahead + behind - total[:, None, None]) * there[:, :, None]
    truth = np.stack([y == 0, y == 1], 2) * there[:, :, None]
    emit = np.einsum("dt,dtf,d->f", truth[:, :, 1] - mean[:, :, 1], x, weight)
    pairs = np.exp(ahead[:, :-1, :, None] + model.move + (score + behind)[:, 1:, None, :] - total[:, None, None, None])
    move = np.einsum("dtij,d->ij", truth[:, :-1, :, None] * truth[:, 1:, None, :] - pairs * there[:, 1:, None, None], weight)
    return emit, move, ((truth[:, 0] - mean[:, 0]) * (weight * begins)[:, None]).sum(0)


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = ROUNDS) -> Model:
    """Gradient ascent on the likelihood of the labels of (features, labels, quality).

    Without examples of both qualities, every line is content.
    """
    if len({quality for _, _, quality in examples}) < 2:
        return ALL_CONTENT
    arrays = list(segments(examples))
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2))
    params = (model.emit, model.move, model.first)
    speed = [np.zeros_like(p) for p in params]
    for _ in range(rounds):
        ups = [sum(parts) for parts in zip(*(uphill(model, *array) for array in arrays))]
        for param, up, moving in zip(params, ups, speed):
            moving *= 0.9
            moving += STEP * (up - PENALTY * param)
            param += moving
    return model


def common_lines(docs: DataFrame, store: Store) -> DataFrame:
    """KEY and `common`: the places of lines that the corpus repeats under PLACES
    different lines or more, and over as many, and nearly as many as texts. Copies of a
    text count once; lines that near copies share keep a neighbour. Nothing above or
    below is different each time."""
    rows = keyed(docs, F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    hashes = F.filter(F.transform("lines", lambda line, i: F.when(line.rlike(WORD), F.struct(i.alias("at"), F.xxhash64(line).alias("h")))),
                      lambda line: line.isNotNull())
    rows = rows.select(*KEY, F.explode(F.array(hashes)).alias("lines"))
    each = F.transform("lines", lambda line, i: F.struct(
        line["at"].alias("at"), line["h"].alias("h"), F.when(i > 0, F.get("lines", i - 1)["h"]).alias("above"), F.get("lines", i + 1)["h"].alias("below")))
    found = store.put(rows.select(*KEY, F.inline(each)), "lines")
    texts = found.select("h", "above", "below", "_text").distinct()

    def sides(name):
        return F.count_distinct(name) + F.count(F.when(F.col(name).isNull(), 1))
    moving = texts.groupBy("h").agg(F.least(sides("above"), sides("below")).alias("places"), F.count_distinct("_text").alias("texts"))
    moving = moving.where((F.col("places") >= PLACES) & (100 * F.col("places") >= MOVING * F.col("texts"))).select("h")
    return store.put(found.join(store.put(moving, "common-lines"), "h", "left_semi").groupBy(*KEY).agg(F.collect_set("at").alias("common")), "common")


def marked(docs: DataFrame, common: DataFrame) -> DataFrame:
    """`docs` as `_row`, with KEY, text and `common`."""
    rows = keyed(docs, F.struct("*").alias("_row"), "text")
    return rows.join(common, KEY, "left").select(*KEY, "_row", "text", F.coalesce("common", F.array().cast("array<int>")).alias("common"))


def fit_from(docs: DataFrame, labels: DataFrame, common: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """A model from at most `sample` labelled rows of each class, with all their lines."""
    both = [labels.where(F.col("quality") == q).select("doc_id", "quality").distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    # At most 2 * sample rows, so the broadcast has a bound.
    chosen = docs.select("doc_id", "text").join(F.broadcast(both[0].unionByName(both[1])), "doc_id")
    each = [marked(chosen.where(F.col("quality") == q), common).orderBy(F.xxhash64("_id"), *KEY).limit(sample) for q in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [line_features((t or b"").split(b"\n"), c)[0].astype("<f4").tobytes()
                    for t, c in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "quality": batch.column(1), "x": pa.array(rows, pa.binary()),
                                              "common": batch.column(3)})
    rows = each[0].union(each[1]).select("_id", "_row.quality", "text", "common")
    rows = rows.mapInArrow(run, "doc_id long, quality int, x binary, common array<int>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["x"])))
    examples = []
    for r in rows:
        x = np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES).astype(float)
        labels = np.full(len(x), r["quality"])
        labels[r["common"]] = 0
        examples.append((x, labels, r["quality"]))
    return fit(examples, rounds)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_content_words"]


def measures(text: bytes, model: Model, common: list[int]) -> tuple[int, ...]:
    words, lines = text.split(), text.split(b"\n")
    features, counts, again = line_features(lines, common)
    content = int(counts[model.decode(features) == 1].sum()) if words else 0
    inside = b"".join(words)
    return len(words), len(inside.decode()), len(text) - len(text.translate(None, SYMBOLS)), again, repeated_words(words), content


def judged(docs: DataFrame, model: Model, common: DataFrame, keep: list[str] | None = None, share: float = SHARE) -> DataFrame:
    """`_row`, the columns `keep` of every row of `docs` (all unless named), with
    NAMES, base_failed and kept; `common` comes from `common_lines`.

    Null text counts as empty and has no words, so it fails. Rows of any length,
    equal rows and other columns are judged and kept as they are; no rows give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(t or b"", model, c) for t, c in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist())]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(NAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_row", *NAMES])

    rows = marked(docs, common).select(F.struct(*(f"_row.`{c}`" for c in keep or docs.columns)).alias("_row"), "text", "common")
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in NAMES)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    good = F.col("n_content_words") >= F.lit(share) * F.col("n_words")
    return rows.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("kept", ~failed & good)


def rated(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`judged` by a model fitted on what `labels` says about `docs`."""
    common = common_lines(docs, Store(docs.sparkSession))
    return judged(docs, fit_from(docs, labels, common), common, keep)


def op6_quality(spark, sf_dir):
    found = rated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("_row.doc_id", *NAMES, "base_failed", "kept")


QUERIES = {"op6_quality": op6_quality}
ORACLE = {}
