"""Phrase collocations from a prefix-free parsing of the corpus.

A piece of text is cut wherever a hash of three neighbouring words says so; each chunk
goes on through the words that ended it, so neighbours overlap by three words. Equal
chunks become one entry of a dictionary with the number of times they occur. An n-gram
of at most four words lies whole in the chunk that it starts in before the overlap, so
counting those of every distinct chunk, weighted, counts each occurrence once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.llm.common import Store, table

LONGEST = 4         # words of a phrase; chunks overlap by one less
EVERY = 32          # one run of words in so many ends a chunk
LEAST = 30          # occurrences of a phrase
COVERED = 80        # per cent of a phrase's occurrences that lie in one longer phrase
TOP = 2000
SCALE = 2_000_000
SEED = 12
BYTES_AT_ONCE = 1 << 22     # of text, taken together in a task
FILTER = 1 << 26    # bits of a filter of frequent words or pairs, whatever their number
KNOWN = 1 << 18     # words whose hashes a task remembers

# What ends a piece, and what separates words.
PIECE, BETWEEN = b".,;:!?\n\x0b\x0c\r", b" \t"
LOWER = bytes(10 if c in PIECE else 32 if c in BETWEEN else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Hashes(dict):
    """Hash of each word; forgets all once it knows too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


def mixed(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` neighbours."""
    out = np.full(max(0, len(hashes) - width + 1), width, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i:i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start, ..., end - 1 of every span, one after another."""
    size = ends - starts
    return np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)


def chunk_edges(hashes: np.ndarray, sizes: np.ndarray, every: int = EVERY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end, and whether its piece ends there, of the chunks of pieces of
    `sizes` words one after another."""
    over = LONGEST - 1
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(mixed(hashes, over) % np.uint64(every) == 0)
    # A run that ends a piece, or lies across two, ends no chunk.
    at = at[(at + over < ends[piece[at]]) & (piece[at] == piece[np.minimum(at + over, len(piece) - 1)])]
    cut = np.sort(np.concatenate([(at + over) * 2, ends * 2 + 1]))
    end, last = cut >> 1, (cut & 1).astype(bool)
    start = np.concatenate([[0], np.where(last, end, end - over)[:-1]]).astype(np.int64)
    return start, end, last


def chunks(docs: DataFrame) -> DataFrame:
    """lang, chunk (its words, a space between), last (its piece ends there), n of all of
    `docs` (lang, text); and, with no `last`, each word with the number of times it is
    there: one row per word and batch, to be summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            sizes = np.cumsum([len(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()])
            cuts = np.flatnonzero(np.diff(sizes // BYTES_AT_ONCE)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                yield from parsed(batch.slice(start, end - start), known)
    return docs.select("lang", "text").mapInArrow(run, "lang string, chunk string, last boolean, n long")


def parsed(batch: pa.RecordBatch, known: Hashes) -> Iterator[pa.RecordBatch]:
    texts = [(t or b"").translate(LOWER) for t in batch.column(1).cast(pa.binary()).to_pylist()]
    pieces = pc.split_pattern(pa.array(texts, pa.binary()).cast(pa.string()), "\n")
    split = pc.ascii_split_whitespace(pieces.flatten())
    words, piece = split.flatten(), pc.list_parent_indices(split)
    there = pc.greater(pc.binary_length(words), 0)
    words, piece = words.filter(there).dictionary_encode(), piece.filter(there).to_numpy()
    if not len(words):
        return
    owner = pc.list_parent_indices(pieces).to_numpy()[piece]
    word, texts = words.indices.to_numpy(), words.dictionary
    hashes = np.fromiter(map(known.__getitem__, texts.cast(pa.binary()).to_pylist()), np.uint64, len(texts))
    sizes = np.diff(np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1], [True]])))
    start, end, last = chunk_edges(hashes[word], sizes)
    inside = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - start)]), pa.int32()),
                                      texts.take(pa.array(word[spans(start, end)])))
    names = ["lang", "chunk", "last", "n"]
    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[start])), pc.binary_join(inside, " "), pa.array(last),
                                      pa.array(np.ones(len(start), np.int64))], names=names)
    lang = batch.column(0).dictionary_encode()
    of = lang.indices.to_numpy()[owner]
    each, n = np.unique(of.astype(np.int64) * len(texts) + word, return_counts=True)
    yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(each // len(texts))), texts.take(pa.array(each % len(texts))),
                                      pa.nulls(len(each), pa.bool_()), pa.array(n)], names=names)


def counted(dictionary: DataFrame, lengths: tuple[int, int], bits: Any) -> DataFrame:
    """lang, size, phrase, n of the phrases of `lengths` words in `dictionary`: one row
    per phrase and task's batch, to be summed. Only phrases whose words, for two words,
    or whose pairs of neighbours pass the filter `bits`.

    Within a batch words and phrases are numbered, so equal numbers are equal words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= BYTES_AT_ONCE:
                yield from grams(held, lengths, bits.value)
                held, size = [], 0
        if held:
            yield from grams(held, lengths, bits.value)
    return dictionary.select("lang", "chunk", "last", "n").mapInArrow(run, "lang string, size long, phrase string, n long")


def grams(batches: list[pa.RecordBatch], lengths: tuple[int, int], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    lang, chunk, last, times = (pa.concat_arrays([batch.column(i) for batch in batches]) for i in range(4))
    split, lang = pc.split_pattern(chunk, " "), lang.dictionary_encode()
    words = split.flatten().dictionary_encode()
    word, texts = words.indices.to_numpy().astype(np.int64), words.dictionary
    sizes = pc.list_value_length(split).to_numpy()
    stop = np.repeat(np.cumsum(sizes), sizes)
    # Words that the next chunk has too are not where a phrase starts.
    shared = np.where(last.to_numpy(zero_copy_only=False), 0, LONGEST - 1)
    weight = np.repeat(times.to_numpy(), sizes) * (np.arange(len(word)) < stop - np.repeat(shared, sizes))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in texts.cast(pa.binary()).to_pylist()), np.uint64, len(texts))
    if lengths[1] == 2:
        known = passes(bits, hashes)[word]
        good = known[:-1] & known[1:]
    else:
        good = passes(bits, pair_hash(hashes[word[:-1]], hashes[word[1:]]))
    # `name` numbers the language and the run of n - 1 words that starts at each of `at`.
    at, name = np.arange(len(word)), np.repeat(lang.indices.to_numpy(), sizes).astype(np.int64) * len(texts) + word
    for n in range(2, lengths[1] + 1):
        there = at + n <= stop[at]
        there[there] = good[at[there] + n - 2]
        at, name = at[there], name[there]
        _, first, name = np.unique(name * len(texts) + word[at + n - 1], return_index=True, return_inverse=True)
        if n < lengths[0] or not len(at):
            continue
        total = np.bincount(name, weight[at]).astype(np.int64)
        mine = np.flatnonzero(total)
        first = at[first[mine]]
        phrase = pc.binary_join_element_wise(*(texts.take(pa.array(word[first + i])) for i in range(n)), " ")
        of = np.searchsorted(np.cumsum(sizes), first, side="right")
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(lang.indices.take(pa.array(of))), pa.array(np.full(len(first), n)), phrase,
                                          pa.array(total[mine])], names=["lang", "size", "phrase", "n"])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(29)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    size, out = np.uint64(len(bits) * 64), np.ones(len(hashes), bool)
    for h in (hashes, hashes >> np.uint64(32) | hashes << np.uint64(32)):
        at = h % size
        out &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def filter_of(phrases: DataFrame, size: int = FILTER) -> np.ndarray:
    """A Bloom filter of `size` bits of `phrases` (phrase) of one or of two words;
    whatever their number, `size` / 64 rows at most reach the driver. A full filter lets
    more through and loses nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            each = [phrase.split(b" ") for phrase in batch.column(0).cast(pa.binary()).to_pylist()]
            h = np.fromiter((known[ws[0]] for ws in each), np.uint64, len(each))
            if each and len(each[0]) == 2:
                h = pair_hash(h, np.fromiter((known[ws[1]] for ws in each), np.uint64, len(each)))
            at = np.unique(np.concatenate([h, h >> np.uint64(32) | h << np.uint64(32)]) % np.uint64(size))
            where, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int64)), pa.array(value.view(np.int64))], names=["at", "bits"])
    rows = phrases.select("phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    out = np.zeros(size // 64, np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def phrase_counts(docs: DataFrame, least: int = LEAST, filter_bits: int = FILTER) -> tuple[DataFrame, DataFrame]:
    """lang, size, phrase, n of the phrases of 1 to LONGEST words that occur `least`
    times or more in `docs` (lang, text), and lang, total of all words.

    No phrase is more frequent than its words and pairs, so those that are too rare are
    left out before longer phrases are counted.
    """
    context, store = docs.sparkSession.sparkContext, Store(docs.sparkSession)
    found = chunks(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"))
    parse = store.put(found.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n")), "dictionary")
    dictionary, words = parse.where("last IS NOT NULL"), parse.where("last IS NULL")
    totals = store.put(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    often = store.put(words.where(F.col("n") >= least).select("lang", F.lit(1).cast("long").alias("size"), F.col("chunk").alias("phrase"), "n"), "words")
    out, above = [often], often
    for lengths in ((2, 2), (3, LONGEST)):
        bits = context.broadcast(filter_of(above, filter_bits))
        summed = counted(dictionary, lengths, bits).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
        above = store.put(summed.where(F.col("n") >= least), "phrases")
        out.append(above)
        bits.unpersist()
    store.drop(parse)
    return out[0].union(out[1]).union(out[2]), totals


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, filter_bits: int = FILTER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the `top` phrases of each language of
    `docs` (lang, text), best first.

    Phrases have 2 to LONGEST words, occur `least` times or more and score by the cut
    that speaks least for them: floor(SCALE * a / (l + r)), a, l and r being the counts
    of the phrase and of the two sides of the cut. A phrase goes if `covered` per cent of
    its occurrences lie in one longer phrase, be that kept or not. Null text is empty, a
    null language is `und`; repeated rows count as often as they are there; other columns
    are not read; no rows give no rows.
    """
    counts, totals = phrase_counts(docs, least, filter_bits)
    candidates = counts.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ")

    def joined(start, size):
        return F.array_join(F.slice(words, start, size), " ")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k").cast("int")).alias("left"),
                       joined((F.col("k") + 1).cast("int"), (F.col("size") - F.col("k")).cast("int")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    # Decimal, as the product may pass 64 bits.
    score = F.expr(f"CAST(a AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(10, 0)) DIV CAST(l + r AS DECIMAL(20, 0))")
    best = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    best = best.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    inside = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.lit(LONGEST - 1)), lambda size: F.transform(
        F.sequence(F.lit(1), F.lit(LONGEST - 1)), lambda start: F.when(
            (size < F.col("size")) & (start + size <= F.col("size") + 1), joined(start, size))))), lambda part: part.isNotNull())
    within = candidates.where("size > 2").select("lang", F.explode(inside).alias("phrase"), "a")
    within = within.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(within, ["lang", "phrase"], "left").where(
        F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"),
                                            F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"))


def op12_phrases(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_phrases": op12_phrases}
ORACLE = {"op12_phrases": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, piece_text FROM (
  SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece_text FROM documents)),
w AS (SELECT lang, piece, unnest(ws) AS w1, unnest(range(len(ws))) AS i FROM (
  SELECT lang, piece, regexp_extract_all(piece_text, '[^\x20\x09]+') AS ws FROM p)),
x AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS MATERIALIZED (SELECT lang, 1 AS size, w1 AS phrase, count(*) AS n FROM x GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 AS phrase, count(*) FROM x WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM x WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) FROM x WHERE w4 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(n) AS n FROM f WHERE size = 1 GROUP BY 1),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND n >= {LEAST}),
sides AS (SELECT lang, phrase, a, k, array_to_string(ws[:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
cut AS (SELECT s.lang, s.phrase, a, k, l.n AS l, r.n AS r, (a::HUGEINT * {SCALE}) // (l.n + r.n) AS score
  FROM sides s JOIN f l ON l.lang = s.lang AND l.phrase = s.first JOIN f r ON r.lang = s.lang AND r.phrase = s.rest),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(ws[s:s + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best LEFT JOIN inside USING (lang, phrase) JOIN n USING (lang) WHERE most IS NULL OR 100 * most < {COVERED} * a
QUALIFY rank <= {TOP}"""}
