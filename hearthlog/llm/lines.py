"""Repeated passages removed line by line, in chunks whose edges the lines choose.

A hash rolling over two lines decides where a chunk starts, so text inserted above a
passage does not shift the chunks inside it. Chunks that an earlier document has too are
removed after their bytes have been compared. The edges of a passage lie in chunks that
do not repeat as a whole; there every two neighbouring lines, and every long line, are
compared in the same way, so each match is grown as far as it goes. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import KEY, WORD, Store, carried, keyed, once, table

MEAN_LINES = 4      # one line in so many starts a chunk
LONG_WORDS = 50     # a line of more words is compared by itself
SALTS = 16          # tasks that the occurrences of one passage are dealt to
PLACE = [*KEY, "start", "end"]

SPACE = r"[\x20\x09-\x0D]"
LONG = rf"^{SPACE}*+(?:{WORD}+{SPACE}++){{{LONG_WORDS}}}{WORD}"


def chunked(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns `keep` and `_chunks`: start, end, h and spans of each chunk.

    Blank lines are looked through. A chunk starts where the hash of a line and the next
    one says so, and goes on through the line that starts the next chunk, so any two
    neighbouring lines lie in one chunk. Its spans (start, end, h) are those two lines,
    if not both are long, and each long line by itself.
    """
    split = once(F.split(F.coalesce(text, F.lit("")), "\n", -1), "_lines", *keep, source=rows)
    full = F.filter(F.transform("_lines", lambda line, i: F.when(line.rlike(WORD), F.struct(
        i.alias("at"), F.xxhash64(line).alias("h"), line.rlike(LONG).alias("long")))), lambda line: line.isNotNull())
    full = once(full, "_full", *keep, source=split)
    fewer = F.greatest(F.size("_full") - 1, F.lit(0))

    def span(a, b):
        return F.struct(a["at"].alias("start"), b["at"].alias("end"), F.xxhash64(a["h"], b["h"], b["at"] - a["at"]).alias("h"))
    ahead = [F.slice("_full", F.lit(1), fewer), F.slice("_full", F.lit(2), fewer)]
    rolled = F.zip_with(*ahead, lambda a, b: F.xxhash64(a["h"], b["h"]))
    starts = F.filter(F.transform(rolled, lambda h, i: F.when((F.pmod(h, F.lit(MEAN_LINES)) == 0) | (i == 0), i)), lambda i: i.isNotNull())
    only = F.when(F.size("_full") == 1, F.array(F.lit(0))).otherwise(starts)
    pairs = F.zip_with(*ahead, lambda a, b: F.when(~(a["long"] & b["long"]), span(a, b)))
    alone = F.transform("_full", lambda a: F.when(a["long"], span(a, a)))
    ready = full.select(*keep, "_full", F.explode(F.array(F.struct(only.alias("starts"), pairs.alias("pairs"), alone.alias("alone")))).alias("_of"))

    def chunk(start, k):
        last = k + 1 == F.size("_of.starts")
        end = F.when(last, F.size("_full") - 1).otherwise(F.get("_of.starts", k + 1))
        inside = F.slice("_full", start + 1, end - start + 1)
        spans = F.concat(F.slice("_of.pairs", start + 1, end - start), F.slice("_of.alone", start + 1, end - start + last.cast("int")))
        first = F.get("_full", start)["at"]
        return F.struct(first.alias("start"), F.get("_full", end)["at"].alias("end"),
                        F.xxhash64(F.transform(inside, lambda line: F.struct(line["h"], line["at"] - first))).alias("h"),
                        F.filter(spans, lambda one: one.isNotNull()).alias("spans"))
    return once(F.transform("_of.starts", chunk), "_chunks", *keep, source=ready)


def bodies(rows: DataFrame, spans: DataFrame, store: Store) -> DataFrame:
    """`spans` (KEY, start, end, h) of `rows` (KEY, _body) with their bytes."""
    suspects = spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end", "h")).alias("spans"))
    # Only suspects' texts are moved, and cut after the join, by merging.
    found = rows.join(suspects.hint("merge"), KEY)
    found = once(F.split("_body", "\n", -1), "_lines", *KEY, "spans", source=found)

    def body(span):
        one, two = F.get("_lines", span["start"]), F.get("_lines", span["end"])
        return (F.when(span["start"] == span["end"], one).when(span["start"] + 1 == span["end"], F.concat_ws("\n", one, two))
                .otherwise(F.array_join(F.slice("_lines", span["start"] + 1, span["end"] - span["start"] + 1), "\n")))
    cut = F.transform("spans", lambda span: F.struct(span["start"].alias("start"), span["end"].alias("end"),
                                                     span["h"].alias("h"), body(span).alias("body")))
    return store.put(found.select(*KEY, F.inline(cut)), "bodies")


def with_first(found: DataFrame, place: list[str]) -> DataFrame:
    """PLACE of `found` (PLACE, h, body) and `first`, the smallest `place` of equal bytes.

    Where all bytes of a hash are equal, as nearly always, the hash alone is joined, and
    a passage that is everywhere is dealt to SALTS tasks.
    """
    per = found.groupBy("h").agg((F.min("body") == F.max("body")).alias("one"), F.min(F.struct(*place)).alias("first"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = found.select(*PLACE, "h", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)).cast("int").alias("salt"))
    same = salted.join(per.where("one").select("h", "first", salts.alias("salt")), ["h", "salt"])
    several = found.join(per.where("NOT one").select("h"), "h", "left_semi")
    first = several.groupBy("h", "body").agg(F.min(F.struct(*place)).alias("first"))
    return same.select(*PLACE, "first").union(several.join(first, ["h", "body"]).select(*PLACE, "first"))


def repeated_lines(docs: DataFrame, store: Store) -> DataFrame:
    """KEY and `removed`: which lines of a document lie in what occurs earlier.

    Chunks that an earlier document has too go whole, so that copies leave here. All
    that is left is looked at two lines at a time, which grows each match to its edges.
    """
    rows = keyed(docs, F.col("text").alias("_body"))
    chunks = chunked(rows, "_body", *KEY).select(*KEY, F.inline("_chunks"))
    chunks = store.put(chunks.where((F.col("start") < F.col("end")) | (F.size("spans") > 0)), "chunks")  # a short line alone stays
    doc = F.struct(*KEY)
    again = chunks.groupBy("h").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi")).where("lo < hi").select("h")
    found = bodies(rows, chunks.join(again, "h", "left_semi").select(*PLACE, "h"), store)
    whole = store.put(with_first(found, KEY).where(doc > F.col("first")).select(*PLACE), "repeated-chunks")
    rest = chunks.join(whole, PLACE, "left_anti").select(*KEY, F.inline("spans"))
    rest = store.put(rest, "spans")
    again = rest.groupBy("h").count().where("count > 1").select("h")
    found = bodies(rows, rest.join(again, "h", "left_semi"), store)
    later = with_first(found, PLACE).where(F.struct(*PLACE) > F.col("first"))
    # What overlaps its own first occurrence leaves that one whole.
    own = (F.col("first._id") == F.col("_id")) & (F.col("first._text") == F.col("_text"))
    begin = F.when(own, F.greatest("start", F.col("first.end") + 1)).otherwise(F.col("start"))
    later = later.select(*KEY, begin.alias("begin"), "end").where("begin <= end")
    gone = whole.select(*KEY, F.col("start").alias("begin"), "end").union(later)
    gone = gone.select(*KEY, F.explode(F.sequence("begin", "end")).alias("at"))
    return gone.groupBy(*KEY).agg(F.collect_set("at").alias("removed"))


def passage_dedup(docs: DataFrame) -> DataFrame:
    """`docs` with the text that is left, then n_lines, n_removed (lines) and
    n_chunks_removed (runs of removed lines).

    A line goes if it lies in two lines, blank ones between them not counted, that
    occur earlier (smallest doc_id, null first, then from the top), or if it has over
    LONG_WORDS words and occurs earlier; so the first of equal lines always stays.
    Short lines repeated alone, and blank lines, stay. Null text stays null and has
    one empty line; a document may be left with an empty text. Other columns are
    kept, but for any of the three added names; no rows give no rows.
    """
    store = Store(docs.sparkSession)
    flags = store.put(repeated_lines(docs, store), "removed-lines")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    body = names[docs.columns.index("text")]
    joined = keyed(docs, *carried(docs)).join(flags.hint("merge"), KEY, "left")
    joined = joined.select(*names, F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    split = once(F.split(F.coalesce(body, F.lit("")), "\n", -1), "_lines", *names, "removed", source=joined)
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "removed")
    text = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    text = F.when(F.size("removed") == 0, F.col(body)).otherwise(text)
    runs = F.size(F.array_except("removed", F.transform("removed", lambda i: i + 1)))
    kept = [(text if c == "text" else F.col(name)).alias(c) for c, name in zip(docs.columns, names)
            if c not in ("n_lines", "n_removed", "n_chunks_removed")]
    return split.select(*kept, F.size("_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"),
                        runs.cast("long").alias("n_chunks_removed"))


def op7_line_dedup(spark, sf_dir):
    left = passage_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", "n_chunks_removed",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE = {}
