"""Repeated byte strings found through suffix order, and removed.

Every string of `length` bytes has an anchor: the leftmost of its `KMER`-grams with
the least hash. Equal strings have equal anchors, so a text is cut into blocks, runs
of strings with one anchor, and only blocks with equal anchors can share a string.

1. Blocks meet by anchor as hashes. Of blocks equal as a whole all but the first go.
2. The bytes of blocks that share an anchor but differ are fetched and aligned by the
   anchor, so equal strings begin in one column. Column by column from the right, each
   round inserts one symbol for every block and updates the collection's order, its
   transform and the bytes that neighbours share. Runs of neighbours that share
   `length` bytes are one string.
3. The bytes of each document that are covered by a string met before are removed.

An anchor that many blocks share is hot, and its blocks are taken apart into single
strings that meet by their own content. Equal blocks and strings of one slice are
reduced to the first before they are shuffled, so no group grows with a passage's
number of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import KEY, Store, keyed, table

LENGTH = 100
KMER = 32
SLICE = 4 << 20         # bytes of text worked on at once
HOT = 2048              # different blocks of one anchor, in a slice or in all
ANCHOR_GROUP = 8 << 20   # bytes of block records in a group
STRING_GROUP = 2 << 20    # bytes of blocks in a collection

BLOCK = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("n", "<u2"), ("off", "<u2")])
RUN = np.dtype([("at", "<u4"), ("n", "<u4")])
WANT = np.dtype([("at", "<u4"), ("n", "<u2"), ("off", "<u2"), ("anchor", "<u8")])   # anchor 0: string by string
PLACE = np.dtype([("id", "<i8"), ("text", "<i8"), ("at", "<u4"), ("size", "<u2"), ("off", "<u2")])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def kmer_hashes(data: np.ndarray, k: int = KMER) -> np.ndarray:
    """A hash of the `k` (a power of two) bytes at each place."""
    rng = np.random.default_rng(11)
    h, width = rng.integers(0, 1 << 64, 256, np.uint64)[data], 1
    while width < k:
        factor = rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        h = mixed(h[:-width] * factor + h[width:])
        width *= 2
    return h


def leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the first least value in the `width` values from each place on."""
    least, index, done = h, np.arange(len(h), dtype=np.int32), 1
    while done < width:
        step = min(done, width - done)
        later = least[step:] < least[:-step]
        least = np.where(later, least[step:], least[:-step])
        index = np.where(later, index[step:], index[:-step])
        done += step
    return index


def blocks(texts: list[bytes], length: int) -> np.ndarray:
    """The blocks of `texts`, `doc` counting in them: where the first string starts
    and how many there are, by hashes of the anchor and of all bytes; `off` is where
    the anchor lies from there."""
    chosen = [i for i, t in enumerate(texts) if len(t) >= length]
    if not chosen:
        return np.empty(0, BLOCK)
    data = np.frombuffer(b"".join(texts[i] for i in chosen), np.uint8)
    size = np.array([len(texts[i]) for i in chosen])
    begin = np.cumsum(size) - size
    h = kmer_hashes(data)
    anchor = leftmost_least(h, length - KMER + 1)
    strings = size - length + 1
    doc = np.repeat(np.arange(len(chosen)), strings)
    start = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings - begin, strings)
    at = anchor[start]
    first = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (doc[1:] != doc[:-1])) + 1])
    n = np.diff(np.concatenate([first, [len(start)]]))
    lo, doc, at = start[first], doc[first], at[first]
    end = lo + n - 1 + length - KMER
    content = mixed(n.astype(np.uint64) << np.uint64(16) ^ (at - lo).astype(np.uint64))
    for step in range(0, 2 * length, KMER):
        content = mixed(content * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(lo + step, end)])
    out = np.empty(len(first), BLOCK)
    out["anchor"], out["content"], out["doc"] = h[at], content, np.array(chosen)[doc]
    out["at"], out["n"], out["off"] = lo - begin[doc], n, at - lo
    return out


def slices(sizes: list[int], limit: int = SLICE) -> Iterator[slice]:
    """Runs of rows of `limit` bytes, or of one row."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if sizes:
        yield slice(start, len(sizes))


def repeats(keys: list[np.ndarray], refs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of entries equal in all `keys`: which one comes first by `refs`, and which are
    not at the first one's place. An entry at the same place is the same entry."""
    order = np.lexsort((*reversed(refs), *reversed(keys)))
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.cumsum(fresh) - 1
    head = order[fresh][group]
    moved = np.any([r[order] != r[head] for r in refs], axis=0) if len(order) else fresh
    return order[fresh], order[moved]


def by_document(ids: np.ndarray, texts: np.ndarray, gone: np.ndarray, want: np.ndarray, which: np.ndarray) -> dict[str, list]:
    """Rows of (KEY, gone, want); `which` counts the document of gone, then of want."""
    rows = {"_id": [], "_text": [], "gone": [], "want": []}
    parts = []
    for records, doc in ((gone, which[:len(gone)]), (want, which[len(gone):])):
        order = np.argsort(doc, kind="stable")
        records, doc = records[order], doc[order]
        cuts = np.flatnonzero(doc[1:] != doc[:-1]) + 1
        parts.append(dict(zip(doc[np.concatenate([[0], cuts])].tolist() if len(doc) else [], np.split(records, cuts))))
    for doc in {**parts[0], **parts[1]}:
        rows["_id"].append(int(ids[doc]))
        rows["_text"].append(int(texts[doc]))
        for name, part in zip(("gone", "want"), parts):
            rows[name].append(part[doc].tobytes() if doc in part else None)
    return rows


FLAGS = "_id long, _text long, gone binary, want binary"
RECORDS = "bucket int, keys binary, live binary, gone binary, hot binary, signals binary"


def to_anchors(length: int, buckets: int, hot: int):
    """Map side: block records by bucket of their anchor, what is settled set apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for part in slices([len(t) for t in texts]):
                found = blocks(texts[part], length)
                if len(found):
                    yield from packed(found, ids[part], hashes[part])

    def packed(found: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc = found["doc"]
        first, again = repeats([found["anchor"], found["content"]], [ids[doc], hashes[doc], found["at"]])
        gone, live = found[again], found[first]
        anchor, inverse, count = np.unique(live["anchor"], return_inverse=True, return_counts=True)
        many = count[inverse] >= hot
        signals, hots, live = anchor[count >= hot], live[many], live[~many]
        home = int(ids[0] % buckets)
        rows = {name: [] for name in ("bucket", "keys", "live", "gone", "hot", "signals")}
        bucket, flag = bucket_of(live["anchor"], buckets), bucket_of(signals, buckets)
        order = np.argsort(bucket, kind="stable")
        live, bucket = live[order], bucket[order]
        lo, hi = (np.searchsorted(bucket, np.arange(buckets), side) for side in ("left", "right"))
        for b in np.unique(np.concatenate([bucket, flag, [home]])).tolist():
            own = [live[lo[b]:hi[b]], *((gone, hots) if b == home else (gone[:0], hots[:0]))]
            used, inverse = np.unique(np.concatenate([o["doc"] for o in own]), return_inverse=True)
            at = 0
            for name, o in zip(("live", "gone", "hot"), own):
                o = o.copy()
                o["doc"] = inverse[at:at + len(o)]
                at += len(o)
                rows[name].append(o.tobytes())
            rows["bucket"].append(b)
            rows["keys"].append(np.stack([ids[used], hashes[used]], 1).astype("<i8").tobytes())
            rows["signals"].append(signals[flag == b].tobytes())
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in rows.items()})
    return run


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def at_anchors(hot: int):
    """Reduce side: equal blocks go but for the first; others of one anchor are wanted."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, "<i8").reshape(-1, 2) for k in part["keys"]]
        base = np.cumsum([0, *map(len, keys)])
        ids, hashes = np.concatenate(keys).T
        sets = {}
        for name in ("live", "gone", "hot"):
            each = [np.frombuffer(b, BLOCK).copy() for b in part[name]]
            for records, shift in zip(each, base):
                records["doc"] += np.uint32(shift)
            sets[name] = np.concatenate(each)
        signals = np.unique(np.concatenate([np.frombuffer(b, "<u8") for b in part["signals"]]))
        live, doc = sets["live"], sets["live"]["doc"]
        first, again = repeats([live["anchor"], live["content"]], [ids[doc], hashes[doc], live["at"]])
        gone, live = np.concatenate([sets["gone"], live[again]]), live[first]
        _, inverse, count = np.unique(live["anchor"], return_inverse=True, return_counts=True)
        count = count[inverse]
        many = (count >= hot) | np.isin(live["anchor"], signals)
        wanted = np.concatenate([live[many], sets["hot"], live[~many & (count > 1)]])
        want = np.zeros(len(wanted), WANT)
        want["at"], want["n"], want["off"] = wanted["at"], wanted["n"], wanted["off"]
        want["anchor"] = wanted["anchor"] | np.uint64(1)
        want["anchor"][:many.sum() + len(sets["hot"])] = 0
        out = np.empty(len(gone), RUN)
        out["at"], out["n"] = gone["at"], gone["n"]
        # A document known in several slices' keys is one document.
        whole, which = np.unique(np.stack([ids, hashes], 1), axis=0, return_inverse=True)
        which = which.reshape(-1)[np.concatenate([gone["doc"], wanted["doc"]]).astype(np.int64)]
        return pd.DataFrame(by_document(whole[:, 0], whole[:, 1], out, want, which))
    return run


STRINGS = "bucket int, places binary, bytes binary, gone binary"


def to_strings(length: int, buckets: int):
    """Map side: the bytes of wanted blocks by bucket of their anchor, and single
    strings of hot ones by bucket of their content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts, wants = batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()
            for part in slices([len(t) for t in texts]):
                yield packed(ids[part], hashes[part], texts[part], wants[part])

    def packed(ids, hashes, texts, wants) -> pa.RecordBatch:
        strings: dict[int, list] = {}
        seen: dict[bytes, tuple] = {}
        gone = []
        for key in sorted(range(len(ids)), key=lambda i: (ids[i], hashes[i])):
            text, doc = texts[key], (ids[key], hashes[key])
            want = np.concatenate([np.frombuffer(w, WANT) for w in wants[key]])
            for at, n, off, anchor in sorted(set(want.tolist())):
                if anchor:
                    strings.setdefault((anchor >> 20) % buckets, []).append((*doc, at, text[at:at + n - 1 + length], off))
                    continue
                for start in range(at, at + n):
                    string = text[start:start + length]
                    if string in seen:
                        if seen[string] != (*doc, start):
                            gone.append((*doc, start, 1, 0))
                        continue
                    seen[string] = (*doc, start)
                    strings.setdefault(xxhash.xxh64_intdigest(string) % buckets, []).append((*doc, start, string, off - (start - at)))
        rows = {"bucket": [], "places": [], "bytes": [], "gone": []}
        home = ids[0] % buckets
        for bucket in {*strings, home}:
            own = strings.get(bucket, [])
            rows["bucket"].append(bucket)
            rows["places"].append(np.array([(*s[:3], len(s[3]), s[4]) for s in own], PLACE).tobytes())
            rows["bytes"].append(b"".join(s[3] for s in own))
            rows["gone"].append(np.array(gone if bucket == home else [], PLACE).tobytes())
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in rows.items()})
    return run


def columns(cells: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each column of `cells` (columns by strings; 0: no byte) from the right: the
    strings in the order of what they hold from there on, and how many bytes each
    shares with the one before, up to the first 0 in either.

    A round inserts one symbol for every string. The symbols in the order so far are
    the transform; its stable order by symbol is the new order. Neighbours with one
    symbol share one byte more than the least shared between their former places.
    """
    count = cells.shape[1]
    order, shared = np.arange(count), np.zeros(count + 1, np.uint16)
    for column in range(len(cells) - 1, -1, -1):
        symbol = cells[column][order]
        place = np.argsort(symbol, kind="stable")
        kind = symbol[place]
        same = np.flatnonzero((kind[1:] == kind[:-1]) & (kind[1:] > 0)) + 1
        less = np.zeros(count + 1, np.uint16)
        if len(same):
            lo, hi = place[same - 1] + 1, place[same] + 1
            # From the last place to the first, so that only the ranges themselves are walked.
            down = np.argsort((count - lo).astype(np.uint16 if count < 65536 else np.int64), kind="stable")
            less[same[down]] = np.minimum.reduceat(shared, np.stack([lo[down], hi[down]], 1).ravel())[::2] + 1
        order, shared = order[place], less
        yield column, order, shared[:count]


def met_before(place: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """For each block of a collection, which of its strings come earlier in it."""
    size, off = place["size"].astype(np.int64), place["off"].astype(np.int64)
    left = int(off.max())
    begin, start = np.cumsum(size) - size, left - off
    cells = np.zeros((int((start + size).max()), len(place)), np.uint8)
    owner = np.repeat(np.arange(len(place)), size)
    cells[np.arange(len(data)) - (begin - start)[owner], owner] = data + 1      # no byte of UTF-8 is 255
    # Strings of one column lie alike from their anchors, so anchors tell which is first.
    key = np.rec.fromarrays([place["id"], place["text"], place["at"] + off])
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    out = np.zeros((len(place), int((size - length).max()) + 1), bool)
    for column, order, shared in columns(cells):
        alike = shared >= length
        if column > left or not alike.any():
            continue
        first = np.flatnonzero(~alike)
        best = np.minimum.reduceat(rank[order], first)
        late = order[rank[order] > best[np.cumsum(~alike) - 1]]
        out[late, column - start[late]] = True
    return out


def at_strings(length: int):
    """Reduce side: strings of a collection that were met before, by document."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        place = np.concatenate([np.frombuffer(b, PLACE) for b in part["places"]])
        rest = np.concatenate([np.frombuffer(b, PLACE) for b in part["gone"]])
        data = np.frombuffer(b"".join(part["bytes"]), np.uint8)
        owner, nth = np.nonzero(met_before(place, data, length)) if len(place) else (np.empty(0, np.int64),) * 2
        ids = np.concatenate([place["id"][owner], rest["id"]])
        texts = np.concatenate([place["text"][owner], rest["text"]])
        starts = np.concatenate([place["at"][owner] + nth, rest["at"]]).astype(np.int64)
        # Neighbouring starts become runs.
        order = np.lexsort((starts, texts, ids))
        ids, texts, starts = ids[order], texts[order], starts[order]
        head = np.ones(len(order), bool)
        head[1:] = (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1]) | (starts[1:] > starts[:-1] + 1)
        first = np.flatnonzero(head)
        out = np.empty(len(first), RUN)
        if len(first):
            out["at"], out["n"] = starts[first], np.maximum.reduceat(starts, first) - starts[first] + 1
        doc = np.cumsum(np.concatenate([[False], (ids[first][1:] != ids[first][:-1]) | (texts[first][1:] != texts[first][:-1])]))[:len(first)]
        heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(first) else first
        return pd.DataFrame(by_document(ids[first][heads], texts[first][heads], out, np.empty(0, WANT), doc))
    return run


def removed(text: bytes, gone: list[bytes], length: int) -> tuple[int, int, bytes]:
    """Bytes removed, their maximal runs, and the rest."""
    if not gone:
        return 0, 0, text
    run = np.concatenate([np.frombuffer(g, RUN) for g in gone])
    at = run["at"].astype(np.int64)
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + run["n"] - 1 + length, -1)
    cover = np.cumsum(edge[:-1]) > 0
    spans = int(cover[0]) + int(np.count_nonzero(cover[1:] & ~cover[:-1]))
    return int(cover.sum()), spans, np.frombuffer(text, np.uint8)[~cover].tobytes()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, kept: bool = True) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 and, if asked for, `kept`, the bytes left (a character may be cut).

    Documents come by doc_id, null first, then by a hash of their text; rows equal in
    both are one document, and each gets its result. Null text is empty. Strings are
    judged on the texts as they came. Other columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    store = Store(spark)
    # Texts are bytes from here on, as are the hashes that tell documents apart.
    docs = keyed(docs, F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A block is about half of `length` - KMER strings.
    groups = 1 + int(size * 2 / (length - KMER) * BLOCK.itemsize / ANCHOR_GROUP)
    records = docs.select("_id", "_text", "text").mapInArrow(to_anchors(length, groups, hot), RECORDS)
    flags = store.put(records.groupBy("bucket").applyInPandas(at_anchors(hot), FLAGS), "block-flags")
    wanted = flags.where("want IS NOT NULL").groupBy(*KEY).agg(F.collect_list("want").alias("wants"))
    amount = flags.agg(F.sum(F.octet_length("want"))).first()[0] or 0
    groups = 1 + int(amount / WANT.itemsize * 1.5 * length / STRING_GROUP)
    strings = docs.select(*KEY, "text").join(wanted, KEY).select(*KEY, "text", "wants")
    strings = strings.mapInArrow(to_strings(length, groups), STRINGS)
    more = store.put(strings.groupBy("bucket").applyInPandas(at_strings(length), FLAGS), "string-flags")
    gone = flags.select(*KEY, "gone").union(more.select(*KEY, "gone")).where("gone IS NOT NULL")
    gone = gone.groupBy(*KEY).agg(F.collect_list("gone").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, parts in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                n, spans, left = removed(text, parts, length)
                rows.append((len(text), n, spans, hashlib.sha256(left).hexdigest(), left if kept else None))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[c.split()[0] for c in RESULT.split(", ")])

    out = docs.join(gone, KEY, "left").select("doc_id", "text", "gone")
    out = out.mapInArrow(run, RESULT)
    return out if kept else out.drop("kept")


def op3_repeats(spark, sf_dir):
    return without_repeats(table(spark, sf_dir, "documents"), kept=False)


QUERIES = {"op3_repeats": op3_repeats}
ORACLE = {}
