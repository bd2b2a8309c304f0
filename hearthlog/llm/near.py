"""Near copies: fingerprints propose pairs, word shingles decide, and no link is lost.

Texts within the radius meet as in `simhash`, in groups that agree on blocks of bits
and in about how many shingles they have. A group proposes the edges of a shortest
spanning forest only, over the pairs that no earlier choice of blocks brings together.
Where all of them hold, whatever else the group could link is linked already; where one
does not, the texts its forest reaches are looked at again: those that are near another
component bring their shingles, and the group compares all of their pairs itself and
hands on a forest of those that hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import KEY, Store, keyed
from hearthlog.llm.graph import components
from hearthlog.llm.simhash import AGREE, GROUP, SEED, TILE, alike, blocks, signed

WORDS = 2           # of the runs a fingerprint is made of: shorter runs bring similar texts nearer than shingles do
SETS = 64           # texts whose shingles are compared with those of as many others at once
STEPS = 4           # sizes lie in one class up to a factor of 1 / similarity to this power
KNOWN = 1 << 18     # words whose hashes a task remembers
PLACE = ["mask", "key", "class"]


class Hashes(dict):
    """Hash of each word; forgets all once it knows too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, or of all words if they are fewer."""
    width = min(width, len(hashes))
    out = np.full(len(hashes) - width + 1 if width else 0, width, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i:i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """32-bit hashes of the different runs of `words` words, sorted."""
    return np.unique((grams(hashes, words) >> np.uint64(32)).astype("<u4"))


def fingerprint(hashes: np.ndarray, words: int = WORDS) -> int:
    """Bits set in over half of the hashes of the runs of `words` words, as a signed number."""
    each = grams(hashes, words)
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(each), 65536):
        set_ += np.unpackbits(each[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > len(each)).view(">i8")[0])


def marks(docs: DataFrame, words: int) -> DataFrame:
    """KEY of every row of `docs`, with node (equal for texts of equal words), fp and
    size, the number of different shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            out = []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                parts = (text or b"").lower().split()
                hashes = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
                out.append((signed(xxhash.xxh64_intdigest(b" ".join(parts), SEED)), fingerprint(hashes), len(shingles(hashes, words))))
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[*KEY, "node", "fp", "size"])
    return keyed(docs, "text").mapInArrow(run, "_id long, _text long, node long, fp long, size long")


def classes(size: F.Column, similarity: float) -> F.Column:
    """Classes such that two sizes share one if the smaller is `similarity` of the larger or more."""
    step = F.log(F.greatest(size, F.lit(1)).cast("double")) / -math.log(similarity)
    return F.array_distinct(F.array(*(F.floor((step + more) / STEPS) for more in (0.0, 1 + 1e-9))))


def members(nodes: DataFrame, store: Store, radius: int, similarity: float, agree: int, group: int) -> DataFrame:
    """PLACE, node and fp of `nodes` (node, fp, size) once for each group they are in:
    any two within `radius` bits and of sizes near enough share one. Groups have
    `group` nodes at most, as far as bits are left to cut them by."""
    masks = [sum(pick) for pick in combinations(blocks((1 << 64) - 1, radius + agree), agree)]
    each = F.explode(F.array(*(F.lit(signed(m)).cast("long") for m in masks)))
    rows = nodes.select("node", "fp", F.explode(classes(F.col("size"), similarity)).alias("class")).select("*", each.alias("mask"))
    todo, out = store.put(rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))), "keyed"), None
    while True:
        sizes = todo.groupBy(*PLACE).count()
        # Where no more bits are left than the radius, a key has 2 ** radius fingerprints at most.
        over = (F.col("count") > group) & (F.bit_count("mask") < 64 - radius)
        large = store.put(sizes.where(over).select(*PLACE), "large")
        done = todo.join(sizes.where((F.col("count") > 1) & ~over).select(*PLACE), PLACE).select(*PLACE, "node", "fp")
        out = done if out is None else out.union(done)
        used = [r["mask"] % (1 << 64) for r in large.select("mask").distinct().collect()]  # few: masks of one round
        if not used:
            return out
        finer = [(signed(mask), signed(mask | more)) for mask in used for more in blocks(((1 << 64) - 1) ^ mask, radius + 1)]
        finer = F.broadcast(nodes.sparkSession.createDataFrame(finer, "mask long, finer long"))  # a few rows a mask
        rest = todo.join(large, PLACE, "left_semi").join(finer, "mask")
        rest = rest.select("node", "fp", "class", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"))
        todo = store.put(rest.distinct(), "keyed")


def earlier(mask: int, cut: list[int]) -> list[int]:
    """The blocks of `cut` before the last one of `mask` that are not in it; none for a
    mask that is no choice of whole blocks."""
    mask %= 1 << 64
    inside = [b for b in cut if b & mask == b]
    return [b for b in cut if b < inside[-1] and not b & mask] if inside and sum(inside) == mask and len(inside) == AGREE else []


def own(fps: np.ndarray, i: np.ndarray, j: np.ndarray, before: list[int]) -> np.ndarray:
    """Which pairs meet here first: they differ in every earlier block."""
    apart, first = fps[i] ^ fps[j], np.ones(len(i), bool)
    for block in before:
        first &= apart & np.uint64(block) != 0
    return first


def tiles(fps: np.ndarray, radius: int, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i, j and distance of the pairs of uint64 `fps` within `radius` bits."""
    count = np.bitwise_count(fps)
    order = np.argsort(count, kind="stable")
    fps, count = fps[order], count[order].astype(np.int64)
    for i in range(0, len(fps), tile):
        most = count[min(i + tile, len(fps)) - 1]
        for j in range(i, len(fps), tile):
            if count[j] - most > radius:
                break
            apart = np.bitwise_count(fps[i:i + tile, None] ^ fps[None, j:j + tile])
            there = apart <= radius
            a, b = np.nonzero(np.triu(there, 1) if i == j else there)
            if len(a):
                yield order[i + a], order[j + b], apart[a, b].astype(np.int64)


def shortest_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) of `n` nodes make a spanning forest of least weight."""
    order = np.argsort(weight, kind="stable")
    a, b, label, chosen = a[order], b[order], np.arange(n), []
    rank = np.arange(len(a))
    while True:
        alive = label[a] != label[b]
        a, b, rank = a[alive], b[alive], rank[alive]
        if not len(a):
            return order[np.unique(np.concatenate([*chosen, np.empty(0, np.int64)]).astype(np.int64))]
        best = np.full(n, len(order))
        np.minimum.at(best, label[a], rank)
        np.minimum.at(best, label[b], rank)
        picked = np.unique(best[best < len(order)])
        chosen.append(picked)
        at = np.searchsorted(rank, picked)
        x, y = a[at], b[at]
        while (label[x] != label[y]).any():
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            label = new[new][label]


def forest(node: np.ndarray, fps: np.ndarray, radius: int, before: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a shortest spanning forest of the nodes within `radius` bits that meet
    here first. Nodes of one fingerprint make a chain, so they are not compared."""
    values, first, back = np.unique(fps, return_index=True, return_inverse=True)
    by = np.argsort(back, kind="stable")
    same = np.flatnonzero(back[by[1:]] == back[by[:-1]]) if not before else np.empty(0, np.int64)
    a = b = weight = np.empty(0, np.int64)
    for i, j, apart in tiles(values, radius):
        here = own(values, i, j, before)
        a, b, weight = np.concatenate([a, i[here]]), np.concatenate([b, j[here]]), np.concatenate([weight, apart[here]])
        keep = shortest_forest(len(values), a, b, weight)
        a, b, weight = a[keep], b[keep], weight[keep]
    return (np.concatenate([node[by[same]], node[first[a]]]), np.concatenate([node[by[same + 1]], node[first[b]]]))


def outside(node: np.ndarray, fps: np.ndarray, root: np.ndarray, radius: int, before: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that have one of another root within `radius` bits, twice."""
    there = np.zeros(len(node), bool)
    for i, j, _ in tiles(fps, radius):
        far = (root[i] != root[j]) & own(fps, i, j, before)
        there[i[far]] = there[j[far]] = True
    return node[there], node[there]


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set of `left` has in common with each of `right`."""
    values = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for sets in (left, right):
        table = np.zeros((len(sets), len(values)), np.float32)
        for row, one in zip(table, sets):
            at = np.searchsorted(values, one)
            at[at == len(values)] = 0
            row[at[values[at] == one] if len(values) else []] = 1
        sides.append(table)
    return sides[0] @ sides[1].T


def alike_edges(node: np.ndarray, fps: np.ndarray, root: np.ndarray, words: np.ndarray, radius: int, before: list[int],
                similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, over what `root` connects already, of all pairs within
    `radius` bits that are similar enough."""
    sets = [np.frombuffer(w, "<u4") for w in words]
    size, label = np.array([len(x) for x in sets]), np.unique(root, return_inverse=True)[1]
    out = [(np.empty(0, np.int64),) * 2]
    for i in range(0, len(node), SETS):
        for j in range(i, len(node), SETS):
            a, b = (x.ravel() for x in np.meshgrid(np.arange(i, min(i + SETS, len(node))), np.arange(j, min(j + SETS, len(node))), indexing="ij"))
            near = (a < b) & (label[a] != label[b]) & (np.bitwise_count(fps[a] ^ fps[b]) <= radius)
            near[near] = own(fps, a[near], b[near], before)
            if not near.any():
                continue
            a, b = a[near], b[near]
            both = shared(sets[i:i + SETS], sets[j:j + SETS])[a - i, b - j].astype(np.int64)
            whole = size[a] + size[b] - both
            good = np.where(whole > 0, both >= similarity * whole, True)
            a, b = a[good], b[good]
            keep = shortest_forest(int(label.max()) + 1, label[a], label[b], np.zeros(len(a)))
            for x, y in zip(a[keep], b[keep]):
                label[label == label[y]] = label[x]
            out.append((node[a[keep]], node[b[keep]]))
    a, b = (np.concatenate(side) for side in zip(*out))
    return a, b


def each_group(rows: DataFrame, propose: Callable[..., tuple], radius: int, agree: int) -> DataFrame:
    """PLACE and a <= b of what `propose` makes of the other columns of each group of
    `rows` and of the blocks that are earlier than the group's."""
    columns, cut = [c for c in rows.columns if c not in PLACE], blocks((1 << 64) - 1, radius + agree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            place = [rest[c].to_numpy() for c in PLACE]
            edges = np.flatnonzero(np.any([p[1:] != p[:-1] for p in place], axis=0)) + 1
            if len(edges):
                yield from proposed(rest.slice(0, edges[-1]), edges)
                rest = rest.slice(edges[-1]).combine_chunks()
        if rest is not None and len(rest):
            yield from proposed(rest, np.array([len(rest)]))

    def proposed(table: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        data, out, mask = [table[c].to_numpy() for c in columns], [], table["mask"].to_numpy()
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            a, b = propose(*(d[start:end] for d in data), earlier(int(mask[start]), cut))
            if len(a):
                out.append((np.full(len(a), start), np.minimum(a, b), np.maximum(a, b)))
        if out:
            at, a, b = (np.concatenate(c) for c in zip(*out))
            place = [pa.array(table[c].to_numpy()[at]) for c in PLACE]
            yield pa.RecordBatch.from_arrays([*place, pa.array(a), pa.array(b)], names=[*PLACE, "a", "b"])
    return rows.select(*PLACE, *columns).repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(
        run, "mask long, key long, class long, a long, b long")


def word_sets(docs: DataFrame, stands: DataFrame, words: int) -> DataFrame:
    """node and its shingles, from the rows of `docs` that stand for them (KEY, node)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            found = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                parts = (text or b"").lower().split()
                found.append(shingles(np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts)), words).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "words"])
    rows = keyed(docs, "text").join(stands, KEY).select("node", "text")
    return rows.mapInArrow(run, "node long, words binary").dropDuplicates(["node"])


def judged(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """`pairs` (a, b) with `good`: whether their shingles are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            good = [alike(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= similarity for x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "good"])
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("words").alias(f"words_{side}")), side)
    return pairs.select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long, good boolean")


def near_copies(docs: DataFrame, radius: int, words: int, similarity: float, agree: int = AGREE, group: int = GROUP) -> DataFrame:
    """doc_id, text_hash and `root` of every row of `docs` (doc_id, text): roots are
    equal where texts have equal words or are connected by pairs within `radius` bits
    whose sets of `words`-word shingles have a Jaccard similarity of `similarity` or more.

    Null and wordless texts are alike and like nothing else; a text of fewer words is
    one shingle. Case of A-Z and kind of white space do not matter. Equal rows have
    equal roots, null doc_ids come back as the smallest long, other columns are not
    read, no rows give no rows.
    """
    store = Store(docs.sparkSession)
    marked = store.put(marks(docs, words), "marks")
    nodes = store.put(marked.groupBy("node").agg(F.min("fp").alias("fp"), F.min("size").alias("size"), F.min(F.struct(*KEY)).alias("stand")), "nodes")
    groups = store.put(members(nodes.select("node", "fp", "size"), store, radius, similarity, agree, group), "groups")
    tried = store.put(each_group(groups, lambda node, fp, before: forest(node, fp.view(np.uint64), radius, before), radius, agree), "proposed")
    ends = tried.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    stands = store.put(nodes.join(ends, "node", "left_semi").select("stand.*", "node"), "stands")
    sets = store.put(word_sets(docs, stands, words), "shingles")
    first = store.put(judged(tried.select("a", "b").distinct(), sets, similarity), "judged")
    linked = first.where("good").select("a", "b")
    roots = components(linked, store)
    # A group is looked at again where an edge of its forest does not hold. Only texts of a
    # fingerprint that its forest reaches have another one within the radius there.
    again = tried.join(first.where("NOT good").select("a", "b"), ["a", "b"], "left_semi").select(*PLACE).distinct()
    reached = tried.join(again, PLACE, "left_semi").select(*PLACE, F.explode(F.array("a", "b")).alias("node")).distinct()
    reached = store.put(reached.join(nodes.select("node", "fp"), "node").select(*PLACE, "fp").distinct(), "again")
    if not reached.isEmpty():
        rows = store.put(groups.join(reached, [*PLACE, "fp"], "left_semi").join(roots, "node", "left").select(
            *PLACE, "node", "fp", F.coalesce("root", "node").alias("root")), "rows-again")
        met = each_group(rows, lambda node, fp, root, before: outside(node, fp.view(np.uint64), root, radius, before), radius, agree)
        met = rows.join(store.put(met.select(*PLACE, F.col("a").alias("node")), "outside"), [*PLACE, "node"], "left_semi").join(sets, "node")
        more = each_group(met, lambda node, fp, root, found, before: alike_edges(
            node, fp.view(np.uint64), root, found, radius, before, similarity), radius, agree)
        roots = components(linked.union(store.put(more.select("a", "b"), "more")), store)
    return marked.join(roots, "node", "left").select(F.col("_id").alias("doc_id"), F.col("_text").alias("text_hash"), F.coalesce("root", "node").alias("root"))
