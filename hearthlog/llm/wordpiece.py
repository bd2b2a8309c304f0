"""How many pieces greedy longest matching cuts a text into, without the pieces.

A trie of the vocabulary with failure links: where the trie ends, the link leads to
the node of what is left after the longest pieces have been cut off, and the number
of pieces cut off on the way was counted when the trie was built. Each byte is
looked at once and each link goes up, so a word costs time in proportion to its
length.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from hearthlog.llm.common import table

CACHED = 400_000    # words whose counts a task remembers
LONG = 64           # bytes of a word that is not remembered
START = b" "        # what a word begins with in the vocabulary


class Automaton:
    """`go[node << 8 | byte]` is a child; `fail` of a node and the pieces `popped` on
    the way to it; -1 where no piece can be cut off."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.go: dict[int, int] = {}
        whole = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.go:
                    self.go[key] = len(whole)
                    whole.append(False)
                node = self.go[key]
            whole[node] = node != 0
        self.fail, self.popped = [-1] * len(whole), [0] * len(whole)
        children: dict[int, list[int]] = {}
        for key, child in self.go.items():
            children.setdefault(key >> 8, []).append(key)
        # Breadth first: a link leads to a shorter string.
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for key in children.get(parent, ()):
                node = self.go[key]
                queue.append(node)
                if whole[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                at, count = self.fail[parent], self.popped[parent]
                while at >= 0 and (at << 8 | key & 255) not in self.go:
                    count += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.go[at << 8 | key & 255], count

    def pieces(self, word: bytes) -> int:
        """Pieces of a word; one, an unknown word, if its bytes cannot be covered."""
        go, fail, popped = self.go, self.fail, self.popped
        node = count = 0
        for byte in word:
            step = go.get(node << 8 | byte)
            while step is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                step = go.get(node << 8 | byte)
            node = step
        while node > 0:
            count += popped[node]
            node = fail[node]
        return count if node == 0 else 1


class Counts(dict):
    """Pieces of words met before; forgotten when there are too many."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.pieces(START + word)
        if len(word) <= LONG:
            if len(self) >= CACHED:
                self.clear()
            self[word] = n
        return n


def vocabulary(path: str | None = None) -> list[bytes]:
    """Pieces of a rank file, by default of the public byte vocabulary, which has
    every byte and so no unknown words."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_words, n_tokens.

    Words are runs of anything but ASCII white space and are cut one by one, each
    with the space the vocabulary marks a word's beginning by. Null text has none.
    Any length of text or word; other columns are not read; equal rows give equal
    rows; no rows give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(Automaton(vocabulary(path)))
        for batch in batches:
            size, n_words, n_tokens = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                size.append(len(text or b""))
                n_words.append(len(words))
                n_tokens.append(sum(map(counts.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n_words, pa.int64()),
                                              pa.array(n_tokens, pa.int64())], schema=SCHEMA)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")


def op4_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLE = {}
