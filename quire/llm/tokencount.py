"""Token counts by a linear longest-match automaton.

Greedy word pieces: from a word's start, the longest piece of the vocabulary
is taken, then the longest from there, and so on. The automaton does this in
one pass: a trie of the vocabulary whose nodes have a failure link (where to
go on when the next byte has no edge) and the number of pieces that are final
on taking it. Only counts are kept; no piece is ever built.

A word is a run of non-space. Its first piece must be one that starts a word,
the others pieces that don't. A byte that the vocabulary has no piece for
counts as one, and so does a word's leading space where nothing longer starts
with it, so every word has pieces. Counts of words are remembered by each
worker, up to a bound.

Nulls: a null text is empty and has no tokens; a null doc_id is kept. Repeated
rows are counted each. An empty table gives no rows. Columns besides doc_id
and text are not read.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import documents, memories, sliced

MEMORY_WORDS = 600_000


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in printable}
    for k, b in enumerate(b for b in range(256) if b not in set(printable)):
        out[chr(256 + k)] = b
    return out


def read_vocabulary(path: str) -> set[bytes]:
    """The pieces of a byte-level vocabulary, as bytes; pieces that start a word begin with a space. Special tokens are no pieces of texts."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    special = {t["content"] for t in whole.get("added_tokens") or () if t.get("special")}
    return {bytes(letters[c] for c in p) for p in whole["model"]["vocab"] if p not in special and all(c in letters for c in p)}


class LongestMatch:
    """The automaton. A node is a number; edges are kept as {node * 256 + byte: node}."""

    INNER = 1  # the root for pieces inside a word; node 0 is the root for whole words

    def __init__(self, vocabulary: set[bytes]):
        self.edges: dict[int, int] = {}
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        final = [False, False]
        order: list[tuple[int, int, int]] = []
        single = {bytes([b]) for b in range(256)}
        for piece in sorted(p for p in vocabulary | single if b" " not in p[1:] and p):
            at = 0 if piece[:1] == b" " else self.INNER
            for byte in piece:
                to = self.edges.get(at << 8 | byte)
                if to is None:
                    to = self.edges[at << 8 | byte] = len(final)
                    final.append(False)
                    self.fail.append(-1)
                    self.popped.append(0)
                at = to
            final[at] = True
        level = [0, self.INNER]
        children: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.edges.items():
            children.setdefault(key >> 8, []).append((key & 255, to))
        while level:
            below = []
            for node in level:
                for byte, to in children.get(node, ()):
                    order.append((node, byte, to))
                    below.append(to)
            level = below
        for parent, byte, node in order:  # parents before children
            if final[node]:
                self.fail[node], self.popped[node] = self.INNER, 1
                continue
            count, back = self.popped[parent], self.fail[parent]
            while back >= 0 and (back << 8 | byte) not in self.edges:
                count += self.popped[back]
                back = self.fail[back]
            if back >= 0:
                self.fail[node], self.popped[node] = self.edges[back << 8 | byte], count

    def count(self, word: bytes) -> int:
        """Pieces of one word, given with its leading space."""
        edges, fail, popped, node, total = self.edges, self.fail, self.popped, 0, 0
        for byte in word:
            to = edges.get(node << 8 | byte)
            while to is None:
                total += popped[node]
                node = fail[node]
                to = edges.get(node << 8 | byte)
            node = to
        while node != self.INNER:
            total += popped[node]
            node = fail[node]
        return total


class Counter(dict):
    """Counts of words, computed when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        self.automaton = LongestMatch(read_vocabulary(path))

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY_WORDS:
            self.clear()
        n = self[word] = self.automaton.count(b" " + word.encode("utf-8", "surrogatepass"))
        return n


_loaded: dict[str, Counter] = {}
memories[__name__] = _loaded


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def _batches(path: str):
    def run(batches):
        of = counter(path).__getitem__
        for batch in sliced(batches, kernel=__name__):
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                own = (text or "").split()
                words.append(len(own))
                # looked up one by one: the memory may start anew at any word
                tokens.append(sum(map(of, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens for every row; no shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _batches(vocabulary), "doc_id long, n_words long, n_tokens long"
    )


def op6_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy piece counts of all documents under the 50k byte-level vocabulary."""
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
