"""Benchmark decontamination: a BM25 index of test items, asked with every training passage.

The index holds the test items: for each term its items and their BM25 weight,
each weight divided by the score that the item gives itself. A passage's score
for an item is then the share of the item's own score, and one threshold
(theta) serves all items. Items are grouped in blocks, and the index also
keeps each term's largest weight, over all items and in each block.

Items go in bands by length, doubling from band to band, so that a long item
does not widen the windows of short ones. For each band a text is cut into
windows of twice the band's longest possible item with a step of half a window,
so each copy of an item lies whole in some window. Block-max WAND then runs over
the windows. One whose terms' largest weights can't sum to theta is skipped. Its
terms are put in order of their largest weight, and the pivot is the first with
which the sum reaches theta: an item with no term from the pivot on can't reach
it either, so only blocks in those terms' lists are looked at. Of these, blocks
whose largest weights can't sum to theta are skipped, and their postings are
never read. What is left is scored in full. Every window of every text is asked.

A retrieved item is verified where it was found: of its question and of its
answer a share of the runs of SHINGLE words must occur there. The last
sentence is the answer and what comes before it the question (of a single
sentence, its halves). An item counts as leaked if both shares reach their
thresholds, or if so much of the whole item is there that the missing part
can't matter (whole).

Test items are a small query set: they are indexed in parts of at most
MAX_PART_WORDS words, each collected and broadcast by itself, and the texts
are read once for each part. Term document frequencies, the number of items,
their mean length and the window are those of all items, so scores don't depend
on the parts.

Nulls: null texts, null items and items without words match nothing; a null
doc_id is kept. Equal items are all reported. Repeated rows each give their
rows. With an empty table on either side there are no rows. Other columns are
not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import kernels
from quire.llm.common import documents, in_slices, release, sliced, stored

K1, B = 1.2, 0.75
THETA = 0.5
SHINGLE = 3
PART_SHARE, WHOLE_SHARE = 0.5, 0.6
BLOCK_ITEMS = 4
MIN_WINDOW = 64
MAX_PART_WORDS = 2_000_000
#: Windows that are scored at a time.
WINDOWS = 64
_SENTENCE_END = re.compile(r"[.!?][\"')\]]*\s+(?=\S)")


def words_of(text: bytes) -> np.ndarray:
    """Hashes of the words in lower case; ASCII that is no digit or letter divides them."""
    if not text.isascii():
        text = text.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")
    return kernels.word_hashes(text, kernels.NOT_ALNUM)


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; a single sentence is halved at a word."""
    ends = [m.end() for m in _SENTENCE_END.finditer(text.strip())]
    if ends:
        return text.strip()[: ends[-1]], text.strip()[ends[-1] :]
    words = text.split()
    half = (len(words) + 1) // 2
    return " ".join(words[:half]), " ".join(words[half:])


@dataclass
class Corpus:
    """Of all items that have words: their number, words, and sorted terms (those of a part at least) with document frequencies."""

    items: int
    words: int
    terms: np.ndarray
    df: np.ndarray


def window_of(length: int) -> int:
    """The window for an item of so many words: twice the longest item of its band."""
    return max(MIN_WINDOW, 2 << (max(length, 1) - 1).bit_length())


class Band:
    """Postings of the items that share a window, with their maxima by term and by block."""

    def __init__(self, window: int, items: np.ndarray, term: np.ndarray, item: np.ndarray, weight: np.ndarray, block_items: int):
        self.window, self.items, self.block_items = window, items, block_items
        order = np.lexsort((item, term))
        term, self.post_item, self.post_weight = term[order], item[order], weight[order]
        self.terms, at = np.unique(term, return_inverse=True)
        self.top = np.maximum.reduceat(self.post_weight, np.searchsorted(at, np.arange(len(self.terms))))
        block = self.post_item // block_items
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (block[1:] != block[:-1]))))
        self.block_of, self.block_top = block[new], np.maximum.reduceat(self.post_weight, new)
        self.block_first = np.searchsorted(at[new], np.arange(len(self.terms) + 1))
        self.post_first = np.concatenate([new, [len(at)]])

    @staticmethod
    def _gather(lists: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places of all entries of some lists, where first divides the entries by list."""
        n = first[lists + 1] - first[lists]
        return np.repeat(first[lists] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def retrieve(self, n_words: int, place: np.ndarray, term: np.ndarray, before: np.ndarray, theta: float) -> list[tuple[int, int, float]]:
        """(item, window start, score) for every window of a text and every item with at least theta.

        The text's words that are terms: their places, terms, and the place of the same term before (or -1).
        """
        # a hit lies in the window that starts at its own step and in the one before; it counts if the term stands nowhere before it there
        step = self.window // 2
        n_windows = max(1, -(-(n_words - step) // step))
        last = np.minimum(place // step, n_windows - 1)
        window = np.concatenate([last, place // step - 1])
        term, before = np.concatenate([term, term]), np.concatenate([before, before])
        kept = (window >= 0) & (window < n_windows) & (before < window * step)
        kept[len(place) :] &= window[len(place) :] != last
        window, term = window[kept], term[kept]
        need = theta - 1e-9
        able = np.bincount(window, self.top[term], n_windows) >= need
        if not able.any():
            return []
        kept = able[window]
        window, term = window[kept], term[kept]
        order = np.lexsort((self.top[term], window))
        window, term = window[order], term[order]
        out = []
        edges = np.searchsorted(window, np.arange(0, n_windows + WINDOWS, WINDOWS))
        for first, end in zip(edges, edges[1:]):
            if first < end:
                out += self._score(window[first:end], term[first:end], need, step)
        return out

    def _score(self, window: np.ndarray, term: np.ndarray, need: float, step: int) -> list[tuple[int, int, float]]:
        """Block-max WAND over some windows: their distinct terms, by window and then by largest weight."""
        base, n_blocks = window[0], int(self.block_of.max()) + 1
        window = window - base
        reach = np.cumsum(self.top[term])
        new = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
        reach -= np.repeat(reach[new] - self.top[term[new]], np.diff(np.concatenate([new, [len(window)]])))
        led = reach >= need
        led, led_cell = self._entries(window[led], term[led], n_blocks)
        bound = np.bincount(led_cell, self.block_top[led], (int(window[-1]) + 1) * n_blocks)
        rest, rest_cell = self._entries(window[reach < need], term[reach < need], n_blocks)
        kept = bound[rest_cell] > 0
        rest, rest_cell = rest[kept], rest_cell[kept]
        bound += np.bincount(rest_cell, self.block_top[rest], len(bound))
        runs, cell = np.concatenate([led, rest]), np.concatenate([led_cell, rest_cell])
        kept = bound[cell] >= need
        runs, cell = runs[kept], cell[kept]
        if not len(runs):
            return []
        at = self._gather(runs, self.post_first)
        own = np.repeat(cell // n_blocks, self.post_first[runs + 1] - self.post_first[runs]) * len(self.items) + self.post_item[at]
        pair, own = np.unique(own, return_inverse=True)
        score = np.bincount(own, self.post_weight[at])
        found = np.flatnonzero(score >= need)
        return [(int(self.items[p % len(self.items)]), int((base + p // len(self.items)) * step), float(score[k])) for k, p in zip(found, pair[found])]

    def _entries(self, window: np.ndarray, term: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """The block entries of some terms in their windows, and the cell (window, block) of each."""
        at = self._gather(term, self.block_first)
        return at, np.repeat(window, self.block_first[term + 1] - self.block_first[term]) * n_blocks + self.block_of[at]


class Index:
    """Items' postings by band, with weights relative to each item's own score.

    corpus is given where the items are a part of all.
    """

    def __init__(self, items: list[tuple[int, str]], theta: float = THETA, block_items: int = BLOCK_ITEMS, corpus: Corpus | None = None):
        self.theta = theta
        kept = [(i, t, w) for i, t in items if t and len(w := words_of(t.encode()))]
        self.item_ids = [i for i, _, _ in kept]
        self.parts = []
        for _, text, words in kept:
            q, a = (words_of(x.encode()) for x in question_and_answer(text))
            self.parts.append([(min(SHINGLE, len(x)), np.unique(kernels.shingle_hashes(x, SHINGLE))) for x in (q, a, words)])
        lengths = np.array([len(w) for *_, w in kept], float)
        term, item, tf = [], [], []
        for k, (*_, words) in enumerate(kept):
            t, n = np.unique(words, return_counts=True)
            term.append(t)
            item.append(np.full(len(t), k))
            tf.append(n)
        term, item, tf = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((term, np.uint64), (item, np.int64), (tf, np.int64)))
        if corpus is None:
            corpus = Corpus(len(kept), int(lengths.sum()), *np.unique(term, return_counts=True))
        df = corpus.df[np.searchsorted(corpus.terms, term)]
        idf = np.log1p((corpus.items - df + 0.5) / (df + 0.5))
        mean = corpus.words / corpus.items if corpus.items else 1.0
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
        weight = weight / np.bincount(item, weight, minlength=len(kept))[item]
        self.terms = np.unique(term)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.terms & np.uint64(0xFFFF)).astype(int)] = True
        self.windows = np.array([window_of(len(w)) for *_, w in kept], np.int64)
        self.bands, self.place_in = [], []
        for window in np.unique(self.windows).tolist():
            members = np.flatnonzero(self.windows == window)
            own = self.windows[item] == window
            band = Band(window, members, term[own], np.searchsorted(members, item[own]), weight[own], block_items)
            place = np.full(len(self.terms), -1)
            place[np.searchsorted(self.terms, band.terms)] = np.arange(len(band.terms))
            self.bands.append(band)
            self.place_in.append(place)

    def retrieve(self, words: np.ndarray) -> list[tuple[int, int, float]]:
        """(item, window start, score) for every window of a text and every item with at least theta."""
        place = np.flatnonzero(self.seen[(words & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(place):
            return []
        term = np.minimum(np.searchsorted(self.terms, words[place]), len(self.terms) - 1)
        hit = self.terms[term] == words[place]
        place, term = place[hit], term[hit]
        if not len(place):
            return []
        order = np.argsort(term, kind="stable")
        again = np.flatnonzero(term[order][1:] == term[order][:-1])
        before = np.full(len(place), -1)
        before[order[again + 1]] = place[order[again]]
        out = []
        for band, place_in in zip(self.bands, self.place_in):
            own = place_in[term]
            mine = own >= 0
            if mine.any():
                out += band.retrieve(len(words), place[mine], own[mine], before[mine], self.theta)
        return out

    def leaks(self, text: bytes | None) -> list[tuple[int, float, float, float]]:
        """Verified leaks of one text: (item id, score, question's share, answer's share), the best window of each item."""
        words = words_of(text or b"")
        best: dict[int, tuple[float, float, float]] = {}
        for item, start, score in self.retrieve(words):
            window = int(self.windows[item])
            here = words[max(0, start - window // 2) : start + window + window // 2]
            q, a, whole = (float(np.isin(p, kernels.shingle_hashes(here, n)).mean()) if n else 1.0 for n, p in self.parts[item])
            if (q >= PART_SHARE and a >= PART_SHARE) or whole >= WHOLE_SHARE:
                best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, q, a))
        return [(self.item_ids[i], *v) for i, v in sorted(best.items())]


def _term_batches(batches):
    """part and item text in; out come a row for each distinct term of an item, and one with a null term and the item's length."""
    for batch in sliced(batches):
        part, term, length = [], [], []
        for p, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            words = words_of(text)
            if len(words):
                own = np.unique(words).view(np.int64).tolist()
                part += [p] * (len(own) + 1)
                term += [*own, None]
                length += [None] * len(own) + [len(words)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(term, pa.int64()), pa.array(length, pa.int64())], names=["part", "term", "length"])


def index_parts(benchmark: DataFrame, theta: float = THETA, max_words: int = MAX_PART_WORDS):
    """Indexes over all items: one, or as many as keep each under about max_words words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first().n or 0
    parts = -(-total // max_words)
    if parts == 1:
        yield Index([(r.item_id, r.text) for r in items.collect()], theta)
    if parts < 2:
        return
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    rows = items.select("part", "text").mapInArrow(_term_batches, "part long, term long, length long")
    counts = stored(rows.groupBy("part", "term").agg(F.count("*").alias("n"), F.sum("length").alias("words")), "terms")
    whole = counts.where("term is null").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    df = counts.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    known = stored(counts.where("term is not null").select("part", "term").join(df, "term"), "frequencies")
    for part in range(parts):
        own = known.where(F.col("part") == part).select("term", "df").toArrow()
        terms = own.column("term").to_numpy().view(np.uint64)
        order = np.argsort(terms)
        corpus = Corpus(whole.n or 0, whole.words or 0, terms[order], own.column("df").to_numpy()[order])
        yield Index([(r.item_id, r.text) for r in items.where(F.col("part") == part).collect()], theta, corpus=corpus)


def _leak_batches(shared):
    def run(batches):
        index = shared.value
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                rows += [(doc_id, *leak) for leak in index.leaks(text)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))],
                names=["doc_id", "item_id", "score", "question_share", "answer_share"],
            )

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, theta: float = THETA) -> DataFrame:
    """A row for each text and leaked item: doc_id, item_id, score, question_share, answer_share. No shuffle."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_share double, answer_share double"
    out = None
    for index in index_parts(benchmark, theta):
        part = rows.mapInArrow(_leak_batches(spark.sparkContext.broadcast(index)), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, theta: float = THETA) -> DataFrame:
    """The rows that leak no item, with all their columns. No shuffle, no join."""
    for index in index_parts(benchmark, theta):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @F.arrow_udf("boolean")
        def clean(texts, shared=shared):
            release()
            return pa.array(in_slices(texts.cast(pa.binary()), lambda own: [not shared.value.leaks(t) for t in own]), pa.bool_())

        docs = docs.where(clean(F.col("text").cast("string")))
    return docs


def op1_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
