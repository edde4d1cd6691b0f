"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Boosting goes round the features in
turn, and each visit fits one shallow tree on that feature's bins to the
remaining error; the trees add up to one lookup table for a feature. The pairs
that explain most of what is left then get tables of two features in the same
way. A text's score is the sum of one entry from each table: vectorised
additions, no tree is walked.

Only features of the text are inputs. The model is fitted on at most
max_labelled labelled ids (those with the smallest hashes), a row for each, of
which the driver receives features only, never texts.

Nulls: a null text is empty and is scored like any other; labels without id or
quality are not used, and if an id has several labels their mean decides (a
tie counts as 1). Where documents repeat an id, equal feature rows count once
and the mean of its different ones is fitted. With no labels, or one class only, every text gets that
class's share (0.5 without labels). Repeated rows are each scored. An empty
table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import kernels
from quire.llm.common import documents, in_slices, release, sliced

MAX_LABELLED = 20_000
FEATURES = (
    "log_bytes", "upper", "symbols", "bangs", "bars", "digits", "stops", "letter_bytes", "wide_bytes", "newlines",
    "word_bytes", "distinct_words", "repeats", "distinct_pairs", "top_word", "lines_repeated", "long_words", "short_words",
)

_CLASSES = np.zeros((256, 9))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*@^~=+<>{}[]\\", b"!?", b"|", b"0123456789", b".,;:", b"abcdefghijklmnopqrstuvwxyz", bytes(range(128, 256)), b"\n")):
    _CLASSES[list(_chars), _k] = 1


def features(text: bytes) -> np.ndarray:
    """One row of FEATURES."""
    data = np.frombuffer(text, np.uint8)
    out = np.zeros(len(FEATURES))
    out[0] = np.log1p(len(data))
    if not len(data):
        return out
    counts = np.zeros(256)
    for at in range(0, len(data), 1 << 20):
        counts += np.bincount(data[at : at + (1 << 20)], minlength=256)
    upper, symbols, bangs, bars, digits, stops, lower, wide, newlines = counts @ _CLASSES
    words = kernels.word_hashes(text, values=kernels.CASED_VALUES)
    n = len(words)
    total = float(len(data))
    letters = upper + lower
    out[1] = upper / letters if letters else 0
    out[2:7] = np.array([symbols, bangs, bars, digits, stops]) / max(n, 1)
    out[7:10] = letters / total, wide / total, newlines / max(n, 1)
    if n:
        gaps = counts[[32, *range(9, 14)]].sum()
        out[10] = (total - gaps) / n
        ordered = np.sort(words)
        new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
        runs = np.diff(new)
        out[11] = len(runs) / n
        out[14] = runs.max() / n
    if n > 1:
        out[12] = np.count_nonzero(words[1:] == words[:-1]) / (n - 1)
        pairs = np.sort(words[1:] * np.uint64(3) + words[:-1])
        out[13] = (1 + np.count_nonzero(pairs[1:] != pairs[:-1])) / (n - 1)
    lines = [x for x in text.split(b"\n") if x]
    out[15] = 1 - len(set(lines)) / len(lines) if lines else 0
    if n:
        starts, ends = kernels.spans(data, kernels.SPACE)
        lengths = ends - starts
        out[16] = np.count_nonzero(lengths > 12) / n
        out[17] = np.count_nonzero(lengths <= 3) / n
    return out


def feature_matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.stack([features(t or b"") for t in texts]) if texts else np.zeros((0, len(FEATURES)))


def _bin(column: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, column, side="right")


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The gain of the best cut of ordered bins into two, and the first bin after it."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A shallow tree over ordered bins, as the step for each bin."""
    gain, at = _best_cut(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, ridge), _tree(g[at:], h[at:], depth - 1, ridge)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The better of cutting rows first or columns first, then each half the other way; and its gain."""
    best, most = np.zeros_like(g), -1.0
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, at = _best_cut(a.sum(1), b.sum(1), ridge)
        step, gain = np.zeros_like(a), 0.0
        for part in (slice(0, at), slice(at, len(a))):
            if part.start == part.stop:
                continue
            step[part] = _tree(a[part].sum(0), b[part].sum(0), 1, ridge)[None, :]
        gain = float((step * a - 0.5 * step**2 * (b + ridge / a.size)).sum())
        if gain > most:
            most, best = gain, step.T if turned else step
    return best, most


class Model:
    """Lookup tables: cuts and a table for each feature, pairs with coarser cuts, and a base."""

    def __init__(self, base, cuts, tables, pairs):
        self.base, self.cuts, self.tables, self.pairs = base, cuts, tables, pairs

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (cuts, t) in enumerate(zip(self.cuts, self.tables)):
            out += t[_bin(x[:, k], cuts)]
        for i, j, a, b, t in self.pairs:
            out += t[_bin(x[:, i], a), _bin(x[:, j], b)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, n_pairs: int = 8, pair_bins: int = 8, pair_rounds: int = 60, rate: float = 0.15, ridge: float = 2.0) -> Model:
    """Fit on features x and labels y (0 or 1)."""
    d = len(FEATURES)
    if not len(y):
        return Model(0.0, [np.zeros(0)] * d, [np.zeros(1)] * d, [])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, k], bins) for k in range(d)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if y.min() == y.max():
        return Model(base, cuts, tables, [])
    binned = [_bin(x[:, k], cuts[k]) for k in range(d)]
    logit = np.full(len(y), base)
    for _ in range(rounds):
        for k in range(d):
            p = 1 / (1 + np.exp(-logit))
            g = np.bincount(binned[k], y - p, len(tables[k]))
            h = np.bincount(binned[k], p * (1 - p), len(tables[k]))
            step = rate * _tree(g, h, 2, ridge)
            tables[k] += step
            logit += step[binned[k]]
    coarse = [_cuts(x[:, k], pair_bins) for k in range(d)]
    small = [_bin(x[:, k], coarse[k]) for k in range(d)]

    def sums(i, j, p):
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        at = small[i] * shape[1] + small[j]
        return at, *(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    p = 1 / (1 + np.exp(-logit))
    ranked = sorted(((_pair_tree(*sums(i, j, p)[1:], ridge)[1], i, j) for i in range(d) for j in range(i)), reverse=True)[:n_pairs]
    pairs = [[i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))] for _, i, j in ranked]
    for _ in range(pair_rounds):
        for pair in pairs:
            p = 1 / (1 + np.exp(-logit))
            at, g, h = sums(pair[0], pair[1], p)
            step = rate * _pair_tree(g, h, ridge)[0]
            pair[4] += step
            logit += step.ravel()[at]
    for k in range(d):  # tables are centred, the base takes the rest
        mean = float(tables[k][binned[k]].mean())
        tables[k] -= mean
        base += mean
    return Model(base, cuts, tables, [tuple(p) for p in pairs])


def _feature_batches(batches):
    for batch in sliced(batches):
        x = feature_matrix(batch.column(1).cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"]
        )


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on the labelled rows that are not held out, max_labelled ids at most.

    The chosen ids and labels (under 20 bytes each, so bounded) are broadcast;
    the documents are read once, and only the features of labelled ones are
    shuffled, to give one row for each id.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q"))
        .where(F.col("doc_id").isNotNull() & F.col("q").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.avg("q").alias("q"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        .select("doc_id", (F.col("q") >= 0.5).cast("double").alias("y"))
    )
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    rows = known.mapInArrow(_feature_batches, "doc_id long, y double, x array<double>").distinct()
    means = F.array(*(F.avg(F.col("x")[k]) for k in range(len(FEATURES))))
    got = sorted(rows.groupBy("doc_id", "y").agg(means.alias("x")).collect(), key=lambda r: (r.y, r.x))
    x = np.array([r.x for r in got]) if got else np.zeros((0, len(FEATURES)))
    return fit(x, np.array([r.y for r in got]))


def score_column(model: Model, text):
    """A column expression: the score of a text column."""

    @F.arrow_udf("double")
    def score(texts):
        release()
        return pa.array(in_slices(texts.cast(pa.binary()), lambda own: model.scores(feature_matrix(own)).tolist()), pa.float64())

    return score(text.cast("string"))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    return (
        docs.select("doc_id", score_column(model, F.col("text")).alias("score"))
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model does not reject, with all their columns."""
    name = "__score"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, score_column(model, F.col("text"))).where(F.col(name) >= 0.5).drop(name)


def op5_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
