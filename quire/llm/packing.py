"""Packing along a space-filling curve.

A document's distinct words are hashed to random signs in DIMS dimensions; the
sums, squashed to a grid, give a point, and the point's place on the Hilbert
curve is the sort key. Documents are range-partitioned and sorted by it, and
each partition's token stream is cut into sequences of seq_len. What is left
over at the end of each partition (less than one sequence) is then laid
together, first fit by falling length, so padding is a part of a sequence and
not a part of every partition.

Copies share a key, so a hash of the row breaks ties: a group of copies of any
size is spread over as many partitions as its bytes need. A partition is
streamed through one task; the driver sees one row for each partition.

Nulls: a null text is empty and has the end token only; a null doc_id is kept
as it is. Repeated rows are packed as often as they occur. An empty table
gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import kernels
from quire.llm.common import documents, memories, partitions, sliced, stored

SEQ_LEN = 4096
END_ID = 2
DIMS, BITS = 3, 12
#: Words whose pieces a worker's young memory holds.
MEMORY_WORDS = 250_000
#: Rows from whose keys the ranges' bounds are taken.
BOUND_ROWS = 20_000


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of an integer grid of 2**bits in each column.

    From the highest bit down, each level's rotation is undone in place; the
    Gray code of the columns' bits is then read off, highest level first.
    """
    x = points.astype(np.int64).copy()
    n, dims = x.shape
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            up = (x[:, d] & bit) != 0
            swap = np.where(up, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(up, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, dims - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> level) & 1)
    return key


def grid_point(text: bytes, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """A document's point: signs of its distinct words' hashes, summed, scaled and squashed to the grid."""
    words = np.sort(kernels.word_hashes(text))
    if not len(words):
        return np.full(dims, 1 << (bits - 1))
    corner = (words & np.uint64((1 << dims) - 1)).astype(np.intp)
    new = np.ones(len(words), bool)
    np.not_equal(words[1:], words[:-1], out=new[1:])
    counts = np.bincount(corner[new], minlength=1 << dims)
    signs = 1.0 - 2 * ((np.arange(1 << dims)[:, None] >> np.arange(dims)) & 1)
    sums = counts @ signs / np.sqrt(counts.sum())
    return np.minimum((1 / (1 + np.exp(-1.7 * sums)) * (1 << bits)).astype(np.int64), (1 << bits) - 1)


class Pieces:
    """Token ids of texts; each word is looked up once and then remembered.

    Texts of ASCII and Latin letters are lower-cased and cut into words,
    digits and runs of symbols just as the tokenizer does it, and these are
    independent of each other. Words are learned many at a time. A text with
    any other character goes run by run of non-space instead, and one with a
    special token, or with a separator that Python counts as space and the
    tokenizer does not, goes through it whole.

    Two memories are kept: when the young one is full it becomes the old one,
    and a new one takes over from it what it meets again.
    """

    _other = re.compile("[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")
    _whole = re.compile("[\x1c-\x1f]|<\\|startoftext\\|>|<\\|endoftext\\|>")
    #: UTF-8 bytes of white space, a-z, stop, comma, and letters from U+00C0 to U+023F (but for two signs).
    _letters = bytes([32, 44, 46, *range(9, 14), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
    _pairs = (b"..", b".,", b",.", b",,", b"\xc3\x97", b"\xc3\xb7")
    _cut = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.id_type = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _cuts(self, text: str) -> list[str] | None:
        """A text's independent parts; None if it has to go whole."""
        if "<|" in text or self._other.search(text):
            return None if self._whole.search(text) else text.split()
        return self._cut(text.lower())

    def _spaced(self, text: str) -> bytes | None:
        """The text with its parts divided by spaces; None if it can't be cut that way."""
        data = text.lower().encode("utf-8", "surrogatepass")
        if data.translate(None, self._letters) or any(p in data for p in self._pairs):
            parts = self._cuts(text)
            return None if parts is None else " ".join(parts).encode()
        return data.replace(b".", b" . ").replace(b",", b" , ")

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.id_type).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        """Words of letters are encoded many as one text, which is cut after their last pieces; other parts one by one."""
        words = [w for w in parts if w.isalpha()]
        for at in range(0, len(words), 200):
            own = words[at : at + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, self.id_type)
            cuts = (self.id_type.itemsize * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(own):
                data = ids.tobytes()
                self.known.update(zip(own, [data[a:b] for a, b in zip([0, *cuts], cuts)]))
            else:
                self.known.update(zip(own, self._encode(own)))
        other = [w for w in parts if not w.isalpha()]
        self.known.update(zip(other, self._encode(other)))

    def _look_up(self, words: list[str]) -> list[bytes]:
        if len(self.known) > MEMORY_WORDS:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        gaps = [k for k, f in enumerate(found) if f is None]
        if gaps:
            new = {words[k] for k in gaps}
            again = {w: self.older[w] for w in new if w in self.older}
            self.known.update(again)
            self._learn(list(new.difference(again)))
            for k in gaps:
                found[k] = self.known[words[k]]
        return found

    def _together(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts whose parts are divided by spaces: each distinct part of all of them is looked up once, and its ids are dealt out."""
        sizes = np.array([len(t) + 1 for t in texts])
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        starts, ends = kernels.spans(data, kernels.SPACE)
        if not len(starts):
            return [np.zeros(0, "<u4") for _ in texts]
        chosen, group = kernels.equal_groups(kernels.span_hashes(data, starts, ends, kernels.CASED_VALUES))
        raw = data.tobytes()
        found = self._look_up([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist())])
        flat = np.frombuffer(b"".join(found), self.id_type)
        lengths = np.array([len(f) // self.id_type.itemsize for f in found])
        first = np.cumsum(lengths) - lengths
        n = lengths[group]
        before = np.cumsum(n) - n
        ids = flat[np.repeat(first[group] - before, n) + np.arange(n.sum())].astype("<u4")
        words = np.searchsorted(starts, np.cumsum(sizes)[:-1])
        return np.split(ids, np.append(before, n.sum())[words])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        spaced = [self._spaced(t) for t in texts]
        own = [k for k, p in enumerate(spaced) if p is not None]
        out: list = [None] * len(texts)
        for k, ids in zip(own, self._together([spaced[k] for k in own]) if own else ()):
            out[k] = ids
        for k, text in enumerate(texts):
            if spaced[k] is None:
                out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return out


_loaded: dict[str, Pieces] = {}
memories[__name__] = _loaded


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def curve_of(text: F.Column, tie: F.Column, bounds: list[tuple[int, int]], lane: list[int]) -> F.Column:
    """A column expression: the place on the curve of a text, and the lane of the range in which (place, tie) lies."""

    @F.pandas_udf("curve long, lane long")
    def curve(texts, ties):
        import pandas as pd

        points = [grid_point((t or "").encode()) for t in texts]
        key = hilbert_key(np.stack(points)) if points else np.zeros(0, np.int64)
        place = [bisect.bisect_right(bounds, pair) for pair in zip(key.tolist(), ties.tolist())]
        return pd.DataFrame({"curve": key, "lane": np.array([lane[k] for k in place], np.int64)})

    return curve(text, tie)


def lanes(spark: SparkSession, n: int) -> list[int]:
    """n numbers that hash partitioning deals out one to each of n partitions."""
    found: dict[int, int] = {}
    size = 16 * n
    while len(found) < n:
        for r in spark.range(size).select("id", F.pmod(F.hash(F.col("id")), F.lit(n)).alias("p")).collect():
            found.setdefault(r.p, r.id)
        size *= 4
    return [found[k] for k in range(n)]


def along_curve(docs: DataFrame, sample_rows: int = BOUND_ROWS) -> DataFrame:
    """doc_id and text in range partitions, each sorted along the curve.

    The ranges' bounds are quantiles of the keys of about sample_rows rows (as
    a range partitioner takes them): they decide how even the partitions are,
    and nothing else. All rows then get their key in the pass that deals them
    out, so no text is hashed twice.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("doc_id", "text")
    total = docs.select(F.lit(1)).count()
    seen = rows if total <= sample_rows else rows.sample(sample_rows / total, 7)
    keys = sorted((r.k.curve, r.tie) for r in seen.withColumn("tie", tie).select(curve_of(F.col("text"), F.col("tie"), [], [0]).alias("k"), "tie").limit(2 * sample_rows).collect())
    bounds = sorted({keys[len(keys) * k // n] for k in range(1, n)}) if keys else []
    return (
        rows.withColumn("tie", tie)
        .withColumn("k", curve_of(F.col("text"), F.col("tie"), bounds, lanes(spark, n)))
        .select("doc_id", "text", "tie", "k.curve", "k.lane")
        .repartition(n, "lane")
        .sortWithinPartitions("lane", "curve", "tie", "doc_id")
        .select("doc_id", "text")
    )


_PACKED = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])


def _groups(texts: list[str], size: int = 1 << 20):
    """Consecutive ranges of about size characters."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _packer(path: str, seq_len: int, end_id: int, with_ids: bool):
    """A function for mapInArrow that packs one sorted partition as one stream of tokens."""
    schema = _PACKED if with_ids else pa.schema(list(_PACKED)[:-1])

    def pack(batches):
        tokens, part, seq, fill = pieces(path), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4")
        for batch in sliced(batches, 1000, __name__):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in _groups(texts):
                rows = []
                for doc_id, doc in zip(ids[first:last], tokens(texts[first:last])):
                    doc = np.concatenate([doc, end])
                    start, total = 0, len(doc)
                    while start < total:
                        length = min(seq_len - fill, total - start)
                        data = doc[start : start + length].tobytes()
                        rows.append((doc_id, start, length, zlib.crc32(data), total, part, seq, fill, data)[: len(schema)])
                        start += length
                        fill += length
                        if fill == seq_len:
                            seq, fill = seq + 1, 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return pack


def lay_tails(tails: list[tuple[int, int, int]], seq_len: int = SEQ_LEN) -> list[tuple[int, int, int, int, int]]:
    """Places for the partitions' sequences: (part, base, tail seq, tail's new sequence, shift).

    tails: (part, last sequence, its length). Whole sequences are numbered on
    from base; unfinished last ones are laid together, first fit by falling
    length, after all whole ones.
    """
    base, out, open_, rest = 0, {}, [], []
    for part, last, length in sorted(tails):
        whole = last + (length == seq_len)
        out[part] = [part, base, last if length < seq_len else -1, -1, 0]
        base += whole
        if length < seq_len:
            rest.append((-length, part))
    for length, part in sorted(rest):
        k = next((k for k, used in enumerate(open_) if used - length <= seq_len), None)
        if k is None:
            k = len(open_)
            open_.append(0)
        out[part][3:] = base + k, open_[k]
        open_[k] -= length
    return [tuple(x) for x in out.values()]


def pack(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (with_ids) ids.

    ids are little-endian unsigned 32-bit integers. The pieces are written to
    the shared folder once, with their places in their partition's stream; the
    partitions' places (one row each) are then added by a broadcast join.
    """
    spark = docs.sparkSession
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    columns = ", ".join(f"{f.name} {kinds[f.type]}" for f in list(_PACKED)[: None if with_ids else -1])
    packed = stored(along_curve(docs).mapInArrow(_packer(tokenizer, seq_len, end_id, with_ids), columns), "packed")
    ends = packed.groupBy("part").agg(F.max(F.struct("seq", (F.col("offset") + F.col("length")).alias("end"))).alias("m")).select("part", "m.seq", "m.end").collect()
    places = lay_tails([(r.part, r.seq, r.end) for r in ends], seq_len)
    lookup = spark.createDataFrame(places or [(-1, 0, 0, 0, 0)], "part int, base long, tail long, tail_seq long, shift long")
    in_tail = F.col("seq") == F.col("tail")
    return packed.join(F.broadcast(lookup), "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.when(in_tail, F.col("tail_seq")).otherwise(F.col("base") + F.col("seq")).alias("sequence_id"),
        (F.col("offset") + F.when(in_tail, F.col("shift")).otherwise(F.lit(0))).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
