"""Near-duplicate vectors by iterative quantisation.

Rotations are learned by iterative quantisation (Gong and Lazebnik 2011) on a
bounded sample: data are centred, a rotation is drawn, and codes (signs) and
rotation are fitted to each other in turn, which spreads the variance and so
balances the bits. Every vector gets a code of one bit a dimension from each
rotation, and each code is cut into chunks: a multi-index of Hamming tables,
with as many tables as the wanted recall at the threshold takes. In a table,
vectors with an equal chunk meet; pairs whose whole codes are near enough are
candidates; these are reranked by the cosine of the original vectors, in
double precision.

Codes are signs of the vectors as they are, not of centred ones: a bit then
differs with a chance that the pair's own angle sets, however the vectors lie
round their mean. What the fitted rotations really do to pairs at the threshold
is measured on pairs laid at vectors of the sample; rotations that are drawn
and not fitted, for which the chance is exact, are added until the wanted share
of those pairs meets. The length of a chunk decides cost only.

No pairs are sent round. A row of a table is its bucket, a class number and the
code, of which all other tables' chunks are parts. A bucket passes on which of
its members have candidates; their vectors are joined to them, and matrix
products for each bucket give each member's number of links and a spanning star
for each local component. A pair that meets in several tables counts in the
first one. Equal vectors are one class with a weight, so copies cost nothing. A
bucket of more than PART members is dealt out in pairs of parts, so no task
holds a group of any size; c members that nearly all link, whose links are to be
counted, cost c * c / PART rows of a code each.

Rotations are fitted for the LENGTHS most frequent lengths of vectors, on
fit_vectors vectors of each; vectors of other lengths get rotations that are
drawn by a seed, as many as the exact chance asks for.

Nulls: a vector that is null, zero, or holds a null or non-finite component
links with nothing, and so does a row with a null vec_id. Vectors of different
lengths are not compared. Repeated rows are vectors of their own. An empty
table gives no rows. Columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import connected_components, partitions, sliced, sorted_groups, stored

THRESHOLD = 0.9
RECALL = 0.995
FIT_VECTORS = 10_000
FIT_ROUNDS = 30
BUCKET = 64
MAX_CHUNK = 24
#: A candidate may differ in the share of bits of a pair at the threshold, and so much more at least.
BIT_MARGIN = 0.13
PROBES = 2000
PART = 2048
COUNTED = 64
LENGTHS = 8
#: Rows of a matrix product at a time.
BLOCK = 512


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with length 1, and which rows have one."""
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        big = np.abs(x).max(1)
        good = np.isfinite(big) & (big > 0)
        x = np.where(good[:, None], x, 1.0) / np.where(good, big, 1.0)[:, None]
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] + 0.0, good


def unit_rows(vectors: pa.Array) -> list[tuple[str, bytes] | None]:
    """For each vector a hash of it in double precision with length 1, and its own bytes; None where it can link with nothing."""
    out: list[tuple[str, bytes] | None] = [None] * len(vectors)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    kind = vectors.type.value_type.to_pandas_dtype()
    for d in np.unique(lengths[lengths > 0]).astype(int).tolist():
        at = np.flatnonzero(lengths == d)
        raw = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        units, good = _scaled(raw.astype(float))
        for k, u, own, ok in zip(at.tolist(), units, raw.astype(kind), good.tolist()):
            out[k] = (xxhash.xxh3_128_hexdigest(u.tobytes()), own.tobytes()) if ok else None
    return out


def units_of(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length from their bytes, in double precision with length 1."""
    return _scaled(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float))[0]


def _unit_batches(batches):
    for batch in sliced(batches, 2048):
        rows = [None if i is None else u for i, u in zip(batch.column(0).to_pylist(), unit_rows(batch.column(1)))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r and r[0] for r in rows], pa.string()), pa.array([r and r[1] for r in rows], pa.binary())], names=["vec_id", "cls", "vector"]
        )


def learn_rotation(x: np.ndarray, seed: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """A rotation of centred rows x that makes their signs a good code."""
    d = x.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(rounds if len(x) else 0):
        codes = np.where(x @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(x.T @ codes)
        rotation = left @ right
    return rotation


def probe_pairs(sample: np.ndarray, threshold: float, n: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at the threshold: one of the sample, and one turned from it in any direction or towards another of the sample."""
    rng = np.random.default_rng(len(sample))
    a = sample[rng.integers(len(sample), size=n)]
    to = np.concatenate([rng.standard_normal((n // 2, sample.shape[1])), sample[rng.integers(len(sample), size=n - n // 2)]])
    to = to - (to * a).sum(1)[:, None] * a
    length = np.sqrt((to * to).sum(1))
    a, to = a[length > 1e-6], to[length > 1e-6] / length[length > 1e-6, None]
    return a, threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * to


class Codes:
    """Rotations for vectors of one length, and the tables that their codes are cut into."""

    def __init__(self, sample: np.ndarray, n_vectors: int, threshold: float = THRESHOLD, recall: float = RECALL):
        d = sample.shape[1]
        centred = sample - sample.mean(0) if len(sample) else sample
        share = math.acos(threshold) / math.pi
        codes = lambda chunk: math.ceil(max(1.0, math.log(1 - recall) / math.log(1 - (1 - share) ** chunk)) / max(1, d // chunk))
        self.rotations = [learn_rotation(centred, 0)]
        self.chunk = self._cheapest(sample, n_vectors, share, codes)
        self.per_code = max(1, d // self.chunk)
        self.rotations += [learn_rotation(centred, seed) for seed in range(1, codes(self.chunk))]
        a, b = probe_pairs(sample, threshold) if len(sample) else (sample, sample)
        met = np.zeros(len(a), bool)
        far = np.zeros(len(a), np.int64)
        done = 0
        while done < len(self.rotations) or len(a) and met.mean() < recall:
            if done == len(self.rotations):
                self.rotations.append(learn_rotation(centred, done, 0))
            differs = (a @ self.rotations[done] >= 0) != (b @ self.rotations[done] >= 0)
            far += differs.sum(1)
            met |= ~differs[:, : self.per_code * self.chunk].reshape(len(a), self.per_code, self.chunk).any(2).all(1)
            done += 1
        self.tables = len(self.rotations) * self.per_code
        self.bits = d * len(self.rotations)
        spread = math.sqrt(share * (1 - share) / self.bits)
        self.max_share = max(share + BIT_MARGIN, share + 6 * spread, far.max(initial=0) / self.bits + 2 * spread)

    def _cheapest(self, sample: np.ndarray, n_vectors: int, share: float, codes) -> int:
        """The length of a chunk with the least work: tables, times what a row and the vectors that it meets in one cost.

        If all bits were balanced and independent, buckets of BUCKET vectors
        would cost least; how many really meet is counted in the sample.
        """
        row = BUCKET * max(0.0, math.log(2) / -math.log(1 - share) - 1)
        signs = sample @ self.rotations[0] >= 0
        d, m = signs.shape[1], len(signs)
        best = []
        for chunk in range(1, min(MAX_CHUNK, d) + 1):
            meet = [] if m else [0.5**chunk]
            for c in range(min(16, d // chunk) if m else 0):
                counts = np.unique(signs[:, c * chunk : (c + 1) * chunk] @ (1 << np.arange(chunk)), return_counts=True)[1].astype(float)
                meet.append((counts * (counts - 1)).sum() / max(1, m * (m - 1)))
            best.append((codes(chunk) * (d // chunk) * (row + n_vectors * float(np.mean(meet))), chunk))
        return min(best)[1]

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed codes of all rotations (rows of bytes) and the chunk in each table."""
        signs = np.concatenate([units @ r >= 0 for r in self.rotations], 1)
        packed = np.packbits(signs, axis=1)
        pad = -packed.shape[1] % 8
        return np.pad(packed, ((0, 0), (0, pad))), self._chunks(signs)

    def _chunks(self, signs: np.ndarray) -> np.ndarray:
        n, used = len(signs), self.per_code * self.chunk
        own = signs.reshape(n, len(self.rotations), -1)[:, :, :used].reshape(n, self.tables, self.chunk)
        return own @ (1 << np.arange(self.chunk, dtype=np.int64))

    def chunks_of(self, codes: np.ndarray) -> np.ndarray:
        """The chunks that packed codes hold."""
        return self._chunks(np.unpackbits(codes, axis=1, count=self.bits).astype(bool))


class Models:
    """Codes by length of vectors: those fitted, and others made from the numbers of vectors when first asked for."""

    def __init__(self, fitted: dict[int, Codes], n_vectors: int, threshold: float, recall: float):
        self.known, self.rest = dict(fitted), (n_vectors, threshold, recall)

    def __getitem__(self, d: int) -> Codes:
        if d not in self.known:
            self.known[d] = Codes(np.zeros((0, d)), *self.rest)
        return self.known[d]


def _key_batches(shared, kind: str, with_code: bool):
    """Classes in; out come a row for each class and table: key, d, rep, and the code."""

    def run(batches):
        models = shared.value
        for batch in sliced(batches, 256):
            reps, vectors = batch.column(0).to_numpy(), batch.column(1)
            by_length: dict[int, list[int]] = {}
            for k, u in enumerate(vectors.to_pylist()):
                by_length.setdefault(len(u) // np.dtype(kind).itemsize, []).append(k)
            for d, own in by_length.items():
                model = models[d]
                codes, chunks = model.encode(units_of(vectors.take(pa.array(own)).to_pylist(), kind))
                # table and chunk take 44 bits at most, the length what is left
                keys = (chunks | (np.arange(model.tables, dtype=np.int64) << MAX_CHUNK)) ^ (d << 44)
                columns = [pa.array(keys.ravel()), pa.array(np.full(keys.size, d, np.int32)), pa.array(np.repeat(reps[own], model.tables))]
                if with_code:
                    own_codes = pa.array([c.tobytes() for c in codes], pa.binary())
                    columns.append(own_codes.take(pa.array(np.repeat(np.arange(len(own)), model.tables))))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "d", "rep", "code"][: len(columns)])

    return run


def _near_codes(codes: np.ndarray, side: np.ndarray | None, limit: float):
    """Pairs i < j of rows whose codes differ in at most limit bits, in blocks; across the two sides only, if sides are given."""
    words = codes.view(np.uint64)
    step = max(1, (1 << 20) // max(1, words.shape[0] * words.shape[1]))
    for at in range(0, len(words), step):
        far = np.bitwise_count(words[at : at + step, None, :] ^ words[None, :, :]).sum(2, dtype=np.int64)
        near = far <= limit
        near &= np.arange(len(words))[None, :] > np.arange(at, at + len(near))[:, None]
        if side is not None:
            near &= side[at : at + len(near), None] != side[None, :]
        i, j = np.nonzero(near)
        yield i + at, j


def _first_here(chunks: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> np.ndarray:
    """Whether the pairs meet in no table before this one."""
    out = np.ones(len(i), bool)
    for t in range(table):
        out &= chunks[i, t] != chunks[j, t]
    return out


def _table_of(key: int, length: int) -> int:
    return (key ^ (length << 44)) >> MAX_CHUNK


def _member_batches(shared):
    """Sorted bucket rows in; out come the members that have a candidate in their bucket."""

    def run(batches):
        models = shared.value
        for group in sorted_groups(batches, 3):
            key, part, other = (group.column(c)[0].as_py() for c in range(3))
            rep = group.column(3).to_numpy()
            if len(rep) < 2:
                continue
            length = group.column(5)[0].as_py()
            model = models[length]
            codes = np.frombuffer(b"".join(group.column(6).to_pylist()), np.uint8).reshape(len(rep), -1)
            side = None if part == other else group.column(4).to_numpy()
            has = np.zeros(len(rep), bool)
            chunks, table = None, _table_of(key, length)
            for i, j in _near_codes(codes, side, model.max_share * model.bits):
                if len(i):
                    chunks = model.chunks_of(codes) if chunks is None else chunks
                    first = _first_here(chunks, i, j, table)
                    has[i[first]] = True
                    has[j[first]] = True
            n = int(has.sum())
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n), pa.array([part] * n, pa.int32()), pa.array([other] * n, pa.int32()), pa.array(rep[has]), group.column(4).filter(pa.array(has))],
                    names=["key", "part", "other", "rep", "side"],
                )

    return run


def _link_batches(shared, kind: str, threshold: float):
    """Sorted buckets of vectors in; out come links for each member, and a star for each local component."""

    def run(batches):
        models = shared.value
        for group in sorted_groups(batches, 3):
            key, part, other = (group.column(c)[0].as_py() for c in range(3))
            rep, side, weight = (group.column(c).to_numpy() for c in (3, 4, 6))
            units = units_of(group.column(5).to_pylist(), kind)
            chunks = models[units.shape[1]].encode(units)[1]
            table = _table_of(key, units.shape[1])
            links, src, dst = np.zeros(len(rep), np.int64), [], []
            for at in range(0, len(rep), BLOCK):
                own = slice(at, at + BLOCK)
                linked = units[own] @ units.T >= threshold
                linked[np.arange(len(linked)), np.arange(at, at + len(linked))] = False
                if part != other:
                    linked &= side[own, None] != side[None, :]
                for t in range(table):
                    linked &= chunks[own, None, t] != chunks[None, :, t]
                links[own] = linked @ weight
                i, j = np.nonzero(linked)
                src.append(i + at)
                dst.append(j)
            i, j = np.concatenate(src), np.concatenate(dst)
            label = rep.copy()
            while len(i):
                low = label.copy()
                np.minimum.at(low, i, label[j])
                if (low == label).all():
                    break
                label = low
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(label), pa.array(links)], names=["rep", "label", "links"])

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, fit_vectors: int = FIT_VECTORS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    spark = embeddings.sparkSession
    n_parts = partitions(spark)
    # vectors of single precision are kept in it; all is reckoned in double precision
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, size = ("<f4", 4) if single else ("<f8", 8)
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("e")).mapInArrow(
        _unit_batches, "vec_id long, cls string, vector binary"
    )
    # the vectors themselves are written once, by class; what class a row is of is a table of its own
    rows = stored(vectors.select("vec_id", "cls"), "rows")
    classes = vectors.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min("vector").alias("vector"))
    # a class is known by its hash of 128 bits; in what follows by a number of its own, given as the table is written (vec_id may repeat)
    reps = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sizes = reps.groupBy((F.octet_length("vector") / size).cast("int").alias("d")).agg(F.count("*").alias("n"))
    fitted = {}
    for r in sizes.orderBy(F.desc("n"), "d").limit(LENGTHS).collect():
        own = reps.where(F.octet_length("vector") == r.d * size).orderBy("cls").limit(fit_vectors).select("vector").collect()
        fitted[r.d] = Codes(units_of([bytes(x.vector) for x in own], kind), r.n, threshold, recall)
    shared = spark.sparkContext.broadcast(Models(fitted, reps.count() if fitted else 0, threshold, recall))
    single_rows = reps.select(F.col("node").alias("rep"), "vector")
    # into how many parts a bucket is dealt is read from one vector in COUNTED, by hash; it decides cost only, never what is compared
    counted = single_rows.where(F.pmod(F.xxhash64("rep"), F.lit(COUNTED)) == 0).mapInArrow(_key_batches(shared, kind, False), "key long, d int, rep long")
    large = stored(
        counted.groupBy("key").agg((F.count("*") * COUNTED).alias("n")).where(F.col("n") > PART).select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "large"
    )
    members = single_rows.mapInArrow(_key_batches(shared, kind, True), "key long, d int, rep long, code binary")
    split = members.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("side", F.pmod(F.xxhash64("rep", "key"), F.col("parts")).cast("int"))
    blocks = split.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("side", "b").cast("int").alias("part"), F.greatest("side", "b").cast("int").alias("other"), "rep", "side", "d", "code"
    )
    grouped = lambda df: df.repartition(n_parts, "key", "part", "other").sortWithinPartitions("key", "part", "other", "rep")
    found = grouped(blocks).mapInArrow(_member_batches(shared), "key long, part int, other int, rep long, side int")
    weighted = reps.select(F.col("node").alias("rep"), "vector", "weight")
    links = stored(
        grouped(found.join(weighted, "rep").select("key", "part", "other", "rep", "side", "vector", "weight"))
        .mapInArrow(_link_batches(shared, kind, threshold), "rep long, label long, links long"),
        "links",
    )
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(links.where("rep <> label").select(F.col("rep").alias("src"), F.col("label").alias("dst")))
    nodes = (
        reps.select("cls", "node", "rep", "weight")
        .join(counts.withColumnRenamed("rep", "node"), "node", "left")
        .join(components, "node", "left")
    )
    nodes = stored(nodes, "nodes")
    smallest = stored(nodes.where("component is not null").groupBy("component").agg(F.min("rep").alias("low")), "smallest")
    by_class = stored(nodes.join(smallest, "component", "left").select(
        "cls", F.coalesce("low", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    ), "by_class")
    out = rows.select("vec_id", "cls").join(by_class, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op10_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
