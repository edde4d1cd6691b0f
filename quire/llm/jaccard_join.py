"""N-gram Jaccard join with an R-tree over count vectors.

A document is its set of 5-word shingles. The shingles are hashed into GROUPS
groups, and the numbers in each group are a point: two documents share at most
the sum, over the groups, of the smaller count. An R-tree over the points (its
boxes keep each group's largest count, and the smallest and largest set size)
finds the pairs whose bound allows the similarity; these are verified with
their sets.

An R-tree over hundreds of thousands of such points alone would compare nearly
everything of like size, as random documents have nearly equal counts. So the
trees are built within neighbourhoods that no linked pair can leave:

* Every document carries some of its shingles as signature. Documents whose
  shingles are mostly rare carry the SIGNATURE smallest by hash. Two linked
  documents share three of four shingles of their union, so each of the
  union's smallest ones is common to both with that chance, and a pair is
  missed with a chance under 1e-12 (1e-15 and less in ordinary texts).
* Documents of which a good part is common shingles, or which have few, carry
  the whole prefix that linked sets must share by counting (a quarter of the
  set and one), rare shingles first. This is exact.

What is common is read from counters over all documents, of a fixed number
(2**SKETCH_BITS); which shingles are called common decides only how fast this
is, never what is found.

Only components are wanted, so no pairs are sent round: equal sets are one
class; each neighbourhood's members are first compared with one hub, which
connects most of a group of copies; then the trees are asked for what is not
yet connected. They pass on which members have a candidate, not the pairs; the
members' sets are joined to them, each neighbourhood is verified in one go,
and a star for each of its components comes out. A pair is looked at in the
first neighbourhood that its documents share. Of a neighbourhood of more than
PART documents the largest component, whose members need not be compared with
each other, and the rest are dealt out in parts: a part of the rest meets every
part, so that c documents of which r are not yet connected cost c rows and
r * c / PART more. A set is known by a 64-bit hash of its shingles.

Nulls: a null text is empty; texts without words link with nothing, and so do
rows with a null doc_id (their component is null). Repeated rows are linked as
equal texts. An empty table gives no rows. Columns besides doc_id and text are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import kernels
from quire.llm.common import connected_components, documents, partitions, sliced, sorted_groups, stored, with_groups

SIZE = 5
PERCENT = 75
SIGNATURE = 32
RARE_SHARE = 0.6
SKETCH_BITS = 19
COMMON = 200
GROUPS = 256
LEAF = 16
PART = 128
#: A count of 255 or more is kept as 255 and read as this: no bound is lost.
_MANY = 10_000_000
_CHUNKS = 32
MARK_BITS = 23


def linked(common, a, b):
    """Whether sets of sizes a and b with so many common members link: 100 * intersection >= 75 * union."""
    return 100 * common >= PERCENT * (a + b - common)


def needed(a, b):
    """The smallest intersection with which sets of sizes a and b link."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def point(shingles: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles in each group, as bytes."""
    return np.minimum(np.bincount((shingles >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS), 255).astype(np.uint8)


def read_points(points: list[bytes]) -> np.ndarray:
    """Rows of counts for the bound."""
    out = np.frombuffer(b"".join(points), np.uint8).reshape(-1, GROUPS).astype(np.int64)
    out[out == 255] = _MANY
    return out


def packed(shingles: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: two of a pair's shingles are taken for one with a chance under 1e-9."""
    return shingles.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    h = xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))
    return h - (1 << 64) if h >> 63 else h


def signature(shingles: np.ndarray, is_common: np.ndarray) -> np.ndarray:
    """The shingles under which a document is filed; see the module's text."""
    n = len(shingles)
    prefix = n - -(-PERCENT * n // 100) + 1
    common = is_common[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    rare = shingles[~common]
    if len(rare) >= RARE_SHARE * n:
        prefix = min(prefix, SIGNATURE)
    return np.concatenate([rare, shingles[common]])[:prefix]


# --- counters -------------------------------------------------------------


def _count_batches(batches):
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in sliced(batches):
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            own = kernels.shingle_set(text)
            np.add.at(total, (own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
    yield _counters(total)


def _counters(total):
    parts = total.astype("<u4").reshape(_CHUNKS, -1)
    return pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])


def _sum_batches(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(counts, "<u4").astype(np.int64)
            sums[chunk] = sums[chunk] + own if chunk in sums else own
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype("<i8").tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])


def common_counters(texts: DataFrame) -> np.ndarray:
    """Which counters hold a common shingle. The driver gets the counters only, 2**SKETCH_BITS numbers."""
    parts = texts.mapInArrow(_count_batches, "chunk int, counts binary").repartition(_CHUNKS, "chunk").mapInArrow(_sum_batches, "chunk int, counts binary")
    total = np.zeros((_CHUNKS, (1 << SKETCH_BITS) // _CHUNKS), np.int64)
    for r in parts.collect():
        total[r.chunk] += np.frombuffer(r.counts, "<i8")
    total = total.ravel()
    usual = float(np.median(total))
    return total > usual + max(COMMON, 8 * np.sqrt(usual))


# --- classes and signatures ----------------------------------------------


def _signature_batches(shared):
    def run(batches):
        is_common, seen = shared.value, set()
        for batch in sliced(batches):
            cls, size, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                own = kernels.shingle_set(text)
                size.append(len(own))
                c = class_of(own) if len(own) else None
                cls.append(c)
                if c is None or c in seen:
                    keys.append(None)
                else:
                    seen.add(c)
                    keys.append(signature(own, is_common).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cls, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *batch.columns[2:]],
                names=["doc_id", "cls", "n", "keys", *batch.schema.names[2:]],
            )

    return run


def _set_batches(shared_marks, shared_common):
    """Sets, points and signatures of the rows whose class and doc_id are marked, each class once for a task."""

    def run(batches):
        marks, is_common, seen = shared_marks.value, shared_common.value, set()
        for batch in sliced(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = kernels.shingle_set(text)
                c = class_of(own) if len(own) else None
                if c is not None and c not in seen and marks[_row_mark(c, doc_id)]:
                    seen.add(c)
                    rows.append((c, len(own), point(own).tobytes(), np.sort(signature(own, is_common).view(np.int64)).tobytes(), packed(own)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["cls", "n", "point", "filed", "members"]
            )

    return run


_MASK = (1 << MARK_BITS) - 1


def _row_mark(cls: int, doc_id: int) -> int:
    return ((cls >> 17) ^ ((doc_id & _MASK) * 40503)) & _MASK


def _row_place():
    return F.shiftright("cls", 17).bitwiseXOR(F.col("own").bitwiseAND(_MASK) * 40503).bitwiseAND(_MASK)


def _class_place():
    return F.shiftright("cls", 17).bitwiseAND(_MASK)


def _mark_words(classes: DataFrame, place) -> DataFrame:
    """A bit map of fixed size of some classes or rows, in words of 32768 bits; a few others share a bit."""
    return classes.select((place / 32768).cast("int").alias("w"), (place % 32768).alias("b")).groupBy("w").agg(F.expr("bitmap_construct_agg(b)").alias("m"))


def _marks(rows: DataFrame) -> np.ndarray:
    """The bit map of rows (cls, own), 2**MARK_BITS bits."""
    out = np.zeros(((1 << MARK_BITS) // 32768, 32768), bool)
    for r in _mark_words(rows, _row_place()).collect():
        out[r.w] = np.unpackbits(np.frombuffer(r.m, np.uint8), bitorder="little")
    return out.ravel()


def marked(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets of some classes (and of a few others), so that a join moves little else. The bit map, 2**MARK_BITS bits, is broadcast."""
    byte = F.conv(F.hex(F.substr(F.col("m"), ((F.col("p") % 32768) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        sets.withColumn("p", _class_place()).withColumn("w", (F.col("p") / 32768).cast("int"))
        .join(F.broadcast(_mark_words(classes, _class_place())), "w")
        .withColumn("byte", byte)
        .where("shiftright(byte, CAST(p % 8 AS INT)) & 1 = 1")
        .select(*sets.columns)
    )


# --- pairs ----------------------------------------------------------------


def _bound_batches(batches):
    """Pairs whose points allow a link."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (read_points(batch.column(c).to_pylist()) for c in (4, 5))
        n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        keep = np.minimum(a, b).sum(1) >= needed(n, m)
        kept = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The number of common members of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _verify_batches(batches):
    for batch in batches:
        a, b, keep = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
        for x, y in zip(a, b):
            x, y = unpacked(x), unpacked(y)
            keep.append(bool(linked(overlap(x, y), len(x), len(y))))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["src", "dst"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, as (src, dst): the bound by points first, then the sets themselves.

    The hints make small tables take the way that large ones take.
    """
    pts = sets.select("cls", "n", "point")
    ends = lambda df, name, cols: df.select(F.col("cls").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in cols))
    bounded = (
        pairs.join(ends(pts, "a", ["n", "point"]), "a").join(ends(pts, "b", ["n", "point"]), "b")
        .where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
        .select("a", "b", "n_a", "n_b", "point_a", "point_b")
        .mapInArrow(_bound_batches, "a long, b long")
    )
    bounded = stored(bounded, "bounded")
    whole = marked(sets.select("cls", "members"), bounded.select(F.explode(F.array("a", "b")).alias("cls")))
    return (
        bounded.hint("shuffle_merge").join(ends(whole, "a", ["members"]), "a").hint("shuffle_merge").join(ends(whole, "b", ["members"]), "b")
        .select("a", "b", "members_a", "members_b")
        .mapInArrow(_verify_batches, "src long, dst long")
    )


class CountTree:
    """An R-tree over points: leaves of LEAF points, and over them boxes of LEAF boxes up to one root.

    Points are packed by set size and then by their strongest groups, so
    that boxes hold sets of like size. A box keeps the largest count of each
    group and the smallest and largest set size below it.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        band = np.log(np.maximum(sizes, 1)) // 0.1
        spread = points.astype(float) / np.maximum(sizes, 1)[:, None]
        top = int(spread.var(0).argmax()) if len(points) else 0
        self.order = np.lexsort((spread[:, top], band))
        self.levels = []
        high, low_n, high_n = points[self.order], sizes[self.order], sizes[self.order]
        while len(high) > 1 or not self.levels:
            cuts = np.arange(0, len(high), LEAF)
            high, low_n, high_n = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low_n, cuts), np.maximum.reduceat(high_n, cuts)
            self.levels.append((high, low_n, high_n))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Rows whose bound against a point allows a link."""
        low, high = -(-PERCENT * size // 100), size * 100 // PERCENT
        boxes = np.array([0])
        for k in range(len(self.levels) - 1, -1, -1):
            most, least_n, most_n = (x[boxes] for x in self.levels[k])
            fits = (most_n >= low) & (least_n <= high)
            fits &= np.minimum(most, point).sum(1, dtype=np.int64) >= needed(size, np.maximum(least_n, low))
            boxes = boxes[fits]
            below = len(self.levels[k - 1][0]) if k else len(self.order)
            boxes = (boxes[:, None] * LEAF + np.arange(LEAF)).ravel()
            boxes = boxes[boxes < below]
        rows = self.order[boxes]
        n = self.sizes[rows]
        ok = (n >= low) & (n <= high) & (np.minimum(self.points[rows], point).sum(1, dtype=np.int64) >= needed(size, n))
        return rows[ok]


def _first_shared(filed: list[np.ndarray], key: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether pairs of documents that share key share no smaller one."""
    smaller = [f[: np.searchsorted(f, key)] for f in filed]
    values, at, counts = np.unique(np.concatenate(smaller), return_inverse=True, return_counts=True)
    kept = np.cumsum(counts > 1) - 1
    if not len(values) or kept[-1] < 0:
        return np.ones(len(i), bool)
    return ~_shares(_bits(smaller, at, counts > 1, kept), i, j).astype(bool)


def _bits(sets: list[np.ndarray], at: np.ndarray, use: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A row of bits for each set: which of the used values it holds. at: the sets' values in order, as numbers."""
    out = np.zeros((len(sets), int(place[-1]) // 64 + 1), np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kept = use[at]
    bit = place[at[kept]]
    np.bitwise_or.at(out, (row[kept], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
    return out


def _shares(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bits rows i and j share, some million words at a time."""
    out, step = np.zeros(len(i), np.int64), max(1, (1 << 20) // bits.shape[1])
    for at in range(0, len(i), step):
        out[at : at + step] = np.bitwise_count(bits[i[at : at + step]] & bits[j[at : at + step]]).sum(1)
    return out


def _candidates(key, side, comp, n, points, filed):
    """Pairs (i, j) of a neighbourhood's members that are not connected, whose bound allows a link, and that meet here first."""
    tree = CountTree(points, n)
    pairs = []
    for k in range(len(n)):
        rows = tree.search(points[k], int(n[k]))
        rows = rows[(rows > k) & (comp[rows] != comp[k])]
        if side is not None:
            rows = rows[side[rows] != side[k]]
        pairs.append((np.full(len(rows), k), rows))
    i, j = (np.concatenate(x) for x in zip(*pairs))
    if len(i):
        first = _first_shared(filed, key, i, j)
        i, j = i[first], j[first]
    return i, j


def _member_batches(batches):
    """Sorted neighbourhoods in; out come the members that have a candidate."""
    for group in sorted_groups(batches, 3):
        key, part, other = (group.column(c)[0].as_py() for c in range(3))
        cls, side, comp, n = (group.column(c).to_numpy() for c in (3, 4, 5, 6))
        if len(cls) < 2 or (comp == comp[0]).all():
            continue
        filed = [np.frombuffer(f, np.int64) for f in group.column(8).to_pylist()]
        i, j = _candidates(key, None if part == other else side, comp, n, read_points(group.column(7).to_pylist()), filed)
        has = np.zeros(len(cls), bool)
        has[i] = has[j] = True
        m = int(has.sum())
        if m:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * m), pa.array([part] * m, pa.int32()), pa.array([other] * m, pa.int32()), pa.array(cls[has]), group.column(4).filter(pa.array(has)), pa.array(comp[has])],
                names=["key", "part", "other", "cls", "side", "component"],
            )


def _link_batches(batches):
    """Sorted neighbourhoods of sets in; out comes a star for each component of their links."""
    for group in sorted_groups(batches, 3):
        key, part, other = (group.column(c)[0].as_py() for c in range(3))
        cls, side, comp = (group.column(c).to_numpy() for c in (3, 4, 5))
        filed = [np.frombuffer(f, np.int64) for f in group.column(6).to_pylist()]
        sets = [unpacked(x) for x in group.column(7).to_pylist()]
        n = np.array([len(x) for x in sets])
        i, j = _candidates(key, None if part == other else side, comp, n, read_points([point(x).tobytes() for x in sets]), filed)
        if not len(i):
            continue
        _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.cumsum(counts > 1) - 1
        shared = _shares(_bits(sets, at, counts > 1, np.maximum(place, 0)), i, j)
        ok = linked(shared, n[i], n[j])
        i, j = i[ok], j[ok]
        label = cls.copy()
        while True:
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
            if (low == label).all():
                break
            label = low
        moved = label != cls
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array(cls[moved]), pa.array(label[moved])], names=["src", "dst"])


def _with_components(rows: DataFrame, components: DataFrame) -> DataFrame:
    return rows.join(components.withColumnRenamed("node", "cls").hint("shuffle_merge"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))


def _blocks(placed: DataFrame) -> DataFrame:
    """What is not connected yet, in blocks of at most 2 * PART members: key, part, other, cls, side, component.

    placed: key, c (its members), cls, component. A small neighbourhood is one
    block. A larger one has parts of those outside its largest component, and
    behind them parts of that component, which do not meet each other.
    """
    columns = ["key", "part", "other", "cls", "side", "component"]
    small = placed.where(F.col("c") <= PART)
    ends = small.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    whole = small.join(ends, "key").select("key", F.lit(0).alias("part"), F.lit(0).alias("other"), "cls", F.lit(0).alias("side"), "component")
    large = placed.where(F.col("c") > PART)
    counts = large.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")).where("all > most")
    main = stored(main.select(
        "key", "main", F.ceil((F.col("all") - F.col("most")) / PART).cast("int").alias("rest"), F.ceil(F.col("most") / PART).cast("int").alias("mains"),
    ), "main")
    in_main = F.col("component") == F.col("main")
    h = F.xxhash64("cls", "key")
    sided = large.join(main, "key").withColumn(
        "side", F.when(in_main, F.col("rest") + F.pmod(h, F.col("mains"))).otherwise(F.pmod(h, F.col("rest"))).cast("int")
    )
    met = F.explode(F.sequence(F.lit(0), F.col("rest") - 1 + F.when(in_main, 0).otherwise(F.col("mains"))))
    dealt = sided.withColumn("b", met).select("key", F.least("side", "b").alias("part"), F.greatest("side", "b").alias("other"), "cls", "side", "component")
    return whole.select(*columns).unionByName(dealt.select(*columns))


def _each_once(sets: DataFrame) -> DataFrame:
    """One row of each class. The sets come from their classes' smallest doc_ids, so rows too many are few; they are found by their numbers, and no set is shuffled for it."""
    tags = sets.groupBy("cls").agg(F.min("tag").alias("first"), F.count("*").alias("c")).where("c > 1")
    more = stored(sets.select("cls", "tag").join(tags, "cls").where("tag <> first").select("tag"), "more")
    return (sets if more.isEmpty() else sets.join(more, "tag", "left_anti")).drop("tag")


def _placed(docs: DataFrame, mark: str | None = None) -> DataFrame:
    """doc_id, cls, n, component (a class of it), low (its smallest doc_id) for every row, and the column mark (a long), if given.

    cls, component and low are null where a text has no words or doc_id is null.
    """
    spark = docs.sparkSession
    n_parts = partitions(spark)
    own = [F.col(mark).alias("mark")] if mark else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *own)
    known = rows.where("doc_id is not null and text is not null")
    common = spark.sparkContext.broadcast(common_counters(known.select("text")))
    signed = stored(rows.mapInArrow(_signature_batches(common), "doc_id long, cls long, n long, keys array<long>" + ", mark long" * len(own)), "signed")
    filed = signed.where("doc_id is not null and keys is not null").select(F.explode("keys").alias("key"), "cls")
    shared_keys = filed.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("c")).where("low <> high").select("key", "c")
    shared_keys = stored(shared_keys, "shared")
    near = stored(filed.join(shared_keys, "key").select("key", "c", "cls").distinct(), "near")
    rows = signed.drop("keys")
    lows = stored(rows.where("doc_id is not null and cls is not null").groupBy("cls").agg(F.min("doc_id").alias("own")), "lows")
    marks = spark.sparkContext.broadcast(_marks(near.select("cls").distinct().join(lows, "cls")))
    sets = _each_once(stored(
        known.select("doc_id", "text").mapInArrow(_set_batches(marks, common), "cls long, n long, point binary, filed binary, members binary")
        .withColumn("tag", F.monotonically_increasing_id()),
        "sets", 256,
    ))

    # one hub for each neighbourhood, by an order that all share
    pairs = with_groups(near, "key", "c", PART, hub=F.min_by("cls", F.struct(F.xxhash64("cls"), "cls"))).where("cls <> hub")
    hubs = verified(pairs.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct(), sets)
    by_hub = connected_components(hubs, arrow_rows=256)

    # what is not connected yet, neighbourhood by neighbourhood
    left = _blocks(stored(_with_components(near, by_hub), "placed"))
    grouped = lambda df: df.repartition(n_parts, "key", "part", "other").sortWithinPartitions("key", "part", "other", "cls")
    found = stored(grouped(left.join(sets.select("cls", "n", "point", "filed"), "cls").select(*left.columns, "n", "point", "filed")).mapInArrow(
        _member_batches, "key long, part int, other int, cls long, side int, component long"
    ), "found")
    whole = marked(sets.select("cls", "filed", "members"), found.select("cls"))
    links = grouped(found.hint("shuffle_merge").join(whole, "cls").select(*found.columns, "filed", "members")).mapInArrow(_link_batches, "src long, dst long")

    # the components by hub stand for the links that made them
    edges = by_hub.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(links)

    # classes without a link are their own component; only linked ones need their component's smallest doc_id
    components = connected_components(edges, arrow_rows=256).withColumnRenamed("node", "cls")
    linked_lows = stored(lows.join(components, "cls"), "linked")
    smallest = stored(linked_lows.groupBy("component").agg(F.min("own").alias("low")), "smallest")
    linked_classes = linked_lows.join(smallest, "component").select("cls", "component", "low")
    by_class = stored(
        lows.join(linked_classes, "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"), F.coalesce("low", "own").alias("low")), "by_class"
    )
    return rows.join(by_class, "cls", "left")


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row."""
    return _placed(docs).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest doc_id.

    Where that doc_id repeats within its component, the row first by class and
    hash of the text stays. Rows without words link with nothing and rows with
    a null doc_id can't be linked, so all of these stay. A doc_id may stay more
    than once: with texts of different components.
    """
    name = "kept"
    while any(name + x in docs.columns for x in ("", "_mark", "_text")):
        name += "_"
    text = F.col("text").cast("string")
    alone = F.col("doc_id").isNull() | ~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked_docs = docs.where(~alone).withColumn(name + "_text", F.xxhash64(text))
    kept = (
        _placed(marked_docs, name + "_text").where("component is not null and doc_id = low")
        .groupBy("component").agg(F.min(F.struct("doc_id", "cls", "mark")).alias("first"))
        .select(F.col("first.doc_id").alias(name), F.col("first.mark").alias(name + "_mark"))
    )
    same = (F.col("doc_id").cast("long") == F.col(name)) & (F.col(name + "_text") == F.col(name + "_mark"))
    one = marked_docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", name + "_text"]).drop(name + "_text")
    return one.unionByName(docs.where(alone))


def op8_count_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(documents(spark, sf_dir))
