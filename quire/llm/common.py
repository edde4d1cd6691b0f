"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.materialize import spread

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none and all runs on this machine (as in local
    tests) a local folder is made, once for each application; a cluster that
    names none is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quire-")
    return _OWN[app]


def stored(df: DataFrame, name: str, arrow_rows: int = 1000) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This cuts the lineage; the copy survives the loss of any executor. While
    it is written, Arrow batches hold arrow_rows rows at most: rows are whole
    texts or sets, of which the usual 10,000 would be large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}/{name}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(arrow_rows, int(before)) if int(before) > 0 else arrow_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; of a table that is small and would be read by fewer tasks than there are cores the rows are dealt out first."""
    return spread(table(spark, sf_dir, "documents"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What kernels remember in a worker, by kernel.
memories: dict[str, dict] = {}


def release(kernel: str = "") -> None:
    for name, memory in memories.items():
        if name != kernel:
            memory.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_slices(values: pa.Array, f, rows: int = 512) -> list:
    """f over the values of an Arrow array, a few rows as Python objects at a time; f maps a list to a list."""
    out: list = []
    for at in range(0, len(values), rows):
        out += f(values.slice(at, rows).to_pylist())
    return out


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 512, kernel: str = "") -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that what a kernel makes of one stays small.

    Workers outlive stages: what other kernels remember is dropped, and memory
    that is free goes back to the system.
    """
    release(kernel)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def sorted_groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal first n_keys columns (integers, no nulls) of sorted batches, one batch for each run."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(n_keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(k[a] for k in keys)
            if held and key != held_key:
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            held_key = key
    if held:
        yield _joined(held)


def with_groups(rows: DataFrame, key: str, size: str, limit: int, **aggregates) -> DataFrame:
    """rows with aggregates over the rows of the same key, where size says how many these are.

    Keys of at most limit rows meet in a task. Of larger ones the aggregates,
    of which there are at most rows / limit, are written first: the join then
    has a plain table on each side and is a broadcast or can be split.
    """
    own = [f.alias(name) for name, f in aggregates.items()]
    small, large = rows.where(F.col(size) <= limit), rows.where(F.col(size) > limit)
    return small.join(small.groupBy(key).agg(*own), key).unionByName(large.join(stored(large.groupBy(key).agg(*own), "groups"), key))


#: Edge lists of at most so many edges (16 bytes each) are settled by one task.
ONE_TASK_EDGES = 500_000


def _union_find(batches):
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 40, one_task: int = ONE_TASK_EDGES, arrow_rows: int = 1000) -> DataFrame:
    """Connected components of an edge list (src, dst): rows (node, component).

    component is the smallest node reachable. The list is read once and written
    here (arrow_rows: see stored), so it need not be a written table. A list of
    at most one_task edges goes through one task. For longer ones the large-star
    and small-star steps alternate, which turn every component into a star around
    its smallest node in about log(n) rounds. Group minima are partial aggregates
    and are written before they are joined: with a plain table on each side a join
    is split by AQE where a hub has very many links, which it could not be next to
    an aggregate by the same key. Self-loops and nulls are ignored; nodes without
    an edge are not returned.
    """
    cur = stored(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(),
        "edges", arrow_rows,
    )
    if cur.count() <= one_task:
        return stored(cur.repartition(1).mapInArrow(_union_find, "node long, component long"), "components")
    before = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small_low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(small_low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        cur = stored(small, "edges")
        now = cur.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
