"""Sharding by fixed virtual slots.

Every record is hashed by its doc_id into one of n_slots slots, for good. A
slot-to-shard map, kept as a table with a version, says where a slot lives;
only the map is edited when shards are added or loads drift, so a record moves
only if its slot does: the newest map is loaded, rebalanced for the loads as
they are now, and written as the next version if that moved a slot. Law:
`bytes`, the shards' sizes are as equal as the slots allow.

A version is one folder, written aside and renamed when it is whole; versions
are never changed, and a version that is there already is an error.

The driver sees one row for each slot (n_slots at most, whatever the input).
Places in a slot of more than HOT_ROWS rows are counted in LANES lanes, so a
doc_id that a third of all rows repeat is no task of its own.

Nulls: a null text is empty; rows with a null doc_id are spread by their text.
Equal doc_ids share a slot and each row keeps a place of its own. An empty
table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import shared_dir, stored

N_SLOTS = 8192
LANES = 32
HOT_ROWS = 100_000
ROW_BYTES = 16
MAP_SCHEMA = "slot int, shard int"


def assign(slot_bytes: list[int], n_shards: int) -> list[int]:
    """A first map: slots by falling size, each to the shard with the fewest bytes so far."""
    load = [(0, 0, s) for s in range(n_shards)]
    shard_of = [0] * len(slot_bytes)
    for slot in sorted(range(len(slot_bytes)), key=lambda i: (-slot_bytes[i], i)):
        size, n, shard = heapq.heappop(load)
        shard_of[slot] = shard
        heapq.heappush(load, (size + slot_bytes[slot], n + 1, shard))
    return shard_of


def rebalance(shard_of: list[int], slot_bytes: list[int], n_shards: int, tolerance: float = 0.02) -> list[int]:
    """Edit a map for n_shards shards, moving few slots.

    Slots of shards that are gone go to the lightest shard. Then slots move
    from the heaviest to the lightest shard while the gap is over tolerance
    times the mean and the move makes it smaller.
    """
    out = list(shard_of)
    load = [0] * n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    homeless = []
    for slot, shard in enumerate(out):
        if shard < n_shards:
            load[shard] += slot_bytes[slot]
            held[shard].append(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda i: -slot_bytes[i]):
        to = min(range(n_shards), key=lambda s: (load[s], len(held[s])))
        out[slot] = to
        load[to] += slot_bytes[slot]
        held[to].append(slot)
    mean = sum(slot_bytes) / n_shards
    for _ in range(len(out) * 2):
        high, low = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[high] - load[low]
        fit = [s for s in held[high] if 0 < slot_bytes[s] < gap]
        if gap <= tolerance * mean or not fit:
            break
        slot = min(fit, key=lambda s: (abs(gap / 2 - slot_bytes[s]), s))
        held[high].remove(slot)
        held[low].append(slot)
        load[high] -= slot_bytes[slot]
        load[low] += slot_bytes[slot]
        out[slot] = low
    return out


def _folder(spark: SparkSession, path: str):
    """Hadoop's view of a folder: its file system and path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of the map at path, oldest first."""
    files, at = _folder(spark, path)
    if not files.exists(at):
        return []
    names = [f.getPath().getName() for f in files.listStatus(at)]
    return sorted(int(n[len("version=") :]) for n in names if n.startswith("version="))


def save_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Add a version of the map at path: written aside, then renamed as a whole."""
    files, at = _folder(spark, path)
    whole = spark._jvm.org.apache.hadoop.fs.Path(at, f"version={version}")
    if files.exists(whole):
        raise ValueError(f"version {version} of the map at {path} is there already")
    aside = spark._jvm.org.apache.hadoop.fs.Path(at, f".written-{uuid.uuid4().hex}")
    spark.createDataFrame(list(enumerate(shard_of)), MAP_SCHEMA).coalesce(1).write.parquet(aside.toString())
    if not files.rename(aside, whole):
        raise ValueError(f"version {version} of the map at {path} was not written")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The map's rows (slot, shard) of a version, the newest if none is named."""
    if version is None:
        version = versions(spark, path)[-1]
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}")


def current_map(spark: SparkSession, path: str, size: list[int], n_shards: int, tolerance: float = 0.0) -> tuple[int, list[int]]:
    """The version in force and its map, for slots of these sizes: the newest one, edited and saved as the next version if it needs to be."""
    known = versions(spark, path)
    if not known:
        shard_of = rebalance(assign(size, n_shards), size, n_shards, tolerance)  # so that the same loads need no edit
        save_map(spark, path, 1, shard_of)
        return 1, shard_of
    before = [r.shard for r in load_map(spark, path, known[-1]).orderBy("slot").collect()]
    if len(before) != len(size):
        raise ValueError(f"the map at {path} has {len(before)} slots, not {len(size)}")
    after = rebalance(before, size, n_shards, tolerance)
    if after == before:
        return known[-1], before
    save_map(spark, path, known[-1] + 1, after)
    return known[-1] + 1, after


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, virtual_slot, lane). The slot is the doc_id's, whatever its text becomes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    mark = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    return rows.withColumn("virtual_slot", F.pmod(mark, F.lit(n_slots)).cast("int")).withColumn("lane", F.pmod(F.monotonically_increasing_id(), F.lit(LANES)).cast("int"))


def slot_loads(rows: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot."""
    size, count = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.virtual_slot], count[r.virtual_slot] = r.b, r.n
    return size, count


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Put all rows into n_shards shards by the map at map_path: the newest version, edited for these loads.

    Returns doc_id, size, text_crc32, virtual_slot, map_version, shard and
    slot: the row's place in its shard, gapless from 0. Places are counted
    within a lane of a virtual slot and then moved by what earlier lanes and the
    shard's earlier slots hold, so no task ever holds a shard or a hot slot.
    """
    spark = docs.sparkSession
    rows = stored(slotted(docs, n_slots), "slotted")
    size, count = slot_loads(rows, n_slots)
    map_path = map_path or f"{shared_dir(spark)}/quire-slot-map-{uuid.uuid4().hex}"
    version, shard_of = current_map(spark, map_path, size, n_shards)
    held = [0] * n_shards
    before = []
    for slot in range(n_slots):
        before.append((slot, shard_of[slot], held[shard_of[slot]], count[slot] > HOT_ROWS))
        held[shard_of[slot]] += count[slot]
    places = F.broadcast(spark.createDataFrame(before, "virtual_slot int, shard int, base long, hot boolean"))
    placed = rows.join(places, "virtual_slot").withColumn("lane", F.when(F.col("hot"), F.col("lane")).otherwise(0))
    within = Window.partitionBy("virtual_slot", "lane").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.row_number().over(within).cast("long"))
    if any(n > HOT_ROWS for n in count):
        # n_slots * LANES rows at most
        earlier = Window.partitionBy("virtual_slot").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
        lanes = placed.where("hot").groupBy("virtual_slot", "lane").agg(F.count("*").alias("n"))
        lanes = lanes.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("virtual_slot", "lane", "start")
        ranked = ranked.join(F.broadcast(lanes), ["virtual_slot", "lane"], "left")
    else:
        ranked = ranked.withColumn("start", F.lit(0).cast("long"))
    return ranked.select(
        "doc_id", "size", "text_crc32", "virtual_slot", F.lit(version).alias("map_version"), "shard",
        (F.col("base") + F.coalesce("start", F.lit(0)) + F.col("rank") - 1).alias("slot"),
    )


def op2_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39; law `bytes`. The table's map is kept with the shared folder and edited by later runs."""
    path = f"{shared_dir(spark)}/quire-slot-maps/{hashlib.sha256(sf_dir.encode()).hexdigest()[:24]}"
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40, map_path=path)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
