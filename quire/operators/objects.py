"""Objects as rows: duplicates, latest versions, references and what they reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.materialize import stored


def duplicates(rows: DataFrame, data: str, key: str) -> DataFrame:
    """Rows by the SHA-256 of their data: sha256, copies, keeper (the smallest key)."""
    return rows.groupBy(F.sha2(F.col(data).cast("binary"), 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min(key).alias("keeper"))


def remapped(rows: DataFrame, data: str, key: str) -> DataFrame:
    """key and keeper for every row, by equal data.

    The keepers of data with copies are written first: the join then has plain
    tables on both sides, and many copies of one value can be split.
    """
    hashed = rows.select(F.col(key), F.coalesce(F.sha2(F.col(data).cast("binary"), 256), F.lit("")).alias("sha256"))
    copied = hashed.groupBy("sha256").agg(F.min(key).alias("keeper"), F.count("*").alias("copies")).where("copies > 1").select("sha256", "keeper")
    return hashed.join(stored(copied, "keepers"), "sha256", "left").select(key, F.coalesce("keeper", key).alias("keeper"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row for each key, by partial aggregation: no row is sorted and none but a running best is kept."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("row")).select(*keys, *(F.col("row")[c].alias(c) for c in rest))


def unreferenced(objects: DataFrame, edges: DataFrame, key: str, target: str) -> DataFrame:
    """Objects that nothing refers to."""
    return objects.join(edges.select(F.col(target).alias("__to")).distinct(), F.col(key) == F.col("__to"), "left_anti")


def reachable(edges: DataFrame, roots: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Nodes reached from roots along edges (src, dst): node.

    A frontier is joined to the edges until nothing new turns up. Each round's
    frontier is a written table, so a lost executor costs one round at most.
    What is seen is looked through for a round's candidates only (a broadcast
    while those are few), and its parts are put together as they grow, two of
    like age at a time, so a long chain does not read ever more files.
    """
    edges = stored(edges.select("src", "dst"), "edges")
    frontier = stored(roots.select("node").distinct(), "roots")
    parts = [(1, frontier)]
    for _ in range(max_rounds):
        seen = parts[0][1]
        for _, part in parts[1:]:
            seen = seen.union(part)
        found = stored(frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct(), "found")
        frontier = stored(found.join(seen.join(found, "node", "left_semi"), "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        parts.append((1, frontier))
        while len(parts) > 1 and parts[-1][0] == parts[-2][0]:
            (age, last), (_, before) = parts.pop(), parts.pop()
            parts.append((2 * age, stored(before.union(last), "seen") if age > 4 else before.union(last)))
    raise RuntimeError("the references do not end")


def renumbered(objects: DataFrame, doc: str, key: str) -> DataFrame:
    """Adds number: objects of each document from 1 without gaps."""
    return objects.withColumn("number", F.row_number().over(Window.partitionBy(doc).orderBy(key)).cast("long"))


def redacted(blocks: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks (x, y) that lie in no rectangle (x0, y0, x1, y1) of their page."""
    r = rects.select(*(F.col(k).alias(f"r_{k}") for k in keys), "x0", "y0", "x1", "y1")
    same = [F.col(k) == F.col(f"r_{k}") for k in keys]
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    return blocks.join(r, [*same, inside], "left_anti")


def replay(log: DataFrame, key: str, seq: str, undone: str) -> DataFrame:
    """The state of a journal: for each key the last operation that is not undone."""
    return latest(log.where(~F.col(undone)), [key], [seq])
