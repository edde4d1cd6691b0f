"""Written intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: dict[str, str] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df into the folder of spark.checkpoint.dir and read it again; where none is set and all runs on this machine, into one of our own."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "") or _OWN.update({app: "file://" + tempfile.mkdtemp(prefix="quire-")}) or _OWN[app]
    path = f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of less than this for each core are dealt out anew by spread.
SMALL_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores before work on whole texts or files, if it is small and its scan has fewer tasks than there are cores.

    A file of one row group is one task however it is split. Larger tables have
    tasks enough and stay as they are: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) >= SMALL_BYTES * cores or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(4 * cores)
