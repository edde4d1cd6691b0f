"""Files of any format as rows: one row for each file, with its pages' text.

    read(spark, path) gives doc_id, format, status, error, title, author and
    pages (page_index, width, height, text). A file that cannot be read has
    status 'error'.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import format_of_bytes, format_of_path

_PAGES = "array<struct<page_index:int,width:double,height:double,text:string>>"
SCHEMA = f"doc_id string, format string, status string, error string, title string, author string, pages {_PAGES}"


def _row(doc_id, kind, data) -> dict:
    from quire.formats import readers

    try:
        p = readers.read(bytes(data or b""), kind)
        rows = [{"page_index": k, "width": w, "height": h, "text": t} for k, (t, (w, h)) in enumerate(zip(p.texts, p.sizes))]
        return {"doc_id": doc_id, "format": kind, "status": "ok", "title": p.title, "author": p.author, "pages": rows}
    except Exception as e:  # noqa: BLE001  (whatever a damaged file makes a reader raise: archives, inflate, XML)
        return {"doc_id": doc_id, "format": kind, "status": "error", "error": str(e) or type(e).__name__}


def parse(files: DataFrame) -> DataFrame:
    """Files (doc_id, content, and format or else by name and content) as rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMA)
    if "format" not in files.columns:
        by_name = format_of_path(F.col("doc_id"))
        files = files.withColumn("format", F.when(by_name != "Unknown", by_name).otherwise(format_of_bytes(F.col("content"))))

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                own = batch.slice(at, 16)
                rows = [_row(*r) for r in zip(*(c.to_pylist() for c in own.columns))]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

    return files.select("doc_id", "format", "content").mapInArrow(run, schema)


def read(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """All files under path, one task for a file's bytes and text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return parse(files.select(F.col("path").alias("doc_id"), "content"))


def pages(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "format", F.explode("pages").alias("p")).select("doc_id", "format", "p.*")


def to_pdf(files: DataFrame) -> DataFrame:
    """doc_id and content as PDF, from files of any format; null content for what cannot be read."""

    def convert(kinds, contents):
        import pandas as pd

        from quire.formats import readers

        out = []
        for kind, data in zip(kinds, contents):
            try:
                out.append(readers.to_pdf(readers.read(bytes(data), kind)))
            except Exception:  # noqa: BLE001
                out.append(None)
        return pd.Series(out, dtype=object)

    return files.select("doc_id", F.pandas_udf(convert, "binary")("format", "content").alias("content"))
