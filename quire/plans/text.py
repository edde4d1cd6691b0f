"""From files to text, in one pass: the common entry points as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import documents, pdf


def document_text(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """doc_id, format, status and the text of all pages, divided by blank lines."""
    rows = documents.read(spark, path, glob)
    return rows.select("doc_id", "format", "status", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n").alias("text"))


def pdf_text(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, status and the text of PDF files; only text is read of them."""
    parsed = pdf.parse(files, key=key, parts=["text"])
    return parsed.select(key, "status", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n").alias("text"))
