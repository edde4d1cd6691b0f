"""Documents as they arrive: a stream of files, each parsed once when it is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from quire.sources import documents, pdf

_FILES = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def file_stream(spark: SparkSession, path: str, glob: str = "*", max_files: int = 1000) -> DataFrame:
    """doc_id, length and content of files, in micro-batches of at most max_files."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(path)
    return files.select(F.col("path").alias("doc_id"), "length", "content")


def document_stream(spark: SparkSession, path: str, glob: str = "*", max_files: int = 1000) -> DataFrame:
    """Rows as documents.read gives them. A file is independent of all others, so no state is kept."""
    return documents.parse(file_stream(spark, path, glob, max_files).select("doc_id", "content"))


def pdf_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return pdf.parse(file_stream(spark, path, "*.pdf", max_files))
