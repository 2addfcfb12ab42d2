"""Files that arrive in a folder, as a stream. Documents don't depend on each other, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, pattern: str = "*.pdf", per_trigger: int = 1000) -> DataFrame:
    """doc_id, length, content of files as they come; each is read once. The tables of `operators` take it as it is."""
    x = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)
    return x.select(F.col("path").alias("doc_id"), "length", "content")
