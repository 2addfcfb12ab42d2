"""Every query of the engine by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import hit_count
from leafmill.operators import tables
from leafmill.plans import codec_queries, column_queries, file_queries, kernel_queries, whole_files
from leafmill.sources.reader import make_files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for module in (file_queries, kernel_queries, column_queries, codec_queries, whole_files):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each language's documents say `the`: texts to PDF files, parsed, walked, read and counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = tables.page_texts(make_files(docs, keep=("lang",)), carry=("doc_id", "lang")).where("error is null")
    counted = text.select("doc_id", "lang", hit_count(F.col("text"), "the", True).alias("n"))
    return counted.groupBy("lang").agg(F.countDistinct("doc_id").alias("docs"), F.sum("n").alias("hits"))
