"""What the operators share: the folder all executors see, tables written to cut lineage, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.shipping import ship

#: Rows and bytes in one Arrow batch; texts can be long, so the row count is far below Spark's default.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
_stashed: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine only where the session names none (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    made = spark.conf.get("leafmill.local.shared.dir", None)
    if not made:
        made = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("leafmill.local.shared.dir", made)
    return made


def stash(df: DataFrame, name: str, codec: str = "zstd", rows_a_file: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives a lost executor. rows_a_file: at most, 0 for any."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).option("maxRecordsPerFile", rows_a_file).parquet(path)
    _stashed.append(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table that this application stashed; call it when no result is read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _stashed:
        path = jvm.org.apache.hadoop.fs.Path(_stashed.pop())
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Before Python work: the package on every executor, and batches of bounded size."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_sql(column: str = "text") -> str:
    """Spark SQL for the words of a text: A-Z lowered, runs of bytes other than ASCII signs and spaces."""
    return f"filter(split(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+'), w -> w <> '')"


#: The same for bytes in Python: every delimiter becomes a space, A-Z becomes a-z; then bytes.split().
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: maximal runs of digits, lowered ASCII letters and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def text_key(*columns: str) -> Column:
    return F.xxhash64(*columns)
