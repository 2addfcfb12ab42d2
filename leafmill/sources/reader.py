"""PDF collections as DataFrames: read from files, made from text tables, written back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leafmill.shipping import ship
from leafmill.sources.document import Document
from leafmill.sources.files import FileFault

#: Files in one Arrow batch: a file can be large, so few travel together.
BATCH_FILES = 64
ERROR = "error struct<kind:string,message:string>"


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_id (the path), length, content of every file below a path."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return x.select(F.col("path").alias("doc_id"), "length", "content")


def per_document(files: DataFrame, schema: str, rows_of: Callable[[Document, dict], Iterator[tuple]], password: bytes = b"", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of every file. A file that can't be read gives one row with its error and nulls, never a failed task.

    schema: columns behind the carried ones and before `error`. rows_of(document, row) gives tuples of them.
    carry: columns of files that each row keeps, so that they need no join to come back.
    """
    spark = files.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_FILES))
    kept = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in carry)
    full = f"{kept}, {schema}, {ERROR}"
    arrow = to_arrow_schema(StructType.fromDDL(full))
    width = len(arrow.names) - len(carry) - 1

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                own = tuple(row[c] for c in carry)
                try:
                    doc = Document.read(bytes(row["content"] or b""), password)
                    out += [(*own, *r, None) for r in rows_of(doc, row)]
                except FileFault as e:
                    out.append((*own, *[None] * width, {"kind": e.kind, "message": str(e)}))
                except Exception as e:  # noqa: BLE001  whatever a broken file leads to belongs to its own row
                    out.append((*own, *[None] * width, {"kind": type(e).__name__, "message": str(e)[:300]}))
                if len(out) >= 2000:
                    yield _batch(out, arrow)
                    out = []
            if out:
                yield _batch(out, arrow)

    return files.mapInArrow(run, full)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    def column(values: list, kind: pa.DataType) -> pa.Array:
        made = next((type(v).arrow for v in values if hasattr(v, "arrow")), pa.array)  # columns that are arrays already
        return made(values, kind)

    return pa.RecordBatch.from_arrays([column([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def make_file(text: str, title: str | None = None, lines: int = 50, size: float = 12.0) -> bytes:
    """A file with the lines of a text, so many to a page."""
    doc = Document()
    rows = text.split("\n")
    for i in range(0, max(1, len(rows)), lines):
        page = doc.add_page()
        doc.add_text(page, "\n".join(rows[i : i + lines]), 72, 740, size)
    if title is not None:
        doc.set_info("Title", title)
    return doc.write()


def make_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, lines: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, content and the columns in `keep`: a PDF file of each text; null texts give one empty page."""
    ship(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_FILES))
    kind = docs.schema[id_col].dataType.simpleString()
    wide = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < wide:  # a small table in one file would be made by one task
        docs = docs.repartition(wide)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(title_col).cast("string") if title_col else F.lit(None).cast("string")).alias("title"), *keep)

    def run(batches):
        for b in batches:
            made = [make_file(t or "", title, lines) for t, title in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary()), *b.columns[3:]], ["doc_id", "content", *keep])

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"doc_id {kind}, content binary{kept}")


def rewrite(files: DataFrame, edit: Callable[[Document], None], password: bytes = b"") -> DataFrame:
    """doc_id, content, error of the files after an edit; one that can't be read keeps its bytes and its error."""

    def rows(doc, row):
        edit(doc)
        yield (doc.write(),)

    x = per_document(files, "content binary", rows, password)
    return x


def save_files(files: DataFrame, path: str) -> None:
    """Keep files as Parquet rows (doc_id, content): safe on any store, and readable as a source again."""
    files.write.mode("overwrite").option("compression", "none").parquet(path)
