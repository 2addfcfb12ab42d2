"""Token-id output (operator 1): ids of a corpus in ascending id order as directly addressable codes.

Each record of the written Parquet files holds one complete image (`leafmill.llm.dac`) of a run of
documents. Parquet is only the envelope: it brings atomic commits, retries after lost executors and any
file system that Spark reaches; a record's bytes stand alone and can be kept as a file of their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm import dac
from leafmill.llm.common import small_batches
from leafmill.llm.tokens import encoder

#: Tokens after which an image is closed; a longer document has an image of its own.
IMAGE_TOKENS = 1 << 16
SHARDS = "part long, seq long, n_docs long, n_tokens long, inside long, image binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append end_id (None: nothing) and write images in ascending id order to `path`.

    Null text counts as empty; null ids come first and are stored as -2**63; rows that share an id stand in
    order of their text. One range shuffle puts the ids in order; a task holds one image at a time.
    """
    small_batches(docs.sparkSession)

    def write(batches):
        enc, part, seq, inside, ids, held, size = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0, [], [], 0

        def image():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64()), pa.array([inside], pa.int64()), pa.array([dac.pack(ids, held)], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "inside", "image"])

        for b in batches:
            for doc, got in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()])):
                got = got.astype(np.uint32)
                if end_id is not None:
                    got = np.append(got, np.uint32(end_id))
                if ids and size + len(got) > IMAGE_TOKENS:
                    yield image()
                    seq, inside, ids, held, size = seq + 1, inside + size, [], [], 0
                ids.append(-(1 << 63) if doc is None else doc)
                held.append(got)
                size += len(got)
        if ids:
            yield image()

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(write, SHARDS).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Read the images back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, first_id.

    The only thing gathered is one total for each written partition.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    small_batches(spark, 32)

    def read(batches):
        for b in batches:
            for raw, base in zip(b.column(0), b.column(1).to_pylist()):
                x = dac.Image(raw.as_buffer())
                ids, lo, hi = x.all().astype("<u4"), x.starts[:-1], x.starts[1:]
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(lo.tolist(), hi.tolist())]
                first = [x.get(i) if i < j else None for i, j in zip(lo.tolist(), hi.tolist())]
                null = x.doc_ids == -(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(x.doc_ids, pa.int64(), mask=null), pa.array(lo + base, pa.int64()), pa.array(hi - lo, pa.int64()), pa.array(crc, pa.int64()), pa.array(first, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32", "first_id"])

    # one row for each partition that was written: that bounds the broadcast
    placed = shards.join(F.broadcast(before), "part").select("image", (F.col("before") + F.col("inside")).alias("base"))
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long")
