"""Token counts of whole texts (operator 5): overlapping chunks of huge texts, spliced where both agree."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm.common import small_batches
from leafmill.llm.tokens import encoder


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """One row for each row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_chunks, n_widened.

    Null text counts as empty: no bytes, no tokens, one chunk. Repeated rows and ids, null ids and ties
    are counted row by row. Other columns are ignored. An empty table gives an empty result. Runs
    without a shuffle; a task holds one Arrow batch and one chunk's encoding at a time.
    """
    small_batches(docs.sparkSession)

    def count(batches):
        enc = encoder(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            got = {}
            for i, ids in zip(short, enc.encode([texts[i] for i in short])):
                got[i] = (len(ids), 1, 0)
            rows = [got[i] if i in got else enc.count(t, chunk, overlap) for i, t in enumerate(texts)]
            n = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), n, pa.array([r[0] > limit for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                ["id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chunks long, n_widened long")
    return out.withColumnRenamed("id", id_col)
