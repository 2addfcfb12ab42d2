"""Benchmark decontamination (operator 6): Wu-Manber search for benchmark word windows in whole documents.

Symbols are words. Patterns of one length form a class with a shift table over blocks of two words (one
word for patterns of one): how far the search may move when a block ends the current window. A block that
no pattern holds lets it skip all but one word of a pattern. A shift of zero leads to the bucket of
patterns that end with that block, each of which is compared word by word.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import small_batches, words

#: Benchmark bytes searched for in one pass; a larger benchmark takes several passes over the documents.
#: The tables of a pass take some 100 bytes for each, in every Python worker.
PASS_BYTES = 4 << 20


class Patterns:
    """Search tables of the windows of some items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.items = [i for i, _ in items]
        found: dict[tuple, list[int]] = {}
        for k, (_, w) in enumerate(items):
            m = min(window, len(w))
            for j in range(len(w) - m + 1 if m else 0):
                own = found.setdefault(tuple(w[j : j + m]), [])
                if not own or own[-1] != k:
                    own.append(k)
        self.classes = []
        for m in sorted({len(p) for p in found}):
            block = min(2, m)
            shift, bucket = {}, {}
            for p, own in found.items():
                if len(p) != m:
                    continue
                for end in range(block, m + 1):
                    key = p[end - block : end] if block == 2 else p[end - 1]
                    shift[key] = min(shift.get(key, m), m - end)
                bucket.setdefault(p[-2:] if block == 2 else p[-1], []).append((p, own))
            self.classes.append((m, block, shift, bucket))

    def search(self, w: list[bytes]) -> tuple[bytearray, set[int]]:
        """(hit marks by word, items that occur)."""
        hit, seen, n = bytearray(len(w)), set(), len(w)
        for m, block, shift, bucket in self.classes:
            free, at = m - block + 1, m
            while at <= n:
                key = (w[at - 2], w[at - 1]) if block == 2 else w[at - 1]
                by = shift.get(key, free)
                if by:
                    at += by
                    continue
                here = tuple(w[at - m : at])
                for p, own in bucket[key]:
                    if p == here:
                        hit[at - m : at] = b"\1" * m
                        seen.update(own)
                at += 1
        return hit, seen


_tables: dict[str, Patterns] = {}


def _patterns(name: str, shared, window: int) -> Patterns:
    """The tables of a broadcast block, made once for each Python worker; the last two blocks are kept."""
    if name not in _tables:
        while len(_tables) > 1:
            del _tables[next(iter(_tables))]
        _tables[name] = Patterns(shared.value, window)
    return _tables[name]


def _passes(benchmark: DataFrame, item_col: str, text_col: str):
    """Benchmark rows in blocks of bounded size, each fit for the driver."""
    rows, size = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if item is None:
            continue
        rows.append((item, words(text)))
        size += len((text or "").encode("utf-8", "surrogatepass"))
        if size > PASS_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: id, columns in `keep`, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. Every
    occurrence counts, overlapping ones too. Null and empty texts have no words: no hits, the hash of "".
    Items with a null id are left out; repeated items count once. Repeated rows and ids, null ids and other
    columns of any name pass through row by row. An empty benchmark or table gives no hits or no rows.
    Without a shuffle while the benchmark fits one pass; a larger one takes a pass for each block of it,
    joined by row.
    """
    small_batches(docs.sparkSession)
    spark, keep = docs.sparkSession, keep or []
    kept = [docs[c].alias(f"keep_{i}") for i, c in enumerate(keep)]
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), *kept)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")

    def finder(block, last):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def find(batches):
            tables = _patterns(name, shared, window)
            for b in batches:
                n_words, marks, items = [], [], []
                for text in b.column("text").to_pylist():
                    w = words(text)
                    hit, seen = tables.search(w)
                    n_words.append(len(w))
                    marks.append(bytes(hit))
                    items.append(sorted({tables.items[k] for k in seen}))
                rest = [b.column(i) for i, f in enumerate(b.schema.names) if f != "text"]
                cols = [*rest, pa.array(n_words, pa.int64())]
                if last:
                    cols += [pa.array([m.count(1) for m in marks], pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([1 in m for m in marks], pa.bool_())]
                    yield pa.RecordBatch.from_arrays(cols, [*(f for f in b.schema.names if f != "text"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
                else:
                    cols += [pa.array([[i for i, x in enumerate(m) if x] for m in marks], pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, [*(f for f in b.schema.names if f != "text"), "n_words", "hit", "items"])

        return find

    # blocks come one after another and are broadcast as they come: the driver holds two at a time
    blocks = _passes(benchmark.select(item_col, item_text_col), item_col, item_text_col)
    block, ahead = next(blocks, []), next(blocks, None)
    if ahead is None:
        out = rows.mapInArrow(finder(block, True), f"{head}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    else:
        rows = rows.withColumn("row", F.xxhash64(*[c for c in rows.columns]))
        head += ", `row` bigint"
        every, n = None, 0
        while block is not None:
            part = rows.mapInArrow(finder(block, False), f"{head}, n_words long, hit array<long>, items array<string>")
            every, n = part if every is None else every.unionByName(part), n + 1
            block, ahead = ahead, next(blocks, None)
        named = [f for f in rows.columns if f not in ("text", "row")]
        # identical rows find the same words: they meet in one group and part again by their number
        grouped = every.groupBy(*named, "row").agg(F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_set("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), (F.count("*") / n).cast("int").alias("copies"))
        out = grouped.select(*named, "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"), F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    for i, c in enumerate(keep):
        out = out.withColumnRenamed(f"keep_{i}", c)
    return out.withColumnRenamed("id", id_col)
