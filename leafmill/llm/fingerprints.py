"""Document fingerprints (operator 9): digests of improbable features in chained Bloom filters.

Every window of 64 bytes gets the sum of its squared byte counts, which orders windows by collision
entropy: -log2(sum / 4096). The higher the entropy, the rarer the window in text; windows below `MIN_BITS`
are left out where others exist. In each run of 64 windows the rarest (leftmost on ties) wins, and a window
that wins at least `WINS` runs, or is the rarest of its document, becomes a feature. A filter of 2048 bits
takes 160 features at five bits each; a further one is chained behind it.

A fingerprint is base64 of its filters, each as its number of features (two bytes) and its bits.
Equal texts have equal fingerprints; a text without bytes has the empty one.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import small_batches

WINDOW, WINS, BITS, FEATURES, HASHES = 64, 16, 2048, 160, 5
MIN_BITS = 2.0
_MAX_SUM = int(WINDOW * WINDOW / 2**MIN_BITS)
_FILTER = 2 + BITS // 8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def square_sums(b: np.ndarray) -> np.ndarray:
    """Sum of squared byte counts of every window: pairs of equal bytes come and go as it slides."""
    ahead, behind = np.zeros(len(b), np.uint8), np.zeros(len(b), np.uint8)
    for d in range(1, WINDOW):
        same = (b[d:] == b[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    first = int((np.bincount(b[:WINDOW]).astype(np.int64) ** 2).sum())
    step = 2 * (behind[WINDOW:].astype(np.int32) - ahead[: len(b) - WINDOW].astype(np.int32))
    return np.concatenate([[first], first + np.cumsum(step, dtype=np.int64)])


def _features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature hash) of texts of WINDOW bytes or more, in order of their place."""
    size = np.array([len(r) for r in raws], np.int64)
    b = np.frombuffer(b"".join(raws), np.uint8)
    sums = square_sums(b)
    sums = np.where(sums > _MAX_SUM, sums + (1 << 20), sums)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    wins = size - WINDOW + 1
    # windows that lie in one document, document after document; key: rarity, then place
    at = np.repeat(start - np.concatenate([[0], np.cumsum(wins)[:-1]]), wins) + np.arange(wins.sum())
    key = (sums[at] << 40) | at
    low = np.concatenate([[0], np.cumsum(wins)[:-1]])
    best = np.minimum.reduceat(key, low)
    best = best[:, None]
    run = key
    for d in (1, 2, 4, 8, 16, 32):  # minimum of 64 windows by doubling
        run = np.minimum(run[:-d], run[d:]) if len(run) > d else run[:0]
    docs = np.repeat(np.arange(len(raws)), wins)
    picked, owner = [best[:, 0]], [np.arange(len(raws))]
    if len(run):
        inside = docs[: len(run)] == docs[WINDOW - 1 : WINDOW - 1 + len(run)]
        edge = np.concatenate([[True], (run[1:] != run[:-1]) | (inside[1:] != inside[:-1])])
        first = np.flatnonzero(edge)
        long = np.diff(np.concatenate([first, [len(run)]])) >= WINS
        first = first[long & inside[first]]
        picked.append(run[first])
        owner.append(docs[first])
    picked, owner = np.concatenate(picked), np.concatenate(owner)
    place, where = np.unique(picked & ((1 << 40) - 1), return_index=True)
    lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, WINDOW)[place]).view("<u8")
    h = np.full(len(place), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(lanes.shape[1]):
        h = _mix(h ^ lanes[:, k]) + np.uint64(k)
    return owner[where], h


def fingerprints(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text."""
    out = [""] * len(texts)
    group, size = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        group.append(i)
        size += len(t)
        if size > 2 << 20:  # bounds the arrays at some 100 bytes for each byte of text
            _digest(texts, group, out)
            group, size = [], 0
    _digest(texts, group, out)
    return out


def _digest(texts: list[bytes], group: list[int], out: list[str]) -> None:
    if not group:
        return
    # a text shorter than a window is one feature: itself, padded, with its length
    raws = [t if len(t := texts[i]) >= WINDOW else t + b"\0" * (WINDOW - 1 - len(t)) + bytes([len(t)]) for i in group]
    doc, h = _features(raws)
    order = np.lexsort((np.arange(len(h)), h, doc))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
    doc, h = doc[~again], h[~again]
    n = np.bincount(doc, minlength=len(group))
    rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    filters = -(-n // FEATURES)
    base = np.cumsum(filters) - filters
    number = base[doc] + rank // FEATURES
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for k in range(HASHES):
        bits[number, (h >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
    packed, held = np.packbits(bits, axis=1), np.bincount(number, minlength=len(bits)).astype(">u2")
    raw = np.concatenate([held.view(np.uint8).reshape(-1, 2), packed], axis=1)
    for i, at, m in zip(group, base.tolist(), filters.tolist()):
        out[i] = base64.b64encode(raw[at : at + m].tobytes()).decode()


def likeness(a: str, b: str) -> float:
    """0 to 1: the mean, over filters of the shorter digest, of the best normalised overlap of bits.

    Overlap counts from what chance gives two filters of such fill plus 0.3 of what is left, up to the
    smaller fill. Two empty digests are alike, one empty digest is like no other.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, _FILTER)[:, 2:] for s in (a, b))
    if len(x) > len(y):
        x, y = y, x
    x, y = (np.ascontiguousarray(z).view(np.uint64) for z in (x, y))
    fx, fy = (np.bitwise_count(z).sum(1, dtype=np.int64) for z in (x, y))
    best = 0.0
    for row, fill in zip(x, fx):
        both = np.bitwise_count(row & y).sum(1, dtype=np.int64)
        chance, most = fill * fy / BITS, np.minimum(fill, fy)
        floor = chance + 0.3 * (most - chance)
        best += max(0.0, float(((both - floor) / np.maximum(most - floor, 1e-9)).max()))
    return min(1.0, best / len(x))


def _bucket(bounds: list[int], column):
    """How many of the sorted bounds are at most the column: binary search in one expression."""
    if not bounds:
        return F.lit(0)
    steps, s = [], 1
    while s <= len(bounds):
        steps.insert(0, s)
        s *= 2
    array = F.lit(bounds).cast("array<bigint>")
    return F.aggregate(F.lit(steps), F.lit(0), lambda lo, st: F.when((lo + st <= len(bounds)) & (F.get(array, lo + st - 1) <= column), lo + st).otherwise(lo))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document in descending id order, after the last the first. Null text counts as empty; null ids
    come last; rows that share an id stand in descending order of their text. An empty table gives no rows.
    Documents are dealt into id ranges once; each range also gets the first document of the next one. The
    driver holds one bound and one id for each range.
    """
    spark = docs.sparkSession
    small_batches(spark, 128)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("at"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    n = max(2, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.select(F.expr(f"percentile_approx(at, array({', '.join(str(i / n) for i in range(1, n))}), 10000)").alias("c")).first().c
    bounds = sorted(set(cuts or []))
    rows = rows.withColumn("range", _bucket(bounds, F.col("at")))
    heads = sorted(rows.groupBy("range").agg(F.max("at").alias("head")).collect(), reverse=True)
    nexts = [(heads[i]["range"], heads[(i + 1) % len(heads)]["head"]) for i in range(len(heads))]
    halo = rows.drop("range").join(F.broadcast(spark.createDataFrame(nexts, "range int, at long")), "at").select("id", "at", "text", "range", F.lit(1).alias("halo"))
    both = rows.select("id", "at", "text", "range", F.lit(0).alias("halo")).unionByName(halo)
    placed = both.repartition(n, "range").sortWithinPartitions("range", "halo", F.desc("at"), F.desc("text")).select("id", "text", "range", "halo")

    def run(batches):
        held = []  # rows of one range that wait for the row behind them
        for b in batches:
            rows = held + list(zip(*(c.to_pylist() for c in b.columns)))
            # of several halo rows with the same id only the first in order counts
            rows = [r for i, r in enumerate(rows) if not (r[3] and i and rows[i - 1][3])]
            held = rows[-1:]
            pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
            if not pairs:
                continue
            texts = [r[1].encode("utf-8", "surrogatepass") for r in rows]
            edited = []
            for i, j in pairs:
                t, k = rows[i][1], len(rows[i][1]) // 2
                edited.append((t[: len(t) - k] + rows[j][1][:k]).encode("utf-8", "surrogatepass"))
            prints = fingerprints(texts + edited)
            own, changed = prints[: len(texts)], prints[len(texts) :]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[i][0] for i, _ in pairs], b.schema.field(0).type), pa.array([len(rows[i][1]) for i, _ in pairs], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), pa.array([own[i] for i, _ in pairs], pa.string()), pa.array(changed, pa.string()),
                 pa.array([likeness(own[i], c) for (i, _), c in zip(pairs, changed)], pa.float64()), pa.array([likeness(own[i], own[j]) for i, j in pairs], pa.float64())],
                ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return placed.mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
