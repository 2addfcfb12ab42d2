"""Language-model scoring (operator 7): a log-frequency Bloom filter of quantised bigram counts.

A bigram of count c enters the filter under the levels 1 .. floor(2 log2 c) + 1; repeated membership probes,
level after level until one fails, give its quantised count: the least count of its level, never more than c but for
false positives. The filter has a segment for each range of bigram hashes, sized by what the segment holds.

A filter of at most `broadcast_bytes` is broadcast to the workers, which probe it as they score. A larger one
stays where its segments were made: each block of documents sends its distinct bigrams to the segments of
their ranges, which probe them and send the counts back. Both ways give the same scores.

p(w | v) = s * q(v w) / count(v) + (1 - s * r) * p(w); p(w) is the smoothed unigram share of the base score,
s = 1 - (bigrams seen once) / (bigram tokens) is the Good-Turing share of what was seen before, q the quantised
count and r the share of all bigram tokens that quantised counts keep: what they lose goes to p(w), so that over the
histories of the corpus probabilities add up to one. For a history without counts p(w | v) = p(w).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.blocks import Block, Values, block_docs, block_units, by_block, list_values, pack_values, planes, scan, squeeze, unplanes, unsqueeze, whole
from leafmill.llm.common import small_batches, stash

#: Filter bits for each entry, probes, and bytes of a filter that is broadcast.
ENTRY_BITS, PROBES, BROADCAST_BYTES = 14, 7, 192 << 20
#: Tokens after which a scan hands out the bigrams it has counted.
FLUSH = 2_000_000
#: Seed of token hashes, the one that Spark's xxhash64 has.
SEED = 42
START, STOP = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def trained(doc_id) -> bool:
    """Whether a document belongs to the training part: crc32 of its id as text, mod 5, isn't 1."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bigram_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; first marks tokens that begin a text."""
    before = np.concatenate([[START], h[:-1]])
    before[first] = START
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) + h)


def text_keys(texts: list[list[bytes]], memo: dict[bytes, int]) -> np.ndarray:
    """Bigram hashes of some texts, the end of each among their tokens."""
    if len(memo) > 400_000:
        memo.clear()
    for w in set().union(*texts).difference(memo):
        memo[w] = xxhash.xxh64_intdigest(w, SEED)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    h = np.full(int(sizes.sum()), STOP, np.uint64)
    ends = np.cumsum(sizes)
    inside = np.ones(len(h), bool)
    inside[ends - 1] = False
    h[inside] = np.fromiter((memo[w] for t in texts for w in t), np.uint64, int(inside.sum()))
    first = np.zeros(len(h), bool)
    first[ends - sizes] = True
    return bigram_keys(h, first)


#: floor(2 log2 c) + 1 is the number of these that are at most c; the least count of a level.
_LEVELS = np.array([-(-(2 ** (k / 2)) // 1) for k in range(126)])
_LEAST = _LEVELS.astype(np.int64)


def quantise(c: np.ndarray) -> np.ndarray:
    """Level of each count."""
    return np.searchsorted(_LEVELS, c.astype(np.float64), "right")


def least(level: np.ndarray) -> np.ndarray:
    """Least count of each level; 0 of level 0."""
    return np.where(level > 0, _LEAST[np.maximum(level, 1) - 1], 0)


def _probe(keys: np.ndarray, level, bits: np.ndarray) -> list[np.ndarray]:
    """Bit places of (key, level) in a filter of so many bits."""
    a = _mix(keys + np.uint64(level * 0xD1342543DE82EF95 & (1 << 64) - 1))
    b = _mix(a ^ np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
    return [((a + np.uint64(k) * b) % bits).astype(np.int64) for k in range(PROBES)]


def segment(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """(bits, bytes) of the filter of some bigrams."""
    q = quantise(counts)
    size = max(64, int(q.sum()) * ENTRY_BITS)
    bits = np.zeros(size, bool)
    for level in range(1, int(q.max()) + 1 if len(q) else 1):
        for at in _probe(keys[q >= level], level, np.uint64(size)):
            bits[at] = True
    return size, np.packbits(bits, bitorder="little").tobytes()


def _shift(ranges: int) -> np.uint64:
    return np.uint64(64 - (ranges.bit_length() - 1))


class Filter:
    """Segments of some ranges."""

    def __init__(self, ranges: int, rows: Iterable[tuple[int, int, bytes]]):
        self.shift = _shift(ranges)
        self.size, self.base, self.own = np.ones(ranges, np.uint64), np.zeros(ranges, np.int64), np.zeros(ranges, bool)
        raw = bytearray()
        for r, size, data in rows:
            self.size[r], self.base[r], self.own[r] = size, len(raw) * 8, True
            raw += data
        self.raw = np.frombuffer(raw, np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each bigram; 0: not there."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.raw):
            return out
        live, level = np.arange(len(keys)), 1
        while len(live):
            k = keys[live]
            r = (k >> self.shift).astype(np.int64)
            there = self.own[r]
            for at in _probe(k, level, self.size[r]):
                at = at + self.base[r]
                there &= (self.raw[np.where(there, at >> 3, 0)] >> (at & 7) & 1).astype(bool)
            live = live[there]
            out[live] = level
            level += 1
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised count of each bigram; 0: not there."""
        return least(self.levels(keys))


def _by_range(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, begin, end) of sorted keys."""
    r = (keys >> _shift(ranges)).astype(np.int64)
    edge = np.flatnonzero(np.diff(r, prepend=-1, append=-1)).tolist()
    return [(int(r[i]), i, j) for i, j in zip(edge, edge[1:])]


def _bigrams(rows: DataFrame, ranges: int) -> DataFrame:
    """range, blob: sorted bigram hashes of training documents with their counts, in compact pieces."""

    def run(batches):
        memo: dict[bytes, int] = {}
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            found = _by_range(keys, ranges)
            blobs = [squeeze(planes(np.diff(keys[i:j], prepend=np.uint64(0))), planes(n[i:j].astype("<u4"))) for _, i, j in found]
            return pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in found], pa.int32()), pa.array(blobs, pa.binary())], ["range", "blob"])

        for b in batches:
            texts = [tokens(t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if trained(i)]
            if texts:
                held.append(text_keys(texts, memo))
                size += len(held[-1])
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return rows.select("id", "text").mapInArrow(run, "range int, blob binary")


def _segments(blobs: DataFrame, parts: int) -> DataFrame:
    """range, bits, data, once, tokens, kept: a filter segment for each range; a task holds one range at a time."""

    def run(batches):
        now, keys, counts = None, [], []

        def done():
            k, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k, kind="stable")
            k, n = k[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            k, n = k[first], np.add.reduceat(n, first)
            size, data = segment(k, n)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([size], pa.int64()), pa.array([data], pa.binary()), pa.array([int((n == 1).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([int(least(quantise(n)).sum())], pa.int64())], ["range", "bits", "data", "once", "tokens", "kept"])

        for b in batches:
            for r, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if r != now:
                    if keys:
                        yield done()
                    now, keys, counts = r, [], []
                k, n = unsqueeze(raw)
                keys.append(np.cumsum(unplanes(k, "<u8"), dtype=np.uint64))
                counts.append(unplanes(n, "<u4").astype(np.int64))
        if keys:
            yield done()

    return blobs.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(run, "range int, bits long, data binary, once long, tokens long, kept long")


def _asked(rows: DataFrame, ranges: int) -> DataFrame:
    """range, block, payload: distinct sorted bigram hashes of each block of documents."""

    def run(batches):
        memo: dict[bytes, int] = {}
        held = []

        def number(block: Block, texts: list[str]):
            split = [tokens(t) for t in texts]
            held.append(np.unique(text_keys(split, memo)))
            return [block.add(x) for x in split]

        def on_end(block):
            if held:
                keys = np.unique(np.concatenate(held))
                found = _by_range(keys, ranges)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in found], pa.int32()), pa.array([block.number] * len(found), pa.int64()), pa.array([squeeze(planes(np.diff(keys[i:j], prepend=np.uint64(0)))) for _, i, j in found], pa.binary())], ["range", "block", "payload"])

        yield from scan(batches, number, lambda ids, numbers: (), on_end)

    return rows.select("id", "text").mapInArrow(run, "range int, block long, payload binary")


def _answered(asked: DataFrame, segments: DataFrame, ranges: int, parts: int) -> DataFrame:
    """block, payload: what was asked with the level of each bigram, from the segment of its range."""
    rows = asked.selectExpr("range", "1 as kind", "block", "payload").unionByName(segments.selectExpr("range", "0 as kind", "bits as block", "data as payload"))

    def run(batches):
        now, own = None, Filter(ranges, [])
        for b in batches:
            blocks, out = [], []
            for r, kind, block, raw in zip(*(c.to_pylist() for c in b.columns)):
                if r != now:
                    now, own = r, Filter(ranges, [])
                if kind == 0:
                    own = Filter(ranges, [(r, block, raw)])
                    continue
                gaps = unsqueeze(raw)[0]
                blocks.append(block)
                out.append(squeeze(gaps, own.levels(np.cumsum(unplanes(gaps, "<u8"), dtype=np.uint64)).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(out, pa.binary())], ["block", "payload"])

    return rows.repartition(parts, "range").sortWithinPartitions("range", "kind").mapInArrow(run, "block long, payload binary")


def _counted(b):
    """For pack_values: count and hash of a unit for each of its places."""
    offsets, at = list_values(b.column(0))
    row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
    pairs = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1)[row]
    return at, np.full(len(at), 16, np.int64), np.ascontiguousarray(pairs.astype("<i8")).view(np.uint8).reshape(-1)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(id as text) mod 5 isn't 1 (null ids are learned from) and scores all.
    Null text counts as empty: one token, the end. Rows that share an id or a text are scored and learned
    from row by row. Without training rows every count is 0. An empty table gives no rows. docs must be a
    repeatable scan (see blocks); other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    read = rows.rdd.getNumPartitions()
    if ranges is None:  # a power of two that follows the input, so that a segment stays of one size
        ranges = 1 << max(6, (4 * read - 1).bit_length())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * read)
    number = whole(tokens)
    # the places of a common token fill a row for each 4,096 partitions of the scan, dealt by token and those
    known = block_units(rows, number, binary=True, counted=trained).withColumn("h", F.xxhash64("unit", F.shiftright("at", 53)))
    known = known.repartition(parts, "h").groupBy("h", "unit").agg(F.sum("n").alias("n"), F.collect_list("at").alias("at"))
    if read <= 4096:  # then a token has one row
        known = stash(known.select("at", "n", F.xxhash64("unit").alias("hash")), "lm-units")
        total = known
    else:
        known = stash(known.drop("h"), "lm-units")
        total = known.groupBy("unit").agg(F.sum("n").alias("n"))
        known = known.drop("n").join(total, "unit").select("at", "n", F.xxhash64("unit").alias("hash"))
    size = total.where("n > 0").agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()

    def train_docs(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(trained(i) for i in b.column(0).to_pylist())], pa.int64())], ["t"])

    ends = rows.select("id").mapInArrow(train_docs, "t long").agg(F.sum("t").alias("t")).first().t or 0
    n_all, n_kinds = (size.n or 0) + ends, size.v + (ends > 0)
    segments = stash(_segments(_bigrams(rows, ranges), parts), "lm-filter")
    seen = segments.agg(F.sum("once").alias("once"), F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept"), F.sum(F.length("data")).alias("bytes")).first()
    share = 1 - seen.once / seen.tokens if seen.tokens else 0.0
    rest = 1 - share * (seen.kept / seen.tokens if seen.tokens else 0.0)
    small = (seen.bytes or 0) <= broadcast_bytes
    # partition by partition, so that the driver holds the filter once
    shared = spark.sparkContext.broadcast(Filter(ranges, ((r["range"], r.bits, r.data) for r in segments.select("range", "bits", "data").coalesce(16).toLocalIterator()))) if small else None
    answers = None if small else _answered(_asked(rows, ranges), segments, ranges, parts)

    def finish(values: Values, ids, lens, numbers):
        if values.ready is None:
            both = values.data.view("<i8").reshape(-1, 2)[values.starts // 16]
            got = [unsqueeze(p) for p in values.more]
            got = [(np.cumsum(unplanes(k, "<u8"), dtype=np.uint64), np.frombuffer(n, np.uint8)) for k, n in got]
            got.sort(key=lambda x: int(x[0][0]))
            told = tuple(np.concatenate(x) for x in zip(*got)) if got else None
            values.ready = (np.append(both[:, 0], ends), np.append(both[:, 1].astype(np.int64).view(np.uint64), STOP), told)
        counts, hashes, told = values.ready
        stop = len(counts) - 1
        sizes = lens + 1
        last = np.cumsum(sizes) - 1
        flat = np.full(int(sizes.sum()), stop, np.int64)
        inside = np.ones(len(flat), bool)
        inside[last] = False
        flat[inside] = numbers
        start = last + 1 - sizes
        first = np.zeros(len(flat), bool)
        first[start] = True
        c = counts[flat]
        base = (c + 0.5) / (n_all + 0.5 * (n_kinds + 1))
        keys = bigram_keys(hashes[flat], first)
        history = np.concatenate([[0], c[:-1]])
        history[first] = ends
        found = shared.value.counts(keys) if small else least(told[1][np.searchsorted(told[0], keys)].astype(np.int64))
        p = np.where(history > 0, share * np.minimum(found, history) / np.maximum(history, 1) + rest * base, base)
        score = np.add.reduceat(np.log10(p), start)
        plain = np.add.reduceat(np.log10(base), start)
        n_known = np.add.reduceat((c > 0).astype(np.int64), start)
        return pa.RecordBatch.from_arrays([ids, pa.array([not trained(i) for i in ids.to_pylist()], pa.bool_()), pa.array(sizes), pa.array(n_known), pa.array(np.full(len(sizes), n_all, np.int64)), pa.array(plain), pa.array(score)], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    values = pack_values(known.select("at", "n", "hash"), _counted)
    out = by_block(block_docs(rows, number), values, finish, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", answers)
    return out.withColumnRenamed("id", id_col)
