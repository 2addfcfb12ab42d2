"""Texts as runs of numbers: vocabularies of bounded blocks of documents, enriched by a join, put back by block.

A corpus has far fewer distinct units (words, pieces between blanks) than unit occurrences. A block of
documents numbers its own distinct units; only these meet in a shuffle, once for each block. What they
are given there returns to the block, where each document looks it up by number.

Blocks are made by a deterministic scan: the documents must come straight from files (or a stashed
table), because the scan is run again for the documents' numbers. A block that got another number of
units in the second run fails the job.

A unit's place is one long, `at`: partition (22 bits), block of the partition (12), number in the block (29).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from leafmill.llm.common import small_batches

#: A block ends when it holds so many distinct units or so many units in all.
BLOCK_UNITS, BLOCK_TOTAL = 400_000, 6_000_000
#: Bits of `at` below the block and below the partition.
UNIT_BITS, PART_BITS = 29, 41
#: Values that a task gathers before it hands them out by block, and numbers of documents in one row.
HELD_VALUES, ROW_NUMBERS = 400_000, 500_000


def planes(x: np.ndarray) -> bytes:
    """Bytes of an integer array, highest last: planes of zeros cost nothing once compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def squeeze(*parts: bytes) -> bytes:
    """Byte strings as one: their lengths, then zstd of all."""
    return np.array([len(parts), *map(len, parts)], "<u8").tobytes() + zstandard.compress(b"".join(parts), 1)


def unsqueeze(raw: bytes) -> list[bytes]:
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u8", n, 8)).tolist()
    data = zstandard.decompress(raw[8 * (n + 1) :]) if n and ends[-1] else b""
    return [data[i:j] for i, j in zip([0, *ends[:-1]], ends)] if n else []


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places starts[0], .., starts[0] + lens[0] - 1, starts[1], .. in one array."""
    total = np.cumsum(lens)
    return np.repeat(starts - (total - lens), lens) + np.arange(int(total[-1]) if len(total) else 0)


def list_values(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, values) of a list column; null lists are empty."""
    at = column.offsets.to_numpy()
    return (at - at[0]).astype(np.int64), column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False)


class Block:
    """Numbers of the units of some documents; `memo` may hold what a coarser piece of text gives."""

    def __init__(self, part: int, seq: int):
        if part >> 22 or seq >> 12:
            raise RuntimeError("more partitions or blocks in a partition than `at` can hold; read the documents in smaller partitions")
        self.number, self.total, self.memo = part << 12 | seq, 0, {}
        self.at = defaultdict(count().__next__)

    def add(self, units: list) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, units), np.uint32, len(units))

    def full(self) -> bool:
        return len(self.at) >= BLOCK_UNITS or self.total >= BLOCK_TOTAL


def whole(units_of: Callable[[str], list]) -> Callable:
    """A scan function of texts whose units come text by text."""

    def number(block: Block, texts: list[str]) -> list[np.ndarray]:
        return [block.add(units_of(t)) for t in texts]

    return number


def scan(batches, number: Callable, on_docs, on_end):
    """Run documents through blocks, some documents at a time; on_docs(ids, numbers) and on_end(block) give record batches."""
    part, seq = TaskContext.get().partitionId(), 0
    block = Block(part, seq)
    for b in batches:
        ids, texts = b.column(b.schema.names.index("id")), b.column(b.schema.names.index("text")).to_pylist()
        for i in range(0, len(texts), 256):  # a block ends between two such groups
            numbers = number(block, [t or "" for t in texts[i : i + 256]])
            block.total += sum(map(len, numbers))
            yield from on_docs(ids.slice(i, 256), numbers)
            if block.full():
                yield from on_end(block)
                seq += 1
                block = Block(part, seq)
    yield from on_end(block)


def block_units(rows: DataFrame, number: Callable, binary: bool = False, counted: Callable | None = None) -> DataFrame:
    """at, unit and, with `counted`, n: the distinct units of each block.

    rows: id, text. number(block, texts) gives an array of unit numbers for each text (see `whole`);
    counted(id) tells whether a document's units count towards n.
    """
    kind = pa.binary() if binary else pa.string()

    def run(batches):
        tally: list[np.ndarray] = []

        def on_docs(ids, numbers):
            if counted:
                tally.extend(x for i, x in zip(ids.to_pylist(), numbers) if counted(i))
            return ()

        def on_end(block):
            units, m = list(block.at), len(block.at)
            n = np.bincount(np.concatenate(tally), minlength=m) if tally else np.zeros(m, np.int64)
            tally.clear()
            for i in range(0, m, 20_000):
                k = len(units[i : i + 20_000])
                cols = [pa.array(np.arange(i, i + k, dtype=np.int64) + (block.number << UNIT_BITS)), pa.array(units[i : i + 20_000], kind)]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(n[i : i + k].astype(np.int64))] if counted else []), ["at", "unit"] + (["n"] if counted else []))

        yield from scan(batches, number, on_docs, on_end)

    return rows.select("id", "text").mapInArrow(run, f"at long, unit {'binary' if binary else 'string'}" + (", n long" if counted else ""))


def block_docs(rows: DataFrame, number: Callable) -> DataFrame:
    """block, kind 1, size (units of the block), ids, payload (numbers) of some documents of a block."""
    id_kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        held: list[tuple] = []

        def on_docs(ids, numbers):
            held.extend((ids.slice(i, 1), x) for i, x in enumerate(numbers))
            return ()

        def on_end(block):
            if not held:
                return
            size = np.cumsum([len(x) + 1 for _, x in held]) // ROW_NUMBERS
            edge = np.flatnonzero(np.diff(size, prepend=-1, append=-1)).tolist()
            for i, j in zip(edge, edge[1:]):
                for k in range(i, j, 256):
                    some = held[k : min(j, k + 256)]
                    lens = np.array([len(x) for _, x in some], "<u4")
                    ids = pa.concat_arrays([x for x, _ in some])
                    numbers = np.concatenate([x for _, x in some]).astype("<u4")
                    yield pa.RecordBatch.from_arrays([pa.array([block.number], pa.int64()), pa.array([1], pa.int32()), pa.array([len(block.at)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([squeeze(planes(lens), planes(numbers))], pa.binary())], ["block", "kind", "size", "ids", "payload"])
            held.clear()

        yield from scan(batches, number, on_docs, on_end)

    return rows.select("id", "text").mapInArrow(run, f"block long, kind int, size long, ids array<{id_kind}>, payload binary")


def pack_values(values: DataFrame, flat: Callable) -> DataFrame:
    """block, payload: the values of places, packed by block.

    flat(batch) gives (at, lens, data) of a record batch: places, bytes of each value, all values in a row.
    """

    def run(batches):
        ats, sizes, datas, n = [], [], [], 0

        def out():
            at, lens, data = np.concatenate(ats), np.concatenate(sizes), np.concatenate(datas)
            block = at >> UNIT_BITS
            order = np.argsort(at, kind="stable")
            starts = np.cumsum(lens) - lens
            edge = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1)).tolist()
            rows = []
            for i, j in zip(edge, edge[1:]):
                some = order[i:j]
                pos = (at[some] & ((1 << UNIT_BITS) - 1)).astype("<u4")
                rows.append((int(block[some[0]]), squeeze(planes(np.diff(pos, prepend=np.uint32(0))), planes(lens[some].astype("<u4")), data[ranges(starts[some], lens[some])].tobytes())))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["block", "payload"])

        for b in batches:
            if not b.num_rows:
                continue
            at, lens, data = flat(b)
            ats.append(at)
            sizes.append(lens)
            datas.append(data)
            n += len(at)
            if n >= HELD_VALUES:
                yield out()
                ats, sizes, datas, n = [], [], [], 0
        if n:
            yield out()

    return values.mapInArrow(run, "block long, payload binary")


class Values:
    """Values of a block by number: starts and lens in bytes, and all bytes in `data`."""

    def __init__(self, block: int, expected: int, payloads: list[bytes], more: list[bytes]):
        parts = [unsqueeze(p) for p in payloads]
        pos = np.concatenate([np.cumsum(unplanes(p, "<u4"), dtype=np.int64) for p, _, _ in parts]) if parts else np.zeros(0, np.int64)
        lens = np.concatenate([unplanes(n, "<u4") for _, n, _ in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        if len(pos) != expected or (expected and int(pos.max()) != expected - 1):
            raise RuntimeError(f"block {block} has {len(pos)} values for {expected} units: its scan wasn't repeatable")
        self.data = np.frombuffer(b"".join(d for _, _, d in parts), np.uint8)
        self.starts, self.lens = np.zeros(expected, np.int64), np.zeros(expected, np.int64)
        self.starts[pos], self.lens[pos] = np.cumsum(lens) - lens, lens
        self.more, self.ready = more, None  # for the use of `finish`


def by_block(docs: DataFrame, values: DataFrame, finish: Callable, schema: str, more: DataFrame | None = None) -> DataFrame:
    """Bring the packed values of each block, and the payloads of `more` (block, payload), to its documents.

    finish(values, ids, lens, numbers) gets the Values of a block, some ids, and the lengths and the concatenation
    of their arrays of numbers, and gives a record batch of `schema`. A task holds the values of one block at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_kind = docs.schema["ids"].dataType.simpleString()
    both = docs
    for kind, df in ((0, values), (-1, more)):
        if df is not None:
            both = both.unionByName(df.selectExpr("block", f"{kind} as kind", "0L as size", f"cast(null as {id_kind}) as ids", "payload"))

    def run(batches):
        now, got, extra, ready = None, [], [], None
        for b in batches:
            for block, kind, size, ids, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist()):
                if block != now:
                    now, got, extra, ready = block, [], [], None
                if kind < 1:
                    (extra if kind else got).append(payload)
                    continue
                if ready is None:
                    ready, got, extra = Values(now, size, got, extra), [], []
                lens, numbers = unsqueeze(payload)
                yield finish(ready, ids.values, unplanes(lens, "<u4").astype(np.int64), unplanes(numbers, "<u4").astype(np.int64))

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return both.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)
