"""Directly addressable codes: a file format for token ids with access to any token without decoding blocks.

An id is cut into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that has one, with
one continuation bit for each chunk (1: a further chunk stands in level k + 1) and a rank directory:
the number of ones before each block of 512 bits. Token i is read from level 0 at i; while the
bit there is 1, its place in the next level is the rank of that bit.

Layout of an image, all little-endian: magic "LMDAC1\\0\\0"; u64 documents, tokens, levels; i64 id of each
document; u64 first token of each document, and the number of tokens; then for each level u64 length,
its chunk bytes, its bitmap in bytes (low bit first), and u32 ranks of its blocks.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, BLOCK = b"LMDAC1\0\0", 512


def pack(doc_ids: list[int], docs: list[np.ndarray]) -> bytes:
    """An image of the ids of documents."""
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate(docs).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    levels, rest = [], ids
    while True:
        more = rest >= 256
        levels.append((rest.astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(levels)), np.asarray(doc_ids, "<i8").tobytes(), np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes()]
    for low, more in levels:
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]) if len(blocks) else np.zeros(0)
        out += [struct.pack("<Q", len(low)), low.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
    return b"".join(out)


class Image:
    """Reader of an image; views of the bytes, nothing is decoded up front."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token image")
        self.n_docs, self.n_tokens, n = struct.unpack_from("<QQQ", raw, 8)
        at = 32

        def view(kind, count):
            nonlocal at
            x = np.frombuffer(raw, kind, count, at)
            at += x.nbytes
            return x

        self.doc_ids, self.starts, self.levels = view("<i8", self.n_docs), view("<u8", self.n_docs + 1).astype(np.int64), []
        for _ in range(n):
            size = int(view("<u8", 1)[0])
            self.levels.append((view(np.uint8, size), view(np.uint8, -(-size // 8)), view("<u4", -(-size // BLOCK))))

    def get(self, i: int) -> int:
        """Token i of the image: one chunk and one rank a level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for low, bits, ranks in self.levels:
            value |= int(low[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            b = i // BLOCK
            i = int(ranks[b]) + int(np.unpackbits(bits[b * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - b * BLOCK].sum())
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """Every token, level by level."""
        value = np.zeros(0, np.uint32)
        for low, bits, _ in reversed(self.levels):
            here = low.astype(np.uint32)
            more = np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)
            if len(value):
                here[more] |= value << 8
            value = here
        return value

    def doc(self, k: int) -> np.ndarray:
        """Tokens of the k-th document by direct access."""
        return np.array([self.get(i) for i in range(self.starts[k], self.starts[k + 1])], np.uint32)
