"""N-gram Jaccard join (operator 3): the chosen-path join over sets of five-word shingles.

A run splits the sets recursively. At a node of the recursion a set takes each of its tokens whose hash
under that node is below 1 / (BRANCH * size); two sets stay together in every child both take. Sets of
similarity 0.8 share at least BRANCH of the larger one's tokens, so that at least one common child is
expected at each level, while unlike sets part soon. A node with at most SMALL sets is a leaf, as is one at the
last level. Independent runs repeat until a pair of the threshold similarity meets in some leaf with
the target recall, which the branching process gives in closed form.

Sets in a leaf are compared by sketches of 64 minhashes (a pair of the threshold similarity falls below the
sketch bound about once in a million), which leaves linear chains of candidates. The components of the
candidates are then compared exactly, every pair, by their whole sets; equal sets are one set with a weight.
Large leaves and components are cut into tiles, so that no task holds more than two tiles of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import small_batches, stash, words
from leafmill.llm.components import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
BRANCH, LEVELS, SMALL, TILE = 0.8, 3, 64, 1024
SKETCH, SKETCH_MIN = 64, 0.5
#: Ids that are broadcast at most to find the texts of candidates (some 24 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def runs_for(recall: float, levels: int = LEVELS) -> int:
    """Independent runs after which a pair of the threshold similarity has met with this probability."""
    out = 0.0  # probability that the process of common children dies out within the levels
    for _ in range(levels):
        out = math.exp(-1.0 * (1 - out))
    return math.ceil(math.log(1 - recall) / math.log(out))


class Shingler:
    """Distinct hashes of runs of SHINGLE words of a text; one run of all words where there are fewer."""

    def __init__(self, k: int = SHINGLE):
        self.k, self.memo = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        w, memo = words(text), self.memo
        if not w:
            return np.zeros(0, np.uint64)
        if len(memo) > 400_000:
            memo.clear()
        for x in w:
            if x not in memo:
                memo[x] = xxhash.xxh64_intdigest(x)
        h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
        k = min(self.k, len(w))
        out = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
        return np.unique(out)


def paths(tokens: np.ndarray, runs: int) -> np.ndarray:
    """(n, 3) nodes by level; 0: the path ended before that level."""
    bound = np.uint64(min(2**64 - 1, int(2**64 / (BRANCH * len(tokens)))))
    rows = np.zeros((runs, 0), np.uint64)
    here = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
    for _ in range(LEVELS):
        live = np.flatnonzero(here)
        nxt_rows, nxt_here, ended = [], [], []
        for i in range(0, len(live), 64):  # bounds the matrix of tokens by nodes
            part = live[i : i + 64]
            h = mix(tokens[None, :] ^ here[part][:, None])
            at, tok = np.nonzero(h < bound)
            nxt_rows.append(part[at])
            nxt_here.append(mix(h[at, tok] + here[part][at]))
            ended.append(part[~np.isin(np.arange(len(part)), at)])
        gone = np.concatenate([np.flatnonzero(here == 0), *ended]) if ended else np.flatnonzero(here == 0)
        if rows.shape[1] == 0:
            gone = gone[:0]  # no child of the root: the run has no path for this set
        src = np.concatenate([*nxt_rows, gone]).astype(np.int64) if nxt_rows else gone
        here2 = np.concatenate([*nxt_here, np.zeros(len(gone), np.uint64)]) if nxt_here else np.zeros(len(gone), np.uint64)
        rows = np.concatenate([rows[src], here2[:, None]], axis=1)
        here = here2
    return rows


def sketch(tokens: np.ndarray) -> bytes:
    """One byte of the minimum of each of SKETCH hash functions."""
    out = np.empty(SKETCH, np.uint8)
    seeds = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    for i in range(0, SKETCH, 16):
        for j, m in enumerate(_mins(tokens, seeds[i : i + 16])):
            out[i + j] = int(m) & 255
    return out.tobytes()


def _mins(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    best = np.full(len(seeds), 2**64 - 1, np.uint64)
    for i in range(0, len(tokens), 8192):
        h = (tokens[i : i + 8192][None, :] ^ seeds[:, None]) * _M1
        h ^= h >> np.uint64(29)
        h *= _M2
        best = np.minimum(best, h.min(axis=1))
    return best >> np.uint64(40)


def _spanning(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs over 0 .. n - 1."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def tiled(df: DataFrame, key: str, size: DataFrame, member: str = "id") -> DataFrame:
    """df with columns t (tile pair of its key) and side: members of a key of more than TILE in tile pairs.

    size: key, n. A member stands in as many tile pairs as its key has tiles, once where it has one tile.
    """
    x = df.join(size, key).withColumn("tiles", F.greatest(F.lit(1), F.ceil(F.col("n") / TILE)).cast("int"))
    x = x.withColumn("own", F.pmod(F.xxhash64(member), F.col("tiles")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return x.withColumn("t", F.concat_ws(":", F.least("own", "other"), F.greatest("own", "other"))).drop("n", "tiles", "other")


def _sets(docs: DataFrame, runs: int, id_col: str, text_col: str) -> DataFrame:
    """doc, hash, set (short hash), size, sketch and the nodes of all paths, from one scan of the texts."""

    def run(batches):
        shingles = Shingler()
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                tokens = shingles(t)
                digest = xxhash.xxh3_128_digest(tokens.tobytes())
                if len(tokens):
                    n = paths(tokens, runs).view(np.int64)
                    rows.append((digest, int.from_bytes(digest[:8], "little", signed=True), len(tokens), sketch(tokens), n))
                else:
                    rows.append((digest, None, 0, None, np.zeros((0, 3), np.int64)))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])]).astype(np.int32))
            nodes = np.concatenate([r[4] for r in rows])
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(nodes[:, k]))) for k in range(LEVELS)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary()), *lists], ["doc", "hash", "set", "size", "sketch", "n1", "n2", "n3"])

    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, hash binary, set long, size long, sketch binary, n1 array<long>, n2 array<long>, n3 array<long>")


def _tokens(rows: DataFrame) -> DataFrame:
    """root, id, weight, tokens of rows with a text."""

    def run(batches):
        shingles = Shingler()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([shingles(t).tobytes() for t in b.column(3).to_pylist()], pa.binary())], ["root", "id", "weight", "tokens"])

    return rows.select("root", "id", "weight", "text").mapInArrow(run, "root long, id long, weight long, tokens binary")


def leaves(sets: DataFrame) -> DataFrame:
    """node, set: the leaves of the recursion that hold two different sets or more."""
    walks = sets.where("size > 0").select("set", F.explode(F.arrays_zip("n1", "n2", "n3")).alias("n")).select("set", "n.n1", "n.n2", "n.n3")
    first = walks.select("set", "n1").distinct().groupBy("n1").agg(F.count("*").alias("c1")).where("c1 > 1")
    met = stash(walks.join(first, "n1").distinct(), "walks")
    small = met.where(F.col("c1") <= SMALL).select(F.col("n1").alias("node"), "set").distinct()
    large = met.where((F.col("c1") > SMALL) & (F.col("n2") != 0))
    second = large.select("set", "n2").distinct().groupBy("n2").agg(F.count("*").alias("c2")).where("c2 > 1")
    deeper = large.join(second, "n2")
    middle = deeper.where(F.col("c2") <= SMALL).select(F.col("n2").alias("node"), "set").distinct()
    last = deeper.where((F.col("c2") > SMALL) & (F.col("n3") != 0)).select(F.col("n3").alias("node"), "set").distinct()
    return stash(small.unionByName(middle).unionByName(last), "leaves")


def near_in_leaves(found: DataFrame, known: DataFrame) -> DataFrame:
    """a, b: in every leaf, a spanning forest of the pairs whose sketches are near. known: set, id, sketch."""
    sizes = found.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    placed = tiled(found, "node", sizes, "set").join(known, "set").select("node", "t", "id", "sketch")

    def near(key, t):
        ids = t.column("id").to_numpy()
        x = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(ids), SKETCH)
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        out = _spanning(len(ids), _near_pairs(x))
        return pa.table({"a": pa.array([ids[i] for i, _ in out], pa.int64()), "b": pa.array([ids[j] for _, j in out], pa.int64())})

    return placed.groupBy("node", "t").applyInArrow(near, "a long, b long")


def exact_links(whole: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """id, links, b: each set's links by weight (b null), and spanning edges id - b of the links."""
    spread = tiled(whole, "root", sizes)

    def exact(key, t):
        ids, weight, own = t.column("id").to_numpy(), t.column("weight").to_numpy(), t.column("own").to_numpy()
        a, b = exact_pairs([np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()], threshold)
        lo, _, hi = key[1].as_py().partition(":")
        if lo != hi:  # a pair within one tile belongs to that tile's own pair
            cross = own[a] != own[b]
            a, b = a[cross], b[cross]
        links = (np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))).astype(np.int64)
        forest = _spanning(len(ids), np.stack([a, b], 1))
        more = [(ids[i], ids[j]) for i, j in forest]
        return pa.table({"id": pa.array([*ids.tolist(), *(i for i, _ in more)], pa.int64()), "links": pa.array([*links.tolist(), *[0] * len(more)], pa.int64()), "b": pa.array([None] * len(ids) + [j for _, j in more], pa.int64())})

    return spread.groupBy("root", "t").applyInArrow(exact, "id long, links long, b long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of docs: id, class_id (least id of its class), n_links, n_copies, set_size.

    Documents link when the Jaccard similarity of their shingle sets is at least `threshold`; a class is a
    connected component. n_links counts the other documents that a document links to, exact copies too;
    n_copies those of equal sets. Texts without words, null texts too, link to nothing: each is a class of its own.
    Rows that share an id are one document as far as classes go; null ids have class null and no links.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.where(docs[id_col].isNotNull())
    sets = stash(_sets(keyed, runs_for(recall), id_col, text_col), "sets")
    # one row for each distinct set: its least document stands for it
    reps = stash(sets.where("size > 0").groupBy("hash").agg(F.min("doc").alias("id"), F.countDistinct("doc").alias("weight"), F.first("set").alias("set"), F.first("sketch").alias("sketch")), "set-classes")
    groups = stash(components(near_in_leaves(leaves(sets), reps.select("set", "id", "sketch"))), "candidate-groups")
    members = groups.join(reps.select("id", "hash", "weight"), "id").select("id", "root", "weight")
    few = members.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = keyed.select(keyed[id_col].cast("long").alias("id"), keyed[text_col].cast("string").alias("text"))
    whole = _tokens(texts.join(F.broadcast(members) if few else members, "id"))
    found = stash(exact_links(whole, groups.groupBy("root").agg(F.count("*").alias("n")), threshold), "links")
    classes = components(found.where("b is not null").select(F.col("id").alias("a"), "b"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    lead = reps.select("hash", "id", "weight").join(classes, "id", "left").join(links, "id", "left").select("hash", F.coalesce("root", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "weight")
    has = F.col("size") > 0
    got = sets.select("doc", "hash", "size").join(lead, "hash", "left").select(
        F.col("doc").alias("id"), F.when(has, F.col("class_id")).otherwise(F.col("doc")).alias("class_id"),
        F.when(has, F.col("links") + F.col("weight") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(has, F.col("weight") - 1).otherwise(0).cast("long").alias("n_copies"), F.col("size").alias("set_size"))
    nulls = docs.where(docs[id_col].isNull()).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("class_id"), *[F.lit(0).cast("long").alias(c) for c in ("n_links", "n_copies", "set_size")])
    return got.unionByName(nulls).withColumnRenamed("id", id_col)


def _near_pairs(x: np.ndarray) -> np.ndarray:
    """Pairs of sketches that agree in SKETCH_MIN of their bytes."""
    out, need = [], SKETCH * SKETCH_MIN
    for i in range(0, len(x), 64):
        same = np.zeros((min(64, len(x) - i), len(x) - i), np.uint8)
        for k in range(SKETCH):
            same += x[i : i + 64, k][:, None] == x[i:, k][None, :]
        a, b = np.nonzero(same >= need)
        keep = a < b
        out.append(np.stack([a[keep] + i, b[keep] + i], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def exact_pairs(toks: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets of this similarity or more, by intersection counts over postings."""
    n = len(toks)
    size = np.array([len(t) for t in toks], np.int64)
    flat = np.concatenate(toks) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    _, number = np.unique(flat, return_inverse=True)
    first = np.searchsorted(flat[order], flat[order], "left")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(first) > 0])) if len(flat) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(flat))
    posting, at = owner[order], np.cumsum(size) - size
    a_out, b_out = [], []
    for i in range(n):
        ks = number[at[i] : at[i] + size[i]]
        lens = ends[ks] - starts[ks]
        hits = posting[np.repeat(starts[ks] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))]
        both = np.bincount(hits, minlength=n)[i + 1 :]
        union = size[i] + size[i + 1 :] - both
        j = np.flatnonzero((both > 0) & (both >= threshold * union - 1e-9))
        a_out.append(np.full(len(j), i, np.int64))
        b_out.append(j + i + 1)
    return (np.concatenate(a_out), np.concatenate(b_out)) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
