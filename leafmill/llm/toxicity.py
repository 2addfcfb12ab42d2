"""Toxicity (operator 10): votes of the nearest labelled examples by exact TF-IDF cosine.

The examples are a bounded sample of labelled rows; every word that stands in any of them is in the vectors and in
their norms. A word weighs (1 + ln tf) * idf * its association with the label, a smooth function of chi-square between
LEAST and 1 which no word fails; so the few words that tell the labels apart aren't drowned by hundreds that don't.

The index keeps postings of words in blocks of 64 examples. Rare words are added up exactly, word by word; for common
ones each block has the largest weight of each word. A query scores blocks in the order of the bounds that these
give, and stops when no further block can reach its k nearest, so the k nearest are exact. Votes are weighted by cosine;
a logistic curve that is fitted to the examples' own leave-one-out votes makes them probabilities.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.blocks import ranges
from leafmill.llm.common import small_batches, stash, words

#: Bounds of the fitted model: labelled rows of each class.
MAX_POSITIVE, MAX_NEGATIVE = 4_000, 8_000
#: Weight of a word that has nothing to do with the label, and the chi-square at which a word weighs half.
LEAST, HALF_CHI = 0.02, 20.0
BLOCK, NEAREST, VISIT = 64, 15, 4
#: A word in this share of the examples is common; texts that are compared together.
COMMON, TOGETHER = 1 / 8, 64
#: Bytes of the packed index in one row; the driver takes a few such rows at a time.
PIECE = 4 << 20


class Terms:
    """Hashes of the distinct words of texts with their counts."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        c, memo = Counter(words(text)), self.memo
        if len(memo) > 400_000:
            memo.clear()
        for w in c:
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, c), np.uint64, len(c)), np.fromiter(c.values(), np.int64, len(c))


class Index:
    """Block-max inverted index of labelled vectors."""

    def __init__(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], weight: tuple[float, float]):
        """examples: (id, label, word hashes, counts); weight: rows that an example of label 0 and 1 stands for."""
        self.weight = weight
        n, labels = len(examples), np.array([e[1] for e in examples], np.int64)
        pos = int(labels.sum())
        flat = np.concatenate([e[2] for e in examples]) if n else np.zeros(0, np.uint64)
        self.names, number = np.unique(flat, return_inverse=True)
        of = np.repeat(np.arange(n), [len(e[2]) for e in examples])
        df = np.bincount(number, minlength=len(self.names)).astype(np.float64)
        bad = np.bincount(number, labels[of], minlength=len(self.names))
        cross = bad * (n - pos - (df - bad)) - (df - bad) * (pos - bad)
        chi = n * cross * cross / np.maximum(max(pos, 1) * max(n - pos, 1) * df * (n - df), 1e-9)
        chi[df >= n] = 0
        self.idf = (np.log((1 + n) / (1 + df)) + 1) * (LEAST + (1 - LEAST) * chi / (chi + HALF_CHI))
        del flat, number, of  # each as long as all postings
        vectors = [self.vector(e[2], e[3]) for e in examples]
        blank = [k for k, (t, _) in enumerate(vectors) if not len(t)]
        got = [sum(weight[labels[k]] for k in blank if labels[k] == x) for x in (0, 1)]
        self.prior = float(weight[1] * pos / max(1e-9, weight[1] * pos + weight[0] * (n - pos)))
        self.blank = (got[1] + self.prior) / (got[0] + got[1] + 1)
        common = df >= max(8, COMMON * n)

        def alike(k):  # examples with the same heaviest shared words stand side by side: blocks get tight bounds
            t, w = vectors[k]
            shared = common[t]
            t, w = t[shared], w[shared]
            return (*t[np.lexsort((t, -w))[:3]].tolist(), examples[k][0])

        order = sorted((k for k in range(n) if len(vectors[k][0])), key=alike)
        self.ids, self.labels = np.array([examples[k][0] for k in order], np.int64), labels[order] if order else labels[:0]
        self.blocks = -(-len(order) // BLOCK)
        rows = np.repeat(np.arange(len(order)), [len(vectors[k][0]) for k in order])
        term = np.concatenate([vectors[k][0] for k in order]) if order else np.zeros(0, np.int64)
        value = np.concatenate([vectors[k][1] for k in order]) if order else np.zeros(0)
        del vectors
        # common words: a column of a dense matrix each; their largest weight in each block
        self.column = np.full(len(self.names), -1, np.int64)
        self.column[common] = np.arange(int(common.sum()))
        dense = common[term]
        matrix = np.zeros((self.blocks * BLOCK, int(common.sum())))
        matrix[rows[dense], self.column[term[dense]]] = value[dense]
        self.dense = matrix.reshape(self.blocks, BLOCK, matrix.shape[1])
        self.most = self.dense.max(1) if self.blocks else np.zeros((0, matrix.shape[1]))
        # other words: postings, word after word
        rows, term, value = rows[~dense], term[~dense], value[~dense]
        by = np.argsort(term, kind="stable")
        self.rows, self.values = rows[by].astype(np.int32), value[by]
        self.lens = np.bincount(term, minlength=len(self.names))
        self.starts = np.cumsum(self.lens) - self.lens

    def vector(self, names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words that the index knows, their weights) of norm 1."""
        if not len(self.names) or not len(names):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        known = self.names[at] == names
        at = at[known]
        w = (1 + np.log(counts[known])) * self.idf[at]
        return at, w / max(math.sqrt(float(w @ w)), 1e-300)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, cosines) of the k nearest of a cosine above 0 of each vector, by cosine, then row; row but[i] is left out of the i-th.

        Each vector's blocks of the highest bounds are scored first; the k-th cosine there shuts out every
        block whose bound lies below it. Vectors that need a block are multiplied with it together.
        """
        m, none = len(vectors), (np.zeros(0, np.int64), np.zeros(0))
        if not self.blocks:
            return [none] * m
        score, q = np.zeros((m, self.blocks, BLOCK)), np.zeros((m, self.dense.shape[2]))
        for i, (term, w) in enumerate(vectors):
            column, lens = self.column[term], self.lens[term]
            q[i, column[column >= 0]] = w[column >= 0]
            at = ranges(self.starts[term], lens)
            if len(at):
                score[i] = np.bincount(self.rows[at], np.repeat(w, lens) * self.values[at], self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        bound = score.max(2) + q @ self.most.T
        for i, row in enumerate(but or ()):
            score[i, row // BLOCK, row % BLOCK] = -np.inf
        seen = np.zeros(bound.shape, bool)

        def visit(need):
            for b in np.flatnonzero(need.any(0)).tolist():
                some = np.flatnonzero(need[:, b])
                score[some, b] += q[some] @ self.dense[b].T
            np.logical_or(seen, need, out=seen)

        first, best = np.zeros(bound.shape, bool), np.argsort(-bound, axis=1, kind="stable")[:, :VISIT]
        np.put_along_axis(first, best, True, 1)
        visit(first & (bound > 0))
        early = np.take_along_axis(score, best[:, :, None], 1).reshape(m, -1)
        kth = np.partition(early, -k, axis=1)[:, -k] if early.shape[1] >= k else np.full(m, -np.inf)
        visit(~seen & (bound > 0) & (bound >= kth[:, None] - 1e-9))
        out = []
        for i in range(m):
            blocks = np.flatnonzero(seen[i])
            sims = np.round(score[i, blocks].ravel(), 12)
            some = np.flatnonzero(sims > 0)
            if len(some) > 4 * k:
                some = some[sims[some] >= np.partition(sims[some], -k)[-k]]
            rows, sims = blocks[some // BLOCK] * BLOCK + some % BLOCK, sims[some]
            top = np.lexsort((rows, -sims))[:k]
            out.append((rows[top], sims[top]))
        return out

    def vote(self, rows: np.ndarray, sims: np.ndarray) -> float:
        """Share of label 1 among neighbours, weighted by cosine and by what each example stands for."""
        if not len(rows):
            return self.blank
        w = sims * np.where(self.labels[rows] == 1, self.weight[1], self.weight[0])
        yes = float(w[self.labels[rows] == 1].sum())
        return (yes + 0.5 * self.prior) / (float(w.sum()) + 0.5)

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]], slope: float = 1.0, shift: float = 0.0) -> list[tuple[float, list[int], list[float]]]:
        """(probability, ids and cosines of the three nearest examples as evidence) of each text's words and counts.

        slope and shift are those of the logistic curve that makes votes probabilities.
        """
        out = []
        for i in range(0, len(texts), TOGETHER):
            for rows, sims in self.nearest([self.vector(*x) for x in texts[i : i + TOGETHER]]):
                raw = min(1 - 1e-6, max(1e-6, self.vote(rows, sims)))
                p = raw if not len(rows) else 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * math.log(raw / (1 - raw)) + shift))))
                out.append((p, self.ids[rows[:3]].tolist(), [round(x, 6) for x in sims[:3].tolist()]))
        return out


def logistic(votes: list[tuple[int, float]], weight: tuple[float, float]) -> tuple[float, float]:
    """Slope and shift of the logistic curve of (label, vote) of examples that were left out of their own votes."""
    y = np.array([v[0] for v in votes], np.float64)
    if not 0 < y.sum() < len(y):
        return 1.0, 0.0
    raw = np.array([v[1] for v in votes]).clip(1e-6, 1 - 1e-6)
    x = np.log(raw / (1 - raw))
    w = np.where(y == 1, weight[1], weight[0])
    w = w / w.mean()
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit, lightly held to the identity
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + (a - 1), (w * (p - y)).sum() + b])
        q = w * p * (1 - p)
        hess = np.array([[(q * x * x).sum() + 1, (q * x).sum()], [(q * x).sum(), q.sum() + 1]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


_loaded: dict[str, Index] = {}


class Model:
    """A fitted index, broadcast as packed bytes, and the curve of its votes. The driver holds no more than the bytes."""

    def __init__(self, spark, raw: bytes | bytearray):
        self.shared, self.name = spark.sparkContext.broadcast(raw), hashlib.md5(raw).hexdigest()
        self.slope, self.shift = 1.0, 0.0

    def loader(self):
        """A function for executors: the index, unpacked once for each Python worker."""
        shared, name = self.shared, self.name

        def load() -> Index:
            if name not in _loaded:
                _loaded.clear()
                _loaded[name] = pickle.loads(zlib.decompress(shared.value))
            return _loaded[name]

        return load

    @property
    def index(self) -> Index:
        return self.loader()()


def _counts(docs: DataFrame) -> DataFrame:
    """id, label, word hashes (little-endian u8) and counts (u4) of each text."""

    def run(batches):
        terms = Terms()
        for b in batches:
            got = [terms(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([h.astype("<u8").tobytes() for h, _ in got], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in got], pa.binary())], ["id", "label", "name", "n"])

    return docs.mapInArrow(run, "id long, label int, name binary, n binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Model:
    """Fit the examples and their index.

    Of labelled rows at most max_positive of label 1 and max_negative of others are taken, in the order of a
    hash of their id. Null ids and labels are left out; an id that is labelled twice takes its highest label;
    of texts that share an id the first in order counts; equal texts are one example, with their highest label. Without examples
    every score is the prior, 0. The index is built in one task, which the sample bounds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).dropna().groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    by_hash = [F.xxhash64("id"), "id"]
    taken = known.where("label = 1").orderBy(*by_hash).limit(max_positive).unionByName(known.where("label = 0").orderBy(*by_hash).limit(max_negative))
    # at most max_positive + max_negative rows: that bounds the broadcast
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(taken), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    # copies of one text are one example: else their every word looks like a sign of their label
    found = found.groupBy("text").agg(F.max("label").alias("label"), F.min("id").alias("id"))
    counts = stash(_counts(found.select("id", "label", "text")), "toxicity-sample")
    sizes = {r.label: r.n for r in counts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    weight = (totals.get(0, 0) / neg if neg else 1.0, totals.get(1, 0) / pos if pos else 1.0)

    def build(batches):  # one task: the sample's bound is its bound, and the driver needs no room for it
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        raw = pickle.dumps(Index([(i, label, np.frombuffer(h, "<u8"), np.frombuffer(n, "<u4")) for i, label, h, n in sorted(rows)], weight), protocol=5)
        rows.clear()
        raw = zlib.compress(raw, 1)
        for k in range(0, len(raw), piece):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([raw[k : k + piece]], pa.binary())], ["at", "size", "raw"])

    piece, parts = PIECE, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a collect would hold the whole index several times over in the driver: its heap, its socket and its Python
    pieces = stash(counts.repartition(1).mapInArrow(build, "at long, size long, raw binary"), "toxicity-index", rows_a_file=1)
    raw = bytearray()
    for r in pieces.toLocalIterator():
        raw = raw or bytearray(r["size"])
        raw[r["at"] : r["at"] + len(r["raw"])] = r["raw"]
    model = Model(spark, raw)
    del raw
    if pos and neg:
        load = model.loader()

        def leave_out(batches):
            index = load()
            row = {i: k for k, i in enumerate(index.ids.tolist())}
            for b in batches:
                for k in range(0, b.num_rows, TOGETHER):
                    some = [x for x in zip(*(c.to_pylist() for c in b.slice(k, TOGETHER).columns)) if x[0] in row]
                    near = index.nearest([index.vector(np.frombuffer(h, "<u8"), np.frombuffer(n, "<u4")) for _, _, h, n in some], but=[row[x[0]] for x in some])
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int32()), pa.array([index.vote(*x) for x in near], pa.float64())], ["id", "label", "vote"])

        votes = counts.repartition(parts).mapInArrow(leave_out, "id long, label int, vote double").collect()
        model.slope, model.shift = logistic([(r.label, r.vote) for r in sorted(votes, key=lambda r: r.id)], weight)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: id, columns in `keep`, score, predicted (score >= 0.5), evidence_ids, evidence_cosines.

    Null text counts as empty; a text without any word of the vectors gets the share that such examples
    have. Repeated rows, ids and other columns pass through row by row. No shuffle; the index is bounded.
    """
    small_batches(docs.sparkSession)
    keep = keep or []
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), *[docs[c].alias(f"keep_{i}") for i, c in enumerate(keep)])
    load, slope, shift = model.loader(), model.slope, model.shift

    def run(batches):
        index, terms = load(), Terms()
        for b in batches:
            got = index.score([terms(t) for t in b.column("text").to_pylist()], slope, shift)
            rest = [(f, b.column(i)) for i, f in enumerate(b.schema.names) if f != "text"]
            p = [g[0] for g in got]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))], [*(f for f, _ in rest), "score", "predicted", "evidence_ids", "evidence_cosines"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    out = rows.mapInArrow(run, f"{head}, score double, predicted int, evidence_ids array<long>, evidence_cosines array<double>")
    for i, c in enumerate(keep):
        out = out.withColumnRenamed(f"keep_{i}", c)
    return out.withColumnRenamed("id", id_col)
