"""SentencePiece encoding and decoding (operator 2) over a relational lattice.

A text is cut into units wherever two neighbouring characters stand together in no piece: no piece crosses
such a place. Of each distinct unit all substrings up to the longest piece are exploded and equi-joined to
the piece table; the edges that this leaves are grouped by unit and folded by Spark's `aggregate`. The ids
return to the documents by block (`leafmill.llm.blocks`).

For a unigram model the fold is Viterbi's: best score of each position from the edges that end there.
A BPE model defines its result by merges, not by the best path, and Viterbi over its scores gives other
ids. There the same lattice is folded in the order of the merges: edges sorted by rank and place, a bitmap
of the boundaries that still stand, and an edge taken when both its ends stand with one boundary between.
One pass is exact unless an edge comes up too early that a worse ranked piece could complete later; such
units are flagged in the fold and folded again with a restart after each merge.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.blocks import Block, Values, block_docs, block_units, by_block, list_values, pack_values, ranges
from leafmill.llm.common import small_batches

SPACE = "▁"
#: Longest unit that the lattice takes (a boundary bitmap is one bigint); longer ones go through the library.
UNIT_CHARS = 60
#: Ids from here on stand for characters without a piece, by their code point.
UNKNOWN = 1 << 26
#: Words whose units a scan remembers, and numbers or ids that are looked up at once.
MEMO_WORDS, SLICE = 400_000, 250_000


class Model:
    """Pieces of a model file and what its units are."""

    def __init__(self, path: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = _fields(sp.serialized_model_proto())
        self.bpe, self.dummy_prefix, self.plain = kind["type"] == 2, kind["add_dummy_prefix"], kind["plain"]
        self.escape, self.unk_surface = kind["escape"], " ⁇ "
        self.text = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(sp.vocab_size())]
        self.pieces = {t: i for i, t in enumerate(self.text) if normal[i]}
        self.score = {t: sp.get_score(i) for t, i in self.pieces.items()}
        self.rank = {t: r for r, t in enumerate(sorted(self.pieces, key=lambda t: (-self.score[t], self.pieces[t])))}
        self.bytes = {i: int(t[3:5], 16) for i, t in enumerate(self.text) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        # what an id stands for whatever its neighbours are; None: a byte of a longer character, or no text
        self.plain_text = [None if sp.is_control(i) or sp.is_unknown(i) else (chr(self.bytes[i]) if self.bytes[i] < 128 else None) if i in self.bytes else t.replace(SPACE, " ") for i, t in enumerate(self.text)]
        self.longest = max(map(len, self.pieces), default=1)
        pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        #: Pairs of characters that stand together in some piece, as sorted numbers.
        self.pairs = np.array(sorted(ord(p[0]) << 21 | ord(p[1]) for p in pairs), np.int64)
        # words between single spaces can be cut alone if none ends in a piece that goes on behind a space
        self.by_word = self.dummy_prefix and not any(q[1] == SPACE for q in pairs if q[0] != SPACE)
        self.char_id = np.full(0x110000, -1, np.int32)
        for t, i in self.pieces.items():
            if len(t) == 1:
                self.char_id[ord(t)] = i
        # texts of ids as bytes; ids whose text hangs on their neighbours are marked
        shown = [b"" if t is None else t.encode() for t in self.plain_text]
        self.shown, self.shown_len = np.frombuffer(b"".join(shown), np.uint8), np.array([len(t) for t in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_len) - self.shown_len
        self.odd = np.array([t is None for t in self.plain_text], bool)
        # the same model for text that is normal already: a later message's fields replace the earlier one's
        bare = b"".join(bytes([f << 3, 0]) for f in (3, 4, 5)) + bytes([2 << 3 | 2, 0])
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=sp.serialized_model_proto() + bytes([3 << 3 | 2, len(bare)]) + bare)

    def normal(self, text: str) -> str:
        """What the library cuts into pieces: spaces escaped, the dummy prefix in front, normalised by its rules."""
        if not text:
            return ""
        if not self.plain:
            return self.sp.normalize(text)
        return ((SPACE if self.dummy_prefix else "") + text).replace(" ", SPACE)

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(units of normal texts that aren't empty, how many each text has)."""
        if not texts:
            return [], np.zeros(0, np.int64)
        all_of = "".join(texts)
        code = np.frombuffer(all_of.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(lens) - lens
        pair = code[:-1] << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        begins = np.concatenate([[True], self.pairs[at] != pair if len(self.pairs) else np.ones(len(pair), bool)])
        begins[starts] = True
        edge = np.flatnonzero(begins).tolist()
        return [all_of[i:j] for i, j in zip(edge, [*edge[1:], len(all_of)])], np.add.reduceat(begins.astype(np.int64), starts)

    def number(self, block: Block, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the units of some texts; words that a block has met before aren't cut again."""
        memo, parts, rest = block.memo, [], []
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for k, t in enumerate(texts):
            whole = None if self.plain and self.by_word else self.normal(t)
            if self.by_word and not self.plain:  # back to words between spaces
                t = whole[1:].replace(SPACE, " ") if whole[:1] == SPACE else ""
            if t and self.by_word and "  " not in t and t[0] != " " and t[-1] != " " and SPACE not in t:
                parts.append(t.split(" "))
            else:
                parts.append(None)
                rest.append((k, self.normal(t) if whole is None else whole))
        new = list(set().union(*(p for p in parts if p)).difference(memo))
        units, counts = self.cut([SPACE + w for w in new])
        raw = block.add(units).astype("<u4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        for w, i, j in zip(new, [0, *ends], ends):
            memo[w] = raw[i:j]
        out = [np.frombuffer(b"".join(map(memo.__getitem__, p)), "<u4") if p else np.zeros(0, np.uint32) for p in parts]
        for k, t in rest:
            out[k] = block.add(self.cut([t])[0]) if t else out[k]
        return out

    def late(self, piece: str) -> bool:
        """Whether a merge of worse ranked halves can make this piece."""
        r = self.rank[piece]
        for k in range(1, len(piece)):
            a, b = piece[:k], piece[k:]
            if all(len(h) == 1 or h in self.rank for h in (a, b)) and any(len(h) > 1 and self.rank[h] > r for h in (a, b)):
                return True
        return False

    def expand(self, ids: list[int]) -> list[int]:
        """Replace characters without a piece by their bytes, or by the unknown id."""
        out, unk = [], self.sp.unk_id()
        for i in ids:
            if i >= UNKNOWN and self.byte_id:
                out.extend(self.byte_id[b] for b in chr(i - UNKNOWN).encode("utf-8", "surrogatepass"))
            elif i < UNKNOWN and (i != unk or self.byte_id):
                out.append(i)
            elif not out or out[-1] != unk:  # a run of unknown characters is one id
                out.append(unk)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, byte runs as UTF-8, spaces restored, the dummy space taken away."""
        parts = [self.plain_text[i] for i in ids]
        if None not in parts:
            text = "".join(parts)
            return text[1:] if self.dummy_prefix and text.startswith(" ") else text
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if not self.sp.is_control(i):
                out.append(self.unk_surface if self.sp.is_unknown(i) else self.text[i].replace(SPACE, " "))
        if run:
            out.append(_utf8(run))
        text = "".join(out)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _utf8(raw: bytearray) -> str:
    """Each byte that isn't part of a character becomes U+FFFD, as the library does."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[i : i + n]).decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        at += 1
        if raw[at - 1] < 128:
            return value, at
        shift += 7


def _message(raw: bytes) -> list[tuple[int, object]]:
    """(field, value) of a protocol buffer message."""
    out, at = [], 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        else:
            n, at = (8, at) if key & 7 == 1 else (4, at) if key & 7 == 5 else _varint(raw, at)
            value, at = raw[at : at + n], at + n
        out.append((key >> 3, value))
    return out


def _fields(raw: bytes) -> dict:
    """What of the trainer's (2) and normalizer's (3) settings encoding depends on."""
    top = _message(raw)
    trainer = dict(x for f, v in top if f == 2 for x in _message(v))
    norm = dict(x for f, v in top if f == 3 for x in _message(v))
    return {
        "type": trainer.get(3, 1), "add_dummy_prefix": bool(norm.get(3, 1)), "escape": bool(norm.get(5, 1)),
        "plain": not norm.get(2) and not norm.get(4, 1) and bool(norm.get(5, 1)) and not trainer.get(24, 0),
    }


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def piece_table(spark: SparkSession, m: Model) -> DataFrame:
    """name (hash of the piece), piece, edge (rank, late flag and id in one bigint), score: pieces of two characters or more, and for unigram models all.

    As many rows as the model file has pieces.
    """
    rows = [(t, (m.rank[t] << 40) | (int(m.bpe and m.late(t)) << 27) | i, float(m.score[t])) for t, i in m.pieces.items() if len(t) > 1 or not m.bpe]
    return spark.createDataFrame(rows, "piece string, edge long, score double").select(F.xxhash64("piece").alias("name"), "piece", "edge", "score")


def spans(least: int, longest: int) -> str:
    """SQL of an array of arrays: for each length of a unit, 1,024 * start + length of its substrings, and 0 first."""
    of = [[0, *(s << 10 | k for s in range(n) for k in range(least, min(longest, n - s) + 1))] for n in range(UNIT_CHARS + 1)]
    return f"from_json('{json.dumps(of)}', 'array<array<int>>')"  # one literal, not a tree of thousands


def lattice(units: DataFrame, pieces: DataFrame, least: int, longest: int, edge: str) -> DataFrame:
    """unit, at, edges: explode bounded substrings, equi-join the piece table, group by unit.

    units: h, unit, at; dealt by h, so that nothing is shuffled here. A unit has one row without a substring that carries
    it through the join; units that are too long have no other. `edge` is the SQL of an edge (null: no edge).
    The join is on the hash of the piece, with the piece itself compared behind it.
    """
    x = units.withColumn("uid", F.monotonically_increasing_id()).withColumn("x", F.explode(F.expr(f"get({spans(least, longest)}, if(char_length(unit) > {UNIT_CHARS}, 0, char_length(unit)))")))
    x = x.selectExpr("h", "uid", "if(x = 0, unit, null) as unit", "if(x = 0, at, null) as at", "shiftright(x, 10) as s", "x & 1023 as k", "substring(unit, shiftright(x, 10) + 1, x & 1023) as sub")
    x = x.withColumn("name", F.expr("if(k = 0, null, xxhash64(sub))"))
    same = F.expr("startswith(sub, piece) and octet_length(sub) <= octet_length(piece)")
    x = x.join(F.broadcast(pieces.withColumnRenamed("name", "of")), (F.col("name") == F.col("of")) & same, "left").where(f"edge is not null or k <= {2 - least}")  # a fixed model's pieces
    x = x.selectExpr("h", "uid", "unit", "at", f"if(k = 0, null, {edge}) as edge")
    return x.groupBy("h", "uid").agg(F.first("unit", ignorenulls=True).alias("unit"), F.first("at", ignorenulls=True).alias("at"), F.collect_list("edge").alias("edges")).drop("h", "uid")


_S, _E = "cast(shiftright(x, 34) & 63 as int)", "cast(shiftright(x, 28) & 63 as int)"
#: Boundaries strictly between the ends of edge x, as bits of the map b.
_INSIDE = f"(b & (shiftleft(1L, {_E}) - shiftleft(2L, {_S})))"
_ENDS = f"((shiftright(b, {_S}) & shiftright(b, {_E}) & 1L) = 1L)"
_CAN = f"({_ENDS} and bit_count({_INSIDE}) = 1)"


def bpe_fold(edges: str = "edges", n: str = "char_length(unit)") -> tuple[str, str]:
    """SQL of (one pass: struct of boundaries b and flag bad; the exact fold: boundaries)."""
    full = f"(shiftleft(2L, {n}) - 1L)"
    step = f"""named_struct(
        'b', if({_CAN.replace('b &', 'a.b &').replace('shiftright(b', 'shiftright(a.b')}, a.b & ~(shiftleft(1L, {_E}) - shiftleft(2L, {_S})), a.b),
        'bad', a.bad or ((shiftright(x, 27) & 1L) = 1L and {_ENDS.replace('shiftright(b', 'shiftright(a.b')} and bit_count({_INSIDE.replace('b &', 'a.b &')}) > 1))"""
    once = f"aggregate({edges}, named_struct('b', {full}, 'bad', false), (a, x) -> {step})"
    taken = f"shiftleft(1L, {_E}) - shiftleft(2L, {_S})"
    exact = f"aggregate(sequence(1, {n}), {full}, (b, i) -> b & ~coalesce(get(transform(filter({edges}, x -> {_CAN}), x -> {taken}), 0), 0L))"
    return once, exact


def bpe_units(units: DataFrame, pieces: DataFrame, m: Model) -> DataFrame:
    """unit, at, edges, b (null: too long) of a BPE lattice: b has a bit for each boundary that the fold leaves.

    Edges are bigints: rank (23 bits), start (6), end (6), late flag (1), id (27). Single characters have none.
    """
    place = "shiftleft(cast(s as bigint), 34) | shiftleft(cast(s + k as bigint), 28)"
    x = lattice(units, pieces, 2, m.longest, f"edge | {place}").withColumn("edges", F.sort_array("edges"))
    once, exact = bpe_fold()
    x = x.selectExpr("unit", "at", "edges", f"if(char_length(unit) > {UNIT_CHARS}, null, {once}) as f")
    return x.selectExpr("unit", "at", "edges", f"inline(array(named_struct('b', if(f.bad, {exact}, f.b))))")


def bpe_ids(m: Model, units: list[str], offsets: np.ndarray, edges: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many each unit has): edges and single characters between neighbouring boundaries, in order of place.

    A character without a piece gets UNKNOWN and its code point.
    """
    n = np.fromiter(map(len, units), np.int64, len(units))
    code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    row, at = np.repeat(np.arange(len(n)), n), ranges(np.zeros(len(n), np.int64), n)
    alone = np.flatnonzero(b[row] >> at & 3 == 3)
    of = np.repeat(np.arange(len(n)), np.diff(offsets))
    s, e, left = edges >> 34 & 63, edges >> 28 & 63, b[of]
    merged = np.flatnonzero((left >> s & left >> e & 1 == 1) & (left & ((1 << e) - (2 << s)) == 0))
    one = m.char_id[code[alone]]
    ids = np.concatenate([np.where(one >= 0, one, UNKNOWN + code[alone]), edges[merged] & (1 << 27) - 1])
    place = np.concatenate([row[alone] << 6 | at[alone], of[merged] << 6 | s[merged]])
    order = np.argsort(place, kind="stable")
    return ids[order], np.bincount(place >> 6, minlength=len(n))


def viterbi_units(units: DataFrame, pieces: DataFrame, m: Model) -> DataFrame:
    """unit, at, ids (null: too long) of a unigram lattice: best path by score, the first found on ties."""
    worst = min(m.score.values(), default=0.0) - 10.0
    edge = "named_struct('e', s + k, 's', s, 'score', coalesce(score, %r), 'id', if(edge is null, %d + ascii(sub), cast(edge & 67108863L as int)))" % (worst, UNKNOWN)
    g = lattice(units, pieces, 1, m.longest, edge).withColumn("edges", F.array_sort("edges"))
    # best[i]: score, start of the last edge and its id, for the path to position i; edges come by end, then start
    init = "array(named_struct('score', cast(0 as double), 's', -1, 'id', -1))"
    better = "if(size(a) <= x.e, concat(a, array(named_struct('score', a[x.s].score + x.score, 's', x.s, 'id', x.id))), if(a[x.s].score + x.score > a[x.e].score, concat(slice(a, 1, x.e), array(named_struct('score', a[x.s].score + x.score, 's', x.s, 'id', x.id))), a))"
    best = g.selectExpr("unit", "at", f"inline(array(named_struct('best', aggregate(edges, {init}, (a, x) -> {better}))))")
    back = "aggregate(sequence(1, size(best) - 1), named_struct('at', size(best) - 1, 'ids', cast(array() as array<int>)), (a, i) -> if(a.at <= 0, a, named_struct('at', best[a.at].s, 'ids', concat(array(best[a.at].id), a.ids))), a -> a.ids)"
    return best.selectExpr("unit", "at", f"if(size(best) = 1, null, {back}) as ids")


def encode_units(units: DataFrame, path: str) -> DataFrame:
    """unit, at and what their ids follow from, for distinct units with their places (h, unit, at); see `unit_ids`."""
    m = model(path)
    return (bpe_units if m.bpe else viterbi_units)(units, piece_table(units.sparkSession, m), m)


def unit_ids(m: Model, b) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many each unit has) of a record batch of `encode_units`; units that are too long go through the library."""
    units, result = b.column(0).to_pylist(), b.column(b.num_columns - 1)
    long = np.flatnonzero(result.is_null().to_numpy(zero_copy_only=False)).tolist()
    offsets, values = list_values(b.column(2))
    if m.bpe:
        ids, lens = bpe_ids(m, units, offsets, values, result.fill_null(0).to_numpy())
    else:
        code = np.where(values >= UNKNOWN, values - UNKNOWN, 0)
        ids, lens = np.where((values >= UNKNOWN) & (m.char_id[code] >= 0), m.char_id[code], values), np.diff(offsets)
    if long:
        every = np.split(ids, np.cumsum(lens)[:-1])
        for i in long:
            every[i] = np.array(m.bare.encode(units[i]), np.int64)
        ids, lens = np.concatenate(every), np.array([len(x) for x in every], np.int64)
    return ids, lens


def _packer(path: str):
    """For pack_values: the ids of a unit, as little-endian u4, for each of its places."""

    def flat(b):
        ids, lens = unit_ids(model(path), b)
        offsets, at = list_values(b.column(1))
        row = np.repeat(np.arange(len(lens)), np.diff(offsets))
        data = ids[ranges((np.cumsum(lens) - lens)[row], lens[row])].astype("<u4")
        return at, 4 * lens[row], data.view(np.uint8)

    return flat


def _finish(path: str):
    """For by_block: the ids of each document, their hash, and the hash of the text they give."""

    def finish(values: Values, ids, lens, numbers):
        m, vocabulary = model(path), values.data.view("<u4")
        parts, took = [], []
        for i in range(0, len(numbers), SLICE):
            x = numbers[i : i + SLICE]
            took.append(values.lens[x] // 4)
            parts.append(vocabulary[ranges(values.starts[x] // 4, took[-1])])
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        before = np.concatenate([[0], np.cumsum(np.concatenate(took))]) if took else np.zeros(1, np.int64)
        edge = before[np.concatenate([[0], np.cumsum(lens)])]
        docs, back, crc = [], [], []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own, text = tokens[i:j], hashlib.md5()
            if len(own) and (int(own.max()) >= UNKNOWN or (not m.byte_id and (own == m.sp.unk_id()).any())):
                own = np.array(m.expand(own.tolist()), "<u4")
            if m.odd[own].any():
                text.update(m.decode(own.tolist()).encode("utf-8", "surrogatepass"))
            else:
                for k in range(0, len(own), SLICE):
                    x = own[k : k + SLICE]
                    raw = m.shown[ranges(m.shown_at[x], m.shown_len[x])].tobytes()
                    text.update(raw[1:] if not k and m.dummy_prefix and raw[:1] == b" " else raw)
            docs.append(own)
            crc.append(zlib.crc32(own.tobytes()))
            back.append(text.hexdigest())
        sizes = np.array([len(x) for x in docs], np.int64)
        flat = np.concatenate(docs).astype(np.int32) if docs else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(crc, pa.int64()), pa.array(back, pa.string())], ["id", "n_pieces", "ids", "ids_crc32", "decoded_md5"])

    return finish


def sentencepiece_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_pieces, ids (array<int>), ids_crc32 (little-endian u32), decoded_md5.

    The ids are those of the library for the whole text; decoded_md5 is the hash of the text that they give
    when they are decoded by the piece table. Null and empty texts have no ids. Repeated rows, ids and null ids are encoded
    row by row; other columns are ignored; an empty table gives no rows. docs must be a repeatable scan.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    number = _number(path)
    # the places of a common unit fill a row for each 4,096 partitions of the scan, dealt by unit and those
    units = block_units(rows, number).withColumn("h", F.xxhash64("unit", F.shiftright("at", 53)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())
    placed = units.repartition(parts, "h").groupBy("h", "unit").agg(F.collect_list("at").alias("at"))
    values = pack_values(encode_units(placed, path), _packer(path))
    kind = docs.schema[id_col].dataType.simpleString()
    out = by_block(block_docs(rows, number), values, _finish(path), f"id {kind}, n_pieces long, ids array<int>, ids_crc32 long, decoded_md5 string")
    return out.withColumnRenamed("id", id_col)


def _number(path: str):
    def number(block: Block, texts: list[str]) -> list[np.ndarray]:
        return model(path).number(block, texts)

    return number


def sentencepiece_decode(coded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """coded with a column of the text of its ids, by the piece table. Null ids give null."""
    small_batches(coded.sparkSession)

    @F.pandas_udf("string")
    def decode(ids):
        own = model(path)
        return ids.map(lambda x: None if x is None else own.decode([int(i) for i in x]))

    return coded.withColumn(text_col, decode(F.col(ids_col)))
