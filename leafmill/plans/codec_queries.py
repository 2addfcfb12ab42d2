"""Queries of codecs, ciphers and the renderer: encode or draw, decode or look, compare with plain SQL."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from leafmill.shipping import ship

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name: str, sql: str | None, run) -> None:
    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


def per_row(df: DataFrame, schema: str, f) -> DataFrame:
    """Rows of f(row values) with `schema`, without a shuffle."""
    ship(df.sparkSession)
    wide = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < wide:
        df = df.repartition(wide)

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            rows = [f(*v) for v in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def lzw_literals(data: bytes) -> bytes:
    """LZW codes of single bytes, with a clear code before codes would grow."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint16)
    codes = np.concatenate([[256], np.insert(raw, np.arange(250, len(raw), 250), 256), [257]])
    return np.packbits((codes[:, None] >> np.arange(8, -1, -1) & 1).astype(np.uint8)).tobytes()


def run_lengths(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 128):
        part = data[i : i + 128]
        out += bytes([len(part) - 1]) + part
    return bytes(out + b"\x80")


def png_rows(data: bytes, columns: int = 16, step: int = 4) -> bytes:
    """Rows by the five PNG filters in turn; the last row is filled with zeros."""
    rows = np.frombuffer(data.ljust(-(-len(data) // columns) * columns, b"\0"), np.uint8).reshape(-1, columns).astype(np.int64)
    above = np.concatenate([np.zeros((1, columns), np.int64), rows])[: len(rows)]
    left, corner = (np.pad(x, ((0, 0), (step, 0)))[:, :columns] for x in (rows, above))
    p = left + above - corner
    a, b, c = abs(p - left), abs(p - above), abs(p - corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
    kind = np.arange(len(rows))[:, None] % 5
    guess = np.choose(kind, [np.zeros_like(rows), left, above, (left + above) // 2, paeth])
    return np.concatenate([kind, (rows - guess) % 256], axis=1).astype(np.uint8).tobytes()


_PNG = {"Predictor": 15, "Colors": 4, "BitsPerComponent": 8, "Columns": 4}
CODECS = {
    "flate": ("FlateDecode", zlib.compress, None), "flate_raw": ("Fl", lambda d: zlib.compress(d)[2:-4], None), "lzw": ("LZWDecode", lzw_literals, None),
    "ascii_hex": ("ASCIIHexDecode", lambda d: d.hex().encode() + b">", None), "ascii_85": ("A85", lambda d: base64.a85encode(d, adobe=True), None),
    "run_length": ("RunLengthDecode", run_lengths, None), "png_predictor": ("FlateDecode", lambda d: zlib.compress(png_rows(d)), _PNG),
}


def _codec(key: str):
    name, encode, parms = CODECS[key]

    def run(spark, sf_dir):
        def one(doc_id, text):
            from leafmill.sources.codecs import decode_stream
            from leafmill.sources.syntax import Name, Stream

            raw = (text or "").encode()
            d = {Name("Filter"): Name(name), **({Name("DecodeParms"): {Name(k): v for k, v in parms.items()}} if parms else {})}
            return doc_id, hashlib.md5(decode_stream(Stream(d, encode(raw)))[: len(raw)]).hexdigest()

        return per_row(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id long, md5 string", one)

    return run


for _key in CODECS:
    add(f"filter_{_key}", "select doc_id, md5(text) as md5 from documents", _codec(_key))


def _chain(spark, sf_dir):
    def one(doc_id, text):
        from leafmill.sources.codecs import decode_stream
        from leafmill.sources.syntax import Name, Stream

        raw = (text or "").encode()
        d = {Name("Filter"): [Name("A85"), Name("RL"), Name("Fl")]}
        return doc_id, hashlib.md5(decode_stream(Stream(d, base64.a85encode(run_lengths(zlib.compress(raw)), adobe=True)))).hexdigest()

    return per_row(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id long, md5 string", one)


add("filter_chain", "select doc_id, md5(text) as md5 from documents", _chain)


def _ciphers(spark, sf_dir):
    def one(key, name):
        from leafmill.sources.security import aes_open, aes_seal, rc4

        raw, secret = name.encode(), hashlib.md5(str(key).encode()).digest()
        return key, rc4(secret, rc4(secret, raw)).decode(), aes_open(secret, aes_seal(secret, raw, secret[::-1])).decode()

    return per_row(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name"), "c_custkey long, rc4 string, aes string", one)


add("cipher_roundtrips", "select c_custkey, c_name as rc4, c_name as aes from customer", _ciphers)


def _encoded_text(spark, sf_dir):
    def one(doc_id, text):
        from leafmill.sources.files import write_object
        from leafmill.sources.syntax import Name, Str, parse_object

        v, _ = parse_object(write_object({Name("T"): [Str((text or "").encode()), 1.5, None]}) + b" ")
        return doc_id, hashlib.sha256(v["T"][0]).hexdigest()

    return per_row(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id long, sha256 string", one)


add("object_syntax_roundtrip", "select doc_id, sha256(text) as sha256 from documents", _encoded_text)


def _drawn(spark, sf_dir):
    """Each supplier is a page with a filled square, a stroke and a clipped corner: what colours they have."""

    def one(key, nation):
        from leafmill.operators.render import render_page
        from leafmill.sources.document import Document

        doc = Document()
        page = doc.add_page(30, 20)
        doc.append_content(page, f"{key % 256 / 255:.6f} {nation * 10 / 255:.6f} 0 rg 2 2 10 10 re f 0 0 1 RG 2 w 15 0 m 15 20 l S q 20 0 10 5 re W n 0 1 0 rg 0 0 30 20 re f Q".encode())
        px = render_page(doc, page).astype(int)
        tile = render_page(doc, page, 1.0, (10, 5, 12, 10)).astype(int)
        return key, *px[13, 6, :3].tolist(), int(px[10, 15, 2]), int(px[17, 25, 1]), int(px[5, 25, 0]), int(abs(tile - px[5:15, 10:22]).max())

    return per_row(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey"), "s_suppkey long, r int, g int, b int, stroke int, clipped int, white int, tile_error int", one)


add("rendered_pages", "select s_suppkey, cast(s_suppkey % 256 as int) as r, cast(s_nationkey * 10 as int) as g, 0 as b, 255 as stroke, 255 as clipped, 255 as white, 0 as tile_error from supplier", _drawn)


def _png(spark, sf_dir):
    """Pictures of two by two pixels drawn without smoothing, through the PNG sink and back."""

    def one(key):
        from leafmill.operators.render import from_png, png, render_page
        from leafmill.sources.document import Document

        doc = Document()
        page = doc.add_page(20, 20)
        raw = bytes([key % 256, 0, 0, 0, key % 251, 0, 0, 0, key % 241, 9, 9, 9])
        doc.append_content(page, b"q 20 0 0 20 0 0 cm BI /W 2 /H 2 /CS /RGB /BPC 8 ID " + raw + b" EI Q")
        px = from_png(png(render_page(doc, page, fast=True)))
        return key, int(px[4, 4, 0]), int(px[4, 15, 1]), int(px[15, 4, 2]), int(px[15, 15, 0])

    return per_row(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"), "s_suppkey long, a int, b int, c int, d int", one)


add("image_pixels", "select s_suppkey, cast(s_suppkey % 256 as int) as a, cast(s_suppkey % 251 as int) as b, cast(s_suppkey % 241 as int) as c, 9 as d from supplier", _png)


def _fax(spark, sf_dir):
    """One-dimensional fax rows: runs of white, then black, from code words back to counts."""

    def one(key):
        from leafmill.sources import ccitt

        white = key % 63
        words = {n: code for code, n in ccitt._RUNS[0].items()}, {n: code for code, n in ccitt._RUNS[1].items()}
        bits = words[0][white] + words[1][64 - white if 64 - white < 64 else 64] + (words[1][0] if white == 0 else "")
        bits += "0" * (-len(bits) % 8)
        raw = ccitt.decode(int(bits, 2).to_bytes(len(bits) // 8, "big"), {"K": 0, "Columns": 64, "Rows": 1, "BlackIs1": True})
        return key, bin(int.from_bytes(raw, "big")).count("1")

    return per_row(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey long, black int", one)


add("fax_rows", "select o_orderkey, cast(64 - o_orderkey % 63 as int) as black from orders", _fax)
