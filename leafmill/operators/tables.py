"""Tables of PDF collections: documents, objects, pages, operations, spans, glyphs, hits, outlines, links, labels.

Each takes a DataFrame of files (doc_id, content). Filters on doc_id belong before these calls; pages can be
chosen with `pages`, which keeps the kernel from touching the others.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import text as T
from leafmill.operators.content import parse_content
from leafmill.sources.document import Document
from leafmill.sources.reader import per_document
from leafmill.sources.syntax import Name, Ref, Stream

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
DEST = "struct<page_index:int,x:double,y:double,zoom:double>"


def box(b):
    return tuple(b)


def as_json(v) -> str:
    """An object as JSON: names get a slash, strings hex in brackets, references `n g R`."""

    def plain(x):
        if isinstance(x, Ref):
            return f"{x.num} {x.gen} R"
        if isinstance(x, Name):
            return f"/{x}"
        if isinstance(x, bytes):
            return f"<{x.hex()}>"
        if isinstance(x, Stream):
            return plain(x.dict)
        if isinstance(x, dict):
            return {k: plain(y) for k, y in x.items()}
        if isinstance(x, list):
            return [plain(y) for y in x]
        return x

    return json.dumps(plain(v))


def kind_of(v) -> str:
    for kind, name in ((type(None), "null"), (bool, "bool"), (int, "integer"), (float, "real"), (Name, "name"), (bytes, "string"), (Ref, "reference"), (list, "array"), (dict, "dictionary"), (Stream, "stream")):
        if isinstance(v, kind):
            return name
    return "keyword"


def _chosen(doc: Document, pages):
    every = doc.pages()
    for i, ref in enumerate(every):
        if pages is None or i in pages:
            yield i, ref


def documents(files: DataFrame, password: bytes = b"") -> DataFrame:
    def rows(doc, row):
        yield doc.version, len(doc.objects), len(doc.pages()), doc.info("Title"), as_json(doc.trailer)

    return per_document(files, "version string, n_objects int, n_pages int, title string, trailer string", rows, password)


def objects(files: DataFrame, password: bytes = b"", want_values: bool = True) -> DataFrame:
    """Every object; without want_values its value and stream stay null."""

    def rows(doc, row):
        for ref, v in sorted(doc.objects.items()):
            yield ref.num, ref.gen, kind_of(v), as_json(v) if want_values else None, v.data if want_values and isinstance(v, Stream) else None

    return per_document(files, "num bigint, gen int, kind string, value string, stream_raw binary", rows, password)


def pages(files: DataFrame, password: bytes = b"") -> DataFrame:
    def rows(doc, row):
        for i, ref in enumerate(doc.pages()):
            w, h = doc.size(ref)
            yield i, ref.num, ref.gen, doc.media_box(ref), doc.rotation(ref), w, h

    return per_document(files, "page_index int, num bigint, gen int, media_box array<double>, rotate int, width double, height double", rows, password)


def operations(files: DataFrame, pages: set[int] | None = None, password: bytes = b"", want_operands: bool = True) -> DataFrame:
    """Every operation; without want_operands those stay null."""

    def rows(doc, row):
        for i, ref in _chosen(doc, pages):
            for k, op in enumerate(parse_content(doc.content(ref))):
                yield i, k, op.operator, [as_json(a) for a in op.operands] if want_operands else None

    return per_document(files, "page_index int, op_seq int, operator string, operands array<string>", rows, password)


def page_texts(files: DataFrame, pages: set[int] | None = None, password: bytes = b"", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    def rows(doc, row):
        for i, ref in _chosen(doc, pages):
            yield i, T.page_text(doc, ref)

    return per_document(files, "page_index int, text string", rows, password, carry)


def spans(files: DataFrame, pages: set[int] | None = None, password: bytes = b"", want_glyphs: bool = True) -> DataFrame:
    def rows(doc, row):
        for i, ref in _chosen(doc, pages):
            for k, s in enumerate(T.page_spans(doc, ref)):
                yield i, k, s.text, s.box, s.size, s.held if want_glyphs else None

    return per_document(files, f"page_index int, span_seq int, text string, bbox {BOX}, font_size double, glyphs array<struct<text:string,bbox:{BOX}>>", rows, password)


def glyphs(spans: DataFrame) -> DataFrame:
    """One row for each glyph of spans, in order."""
    x = spans.where("error is null").select("doc_id", "page_index", "span_seq", F.posexplode("glyphs").alias("glyph_seq", "g"))
    return x.select("doc_id", "page_index", "span_seq", "glyph_seq", F.col("g.text").alias("text"), F.col("g.bbox").alias("bbox"))


def hits(files: DataFrame, query: str, ignore_case: bool = False, pages: set[int] | None = None, password: bytes = b"") -> DataFrame:
    def rows(doc, row):
        for i, ref in _chosen(doc, pages):
            for k, boxes in enumerate(T.search_spans(T.page_spans(doc, ref), query, ignore_case)):
                yield i, k, boxes

    return per_document(files, f"page_index int, hit_seq int, rects array<{BOX}>", rows, password)


def outlines(files: DataFrame, password: bytes = b"") -> DataFrame:
    def rows(doc, row):
        for o in doc.outlines():
            t = o["target"] or {}
            yield o["node_path"], o["depth"], o["title"], t.get("kind"), t.get("dest"), t.get("uri")

    return per_document(files, f"node_path array<int>, depth int, title string, target_kind string, dest {DEST}, uri string", rows, password)


def links(files: DataFrame, pages: set[int] | None = None, password: bytes = b"") -> DataFrame:
    def rows(doc, row):
        numbers = doc.page_numbers()
        for i, ref in _chosen(doc, pages):
            for k, x in enumerate(doc.links(ref, numbers)):
                yield i, k, box(x["rect"]), x["kind"], x["dest"], x["uri"]

    return per_document(files, f"page_index int, link_seq int, rect {BOX}, target_kind string, dest {DEST}, uri string", rows, password)


def label_ranges(files: DataFrame, password: bytes = b"") -> DataFrame:
    def rows(doc, row):
        for k, r in enumerate(doc.label_ranges()):
            yield k, r["start"], r["style"], r["prefix"], r["first"]

    return per_document(files, "seq int, start int, style string, prefix string, first int", rows, password)


def page_labels(files: DataFrame, password: bytes = b"") -> DataFrame:
    """doc_id, page_index, label: each page beside the last range that starts at or before it, formatted as columns.

    A document's ranges are few and come out of the same parse as its pages, so the as-of match stays inside its row.
    """
    from leafmill.functions.text import page_label

    def rows(doc, row):
        yield len(doc.pages()), [(r["start"], k, r["style"], r["prefix"], r["first"]) for k, r in enumerate(doc.label_ranges())]

    x = per_document(files, "n int, ranges array<struct<start:int,seq:int,style:string,prefix:string,first:int>>", rows, password).where("error is null and n > 0")
    x = x.select("doc_id", "ranges", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("page_index"))
    x = x.withColumn("r", F.array_max(F.filter("ranges", lambda r: r.start <= F.col("page_index"))))
    return x.select("doc_id", "page_index", page_label(F.col("page_index"), F.col("r.start"), F.col("r.style"), F.col("r.prefix"), F.col("r.first")).alias("label"))
