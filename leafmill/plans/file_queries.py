"""Queries that go the whole way: texts are made into PDF files, which are then parsed and queried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import hit_count
from leafmill.operators import tables
from leafmill.operators.relational import lines
from leafmill.sources.document import Document
from leafmill.sources.reader import make_files, per_document, rewrite

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_files(docs_of(spark, sf_dir), title_col="source")


def whole_texts(files: DataFrame) -> DataFrame:
    """doc_id, text: the pages of each file in order, without those that hold no text."""
    x = tables.page_texts(files).where("error is null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("p"))
    return x.select("doc_id", F.array_join(F.transform(F.filter("p", lambda q: q.text != ""), lambda q: q.text), "\n").alias("text"))


#: What WinAnsi can't hold is written as `?`; blank lines leave no trace in extracted text.
_SHOWN = r"regexp_replace(text, '[^\x{00}-\x{7F}\x{A0}-\x{FF}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]', '?', 'g')"
_LINES = f"list_filter(string_split({_SHOWN}, chr(10)), lambda x: x <> '')"
_RAW = f"string_split({_SHOWN}, chr(10))"


@query(f"select doc_id, array_to_string({_LINES}, chr(10)) as text from documents")
def pdf_roundtrip_text(spark, sf_dir):
    return whole_texts(files_of(spark, sf_dir))


@query(f"select lang, count(*) as docs, cast(sum((length(t) - length(replace(t, 'the', ''))) / 3) as bigint) as hits from (select lang, lower(array_to_string({_LINES}, chr(10))) as t from documents) group by lang")
def term_hits_by_lang(spark, sf_dir):
    files = make_files(docs_of(spark, sf_dir), keep=("lang",))
    x = tables.page_texts(files, carry=("lang",)).where("error is null")
    return x.groupBy("lang").agg(F.count_if(F.col("page_index") == 0).alias("docs"), F.sum(hit_count(F.col("text"), "the", True)).alias("hits"))


@query("select doc_id, '1.7' as version, cast(greatest(1, ceil(len(string_split(text, chr(10))) / 50.0)) as int) as n_pages, cast(3 + 1 + 2 * greatest(1, ceil(len(string_split(text, chr(10))) / 50.0)) + greatest(1, ceil(len(string_split(text, chr(10))) / 50.0)) - 1 as int) as n_objects, source as title from documents")
def pdf_documents(spark, sf_dir):
    return tables.documents(files_of(spark, sf_dir)).select("doc_id", "version", "n_pages", "n_objects", "title")


@query("select doc_id, cast(i as int) as page_index, 612.0::double as width, 792.0::double as height, 0 as rotate from (select doc_id, unnest(range(cast(greatest(1, ceil(len(string_split(text, chr(10))) / 50.0)) as bigint))) i from documents)")
def pdf_pages(spark, sf_dir):
    return tables.pages(files_of(spark, sf_dir)).select("doc_id", "page_index", "width", "height", "rotate")


@query(f"""with l as (select doc_id, {_RAW} as a from documents), x as (select doc_id, a, unnest(range(len(a))) as i from l)
select doc_id, cast(i // 50 as int) as page_index, a[i + 1] as text, round(740 - (i % 50) * 14.4 - 2.4, 6)::double as y0, round(740 - (i % 50) * 14.4 + 9.6, 6)::double as y1 from x where a[i + 1] <> ''""")
def text_spans(spark, sf_dir):
    x = tables.spans(files_of(spark, sf_dir), want_glyphs=False).where("error is null")
    return x.select("doc_id", "page_index", "text", F.round("bbox.y0", 6).alias("y0"), F.round("bbox.y1", 6).alias("y1"))


@query(f"""with l as (select doc_id, {_RAW} as a from documents), x as (select doc_id, unnest(a) as t from l)
select doc_id, cast(sum(length(t)) as bigint) as glyphs, count(*) as spans from x where t <> '' group by doc_id""")
def glyph_counts(spark, sf_dir):
    x = tables.spans(files_of(spark, sf_dir)).where("error is null")
    return x.groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.size("glyphs")).alias("glyphs"))


@query(f"""with l as (select doc_id, {_RAW} as a from documents),
p as (select doc_id, i, array_to_string(list_filter(a[i * 50 + 1:i * 50 + 50], lambda x: x <> ''), ' ') as t from (select doc_id, a, unnest(range(cast(ceil(len(a) / 50.0) as bigint))) as i from l))
select doc_id, cast(i as int) as page_index, cast((length(lower(t)) - length(replace(lower(t), 'tion', ''))) / 4 as bigint) as hits from p where contains(lower(t), 'tion')""")
def search_hits(spark, sf_dir):
    x = tables.hits(files_of(spark, sf_dir), "tion", ignore_case=True).where("error is null")
    return x.groupBy("doc_id", "page_index").agg(F.count("*").alias("hits"))


@query(f"""with l as (select doc_id, {_RAW} as a from documents), x as (select doc_id, a, unnest(range(len(a))) as i from l where doc_id is not null)
select doc_id, cast(i // 50 as int) as page_index, count(*) as n_lines from x where a[i + 1] <> '' group by 1, 2""")
def line_assembly(spark, sf_dir):
    x = tables.spans(files_of(spark, sf_dir), want_glyphs=False).where("error is null").select("doc_id", "page_index", "span_seq", "bbox.*", F.col("font_size").alias("size"))
    return lines(x, ["doc_id", "page_index"]).groupBy("doc_id", "page_index").agg(F.countDistinct("line_no").alias("n_lines"))


@query("""with l as (select doc_id, string_split(text, chr(10)) as a from documents), p as (select doc_id, unnest(range(cast(greatest(1, ceil(len(a) / 50.0)) as bigint))) as i, a from l)
select operator, count(*) as n from (
  select unnest(list_concat(['BT', 'Tf', 'TL', 'Td', 'Tj', 'ET'], flatten(list_transform(range(len(a[i * 50 + 1:i * 50 + 50]) - 1), lambda k: ['T*', 'Tj'])))) as operator from p) group by operator""")
def content_operations(spark, sf_dir):
    return tables.operations(files_of(spark, sf_dir), want_operands=False).where("error is null").groupBy("operator").agg(F.count("*").alias("n"))


@query("select kind, count(*) as n from (select unnest(list_concat(['dictionary', 'dictionary', 'dictionary', 'dictionary'], flatten(list_transform(range(cast(greatest(1, ceil(len(string_split(text, chr(10))) / 50.0)) as bigint)), lambda i: if(i = 0, ['dictionary', 'stream'], ['dictionary', 'dictionary', 'stream']))))) as kind from documents) group by kind")
def object_kinds(spark, sf_dir):
    return tables.objects(files_of(spark, sf_dir), want_values=False).where("error is null").groupBy("kind").agg(F.count("*").alias("n"))


@query("select lang, count(*) as docs, cast(sum(greatest(1, ceil(len(string_split(text, chr(10))) / 50.0))) as bigint) as pages from documents group by lang")
def corpus_stats(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    d = tables.documents(make_files(docs)).where("error is null").select("doc_id", "n_pages")
    return docs.select("doc_id", "lang").join(d, "doc_id").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_pages").alias("pages"))


@query("select doc_id, 90 as rotate, 792.0::double as width, 612.0::double as height, upper(source) as title from documents")
def edited_files(spark, sf_dir):
    """Turn the first page, retitle, save, read again."""

    def edit(doc: Document):
        doc.rotate_page(0, 90)
        doc.set_info("Title", (doc.info("Title") or "").upper())

    def rows(doc, row):
        first = doc.pages()[0]
        yield (doc.rotation(first), *doc.size(first), doc.info("Title"))

    made = rewrite(files_of(spark, sf_dir), edit).drop("error")
    return per_document(made, "rotate int, width double, height double, title string", rows).where("error is null").drop("error")


@query("select doc_id, cast(greatest(1, ceil(len(string_split(text, chr(10))) / 50.0)) as int) as n_pages from documents")
def added_and_removed_pages(spark, sf_dir):
    def edit(doc: Document):
        page = doc.add_page(200, 100)
        doc.draw_line(page, 0, 0, 200, 100)
        doc.draw_rect(page, 10, 10, 50, 50, fill=(1, 0, 0))
        doc.remove_page(0)

    return tables.documents(rewrite(files_of(spark, sf_dir), edit).drop("error")).select("doc_id", "n_pages")


@query("select doc_id, true as same from documents")
def double_save_is_stable(spark, sf_dir):
    def rows(doc, row):
        yield (doc.write() == bytes(row["content"]),)

    return per_document(files_of(spark, sf_dir), "same boolean", rows).select("doc_id", "same")


@query(ORACLE["pdf_roundtrip_text"])
def broken_startxref_pages(spark, sf_dir):
    """Files whose startxref leads nowhere are rebuilt from their object headers: the text of all their pages."""
    f = files_of(spark, sf_dir)
    broken = f.select("doc_id", F.expr("unhex(regexp_replace(hex(content), '(7374617274787265660A)([0-9]+)(0A2525454F460A)$', '$139393939393939$3'))").alias("content"))
    return whole_texts(broken)


def _with_navigation(doc: Document):
    from leafmill.sources.syntax import Name, Str

    pages = doc.pages()
    root = doc.catalog
    item = doc.add({Name("Title"): Str(b"Chapter 1"), Name("Dest"): [pages[0], Name("XYZ"), None, 792]})
    last = doc.add({Name("Title"): Str(b"End"), Name("A"): {Name("S"): Name("GoTo"), Name("D"): Str(b"end")}})
    doc.objects[item][Name("Next")] = last
    root[Name("Outlines")] = doc.add({Name("First"): item, Name("Last"): last})
    root[Name("Names")] = {Name("Dests"): {Name("Names"): [Str(b"end"), [pages[-1], Name("FitH"), 100]]}}
    root[Name("PageLabels")] = {Name("Nums"): [0, {Name("S"): Name("r")}, 2, {Name("S"): Name("D"), Name("P"): Str(b"A-"), Name("St"): 5}]}
    link = doc.add({Name("Type"): Name("Annot"), Name("Subtype"): Name("Link"), Name("Rect"): [200, 720, 72, 700], Name("A"): {Name("S"): Name("URI"), Name("URI"): Str(b"https://example.com/")}})
    for page in pages:
        doc.objects[page][Name("Annots")] = [link]


def navigated(spark, sf_dir):
    return rewrite(make_files(docs_of(spark, sf_dir), lines=10), _with_navigation).drop("error")


_PAGES10 = "cast(greatest(1, ceil(len(string_split(text, chr(10))) / 10.0)) as int)"


@query(f"select doc_id, 'Chapter 1' as title, 0 as page_index, 792.0::double as y from documents union all select doc_id, 'End', {_PAGES10} - 1, 100.0 from documents")
def outline_items(spark, sf_dir):
    return tables.outlines(navigated(spark, sf_dir)).select("doc_id", "title", "dest.page_index", "dest.y")


@query(f"select doc_id, cast(i as int) as page_index, 72.0::double as x0, 700.0::double as y0, 200.0::double as x1, 720.0::double as y1, 'https://example.com/' as uri from (select doc_id, unnest(range({_PAGES10})) as i from documents)")
def page_links(spark, sf_dir):
    return tables.links(navigated(spark, sf_dir)).select("doc_id", "page_index", "rect.*", "uri")


@query(f"select doc_id, cast(i as int) as page_index, case when i < 2 then ['i', 'ii'][i + 1] else 'A-' || (5 + i - 2) end as label from (select doc_id, unnest(range({_PAGES10})) as i from documents)")
def page_labels(spark, sf_dir):
    return tables.page_labels(navigated(spark, sf_dir))
