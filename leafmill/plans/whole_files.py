"""Queries over whole files that the writer doesn't make: encrypted ones, object and xref streams, updates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import tables
from leafmill.plans.file_queries import _LINES
from leafmill.shipping import ship
from leafmill.sources import files, security
from leafmill.sources.document import Document
from leafmill.sources.reader import BATCH_FILES, make_file
from leafmill.sources.syntax import Name, Ref, Str, Stream

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_ID = b"0123456789abcdef"
#: Name: revision, version, key bits, AES. Revision 6 has no query.
LOCKS = {"rc4_40": (2, 1, 40, False), "rc4_128": (3, 2, 128, False), "crypt_filter_rc4": (4, 4, 128, False), "aes_128": (4, 4, 128, True)}


def lock(raw: bytes, revision: int, version: int, bits: int, aes: bool, owner: bytes = b"owner") -> bytes:
    """A file's strings and streams encrypted, with an empty user password and this owner password."""
    doc, size = Document.read(raw), bits // 8
    d = {Name("Filter"): Name("Standard"), Name("V"): version, Name("R"): revision, Name("Length"): bits, Name("P"): -4}
    if version >= 4:
        d |= {Name("CF"): {Name("StdCF"): {Name("CFM"): Name("AESV2" if aes else "V2")}}, Name("StmF"): Name("StdCF"), Name("StrF"): Name("StdCF")}
    rounds = revision >= 3
    h = hashlib.md5((owner + security.PAD)[:32]).digest()
    for _ in range(50 if rounds else 0):
        h = hashlib.md5(h).digest()
    o = security.PAD
    for i in range(20 if rounds else 1):
        o = security.rc4(bytes(c ^ i for c in h[:size]), o)
    d[Name("O")] = Str(o)
    handler = security.Handler.__new__(security.Handler)
    handler.d, handler.id, handler.r, handler.size, handler.meta = d, _ID, revision, size, True
    key = handler._key_r4(b"")
    u = security.rc4(key, hashlib.md5(security.PAD + _ID).digest() if rounds else security.PAD)
    for i in range(1, 20 if rounds else 1):
        u = security.rc4(bytes(c ^ i for c in key), u)
    d[Name("U")] = Str(u + bytes(16) if rounds else u)
    handler.key = key

    def seal(x, ref):
        if isinstance(x, Stream):
            return Stream({k: seal(v, ref) for k, v in x.dict.items()}, hide(x.data, ref))
        if isinstance(x, Str):
            return Str(hide(bytes(x), ref))
        if isinstance(x, dict):
            return {k: seal(v, ref) for k, v in x.items()}
        return [seal(v, ref) for v in x] if isinstance(x, list) else x

    def hide(data, ref):
        own = handler.object_key(ref, aes)
        return security.aes_seal(own, data, hashlib.md5(data).digest()) if aes else security.rc4(own, data)

    at = Ref(max(r.num for r in doc.objects) + 1, 0)
    out = files.write_file({**{r: seal(x, r) for r, x in doc.objects.items()}, at: d}, doc.trailer)
    return out.replace(b"trailer\n<<", b"trailer\n<</Encrypt %d 0 R " % at.num).replace(b"/ID [", b"/ID [<" + _ID.hex().encode() + b"> ")


def _table(rows: list[tuple[int, int, int]]) -> bytes:
    return b"".join(bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in rows)


def modern(raw: bytes, hybrid: bool = False) -> bytes:
    """The file with its other objects in an object stream and its table as a stream; hybrid: a classic table that points to it."""
    doc = Document.read(raw)
    inner = {r.num: x for r, x in doc.objects.items() if not isinstance(x, Stream)}
    body, heads = b"", []
    for num, x in inner.items():
        heads.append(b"%d %d" % (num, len(body)))
        body += files.write_object(x) + b" "
    head = b" ".join(heads) + b" "
    top = max(r.num for r in doc.objects) + 1
    streams = {r.num: x for r, x in doc.objects.items() if isinstance(x, Stream)} | {top: Stream({Name("Type"): Name("ObjStm"), Name("N"): len(inner), Name("First"): len(head)}, head + body)}
    out, place = b"%PDF-1.5\n", {}
    for num, x in streams.items():
        place[num] = len(out)
        out += b"%d 0 obj\n" % num + files.write_object(x) + b"\nendobj\n"
    rows = [(0, 0, 0)]
    for num in range(1, top + 1):
        rows.append((1, place[num], 0) if num in place else (2, top, list(inner).index(num)) if num in inner else (0, 0, 0))
    table, start = _table(rows), len(out)
    root = b"/Root %d 0 R" % doc.trailer["Root"].num + (b"/Info %d 0 R" % doc.trailer["Info"].num if "Info" in doc.trailer else b"")
    out += b"%d 0 obj\n<</Type/XRef/Size %d/W[1 4 2]%s/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (top + 1, top + 1, root, len(table), table)
    if hybrid:
        classic = len(out)
        out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, at) for n, at in sorted(place.items()))
        out += b"trailer\n<</Size %d%s/XRefStm %d>>\n" % (top + 1, root, start)
        start = classic
    return out + b"startxref\n%d\n%%%%EOF" % start


def update(raw: bytes, title: str) -> bytes:
    """The file with a later section behind it, whose information dictionary has another title."""
    doc = Document.read(raw)
    num = doc.trailer["Info"].num
    prev = int(raw[raw.rindex(b"startxref") + 9 :].split()[0])
    at = len(raw) + 1
    out = raw + b"\n%d 0 obj\n<</Title %s>>\nendobj\n" % (num, files.write_string(title.encode("latin-1", "replace")))
    return out + b"xref\n%d 1\n%010d 00000 n \ntrailer\n<</Size %d/Root %d 0 R/Info %d 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (num, at, num + 1, doc.trailer["Root"].num, num, prev, len(out))


def built(spark: SparkSession, sf_dir: str, make: Callable[[bytes], bytes]) -> DataFrame:
    """doc_id, content: a file of each document's text, made over."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_FILES))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    wide = spark.sparkContext.defaultParallelism
    docs = docs.repartition(wide) if docs.rdd.getNumPartitions() < wide else docs

    def run(batches):
        for b in batches:
            made = [make(make_file(t or "", title)) for t, title in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["doc_id", "content"])

    return docs.mapInArrow(run, "doc_id long, content binary")


def texts(made: DataFrame, password: bytes = b"") -> DataFrame:
    """doc_id, text: the text of all pages; a page without text leaves no trace."""
    x = tables.page_texts(made, password=password).where("error is null")
    pages = F.array_sort(F.collect_list(F.struct("page_index", "text")))
    return x.groupBy("doc_id").agg(F.array_join(F.filter(F.transform(pages, lambda p: p.text), lambda t: t != ""), "\n").alias("text"))


_TEXT = f"select doc_id, array_to_string({_LINES}, chr(10)) as text from documents"


def _add(name: str, make: Callable[[bytes], bytes], password: bytes = b"") -> None:
    QUERIES[name] = lambda spark, sf_dir: texts(built(spark, sf_dir, make), password)
    ORACLE[name] = _TEXT


for _name, _kind in LOCKS.items():
    _add(f"encrypted_{_name}", lambda raw, kind=_kind: lock(raw, *kind))
_add("encrypted_owner_password", lambda raw: lock(raw, *LOCKS["rc4_128"]), b"owner")
_add("object_streams", modern)
_add("hybrid_xref", lambda raw: modern(raw, hybrid=True))


def modern_file_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version, pages and title of files of object streams; the streams that held objects are gone."""
    made = tables.documents(built(spark, sf_dir, modern)).where("error is null")
    return made.select("doc_id", "version", "n_pages", "title", F.col("n_objects").cast("long").alias("n_objects"))


_PAGES = "greatest(1, ceil(len(string_split(text, chr(10))) / 50.0))"
QUERIES["modern_file_objects"] = modern_file_objects
ORACLE["modern_file_objects"] = f"select doc_id, '1.5' as version, cast({_PAGES} as int) as n_pages, source as title, cast(3 + 3 * {_PAGES} as bigint) as n_objects from documents"


def incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest section counts, the older one still gives the pages."""
    return tables.documents(built(spark, sf_dir, lambda raw: update(raw, "a later title"))).select("doc_id", "n_pages", "title")


QUERIES["incremental_update"] = incremental_update
ORACLE["incremental_update"] = f"select doc_id, cast({_PAGES} as int) as n_pages, 'a later title' as title from documents"
