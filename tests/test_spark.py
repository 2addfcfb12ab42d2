"""The DataFrame layer on a small session."""

import math
import os

import pytest
from pyspark.sql import functions as F

from leafmill.functions import pdf_functions as P
from leafmill.functions import text as T
from leafmill.operators import relational as R
from leafmill.operators import tables
from leafmill.operators.colorspaces import run_calculator
from leafmill.operators.tiles import render_tiles
from leafmill.plans import registry
from leafmill.sources.reader import make_file, make_files, read_files
from leafmill.streaming import stream_files

SF = "/root/testdata/sf0.001"


def test_files_to_rows(spark, tmp_path):
    for name, raw in (("a.pdf", make_file("one needle\ntwo")), ("b.pdf", b"not a pdf"), ("c.pdf", make_file("hay\n" * 60 + "needle", lines=50)), ("d.txt", b"")):
        (tmp_path / name).write_bytes(raw)
    files = read_files(spark, f"file://{tmp_path}")
    docs = {os.path.basename(r.doc_id): r for r in tables.documents(files).collect()}
    assert docs["a.pdf"].n_pages == 1 and docs["c.pdf"].n_pages == 2 and docs["b.pdf"].error.kind == "NotAPdf" and set(docs) == {"a.pdf", "b.pdf", "c.pdf"}
    hits = [(os.path.basename(r.doc_id), r.page_index, len(r.rects)) for r in tables.hits(files, "needle").where("error is null").collect()]
    assert sorted(hits) == [("a.pdf", 0, 1), ("c.pdf", 1, 1)]
    assert tables.hits(files, "needle", pages={0}).where("error is null").count() == 1
    png = render_tiles(files, 0.2, tile=64).where("error is null and page_index = 0")
    assert png.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("h")).alias("n")).where(f"n = {math.ceil(612 * 0.2) * math.ceil(792 * 0.2)}").count() == 2


def test_stream_reads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(make_file("streamed words"))
    x = tables.page_texts(stream_files(spark, f"file://{tmp_path}/in"))
    q = x.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.text for r in spark.table("streamed").collect()] == ["streamed words"]


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in tables.page_texts(make_files(docs)).collect()) == [(0, "x"), (1, ""), (2, "")]
    assert tables.page_texts(make_files(docs.limit(0))).count() == 0


@pytest.mark.parametrize("program", ["{ add 2 mul }", "{ 2 copy gt { sub } { exch sub } ifelse }", "{ atan }", "{ exch dup 3 1 roll mul idiv }", "{ pop -2.5 round }", "{ mod 3 index pop }", "{ cvi exch cvi xor 2 bitshift }"])
def test_compiled_programs_agree_with_the_machine(spark, program):
    pairs = [(3.0, 4.0), (-7.5, 2.0), (0.0, 0.0), (5.0, -3.0)]
    df = spark.createDataFrame(pairs, "a double, b double")
    got = df.select(*[c.alias(f"y{i}") for i, c in enumerate(P.calculator(program)([F.col("a"), F.col("b")]))]).collect()
    for row, pair in zip(got, pairs):
        assert list(row) == pytest.approx(run_calculator(program, list(pair)))


def test_dynamic_programs_are_refused(spark):
    with pytest.raises(P.DynamicStack):
        P.calculator("{ copy }")([F.col("a"), F.col("b")])


@pytest.mark.parametrize("a,b,q,r", [(5.5, 1.9, 5.0, 0.0), (5.0, 0.5, 0.0, 0.0), (-7.9, 2.1, -3.0, -1.0), (7.0, -2.0, -3.0, 1.0), (1e300, 3.0, 3074457345618258602.0, 1.0)])
def test_whole_division(spark, a, b, q, r):
    row = spark.createDataFrame([(a, b)], "a double, b double").select(*[P.calculator("{ %s }" % op)([F.col("a"), F.col("b")])[0].alias(op) for op in ("idiv", "mod")]).first()
    assert tuple(row) == (q, r)
    assert (run_calculator("{ idiv }", [a, b])[0], run_calculator("{ mod }", [a, b])[0]) == pytest.approx((q, r), abs=1.0 if a > 1e18 else 0)


def test_dynamic_programs_run_in_a_kernel(spark):
    df = spark.createDataFrame([(1.5, 0.0), (1.5, 1.0), (1.5, 2.0)], "a double, b double")
    make = P.program("{ 7 exch 9 exch index 4 1 roll pop pop pop }", 2)
    assert [tuple(r) for r in df.select(*[c.alias(f"y{i}") for i, c in enumerate(make([F.col("a"), F.col("b")]))]).collect()] == [(9.0, 0.0), (7.0, 0.0), (1.5, 0.0)]


def test_labels(spark):
    row = spark.range(1).select(T.roman(F.lit(1994)).alias("a"), T.letters(F.lit(27)).alias("b"), T.letters(F.lit(53)).alias("c"), T.roman(F.lit(0)).alias("d"), T.header_version(F.encode(F.lit("x%PDF-1.5\n"), "UTF-8")).alias("e")).first()
    assert tuple(row) == ("MCMXCIV", "AA", "AAA", "", "1.5")


def test_hot_path_has_no_python(spark):
    for name in ("blend_hue", "func_type4_branch", "text_width_helvetica", "page_label_format", "object_latest_wins"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_flagship(spark):
    rows = registry.flagship(spark, SF).collect()
    assert sum(r.docs for r in rows) == 200 and all(r.hits >= 0 for r in rows)


def test_checksums_of_whole_texts(spark):
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.adler32 for r in registry.QUERIES["adler32_whole_text"](spark, SF).collect()}
    assert got == {i: zlib.adler32(t.encode()) for i, t in texts.items()} and max(map(len, texts.values())) > 400


def test_long_files_are_rebuilt_with_all_pages(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view documents as from '{SF}/documents.parquet'")
    want = con.sql(registry.ORACLE["broken_startxref_pages"]).fetchall()
    got = {r.doc_id: r.text for r in registry.QUERIES["broken_startxref_pages"](spark, SF).collect()}
    assert got == dict(want) and len(got) == con.sql("select count(*) from documents").fetchall()[0][0]
    assert any(t.count("\n") > 50 for t in got.values())


def test_recursion_over_more_rows_than_the_limit(spark):
    """A root, ten kids and 1,200 leaves where Spark would stop at 1,000 rows: each leaf has its own value, or that of its parent or of the root."""
    n = 1_200
    spark.conf.set("spark.sql.cteRecursionRowLimit", "1000")  # Spark's own is a million
    leaf = spark.range(n).select(F.lit(0).alias("doc_id"), F.concat(F.lit("l"), "id").alias("node"), F.concat(F.lit("k"), F.col("id") % 10).alias("parent"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("box"), F.col("id").cast("int").alias("seq"))
    kid = spark.range(10).select(F.lit(0).alias("doc_id"), F.concat(F.lit("k"), "id").alias("node"), F.lit("root").alias("parent"), F.when(F.col("id") % 2 == 0, -F.col("id") - 2).alias("box"), F.col("id").cast("int").alias("seq"))
    edges = leaf.unionByName(kid)
    nodes = edges.drop("seq").unionByName(spark.createDataFrame([(0, "root", None, -1)], "doc_id int, node string, parent string, box long"))
    got = R.inherited(nodes, "box").where("node like 'l%'").withColumn("id", F.substring("node", 2, 20).cast("long"))
    want = F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 2 == 0, -F.col("id") % 10 - 2).otherwise(-1)
    assert got.agg(F.count("*"), F.count_if(F.col("value") == want)).first() == (n, n)
    walked = R.tree_walk(edges, spark.createDataFrame([(0, "root")], "doc_id int, node string"))
    assert walked.groupBy("level").agg(F.count("*")).orderBy("level").collect() == [(0, 1), (1, 10), (2, n)]


def test_recursion_over_odd_trees(spark):
    """A chain longer than the depth, a cycle, a kid of two parents, a parent that isn't there."""
    chain = [(1, f"n{i}", f"n{i - 1}" if i else None, 7 if i == 0 else None) for i in range(9)]
    odd = [(2, "a", "b", None), (2, "b", "a", None), (2, "c", "gone", None), (2, "d", "gone", 5), (2, "e", "d", None)]
    nodes = spark.createDataFrame(chain + odd, "doc_id int, node string, parent string, box long")
    got = {(r.doc_id, r.node): r.value for r in R.inherited(nodes, "box", depth=5).collect()}
    assert got == {**{(1, f"n{i}"): 7 if i <= 5 else None for i in range(9)}, (2, "a"): None, (2, "b"): None, (2, "c"): None, (2, "d"): 5, (2, "e"): 5}
    edges = spark.createDataFrame([(1, "r", "a", 0), (1, "r", "b", 1), (1, "b", "a", 0), (1, "a", "x", 0), (1, "x", "b", 0), (1, "b", "y", 1), (1, "y", "z", 0)], "doc_id int, parent string, node string, seq int")
    roots = spark.createDataFrame([(1, "r"), (2, "alone")], "doc_id int, node string")
    got = {(r.doc_id, r.node): (r.level, r.path) for r in R.tree_walk(edges, roots, depth=4).collect()}
    assert got == {(1, "r"): (0, []), (1, "a"): (1, [0]), (1, "x"): (2, [0, 0]), (1, "b"): (3, [0, 0, 0]), (1, "y"): (4, [0, 0, 0, 1]), (1, "z"): (3, [1, 1, 0]), (2, "alone"): (0, [])}
