"""Relational kernels of a PDF file's structure: which object counts, the page tree, inheritance, labels, lines.

All are DataFrame or SQL operations keyed by document, so they run over any number of files at once.
Ordered picks use min_by / max_by, which combine on the map side, rather than windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_wins(xref: DataFrame, keys: list[str], order: str, kind: str = "type", free: str = "free") -> DataFrame:
    """The newest entry of each object number (least `order`); a free entry hides older ones and is left out."""
    rest = [c for c in xref.columns if c not in keys]
    picked = xref.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("e"))
    return picked.select(*keys, "e.*").where(F.col(kind) != free)


def merge_trailer(entries: DataFrame, doc: str = "doc_id", key: str = "key", value: str = "value", order: str = "section_seq") -> DataFrame:
    """Trailer keys over all sections; of each key the newest section's value."""
    return entries.groupBy(doc, key).agg(F.min_by(value, order).alias(value))


def last_occurrence(found: DataFrame, keys: list[str], offset: str = "offset") -> DataFrame:
    """For a rebuilt table: of each object number the occurrence farthest into the file."""
    rest = [c for c in found.columns if c not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(offset)).alias("e")).select(*keys, "e.*")


def dereference(refs: DataFrame, objects: DataFrame, doc: str = "doc_id", num: str = "num", gen: str = "gen", value: str = "value") -> DataFrame:
    """refs with the referenced object's value: exact generation, else the lowest of the number, else null."""
    exact = objects.select(doc, num, gen, F.col(value).alias("__exact"), F.lit(True).alias("__hit"))
    low = objects.groupBy(doc, num).agg(F.min_by(value, gen).alias("__low"))
    x = refs.join(exact, [doc, num, gen], "left").join(low, [doc, num], "left")
    return x.withColumn(value, F.when(F.col("__hit"), F.col("__exact")).otherwise(F.col("__low"))).drop("__exact", "__low", "__hit")


def _any_number_of_rows(spark: SparkSession) -> SparkSession:
    """A recursive query stops with an error beyond a million rows unless told otherwise; depth bounds these."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark


def tree_walk(edges: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """doc_id, node, level, path of every node below the roots in document order, each node at its first path.

    edges: doc_id, parent, node, seq; roots: doc_id, node. Paths hold the place of each step, so ordering by path is
    pre-order. A node met again further on (a cycle or a shared kid) counts where it stands first. Only nodes with kids
    go through the recursion; leaves are joined to it once.
    """
    spark = _any_number_of_rows(edges.sparkSession)
    parents = edges.select("doc_id", F.col("parent").alias("node")).distinct()
    inner = edges.join(parents, ["doc_id", "node"], "left_semi")
    leaves = edges.join(parents, ["doc_id", "node"], "left_anti").select("doc_id", "parent", "node", "seq", F.lit(True).alias("leaf"))
    # a node that was walked to stands for itself and for its leaves
    own = inner.select("doc_id", "node").unionByName(roots.select("doc_id", "node")).distinct().select("doc_id", F.col("node").alias("parent"), "node", F.lit(0).alias("seq"), F.lit(False).alias("leaf"))
    sql = """
    WITH RECURSIVE walk(doc_id, node, level, path, seen) MAX RECURSION LEVEL 100 AS (
        SELECT doc_id, node, 0, CAST(array() AS ARRAY<INT>), array(node) FROM {roots}
        UNION ALL
        SELECT e.doc_id, e.node, w.level + 1, array_append(w.path, CAST(e.seq AS INT)), array_append(w.seen, e.node)
        FROM walk w JOIN {inner} e ON e.doc_id = w.doc_id AND e.parent = w.node
        WHERE w.level < %d AND NOT array_contains(w.seen, e.node)),
    every AS (
        SELECT e.doc_id, e.node, if(leaf, array_append(w.path, CAST(e.seq AS INT)), w.path) AS path, w.level + CAST(leaf AS INT) AS level
        FROM walk w JOIN {ends} e ON e.doc_id = w.doc_id AND e.parent = w.node
        WHERE NOT leaf OR w.level < %d AND NOT array_contains(w.seen, e.node))
    SELECT doc_id, node, min(struct(path, level)) AS first FROM every GROUP BY doc_id, node""" % (depth, depth)
    x = spark.sql(sql, inner=inner, ends=leaves.unionByName(own), roots=roots)
    return x.select("doc_id", "node", F.col("first.level").alias("level"), F.col("first.path").alias("path"))


def inherited(nodes: DataFrame, attribute: str, depth: int = 64) -> DataFrame:
    """doc_id, node, value: the attribute of the nearest of a node and its ancestors that has one.

    nodes: doc_id, node, parent (null at a root), and the attribute (null where it isn't set). Only nodes that are parents
    go through the recursion; every node then looks at itself and its parent.
    """
    spark = _any_number_of_rows(nodes.sparkSession)
    parents = nodes.where("parent is not null").select("doc_id", F.col("parent").alias("node")).distinct()
    names = {"a": attribute, "depth": depth}
    inner = nodes.join(parents, ["doc_id", "node"], "left_semi")
    sql = """
    WITH RECURSIVE up(doc_id, node, at, level) MAX RECURSION LEVEL 100 AS (
        SELECT doc_id, node, node, 0 FROM {nodes}
        UNION ALL
        SELECT u.doc_id, u.node, n.parent, u.level + 1
        FROM up u JOIN {nodes} n ON n.doc_id = u.doc_id AND n.node = u.at
        WHERE n.parent IS NOT NULL AND n.%(a)s IS NULL AND u.level < %(depth)d)
    SELECT u.doc_id, u.node, min(u.level) AS level, min_by(n.%(a)s, u.level) AS value
    FROM up u JOIN {nodes} n ON n.doc_id = u.doc_id AND n.node = u.at WHERE n.%(a)s IS NOT NULL GROUP BY u.doc_id, u.node""" % names
    above = spark.sql(sql, nodes=inner)
    sql = """
    SELECT n.doc_id, n.node, coalesce(min_by(n.%(a)s, 0) FILTER (WHERE n.%(a)s IS NOT NULL), min_by(r.value, r.level) FILTER (WHERE r.level < %(depth)d)) AS value
    FROM {nodes} n LEFT JOIN {above} r ON r.doc_id = n.doc_id AND r.node = n.parent AND n.%(a)s IS NULL GROUP BY n.doc_id, n.node""" % names
    return spark.sql(sql, nodes=nodes, above=above)


def subsections(ids: DataFrame, doc: str = "doc_id", num: str = "num") -> DataFrame:
    """doc, first, n: runs of consecutive object numbers, as a cross-reference table lists them."""
    w = Window.partitionBy(doc).orderBy(num)
    x = ids.select(doc, num).distinct().withColumn("island", F.col(num) - F.row_number().over(w))
    return x.groupBy(doc, "island").agg(F.min(num).alias("first"), F.count("*").alias("n")).drop("island")


def as_of(rows: DataFrame, ranges: DataFrame, key: list[str], at: str, start: str, seq: str, take: list[str]) -> DataFrame:
    """rows with the columns `take` of the last range that starts at or before `at` (later entry on equal starts).

    One sort of rows and ranges together and a running last value, instead of a join on an inequality.
    """
    marks = ranges.select(*key, F.col(start).alias("__at"), F.lit(0).alias("__row"), F.col(seq).cast("long").alias("__seq"), F.struct(*take).alias("__take"))
    own = rows.select(*key, F.col(at).alias("__at"), F.lit(1).alias("__row"), F.lit(0).cast("long").alias("__seq"), F.struct(*rows.columns).alias("__own"))
    both = own.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("__at", "__row", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    x = both.withColumn("__last", F.last("__take", ignorenulls=True).over(w)).where("__row = 1")
    return x.select("__own.*", *[F.col(f"__last.{c}").alias(c) for c in take])


def first_of(candidates: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per key the value of the first candidate in `order` (precedence of destination tables)."""
    return candidates.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def lines(spans: DataFrame, keys: list[str], seq: str = "span_seq") -> DataFrame:
    """spans with line_no and gap: where a new line begins, and whether a space separates neighbours.

    Spans carry x0, y0, x1, y1 and size. Two neighbours share a line when the middles of their boxes
    differ by at most half the larger size; a gap of over 0.3 of the size counts as a space.
    """
    w = Window.partitionBy(*keys).orderBy(seq)
    mid = (F.col("y0") + F.col("y1")) / 2
    size = F.greatest("size", F.lag("size").over(w))
    new = F.when(F.lag(mid).over(w).isNull(), 0).when(F.abs(mid - F.lag(mid).over(w)) <= 0.5 * size, 0).otherwise(1)
    gap = F.coalesce((new == 0) & (F.col("x0") - F.lag("x1").over(w) > 0.3 * size), F.lit(False))
    return spans.withColumn("__new", new).withColumn("gap", gap).withColumn("line_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def line_boxes(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One box for each line that a hit touches."""
    return hits.groupBy(*keys, "line_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


