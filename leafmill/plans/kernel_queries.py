"""Queries of the relational kernels over the supplied tables, whose rows stand for objects, sections and nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import relational as R

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark, sf_dir):
    """Events as cross-reference entries: user = object number, time = section order, one type = freed."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "free").otherwise(F.col("event_type"))
    return e.select(F.lit(0).alias("doc_id"), F.col("user_id").alias("num"), F.struct("ts", "event_id").alias("order"), kind.alias("type"), "event_id", "value")


_ENTRIES = "(select user_id as num, ts, event_id, value, case when event_type = 'purchase' then 'free' else event_type end as type, row_number() over (partition by user_id order by ts, event_id) as up, row_number() over (partition by user_id order by ts desc, event_id desc) as down from events)"


@query(f"select num, type, event_id from {_ENTRIES} where up = 1 and type <> 'free'")
def object_latest_wins(spark, sf_dir):
    return R.latest_wins(entries(spark, sf_dir), ["doc_id", "num"], "order").select("num", "type", "event_id")


@query(f"select num, event_id, type from {_ENTRIES} where down = 1")
def rebuilt_last_wins(spark, sf_dir):
    return R.last_occurrence(entries(spark, sf_dir), ["doc_id", "num"], "order").select("num", "event_id", "type")


@query("select event_type as key, arg_min(value, (ts, event_id)) as value from events group by event_type")
def trailer_merge(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.lit(0).alias("doc_id"), F.col("event_type").alias("key"), "value", F.struct("ts", "event_id").alias("section_seq"))
    return R.merge_trailer(e).select("key", "value")


@query("""with o as (select l_orderkey as num, l_linenumber as gen, min(l_quantity) as value from lineitem group by 1, 2), low as (select num, arg_min(value, gen) as v from o group by num)
select o_orderkey as num, cast(o_orderkey % 7 as int) as gen, coalesce(o.value, low.v) as value from orders left join o on o.num = o_orderkey and o.gen = o_orderkey % 7 left join low on low.num = o_orderkey""")
def dereference(spark, sf_dir):
    objects = read(spark, sf_dir, "lineitem").select(F.lit(0).alias("doc_id"), F.col("l_orderkey").alias("num"), F.col("l_linenumber").alias("gen"), "l_quantity").groupBy("doc_id", "num", "gen").agg(F.min("l_quantity").alias("value"))
    refs = read(spark, sf_dir, "orders").select(F.lit(0).alias("doc_id"), F.col("o_orderkey").alias("num"), (F.col("o_orderkey") % 7).cast("int").alias("gen"))
    return R.dereference(refs, objects).select("num", "gen", "value")


def tree(spark, sf_dir):
    """A tree of regions, nations and customers: edges with the place of each kid."""
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    zero = F.lit(0).alias("doc_id")
    region = read(spark, sf_dir, "region").select(zero, F.lit("root").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("node"), F.col("r_regionkey").cast("int").alias("seq"))
    nation = n.select(zero, F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_nationkey").cast("int").alias("seq"))
    customer = c.select(zero, F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_custkey").cast("int").alias("seq"))
    return region.unionByName(nation).unionByName(customer)


_TREE = "(select 'root' as parent, 'r' || r_regionkey as node, cast(r_regionkey as int) as seq from region union all select 'r' || n_regionkey, 'n' || n_nationkey, cast(n_nationkey as int) from nation union all select 'n' || c_nationkey, 'c' || c_custkey, cast(c_custkey as int) from customer)"


@query(f"""with recursive w as (select 'root' as node, 0 as level, cast([] as int[]) as path union all select t.node, w.level + 1, list_append(w.path, t.seq) from w join {_TREE} t on t.parent = w.node)
select node, level, array_to_string(path, '/') as path from w""")
def tree_walk(spark, sf_dir):
    roots = spark.createDataFrame([(0, "root")], "doc_id int, node string")
    x = R.tree_walk(tree(spark, sf_dir), roots)
    return x.select("node", "level", F.array_join(F.transform("path", lambda v: v.cast("string")), "/").alias("path"))


@query("""select 'c' || c_custkey as node, cast(case when c_custkey % 3 = 0 then c_custkey when n_nationkey % 2 = 0 then n_nationkey else n_regionkey end as bigint) as value
from customer join nation on c_nationkey = n_nationkey""")
def inherited_attribute(spark, sf_dir):
    t = tree(spark, sf_dir).withColumn("key", F.substring("node", 2, 20).cast("long"))
    own = F.when(F.col("node").startswith("c") & (F.col("key") % 3 == 0), F.col("key")).when(F.col("node").startswith("n") & (F.col("key") % 2 == 0), F.col("key")).when(F.col("node").startswith("r"), F.col("key"))
    nodes = t.select("doc_id", "node", F.when(F.col("parent") != "root", F.col("parent")).alias("parent"), own.alias("box"))
    return R.inherited(nodes, "box").where(F.col("node").startswith("c")).select("node", "value")


@query("""with i as (select o_orderkey as num, o_orderkey - row_number() over (order by o_orderkey) as g from orders where o_orderkey % 8 < 5)
select min(num) as first, count(*) as n from i group by g""")
def xref_subsections(spark, sf_dir):
    ids = read(spark, sf_dir, "orders").where("o_orderkey % 8 < 5").select((F.lit(0)).alias("doc_id"), F.col("o_orderkey").alias("num"))
    return R.subsections(ids).select("first", "n")


@query("""with c as (select n_name as name, 0 as prio, n_nationkey as seq, 'old ' || n_nationkey as target from nation where n_nationkey % 2 = 0 union all select n_name, 1, n_nationkey, 'tree ' || n_nationkey from nation union all select n_name, 1, n_nationkey + 100, 'late' from nation)
select name, arg_min(target, prio * 1000 + seq) as target from c group by name""")
def named_destination_precedence(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    cell = lambda d, prio, seq, target: d.select(F.col("n_name").alias("name"), F.lit(prio).alias("prio"), seq.alias("seq"), target.alias("target"))
    key = F.col("n_nationkey")
    every = cell(n.where("n_nationkey % 2 = 0"), 0, key, F.concat(F.lit("old "), key)).unionByName(cell(n, 1, key, F.concat(F.lit("tree "), key))).unionByName(cell(n, 1, key + 100, F.lit("late")))
    return R.first_of(every, ["name"], ["prio", "seq"], "target")


@query("select l_orderkey, l_linenumber, cast(o_custkey as bigint) as page_index from lineitem join orders on l_orderkey = o_orderkey")
def page_number_map(spark, sf_dir):
    pages = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("page_index"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(pages, "l_orderkey")


@query("""with r as (select cast(n_nationkey as bigint) * 37 as start, n_nationkey as seq, ['D','R','r','A','a'][n_nationkey % 5 + 1] as style from nation)
select event_id, r.start, r.style from events e asof left join r on e.event_id >= r.start""")
def page_label_asof(spark, sf_dir):
    r = read(spark, sf_dir, "nation").select(F.lit(0).alias("doc_id"), (F.col("n_nationkey").cast("long") * 37).alias("start"), F.col("n_nationkey").alias("seq"), F.element_at(F.array(*[F.lit(s) for s in "DRrAa"]), (F.col("n_nationkey") % 5 + 1).cast("int")).alias("style"))
    # the events of one user stand for a document's pages; each document has the same few ranges
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id")
    own = r.drop("doc_id").withColumn("k", F.lit(1)).join(e.select("doc_id").distinct().withColumn("k", F.lit(1)), "k").drop("k")
    return R.as_of(e, own, ["doc_id"], "event_id", "start", "seq", ["start", "style"]).select("event_id", "start", "style")


@query("""select page_id, count(*) as links from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as uri from pages) where uri <> '' group by page_id""")
def link_targets(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)")).alias("uri")).where("uri <> ''").groupBy("page_id").agg(F.count("*").alias("links"))


@query("select conv_id, string_agg(text || chr(10), '' order by turn) as content from conversations group by conv_id")
def content_concat(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return c.select("conv_id", F.array_join(F.transform("p", lambda x: F.concat(x.text, F.lit("\n"))), "").alias("content"))


@query("""with s as (select conv_id, turn, cast((turn // 3) * 20 as double) as y, cast((turn % 3) * 40 as double) as x0, cast((turn % 3) * 40 + 10 + conv_id % 30 as double) as x1 from conversations)
select conv_id, turn, cast(turn // 3 - min(turn // 3) over (partition by conv_id) as int) as line_no,
coalesce((turn // 3 = lag(turn // 3) over w) and x0 - lag(x1) over w > 3.0, false) as gap from s window w as (partition by conv_id order by turn)""")
def span_lines(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    third = F.floor(F.col("turn") / 3)
    s = c.select("conv_id", "turn", ((F.col("turn") % 3) * 40).cast("double").alias("x0"), ((F.col("turn") % 3) * 40 + 10 + F.col("conv_id") % 30).cast("double").alias("x1"), (third * 20).cast("double").alias("y0"), (third * 20 + 10).cast("double").alias("y1"), F.lit(10.0).alias("size"))
    return R.lines(s, ["conv_id"], "turn").select("conv_id", "turn", "line_no", "gap")


@query("select l_orderkey, cast(l_linenumber // 2 as int) as line_no, min(l_tax) as x0, min(l_discount) as y0, max(l_quantity) as x1, max(l_extendedprice) as y1 from lineitem group by 1, 2")
def hit_line_boxes(spark, sf_dir):
    h = read(spark, sf_dir, "lineitem").select("l_orderkey", F.floor(F.col("l_linenumber") / 2).cast("int").alias("line_no"), F.col("l_tax").alias("x0"), F.col("l_discount").alias("y0"), F.col("l_quantity").alias("x1"), F.col("l_extendedprice").alias("y1"))
    return R.line_boxes(h, ["l_orderkey"])


@query("select doc_id, cast(sum(ord(c)) over (partition by doc_id order by i) % 256 as int) as v, i from (select doc_id, i, substring(source, cast(i + 1 as int), 1) as c from (select doc_id, source, unnest(range(length(source))) as i from documents))")
def png_sub_predictor(spark, sf_dir):
    """Undoing PNG's Sub filter for one-byte pixels is a running sum, mod 256."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_codes(F.encode("source", "UTF-8"), 1)).alias("i", "c"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("doc_id", F.col("i").cast("long").alias("i"), (F.sum("c").over(w) % 256).cast("int").alias("v"))
