"""Connected components of an edge table by minimum label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import stash


def components(edges: DataFrame) -> DataFrame:
    """id, root for every id of (a, b) edges; root is the least id of its component.

    Each round hooks every root to the least root it sees across an edge, then shortens the paths; edges
    inside a component leave, so what a round reads shrinks. Labels are written to the shared folder.
    """
    live = stash(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = stash(live.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")), "labels")
    while live.limit(1).count():
        # the larger root of an edge hooks to the smallest root it meets
        hook = live.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to"))
        hook = stash(hook, "hooks")
        while True:  # to the end of each chain of hooks; chains halve in every step
            up = hook.select(F.col("from").alias("f2"), F.col("to").alias("t2"))
            longer = hook.join(up, hook["to"] == up["f2"], "left").select("from", F.coalesce("t2", "to").alias("to"), F.col("t2").isNotNull().alias("moved"))
            longer = stash(longer, "hooks")
            hook = longer.select("from", "to")
            if not longer.where("moved").limit(1).count():
                break
        labels = stash(labels.join(hook, labels["root"] == hook["from"], "left").select("id", F.coalesce("to", "root").alias("root")), "labels")
        x, y = hook.select(F.col("from").alias("fa"), F.col("to").alias("ta")), hook.select(F.col("from").alias("fb"), F.col("to").alias("tb"))
        moved = live.join(x, live["a"] == x["fa"], "left").join(y, live["b"] == y["fb"], "left").select(F.coalesce("ta", "a").alias("p"), F.coalesce("tb", "b").alias("q"))
        live = stash(moved.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
    return labels
