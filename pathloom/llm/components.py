"""Connected components by minimum labels and pointer jumping, every step a distributed join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.session import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any order, repeats allowed: (node, label), label the smallest node reachable."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("moved")))
    while labels.where("moved").limit(1).count():
        l, e = labels.alias("l"), both.alias("e")
        near = e.join(l, F.col("e.b") == F.col("l.node")).groupBy(F.col("e.a").alias("node")).agg(F.min("l.label").alias("m"))
        step = labels.alias("o").join(near.alias("n"), F.col("o.node") == F.col("n.node")).select("o.node", F.col("o.label").alias("was"), F.least("o.label", "n.m").alias("label"))
        jumped = step.alias("s").join(labels.alias("j"), F.col("s.label") == F.col("j.node")).select("s.node", "s.was", F.least("s.label", "j.label").alias("label"))
        after = cut(jumped.select("node", "label", (F.col("label") < F.col("was")).alias("moved")))
        drop_cut(labels)
        labels = after
    drop_cut(both)
    return labels.select("node", "label")
