"""Connected components by hooking to the smallest neighbour label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rillway.session import Scratch


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b); the component is its smallest node.

    Every round pre-aggregates the labels that reach a node before they are shuffled. Rows of one hub or one large component
    meet a single row on the other side of each join, so adaptive execution can split them. Nulls, loops and repeated edges are passed over; no edges give no rows.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = scratch.cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    lab = scratch.cut(e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("c")))
    while True:
        near = e.join(lab.select(F.col("node").alias("v"), F.col("c").alias("cv")), "v").groupBy("u").agg(F.min("cv").alias("m"))
        step = lab.join(near.select(F.col("u").alias("node"), "m"), "node").select("node", F.least("c", "m").alias("c1"), F.col("c").alias("c0"))
        up = lab.select(F.col("node").alias("c1"), F.col("c").alias("cc"))
        new = scratch.cut(step.join(up, "c1", "left").select("node", F.least("c1", F.coalesce("cc", "c1")).alias("c"), "c0"))
        moved = not new.where("c <> c0").isEmpty()
        scratch.drop(lab)
        lab = new
        if not moved:
            return lab.select("node", F.col("c").alias("component"))
