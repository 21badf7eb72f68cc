"""Edge-table graph operators: propagation, hops, quality, dropout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rillway.functions.text import hash_share
from rillway.session import Scratch


def both_ways(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v"), F.col(weight).alias("w"))
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def personalised_pagerank(edges: DataFrame, a: str, b: str, weight: str, seeds: DataFrame, damping: float, rounds: int) -> DataFrame:
    """(node, score) after a fixed number of rounds of restart with 1 - damping at the seeds (node, score).

    Edges count in both directions, shares by weight; nodes never reached are left out.
    """
    scratch = Scratch(edges.sparkSession)
    e = both_ways(edges, a, b, weight).groupBy("u", "v").agg(F.sum("w").alias("w"))
    out = e.groupBy("u").agg(F.sum("w").alias("total"))
    e = scratch.cut(e.join(out, "u").select("u", "v", (F.col("w") / F.col("total")).alias("p")))
    start = seeds.select("node", F.col("score").alias("s0"))
    now = start.select("node", F.col("s0").alias("s"))
    for i in range(rounds):
        flow = e.join(now.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.sum(F.col("s") * F.col("p")).alias("f"))
        now = flow.join(start, "node", "full").select("node", ((1 - damping) * F.coalesce("s0", F.lit(0.0)) + damping * F.coalesce("f", F.lit(0.0))).alias("s"))
        if i < rounds - 1:
            now = scratch.cut(now)
    return now.select("node", F.col("s").alias("score"))


def hop_scores(edges: DataFrame, a: str, b: str, weight: str, seeds: DataFrame, hops: int, decay: float) -> DataFrame:
    """(node, score): the best product of weights and decay over paths of at most hops edges from a seed."""
    e = both_ways(edges, a, b, weight).groupBy("u", "v").agg(F.max("w").alias("w"))
    best = seeds.select("node", F.col("score").alias("s"))
    front = best
    for _ in range(hops):
        front = e.join(front.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.max(F.col("s") * F.col("w") * decay).alias("s"))
        best = best.unionByName(front).groupBy("node").agg(F.max("s").alias("s"))
    return best.select("node", F.col("s").alias("score"))


def dropout(edges: DataFrame, key_cols: list[str], salt: str, rate: float) -> DataFrame:
    """Edges whose hash share is at least rate; the same edges for the same salt wherever it runs."""
    return edges.where(hash_share(F.concat_ws("|", F.lit(salt), *key_cols)) >= rate)
