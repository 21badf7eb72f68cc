"""Ranking metrics, calibration, summaries and comparisons of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def ranking_metrics(ranked: DataFrame, qid: str, grade: str, pool: DataFrame, k: int) -> DataFrame:
    """Per query: mrr, ndcg (gains 2^g - 1, ideal from the whole pool), recall, precision, first_relevant_rank.

    ranked holds (qid, rank, grade); pool holds (qid, grade) of all candidates that have a grade above 0. A row is
    relevant from grade 2. Queries without relevant candidates have null recall and ndcg 0.
    """
    g = F.coalesce(F.col(grade), F.lit(0))
    head = F.col("rank") <= k
    rel = g >= 2
    got = ranked.groupBy(qid).agg(
        F.sum(F.when(head, (F.pow(F.lit(2.0), g) - 1) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(head & rel, F.col("rank"))).alias("first_relevant_rank"),
        F.count_if(head & rel).alias("hits"),
    )
    place = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc(grade)))
    ideal = pool.withColumn("p", place).groupBy(qid).agg(
        F.sum(F.when(F.col("p") <= k, (F.pow(F.lit(2.0), F.col(grade)) - 1) / F.log2(F.col("p") + 1))).alias("idcg"), F.count_if(F.col(grade) >= 2).alias("n_relevant")
    )
    m = got.join(ideal, qid, "left")
    return m.select(
        qid,
        F.round(F.coalesce(1 / F.col("first_relevant_rank"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.least(F.col("dcg") / F.col("idcg"), F.lit(1.0)), F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.when(F.col("n_relevant") > 0, F.least(F.col("hits") / F.col("n_relevant"), F.lit(1.0))), 6).alias("recall"),
        F.round(F.col("hits") / F.lit(k), 6).alias("precision"),
        F.col("first_relevant_rank").cast("int").alias("first_relevant_rank"),
    )


def calibration(df: DataFrame, conf: Column, correct: Column, bins: int = 5) -> DataFrame:
    """Equal bins of confidence (the last closed): count, mean confidence, accuracy and the gap; empty bins are left out."""
    c = F.when(conf.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)))
    d = df.select(c.alias("c"), correct.cast("int").alias("y")).where("c is not null and y is not null")
    d = d.withColumn("bin", F.least(F.floor(F.col("c") * bins), F.lit(bins - 1)).cast("int"))
    return d.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean_confidence"), F.round(F.avg("y"), 6).alias("accuracy"), F.round(F.abs(F.avg("c") - F.avg("y")), 6).alias("gap"), F.round(F.avg(F.pow(F.col("c") - F.col("y"), 2)), 6).alias("brier"))


def paired(df: DataFrame, item: str, factor: str, value: str, metric: str, controls: list[str]) -> DataFrame:
    """Per pair of values of a factor: how the metric differs on the same item under the same controls.

    Each (item, controls, value) is pre-aggregated to one row first, so pairs per item are bounded by the values.
    """
    one = df.groupBy(item, *controls, factor).agg(F.max(metric).alias("m")).withColumnRenamed(factor, value)
    b = one.select(item, *controls, F.col(value).alias("right_value"), F.col("m").alias("right_m"))
    p = one.withColumnRenamed(value, "left_value").join(b, [item, *controls]).where("left_value < right_value")
    d = F.col("right_m") - F.col("m")
    return p.groupBy("left_value", "right_value").agg(
        F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean_delta"), F.round(1.96 * F.stddev_samp(d) / F.sqrt(F.count("*")), 6).alias("half_width"),
        F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"),
    )


def pareto(df: DataFrame, quality: str, cost: str, ranges: int = 64) -> DataFrame:
    """Rows that no other row beats in quality at no more cost, or in cost at no less quality.

    The best quality at each cost is aggregated first. Costs are cut at their quantiles into ranges; a running maximum within
    each range, and the best of the ranges before it, replace both the join of all pairs and one sort of all costs.
    """
    best = df.groupBy(cost).agg(F.max(quality).alias("top"))
    cuts = sorted(set(best.approxQuantile(cost, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))
    part = F.lit(0)
    if cuts:
        part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(cost)))
    best = best.withColumn("part", part)
    heads = best.groupBy("part").agg(F.max("top").alias("head"))  # at most so many rows as there are ranges
    ahead = heads.select("part", F.max("head").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"))
    within = F.max("top").over(Window.partitionBy("part").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("within", within).join(F.broadcast(ahead), "part").withColumn("before", F.greatest("within", "ahead")).where("before is null or top > before")
    return df.join(front.select(cost, F.col("top").alias(quality)), [cost, quality], "left_semi")
