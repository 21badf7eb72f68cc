"""Mixing sources to target weights by entropy balancing.

Of all ways to repeat documents that give each source its share of the tokens, the one nearest to taking every
document once is exp(rate of its source times its length), cut at the repeats the source allows. The rates solve
a convex dual, one coordinate per source, by Newton steps over sums that are gathered from the executors; the
rates of documents are then rounded to copies.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from rillway.session import Scratch

NEWTON, TOLERANCE, PER_BUCKET, STARTS = 60, 1e-6, 20_000, 32


def solve_rates(hist: DataFrame, sources: dict[str, tuple[float, int, float]]) -> dict[str, float]:
    """Rate of each source so that its tokens reach their goal: source -> (goal, cap, mean length).

    hist holds (source, n, k): how many documents of a source have n tokens. Each round gathers two sums a source
    from the executors; a step that leaves the interval known to hold the rate is replaced by halving it.
    """
    lam = {s: 0.0 for s in sources}
    low, high = {s: -60.0 for s in sources}, {s: 60.0 for s in sources}
    open_ = set(sources)
    for _ in range(NEWTON):
        if not open_:
            break
        cases = F.create_map(*[F.lit(x) for s in sorted(open_) for x in (s, lam[s])])
        caps = F.create_map(*[F.lit(x) for s in sorted(open_) for x in (s, float(sources[s][1]))])
        means = F.create_map(*[F.lit(x) for s in sorted(open_) for x in (s, sources[s][2])])
        x = F.col("n") / means[F.col("source")]
        raw = F.exp(F.least(cases[F.col("source")] * x, F.lit(700.0)))
        w = F.least(raw, caps[F.col("source")])
        sums = hist.where(F.col("source").isin(sorted(open_))).groupBy("source").agg(
            F.sum(w * F.col("n") * F.col("k")).alias("t"), F.sum(F.when(raw < caps[F.col("source")], w * F.col("n") * x * F.col("k")).otherwise(0.0)).alias("g")
        )
        for r in sums.collect():
            s, goal = r["source"], sources[r["source"]][0]
            off = r["t"] - goal
            if abs(off) <= TOLERANCE * max(goal, 1.0) or high[s] - low[s] < 1e-12:
                open_.discard(s)
                continue
            if off > 0:
                high[s] = min(high[s], lam[s])
            else:
                low[s] = max(low[s], lam[s])
            step = lam[s] - off / r["g"] if r["g"] > 0 else math.inf
            lam[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    return lam


def mix(items: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) for items (item, source, n) and a small table of targets (source, target_share, max_repeats).

    copies: item, source, n, copies (0 to max_repeats of the source). shares: source, target_share, actual_share,
    tokens, items, copies. The total is what can be had at most with the shares kept, but no more than the tokens
    of the sources listed, unless given. Sources that aren't listed and items without tokens get no copies and are
    left out; a source without items has share 0, and the others keep their proportions.
    """
    spark = items.sparkSession
    scratch = Scratch(spark)
    want = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.collect() if r["source"] is not None and (r["target_share"] or 0) > 0}
    src = scratch.cut(items.select("item", "source", "n").where(F.col("n") > 0).join(F.broadcast(targets.select("source")), "source", "left_semi"))
    hist = scratch.cut(src.groupBy("source", "n").agg(F.count("*").alias("k")))
    have = {r["source"]: (r["t"], r["c"]) for r in hist.groupBy("source").agg(F.sum(F.col("n") * F.col("k")).alias("t"), F.sum("k").alias("c")).collect() if r["source"] in want}
    share = sum(want[s][0] for s in have) or 1.0
    if have:
        most = min(want[s][1] * t / (want[s][0] / share) for s, (t, _) in have.items())
        total = min(most, total or sum(t for t, _ in have.values()))
    goals = {s: (total * want[s][0] / share, want[s][1], t / c) for s, (t, c) in have.items()}
    lam = solve_rates(hist, goals) if goals else {}
    if goals:
        table = spark.createDataFrame([(s, lam[s] / goals[s][2], float(goals[s][1]), max(1, -(-have[s][1] // PER_BUCKET))) for s in sorted(goals)], "source string, a double, cap double, b long")
    else:
        table = spark.createDataFrame([], "source string, a double, cap double, b long")
    rated = src.join(F.broadcast(table), "source").withColumn("rate", F.least(F.exp(F.least(F.col("a") * F.col("n"), F.lit(700.0))), F.col("cap")))
    # systematic rounding in the order of length: each item gets its rate rounded down or up, and sums stay close
    bucket = F.pmod(F.xxhash64("item"), F.col("b"))
    order = Window.partitionBy("source", "bucket").orderBy("n", F.xxhash64("item"), "item").rowsBetween(Window.unboundedPreceding, 0)
    run = scratch.cut(rated.withColumn("bucket", bucket).withColumn("upto", F.sum("rate").over(order)))

    def rounded(start):
        eps = 1e-9
        return F.least(F.floor(F.col("upto") + start + eps) - F.floor(F.col("upto") - F.col("rate") + start + eps), F.ceil(F.col("cap")))

    # of a few starting points of the rounding, each bucket takes the one that comes nearest to its tokens
    tried = run.groupBy("source", "bucket").agg(
        F.array_min(F.array(*[F.struct(F.abs(F.sum(rounded(F.lit(j / STARTS)) * F.col("n")) - F.sum(F.col("rate") * F.col("n"))).alias("off"), F.lit(j / STARTS).alias("start")) for j in range(STARTS)])).alias("best")
    ).select("source", "bucket", F.col("best.start").alias("start"))
    copies = run.join(tried, ["source", "bucket"]).select("item", "source", "n", rounded(F.col("start")).cast("int").alias("copies"))
    got = copies.groupBy("source").agg(F.sum(F.col("n") * F.col("copies")).alias("tokens"), F.count("*").alias("items"), F.sum("copies").alias("copies"))
    whole = got.agg(F.sum("tokens").alias("all"))
    shares = (
        targets.select("source", "target_share").join(got, "source", "left").join(F.broadcast(whole), F.lit(True))
        .select("source", "target_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("copies", F.lit(0)).alias("copies"))
    )
    return copies, shares
