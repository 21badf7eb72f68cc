"""Filling containers of fixed capacity, by best-fit decreasing with bound-certified repacking.

Items are dealt to partitions of bounded size and packed there by best-fit decreasing. A dual-feasible-function
bound says how many containers a partition needs at least; where more are used, the items of its worst-filled
containers are exchanged with those of other such partitions and packed again.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rillway.session import Scratch

#: Items packed in one task at most (on average, items being dealt by hash), and containers of a partition kept out of the exchange below this fill.
PER_PARTITION, FULL = 20_000, 0.999


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Least number of containers for the sizes (each as often as counts says): the largest bound of the dual-feasible functions tried.

    For each threshold t up to half the capacity, items above capacity - t count as whole containers and items below
    t not at all; and items are also rounded to multiples of 1 / (k + 1). Both maps keep any full container at 1.
    """
    if not len(sizes):
        return 0
    s, back = np.unique(np.asarray(sizes, np.int64), return_inverse=True)
    n = np.bincount(back, weights=counts).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(s * n)])
    many = np.concatenate([[0], np.cumsum(n)])
    best = -(-int(sums[-1]) // capacity)
    ts = np.unique(np.concatenate([[1], s[2 * s <= capacity]]))
    lo, hi = np.searchsorted(s, ts, "left"), np.searchsorted(s, capacity - ts, "right")
    whole = many[-1] - many[hi]
    middle = sums[hi] - sums[np.minimum(lo, hi)]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 21):
        x = (k + 1) * s
        part = np.where(x % capacity == 0, s * k, (x // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((part * n).sum()) // (k * capacity)))
    return best


def least_containers(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container_name, least): the bound over all items together, from how many parts there are of each size; sizes are at most the capacity."""
    sizes = _pieces(items.select("item", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).alias("n")), capacities).groupBy("container_name", "capacity", "n").agg(F.count("*").alias("k"))

    def bound(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"container_name": [g["container_name"].iloc[0]], "least": [lower_bound(g["n"].to_numpy(), int(g["capacity"].iloc[0]), g["k"].to_numpy())]})

    return sizes.groupBy("container_name").applyInPandas(bound, "container_name string, least long")


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, by best-fit decreasing; items must not exceed the capacity."""
    out = np.zeros(len(sizes), np.int64)
    free: dict[int, list[int]] = {}
    rooms: list[int] = []  # the different amounts of room that open containers have, sorted
    n = 0
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        size = int(sizes[i])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            bin_no, room = n, capacity
            n += 1
        else:
            room = rooms[at]
            bin_no = free[room].pop()
            if not free[room]:
                del free[room], rooms[at]
        out[i] = bin_no
        room -= size
        if room > 0:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append(bin_no)
    return out


def _pieces(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """(container_name, capacity, item, part_no, n): items above the capacity in parts of the capacity, the rest last."""
    cap = F.col("capacity")
    parts = F.greatest(F.ceil(F.col("n") / cap), F.lit(1)).cast("int")
    return items.join(F.broadcast(capacities), F.lit(True)).withColumn("parts", parts).withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "container_name", "capacity", "item", "part_no", F.when(F.col("part_no") < F.col("parts") - 1, cap).otherwise(F.col("n") - cap * F.col("part_no")).cast("int").alias("n")
    )


def pack(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """Assign items (item, n) to containers of each row (container_name, capacity) of a small table.

    Returns container_name, capacity, container_id, item, part_no, n, bins, bound: each item once for each kind of
    container, or in parts where it exceeds the capacity. bins and bound are the containers used and needed at least
    by the items that were packed together. Items of size 0 or null size take no room and stand in the first
    container of their partition. A capacity below 1 is an error. Empty input gives no rows.
    """
    spark = items.sparkSession
    scratch = Scratch(spark)
    src = items.select("item", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).alias("n"))
    caps = capacities.select("container_name", F.when(F.col("capacity") < 1, F.raise_error(F.lit("capacity below 1"))).otherwise(F.col("capacity")).alias("capacity"))
    pieces = scratch.cut(_pieces(src, caps))
    kinds = {r["container_name"]: max(1, -(-r["k"] // PER_PARTITION)) for r in pieces.groupBy("container_name").agg(F.count("*").alias("k")).collect()}
    if not kinds:
        kinds = {"": 1}
    split = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("container_name")]
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item", "part_no"), split))
    item_type = pieces.schema["item"].dataType.simpleString()
    packed = f"container_name string, capacity int, part long, item {item_type}, part_no int, n int, bin long, bins long, bound long, loose boolean"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n", "item", "part_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        cap = int(g["capacity"].iloc[0])
        sizes = g["n"].to_numpy()
        g["bin"] = best_fit(sizes, cap)
        g["bins"], g["bound"] = int(g["bin"].max()) + 1, lower_bound(sizes, cap)
        fill = np.bincount(g["bin"], weights=sizes)
        gap = int(g["bins"].iloc[0] - g["bound"].iloc[0])
        loose = np.zeros(len(fill), bool)
        if gap > 0:  # as many of the worst-filled containers as could be saved, and as many again to move items about
            loose[np.argsort(fill, kind="stable")[: max(2, 2 * gap)]] = True
            loose &= fill < FULL * cap
        g["loose"] = loose[g["bin"]]
        return g[["container_name", "capacity", "part", "item", "part_no", "n", "bin", "bins", "bound", "loose"]]

    now = scratch.cut(dealt.groupBy("container_name", "part").applyInPandas(run, packed))
    kept, r = None, 0
    while True:
        # partitions that use more containers than their bound, until there are none or an exchange saves none any more
        loose = {x["container_name"]: (x["k"], x["used"]) for x in now.where("loose").groupBy("container_name").agg(F.count("*").alias("k"), F.count_distinct("part", "bin").alias("used")).collect()}
        if not loose:
            break
        share = {k: max(1, -(-v // PER_PARTITION)) for k, (v, _) in loose.items()}
        m = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("container_name")]
        again = now.where("loose").select("container_name", "capacity", "item", "part_no", "n").withColumn("part", F.pmod(F.xxhash64(F.lit(r), "item", "part_no"), m) + (r + 1) * 1_000_000_000)
        new = scratch.cut(again.groupBy("container_name", "part").applyInPandas(run, packed))
        used = {x["container_name"]: x["used"] for x in new.groupBy("container_name").agg(F.count_distinct("part", "bin").alias("used")).collect()}
        better = [k for k, (_, before) in loose.items() if used[k] < before]
        gain = F.col("container_name").isin(better)
        fixed = now.where(~(F.col("loose") & gain))
        kept = fixed if kept is None else kept.unionByName(fixed)
        now, r = new.where(gain), r + 1
        if not better:
            break
    out = now if kept is None else kept.unionByName(now)
    return out.select("container_name", "capacity", F.concat_ws("-", "part", "bin").alias("container_id"), "item", "part_no", "n", "bins", "bound")
