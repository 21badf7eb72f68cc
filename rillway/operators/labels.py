"""Ranking of hierarchical codes for queries: candidates, reranking by overlaps and branches, learned scorer, confidence, diagnosis.

Candidates are rows (qid, code, score, rank); every step works on all queries at once with windows over qid, adds its
bonus to the score and ranks anew. Ties go to the smaller code. Profiles hold the token sets of a code's texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rillway.functions import cpv
from rillway.functions.text import confidence, min_max, rounded, tokens

DIGITS = 6
BEAMS = {2: 4, 4: 6, 6: 10}
SOFT = {2: 0.03, 4: 0.05, 6: 0.07}
NEGATIVES, BUCKET_SIZE, PER_BUCKET = 6, 8, 3
FEATURES = ("label", "variant_max", "variant_mean", "name", "description", "hierarchy", "alias", "example", "parent", "action")


def overlap(a: Column, b: Column) -> Column:
    """Share of the token set a in the set b; 0 where either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


#: Overlaps that the reranking steps read: of a token set of the query and one of the code.
STEP_OVERLAPS = (("q", "canonical"), ("t_object", "canonical"), ("q", "example"), ("t_object", "example"), ("t_action", "canonical"), ("q", "siblings"), ("q", "children"))


def overlap_columns() -> list[Column]:
    """The overlaps of the steps as numbers, in place of the token sets."""
    return [overlap(F.col(a), F.col("t_" + b)).alias(f"o_{a}_{b}") for a, b in STEP_OVERLAPS]


def overlap_in(c: DataFrame, a: str, b: str) -> Column:
    """An overlap of candidates: the number where they have it, else from the token sets."""
    return F.col(f"o_{a}_{b}") if f"o_{a}_{b}" in c.columns else overlap(F.col(a), F.col("t_" + b))


def ranked(c: DataFrame, *then: Column) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), *then, "code")
    return c.withColumn("score", F.round("score", DIGITS)).withColumn("rank", F.row_number().over(w))


def bonus(c: DataFrame, extra: Column) -> DataFrame:
    """Candidates with extra added to the score, ranked anew; the added part stays in the column bonus."""
    # a hair is added, so that what is exactly between two numbers is rounded alike whatever the order of the sums
    return ranked(c.withColumn("bonus", F.round(extra + 1e-9, DIGITS)).withColumn("score", F.col("score") + F.col("bonus")))


def normal_score(c: DataFrame) -> Column:
    w = Window.partitionBy("qid")
    return min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w))


def profiles(catalogue: DataFrame, examples: DataFrame, languages: list[str]) -> DataFrame:
    """(code, parent, label, tokens of label, alias, hierarchy, parent label, children, siblings and example, and of all canonical texts) of a catalogue with a column per language.

    The hierarchy is the inferred one; labels of ancestors, children and siblings count where the code is in the catalogue.
    Lists of children and siblings are cut at eight in code order, which is what a profile shows of them.
    """
    c = catalogue.select("code", F.coalesce("en", F.lit("")).alias("label"), F.concat_ws(" ", *[x for x in languages if x != "en"]).alias("alias"), cpv.inferred_parent(F.col("code")).alias("parent"))
    names = c.select("code", "label")
    up = c.select("code", F.posexplode(cpv.ancestors(F.col("code"))).alias("d", "a")).join(names.select(F.col("code").alias("a"), F.col("label").alias("l")), "a")
    up = up.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "l"))), lambda x: x["l"]), " ").alias("hierarchy"))
    listed = lambda x: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(x)), 1, 8), lambda r: r["l"]), " ")
    kids = c.where("parent is not null").groupBy(F.col("parent").alias("code")).agg(listed(F.struct("code", F.col("label").alias("l"))).alias("children"))
    sib = c.where("parent is not null").select("code", "parent").join(c.select("parent", F.col("code").alias("s"), F.col("label").alias("l")), "parent").where("code <> s").groupBy("code").agg(listed(F.struct("s", "l")).alias("siblings"))
    ex = examples.groupBy("cpv_code").agg(F.min_by("example_text", "example_id").alias("example")).withColumnRenamed("cpv_code", "code")
    p = c.join(up, "code", "left").join(kids, "code", "left").join(sib, "code", "left").join(ex, "code", "left").join(names.select(F.col("code").alias("parent"), F.col("label").alias("parent_label")), "parent", "left")
    sets = {"label": F.col("label"), "alias": F.col("alias"), "hierarchy": F.concat_ws(" ", "hierarchy", "parent_label"), "parent_label": F.col("parent_label"), "children": F.col("children"), "siblings": F.col("siblings"), "example": F.col("example"), "canonical": F.concat_ws(" ", "label", "alias", "hierarchy")}
    return p.select("code", "parent", cpv.code_level(F.col("code")).alias("code_level"), *[F.array_distinct(tokens(v)).alias("t_" + k) for k, v in sets.items()])


def candidates(queries: DataFrame, profile: DataFrame, k: int, common: float = 0.25) -> DataFrame:
    """(qid, code, score, rank): the k codes whose label and alias words are in the query, weighted by their rarity among the codes; words of more than a share of the codes count nothing."""
    terms = profile.select("code", F.explode(F.array_union("t_label", "t_alias")).alias("t"))
    n = profile.agg(F.count("*").alias("n"))
    idf = terms.groupBy("t").agg(F.count("*").alias("df")).join(F.broadcast(n), F.lit(True)).where(F.col("df") <= common * F.col("n")).select("t", F.log1p(F.col("n") / F.col("df")).alias("w"))
    known = terms.join(idf, "t")  # of the catalogue, which is small and fixed
    hits = queries.select("qid", F.explode("q").alias("t")).join(F.broadcast(known), "t").groupBy("qid", "code").agg(F.sum("w").alias("score"))
    return ranked(hits).where(F.col("rank") <= k)


def object_focus(c: DataFrame) -> DataFrame:
    """Bonus for the main object (t_main), action (t_action) and side terms (t_side) of the query in the canonical text, less for what it excludes (t_exclude)."""
    o = {k: overlap(F.col("t_" + k), F.col("t_canonical")) for k in ("main", "action", "side", "exclude")}
    return bonus(c, 0.18 * o["main"] + 0.06 * o["action"] + 0.02 * o["side"] - F.when(o["exclude"] > o["main"], 0.10 * o["exclude"]).otherwise(0.0))


def label_features(c: DataFrame) -> DataFrame:
    """Ten overlaps of query and code, as columns f_*; the query forms are its words, its object with its action, and its translation."""
    forms = [F.col(x) for x in ("q", "t_object", "t_translated")]
    best = lambda t: F.greatest(*[overlap(q, F.col(t)) for q in forms])
    variants = [overlap(q, F.col(t)) for q in forms for t in ("t_label", "t_alias", "t_hierarchy")]
    values = {
        "label": best("t_canonical"), "variant_max": F.greatest(*variants), "variant_mean": sum(variants) / len(variants), "name": best("t_label"), "description": best("t_children"),
        "hierarchy": best("t_hierarchy"), "alias": best("t_alias"), "example": best("t_example"), "parent": overlap(F.col("t_object"), F.col("t_parent_label")), "action": overlap(F.col("t_action"), F.col("t_canonical")),
    }
    return c.select("*", *[F.round(v, DIGITS).alias("f_" + k) for k, v in values.items()])


def zero_shot(c: DataFrame, head: int = 80) -> DataFrame:
    """Weighted sum of the features, the scaled score and a bonus for specific codes, added to the score of the head; the tail keeps its score."""
    level = F.when(F.col("code_level") >= 8, 0.04).when(F.col("code_level") >= 6, 0.02).otherwise(0.0)
    w = Window.partitionBy("qid", F.col("rank") <= head)
    prior = min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w))
    s = 0.22 * F.col("f_label") + 0.16 * F.col("f_variant_max") + 0.08 * F.col("f_variant_mean") + 0.18 * F.col("f_hierarchy") + 0.16 * F.col("f_alias") + 0.12 * F.col("f_example") + 0.08 * F.col("f_action") + 0.08 * prior + level
    return bonus(c, F.when(F.col("rank") <= head, s).otherwise(0.0))


def canonical_rerank(c: DataFrame) -> DataFrame:
    o, e = F.greatest(overlap_in(c, "q", "canonical"), overlap_in(c, "t_object", "canonical")), F.greatest(overlap_in(c, "q", "example"), overlap_in(c, "t_object", "example"))
    return bonus(c, 0.18 * o + 0.06 * overlap_in(c, "t_action", "canonical") + 0.05 * normal_score(c) + F.when(o >= e, 0.04).otherwise(0.0))


def dominant_branch(c: DataFrame, widths: tuple[int, ...] = (6, 4), head: int = 8) -> DataFrame:
    """(qid, branch): the prefix of most scaled score among the head of each ranking, of the first width at which it has two codes and .8; queries without one are left out."""
    top = c.where(F.col("rank") <= head)
    top = top.withColumn("norm", normal_score(top))
    out = None
    for i, width in enumerate(widths):
        p = top.groupBy("qid", F.substring("code", 1, width).alias("branch")).agg(F.sum("norm").alias("w"), F.count("*").alias("n"))
        best = p.groupBy("qid").agg(F.min_by(F.struct("branch", "w", "n"), F.struct(-F.round("w", DIGITS), "branch")).alias("b"))
        found = best.where("b.n >= 2 and round(b.w, 6) >= 0.8").select("qid", F.lit(i).alias("i"), "b.branch")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("qid").agg(F.min_by("branch", "i").alias("branch"))


def branch_selector(c: DataFrame) -> DataFrame:
    """Bonus for codes of the dominant branch, more where object or siblings fit, less for a broad code whose children fit."""
    d = c.join(dominant_branch(c), "qid", "left")
    inside = F.when(F.length("branch") >= 6, 0.12).otherwise(0.08) + F.when(overlap_in(c, "t_object", "canonical") >= 0.18, 0.05).otherwise(0.0)
    inside += F.when(overlap_in(c, "q", "siblings") > 0.08, 0.03).otherwise(0.0) - F.when((F.col("code_level") < 8) & (overlap_in(c, "q", "children") > 0.10), 0.04).otherwise(0.0)
    return bonus(d, F.when(F.startswith("code", F.col("branch")), inside).otherwise(0.0))


def specificity(c: DataFrame) -> DataFrame:
    """A specific code gets .09 if it fits as well as its parent in the ranking; a broad one loses .10 if a child in the ranking fits as well."""
    c = c.withColumn("fit", F.round(F.greatest(overlap_in(c, "q", "canonical"), overlap_in(c, "t_object", "canonical")), DIGITS))
    up = c.select("qid", F.col("code").alias("parent"), F.col("fit").alias("parent_fit"))
    down = c.where("parent is not null").groupBy("qid", F.col("parent").alias("code")).agg(F.max("fit").alias("child_fit"))
    d = c.join(up, ["qid", "parent"], "left").join(down, ["qid", "code"], "left")
    good = (F.col("code_level") >= 8) & (F.col("fit") >= F.round(F.col("parent_fit") - 0.03, DIGITS))
    broad = (F.col("code_level") < 8) & (F.col("child_fit") >= F.round(F.col("fit") - 0.02, DIGITS))
    return bonus(d, F.when(good, 0.09).otherwise(0.0) - F.when(broad, 0.10).otherwise(0.0))


def beam(c: DataFrame) -> DataFrame:
    """Prefixes of 2, 4 and 6 digits scored .7 best + .3 mean of the best three; codes under a prefix within the beam get a soft bonus; ties are broken by the mean stage score."""
    stage: Column = F.lit(0.0)
    soft: Column = F.lit(0.0)
    for width, keep in BEAMS.items():
        p = F.substring("code", 1, width)
        within = Window.partitionBy("qid", p).orderBy(F.desc("score"), "code")
        top = c.withColumn("p", p).withColumn("r", F.row_number().over(within)).where("r <= 3").groupBy("qid", "p").agg(F.round(0.7 * F.max("score") + 0.3 * F.avg("score"), DIGITS).alias("s"))
        top = top.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "p")))
        c = c.withColumn(f"p{width}", p).join(top.select("qid", F.col("p").alias(f"p{width}"), F.col("s").alias(f"s{width}"), F.col("n").alias(f"n{width}")), ["qid", f"p{width}"])
        stage = stage + F.col(f"s{width}") / 3
        soft = soft + F.when(F.col(f"n{width}") <= keep, SOFT[width]).otherwise(0.0)
    c = c.withColumn("stage", F.round(stage, DIGITS)).withColumn("bonus", F.round(soft, DIGITS)).withColumn("score", F.col("score") + F.col("bonus"))
    return ranked(c, F.desc("stage"))


def local_branch(c: DataFrame, rescored: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The codes of the dominant branch (6, 4 or 2 digits) rescored among themselves: .08 scaled score and .08 less .01 a rank on top."""
    b = c.join(dominant_branch(c, (6, 4, 2)), "qid").where(F.startswith("code", F.col("branch")))
    b = ranked((rescored or (lambda x: x))(b))
    size = F.count("*").over(Window.partitionBy("qid"))
    b = b.withColumn("norm", normal_score(b)).withColumn("size", size).where("size >= 2")
    extra = b.select("qid", "code", F.round(0.08 * F.col("norm") + F.greatest(F.lit(0.0), 0.08 - 0.01 * (F.col("rank") - 1)), DIGITS).alias("extra"))
    return bonus(c.join(extra, ["qid", "code"], "left"), F.coalesce("extra", F.lit(0.0)))


def related(a: Column, b: Column) -> Column:
    """Siblings, ancestor and descendant, or four digits in common."""
    return (cpv.inferred_parent(a) == cpv.inferred_parent(b)) | (cpv.level(a, b) >= 4) | F.array_contains(cpv.ancestors(a), b) | F.array_contains(cpv.ancestors(b), a)


def post_refine(c: DataFrame, k: int) -> DataFrame:
    """Of the k best: .10 of the mean score of related codes among them and .01 for each, .03 at most."""
    top = c.where(F.col("rank") <= k)
    o = top.select("qid", F.col("code").alias("other"), F.col("score").alias("s"))
    n = top.select("qid", "code").join(o, "qid").where("code <> other").where(F.coalesce(related(F.col("code"), F.col("other")), F.lit(False))).groupBy("qid", "code").agg(F.avg("s").alias("support"), F.count("*").alias("n"))
    d = top.join(n, ["qid", "code"], "left").na.fill(0, ["support", "n"])
    return bonus(d.withColumn("n_related", F.col("n")).drop("n"), 0.10 * F.col("support") + F.least(F.lit(0.03), 0.01 * F.col("n_related")))


def decision_gates(c: DataFrame) -> DataFrame:
    """(qid, margin, confidence, rerank, rerank_reason, ask_model): of each ranking the margin, calibrated confidence, and whether a costly step pays."""
    at = lambda k, col: F.max(F.when(F.col("rank") == k, F.col(col)))
    heads = lambda k, n: F.count_distinct(F.when(F.col("rank") <= k, F.substring("code", 1, n)))
    g = c.groupBy("qid").agg(at(1, "score").alias("s1"), at(2, "score").alias("s2"), at(1, "code").alias("c1"), at(2, "code").alias("c2"), heads(3, 5).alias("b5"), heads(4, 6).alias("b6"))
    m, pair = F.round(F.col("s1") - F.col("s2"), DIGITS), cpv.level(F.col("c1"), F.col("c2"))
    base = confidence(F.col("s1"))
    branch = F.when(F.col("b5") <= 1, 1.0).when(F.col("b5") == 2, 0.72).otherwise(0.55)
    conf = F.when(F.col("s2").isNull(), base).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), base * (0.45 + 0.55 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), m) / 0.12)) * branch)))
    why = F.when(F.col("s2").isNull(), "not_enough_candidates").when(m <= 0.10, "close_score_margin").when((m <= 0.16) & ((pair >= 4) | (F.col("b6") <= 2)), "same_branch_cluster").otherwise("high_confidence")
    costly = why.isin("close_score_margin", "same_branch_cluster")
    ask = costly & ((m <= 0.35) | ((m <= 0.80) & ((F.col("b5") <= 2) | (pair >= 2))))
    return g.select("qid", m.alias("margin"), F.round(conf, DIGITS).alias("confidence"), costly.alias("rerank"), why.alias("rerank_reason"), ask.alias("ask_model"))


def hard_negatives(queries: DataFrame, profile: DataFrame, most: int = NEGATIVES) -> DataFrame:
    """(qid, gold, negative, weight): codes that are easily taken for the gold code of each query (qid, gold, q).

    A code is confusing by .6 overlap with the query, .25 with the gold code's text and .15 common digits. Buckets in order:
    branch, siblings, class, group, division, all; the middle ones are first thinned to eight in the order of a hash. Three of
    each bucket are taken, the most confusing first, until there are enough. The weight grows with nearness to the gold code.

    Every query is set against all codes of the catalogue, which is small and fixed, by counting words in arrays of its own batch;
    pairs of queries and codes aren't rows.
    """
    cat = sorted((r["code"], r["parent"], r["t_canonical"]) for r in profile.select("code", "parent", "t_canonical").collect())
    codes = [c for c, _, _ in cat]
    place = {c: i for i, c in enumerate(codes)}
    vocabulary = sorted({t for _, _, ts in cat for t in ts})
    col = {t: i for i, t in enumerate(vocabulary)}
    has = np.zeros((len(vocabulary) + 1, len(codes)), dtype=np.int16)  # the last row: words that no code has
    for i, (_, _, ts) in enumerate(cat):
        has[[col[t] for t in ts], i] = 1
    sizes = has.sum(0)
    level = lambda a, b: 8 if a == b else next((w for w in (6, 4, 2) if a[:w] == b[:w]), 0)
    lv = np.array([[level(a, b) for b in codes] for a in codes])
    sib = np.array([[p is not None and p == o for _, o, _ in cat] for _, p, _ in cat])
    near = 0.25 * (has.T.astype(float) @ has) / np.maximum(sizes, 1)[:, None]
    fixed = near + 0.15 * lv / 8.0
    weight = np.where(sib, 4.5, np.select([lv >= 6, lv >= 4, lv >= 2], [4.0, 3.0, 2.0], 1.0))
    other = ~np.eye(len(codes), dtype=bool)
    kinds = [[np.flatnonzero(k[g] & other[g]) for k in (sib | (lv >= 4), sib, lv >= 6, lv == 4, lv == 2)] for g in range(len(codes))]

    def choose(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        words, known = pa.array(vocabulary, pa.string()), pa.array(codes, pa.string())
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                n, q = b.num_rows, b.column("q")
                size = pc.fill_null(pc.list_value_length(q), 0).to_numpy(zero_copy_only=False)
                at = pc.fill_null(pc.index_in(q.flatten(), value_set=words), len(vocabulary)).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(n), size)[at < len(vocabulary)]
                at = at[at < len(vocabulary)]
                common = np.zeros((n, len(codes)))
                if len(at):
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    common[row[first]] = np.add.reduceat(has[at], first, axis=0)
                gold = pc.fill_null(pc.index_in(b.column("gold"), value_set=known), -1).to_numpy(zero_copy_only=False)
                conf = np.floor((0.60 * (common / np.maximum(size, 1)[:, None]) + fixed[gold]) * 10.0**DIGITS + 0.5) / 10.0**DIGITS
                conf[np.arange(n), gold] = -np.inf
                best = np.argsort(-conf, axis=1, kind="stable")[:, :PER_BUCKET]
                qids, out = b.column("qid").to_pylist(), []
                for i, g in enumerate(gold):
                    if g < 0:
                        continue
                    taken: dict[int, None] = {}
                    for bucket, of in enumerate([*kinds[g], None]):
                        if len(taken) >= most:
                            break
                        if of is None:
                            of = [j for j in best[i] if j != g]
                        elif len(of) > BUCKET_SIZE and bucket > 0:
                            of = sorted(of, key=lambda j: (hashlib.md5(f"{qids[i]}|{codes[j]}".encode()).hexdigest(), codes[j]))[:BUCKET_SIZE]
                        taken.update(dict.fromkeys(sorted(of, key=lambda j: (-conf[i, j], j))[:PER_BUCKET]))
                    out += [(i, g, j) for j in list(taken)[:most]]
                r, g, j = np.array(out, dtype=int).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([b.column("qid").take(pa.array(r)), known.take(pa.array(g)), known.take(pa.array(j)), pa.array(weight[g, j], pa.float64())], names=["qid", "gold", "negative", "weight"])

    return queries.select("qid", "gold", "q").mapInArrow(choose, f"qid {queries.schema['qid'].dataType.simpleString()}, gold string, negative string, weight double")


def fit_label_scorer(pairs: DataFrame, c: float = 1.0):
    """Scaled, balanced and weighted logistic regression over the f_* columns of pairs (y 0 or 1, weight); null with less than 100 pairs."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n = {r["y"]: r["k"] for r in pairs.groupBy("y").agg(F.count("*").alias("k")).collect()}
    if sum(n.values()) < 100 or len(n) < 2:
        return None
    total = sum(n.values())
    balance = F.when(F.col("y") == 1, total / (2.0 * n[1])).otherwise(total / (2.0 * n[0]))
    d = pairs.withColumn("w", F.col("weight") * balance)
    mass = d.agg(F.sum("w")).first()[0]
    steps = [
        VectorAssembler(inputCols=["f_" + f for f in FEATURES], outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1.0 / (c * mass), standardization=False, maxIter=100),
    ]
    return Pipeline(stages=steps).fit(d)


def learned_scores(c: DataFrame, model, head: int | None = None) -> DataFrame:
    """Candidates with the probability of the learned scorer as score; those below the head keep their place below it. Without a model nothing changes."""
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return c
    d = model.transform(c).withColumn("p", vector_to_array("probability")[1]).drop("raw", "x", "rawPrediction", "probability", "prediction")
    tail = F.lit(False) if head is None else F.col("rank") > head
    return ranked(d.withColumn("score", F.when(tail, F.col("score") / 1e6).otherwise(F.col("p"))).drop("p"))


def pair_scorer(c: DataFrame, score: Callable | None, model=None, head: int = 64) -> DataFrame:
    """The head scored by a given function of (query texts, code texts) in Arrow batches, scaled and fused .65 to .35 with the scaled score; the learned scorer where there is none."""
    if score is None:
        return learned_scores(c, model)
    import pandas as pd

    fn = F.pandas_udf(lambda a, b: pd.Series(score(list(a), list(b)), dtype="float64"), "double")
    top = c.where(F.col("rank") <= head).withColumn("s", fn(F.array_join("q", " "), F.array_join("t_canonical", " ")))
    w = Window.partitionBy("qid")
    fused = 0.65 * min_max(F.col("s"), F.min("s").over(w), F.max("s").over(w)) + 0.35 * normal_score(top)
    return ranked(top.withColumn("score", fused).drop("s").unionByName(c.where(F.col("rank") > head).withColumn("score", F.col("score") / 1e6)))


def stage_prefixes(c: DataFrame, width: int, count: int = 2, relative: float = 0.9) -> DataFrame:
    """(qid, prefix, score): prefixes kept at a stage: the first count, and all within a share of the best."""
    p = c.withColumn("prefix", F.substring("code", 1, width))
    r = p.withColumn("r", F.row_number().over(Window.partitionBy("qid", "prefix").orderBy(F.desc("score"), "code")))
    g = r.groupBy("qid", "prefix").agg(F.avg(F.when(F.col("r") <= 3, F.col("score"))).alias("m"), F.max("score").alias("b"), F.count("*").alias("n"))
    s = F.round(0.55 * F.col("m") + 0.40 * F.col("b") + F.least(F.lit(0.05), 0.01 * F.col("n")), DIGITS)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "prefix")
    g = g.select("qid", "prefix", s.alias("score")).withColumn("i", F.row_number().over(w)).withColumn("best", F.first("score").over(w))
    return g.where((F.col("i") <= count) | (F.col("score") >= relative * F.col("best"))).select("qid", "prefix", "score")


def rank_diagnostics(c: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query (qid, golds ARRAY, n_words): rank of the gold code, margin, entropy, diversity, failure mode and likely bottleneck. Queries without candidates keep a row."""
    top = gold.select("qid", "golds").join(c.where(F.col("rank") <= k), "qid").withColumn("lv", cpv.best_level(F.col("code"), F.col("golds"))).withColumn("hit", F.array_contains("golds", F.col("code")))
    total = F.sum("score").over(Window.partitionBy("qid"))
    top = top.withColumn("share", F.when(total > 0, F.col("score") / total))
    g = top.groupBy("qid").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("gold_rank"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
        F.max(F.when(F.col("rank") == 1, F.col("code"))).alias("top1"), F.sum(F.when(F.col("share") > 0, -F.col("share") * F.log("share"))).alias("h"), F.count_distinct("code").alias("unique_codes"), F.count_distinct(F.substring("code", 1, 2)).alias("unique_divisions"), F.max("lv").alias("best_level"),
    )
    d = gold.join(g, "qid", "left").na.fill(0, ["n", "unique_codes", "unique_divisions", "best_level"])
    m, exact, best = F.round(F.col("s1") - F.col("s2"), DIGITS), F.coalesce(F.col("gold_rank") == 1, F.lit(False)), F.col("best_level") / 8.0
    conf = confidence(F.col("s1"))
    mode = F.when(exact, "ok").when(F.col("gold_rank").isNotNull(), "gold_present_but_not_ranked_first").when(best >= 0.75, "same_class_wrong_code").when(best >= 0.25, "same_branch_wrong_code").otherwise("gold_missing_from_top_k")
    neck = {"ok": "none", "gold_present_but_not_ranked_first": "reranker_or_prompt_selection", "same_class_wrong_code": "sibling_disambiguation", "same_branch_wrong_code": "hierarchy_disambiguation", "gold_missing_from_top_k": "candidate_generation_or_retriever"}
    sure = ~exact & (F.coalesce(m >= 1.2, F.lit(False)) | F.coalesce(conf >= 0.55, F.lit(False)))
    d = d.withColumn("failure_mode", mode).withColumn("high_confidence_wrong", sure)
    table = F.create_map(*[F.lit(x) for kv in neck.items() for x in kv])
    dup = F.when(F.col("n") > 0, (F.col("n") - F.col("unique_codes")) / F.col("n")).otherwise(0.0)
    return d.select(
        "qid", "top1", "gold_rank", "failure_mode", F.when(F.col("high_confidence_wrong"), "confidence_calibration").otherwise(table[F.col("failure_mode")]).alias("likely_bottleneck"), m.alias("margin"),
        F.round(F.when(F.col("n") > 1, F.col("h") / F.log("n")), DIGITS).alias("entropy"), F.col("unique_codes").cast("int").alias("unique_codes"), F.col("unique_divisions").cast("int").alias("unique_divisions"), F.round(dup, DIGITS).alias("duplicate_rate"), F.round(best, 3).alias("best_hierarchy"),
        "high_confidence_wrong", F.coalesce(m <= 0.8, F.lit(False)).alias("low_margin"), ((dup >= 0.1) | ((F.col("n") >= 3) & (F.col("unique_divisions") <= 2) & (best >= 0.25))).alias("duplicate_pressure"),
        ((F.col("n") > 1) & (F.col("unique_divisions") <= 1)).alias("low_diversity"), (F.col("n_words") <= 3).alias("short_query"), F.round(conf, DIGITS).alias("confidence"),
    )


def ranked_evaluation(c: DataFrame, gold: DataFrame, k: int, distance: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(per query, summary): top-1, hit, precision over k and over what was returned, reciprocal rank, linear-gain NDCG and best distance of rankings; a query without predictions counts as a miss."""
    distance = distance or cpv.distance
    top = gold.select("qid", "golds").join(c.where(F.col("rank") <= k), "qid", "left").withColumn("hit", F.coalesce(F.array_contains("golds", F.col("code")), F.lit(False)))
    gain = F.coalesce(cpv.best_level(F.col("code"), F.col("golds")) / 8.0, F.lit(0.0))
    near = F.array_min(F.transform("golds", lambda g: distance(F.col("code"), g)))
    top = top.withColumn("gain", gain).withColumn("near", near).withColumn("p", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("gain"), "rank")))
    q = top.groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("hit").cast("int"))).alias("top1"), F.count_if("hit").alias("hits"), F.count("code").alias("returned"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("gain") / F.log2(F.col("p") + 1)).alias("idcg"), F.min("near").alias("best_distance"), F.max("gain").alias("best_match"), F.max(F.when(F.col("rank") == 1, F.col("gain"))).alias("top1_match"),
    )
    q = q.select(
        "qid", F.coalesce("top1", F.lit(0)).alias("top1"), (F.col("hits") > 0).cast("int").alias("hit"), F.round(F.col("hits") / F.lit(k), DIGITS).alias("precision_at_k"), F.round(F.coalesce(F.col("hits") / F.nullif(F.col("returned"), F.lit(0)), F.lit(0.0)), DIGITS).alias("precision_returned"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), DIGITS).alias("reciprocal_rank"), F.round(F.coalesce(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0)), F.lit(0.0)), DIGITS).alias("ndcg"), "best_distance", F.round("best_match", 3).alias("best_match"), F.round(F.coalesce("top1_match", F.lit(0.0)), 3).alias("top1_match"),
        F.when(F.col("returned") == 0, "no_prediction").when(F.coalesce(F.col("top1"), F.lit(0)) == 1, "ok").when(F.col("hits") > 0, "ranked_too_low").otherwise("missing").alias("reason"),
    )
    means = [F.round(F.avg(x), 5).alias(x) for x in ("top1", "hit", "precision_at_k", "precision_returned", "reciprocal_rank", "ndcg", "best_distance", "best_match", "top1_match")]
    return q, q.agg(F.count("*").alias("n"), *means, *[F.count_if(F.col("reason") == r).alias("n_" + r) for r in ("ok", "ranked_too_low", "missing", "no_prediction")])


def scorer_only(before: DataFrame, after: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, gold_present, before_right, after_right, improved, hurt): what a scorer changes on the same shortlist."""
    first = lambda c, n: c.where("rank = 1").select("qid", F.col("code").alias(n))
    have = gold.join(before, "qid").groupBy("qid").agg(F.max(F.array_contains("golds", F.col("code"))).alias("gold_present"))
    d = gold.join(have, "qid", "left").join(first(before, "b"), "qid", "left").join(first(after, "a"), "qid", "left")
    has = lambda x: F.coalesce(F.array_contains("golds", F.col(x)), F.lit(False))
    p = F.coalesce("gold_present", F.lit(False))
    return d.select("qid", p.alias("gold_present"), has("b").alias("before_right"), has("a").alias("after_right"), (p & ~has("b") & has("a")).alias("improved"), (p & has("b") & ~has("a")).alias("hurt"))


# expansion along the hierarchy of codes

#: Settings of the profiles of expansion.
PROFILES = {
    "safe_branch": dict(siblings=6, children=8, seeds=6, added=18, proximity=0.82, steps=0, strict=True),
    "conservative": dict(siblings=4, children=6, seeds=8, added=35, proximity=0.78, steps=0, strict=False),
    "balanced": dict(siblings=8, children=12, seeds=12, added=60, proximity=0.70, steps=0, strict=False),
    "exploratory": dict(siblings=16, children=24, seeds=18, added=120, proximity=0.62, steps=3, strict=False),
    "ppr_only": dict(siblings=12, children=18, seeds=12, added=80, proximity=0.68, steps=3, strict=False),
    "direct_only": dict(siblings=8, children=12, seeds=12, added=60, proximity=0.70, steps=0, strict=False),
    "selection": dict(siblings=24, children=32, seeds=20, added=160, proximity=0.62, steps=3, strict=False),
}
DECAY = {"ancestor": 0.64, "sibling": 0.52, "child": 0.58}
STEP_DECAY, STEP_LOSS = {"ancestor": 0.58, "sibling": 0.42, "child": 0.50}, 0.72


def neighbours(codes: DataFrame, siblings: int, children: int) -> DataFrame:
    """(code, to, relation): known ancestors, the first siblings and the first children of each code, in code order; the nearest relation counts."""
    c = codes.select("code", cpv.inferred_parent(F.col("code")).alias("parent"))
    up = c.select("code", F.explode(cpv.ancestors(F.col("code"))).alias("to")).join(c.select(F.col("code").alias("to")), "to", "left_semi").select("code", "to", F.lit("ancestor").alias("relation"))
    kids = c.where("parent is not null").withColumn("r", F.row_number().over(Window.partitionBy("parent").orderBy("code")))
    down = kids.where(F.col("r") <= children).select(F.col("parent").alias("code"), F.col("code").alias("to"), F.lit("child").alias("relation")).join(c.select("code"), "code", "left_semi")
    # of the first siblings of a code: those among the first n + 1 children of its parent, itself left out
    near = kids.where(F.col("r") <= siblings + 1).select("parent", F.col("code").alias("to"), F.col("r").alias("r_to"))
    side = kids.join(near, "parent").where((F.col("code") != F.col("to")) & ((F.col("r_to") <= siblings) | (F.col("r") <= siblings))).select("code", "to", F.lit("sibling").alias("relation"))
    order = F.when(F.col("relation") == "ancestor", 0).when(F.col("relation") == "sibling", 1).otherwise(2)
    return up.unionByName(side).unionByName(down).groupBy("code", "to").agg(F.min_by("relation", order).alias("relation"))


def supported_branches(c: DataFrame, seeds: int, least: float = 0.12, support: int = 2) -> DataFrame:
    """(qid, prefix): prefixes of six or four digits that enough strong seeds share."""
    top = c.withColumn("norm", normal_score(c)).where((F.col("rank") <= seeds) & (F.col("norm") >= least))
    return top.select("qid", F.explode(F.array(F.substring("code", 1, 6), F.substring("code", 1, 4))).alias("prefix")).groupBy("qid", "prefix").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("qid", "prefix")


def expand_pool(c: DataFrame, codes: DataFrame, queries: DataFrame, profile: DataFrame, name: str = "balanced") -> DataFrame:
    """(qid, code, base, proximity, graph, relation): the candidates and, as far as the profile goes, neighbours of the seeds.

    Seeds give their strength (scaled score, or the inverse of their rank if that is more) times the decay of the relation; with
    steps the strength goes on to neighbours of neighbours. The best additions by proximity are kept. graph is the scaled
    mixture of proximity and the overlap of query and label.
    """
    s = PROFILES[name]
    base = c.withColumn("base", rounded(normal_score(c), DIGITS)).select("qid", "code", "rank", "base")
    seed = base.where(F.col("rank") <= s["seeds"]).select("qid", "code", rounded(F.greatest(F.col("base"), 1 / F.col("rank")), DIGITS).alias("strength"))
    links = neighbours(codes, s["siblings"], s["children"])
    decay = lambda t: F.create_map(*[F.lit(x) for kv in t.items() for x in kv])[F.col("relation")]
    walk = seed
    if s["strict"]:
        ok = supported_branches(c, s["seeds"])
        in_branch = seed.select("qid", "code", F.explode(F.array(F.substring("code", 1, 6), F.substring("code", 1, 4))).alias("prefix")).join(ok, ["qid", "prefix"], "left_semi")
        walk = seed.join(in_branch.select("qid", "code").distinct(), ["qid", "code"], "left_semi")
    near = walk.join(F.broadcast(links), "code").select("qid", F.col("to").alias("code"), (F.col("strength") * decay(DECAY)).alias("p"), "relation")
    reached = near
    front = seed.select("qid", "code", F.col("strength").alias("p"))
    for i in range(s["steps"]):
        nxt = front.join(F.broadcast(links), "code").select("qid", F.col("to").alias("code"), (F.col("p") * decay(STEP_DECAY) * STEP_LOSS**i).alias("p"), F.concat(F.lit("ppr_"), "relation").alias("relation"))
        front = nxt.groupBy("qid", "code").agg(F.max("p").alias("p"))
        reached = reached.unionByName(nxt)
    best = reached.unionByName(seed.select("qid", "code", F.col("strength").alias("p"), F.lit("seed").alias("relation"))).groupBy("qid", "code").agg(rounded(F.max("p"), DIGITS).alias("proximity"), F.min_by("relation", F.struct(-rounded(F.col("p"), DIGITS), "relation")).alias("relation"))
    d = base.select("qid", "code", "base").join(best, ["qid", "code"], "full").withColumn("is_base", F.col("base").isNotNull())
    extra = F.row_number().over(Window.partitionBy("qid", "is_base").orderBy(F.desc("proximity"), "code"))
    d = d.withColumn("r", extra).where(F.col("is_base") | (F.col("r") <= s["added"])).na.fill(0.0, ["base", "proximity"])
    d = d.join(queries.select("qid", "q"), "qid").join(F.broadcast(profile.select("code", "t_canonical")), "code").withColumn("lex", overlap(F.col("q"), F.col("t_canonical")))
    w = Window.partitionBy("qid")
    lex = min_max(F.col("lex"), F.min("lex").over(w), F.max("lex").over(w))
    d = d.withColumn("raw", s["proximity"] * F.col("proximity") + (1 - s["proximity"]) * lex)
    graph = min_max(F.col("raw"), F.min("raw").over(w), F.max("raw").over(w))
    return d.select("qid", "code", "base", "proximity", rounded(graph, DIGITS).alias("graph"), F.when(F.col("is_base"), "base").otherwise(F.col("relation")).alias("relation"))


def pool_metrics(c: DataFrame, pool: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query: size of the pool, additions, whether the gold code came into it, noise among the additions, and shares of kinds of paths."""
    d = gold.join(pool, "qid").withColumn("lv", cpv.best_level(F.col("code"), F.col("golds"))).withColumn("added", F.col("relation") != "base")
    hit = F.array_contains("golds", F.col("code"))
    final = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round(F.col("base") + F.col("graph"), DIGITS)), "code"))
    d = d.withColumn("final", final)
    head = F.col("final") <= k
    g = d.groupBy("qid").agg(
        F.count("*").alias("pool_size"), F.count_if("added").alias("n_added"), F.max(hit.cast("int")).alias("pool_hit"), F.max((hit & head).cast("int")).alias("final_hit"), F.count_if(F.col("added") & (F.col("lv") == 0)).alias("n_noise"), F.count_if(F.col("added") & (F.col("lv") > 0)).alias("n_useful"),
        F.max(F.when(head, F.col("lv"))).alias("best_level"), F.count_if(head & F.col("added")).alias("n_paths"), F.count_if(head & F.col("relation").contains("sibling")).alias("n_sibling_paths"), F.count_if(head & F.col("relation").startswith("ppr_")).alias("n_step_paths"),
    )
    base = gold.join(c.where(F.col("rank") <= k), "qid").groupBy("qid").agg(F.max(F.array_contains("golds", F.col("code")).cast("int")).alias("base_hit"))
    g = g.join(base, "qid", "left")
    return g.select(
        "qid", "pool_size", "n_added", "n_useful", F.round(F.when(F.col("n_added") > 0, F.col("n_noise") / F.col("n_added")).otherwise(0.0), DIGITS).alias("noise_rate"), F.coalesce("base_hit", F.lit(0)).alias("base_hit"), "pool_hit", "final_hit",
        ((F.coalesce("base_hit", F.lit(0)) == 0) & (F.col("final_hit") == 1)).cast("int").alias("gold_delta"), ((F.col("pool_hit") == 1) & (F.col("final_hit") == 0)).cast("int").alias("pool_gap"), (F.col("best_level") >= 2).cast("int").alias("branch_recall"), (F.col("best_level") >= 6).cast("int").alias("class_recall"),
        F.round(F.when(F.col("n_paths") > 0, F.col("n_sibling_paths") / F.col("n_paths")).otherwise(0.0), DIGITS).alias("sibling_path_share"), F.round(F.when(F.col("n_paths") > 0, F.col("n_step_paths") / F.col("n_paths")).otherwise(0.0), DIGITS).alias("step_path_share"),
    )


def feedback_terms(c: DataFrame, profile: DataFrame, depth: int = 8, most: int = 6) -> DataFrame:
    """(qid, hint): words of the labels of the best codes that aren't in the query, most frequent first; pseudo relevance feedback for a second search."""
    t = c.where(F.col("rank") <= depth).select("qid", "code", "q").join(F.broadcast(profile.select("code", "t_label")), "code")
    w = t.select("qid", F.explode(F.array_except("t_label", "q")).alias("hint")).where(F.length("hint") > 2).groupBy("qid", "hint").agg(F.count("*").alias("n"))
    return w.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "hint"))).where(F.col("r") <= most).select("qid", "hint", "n")
