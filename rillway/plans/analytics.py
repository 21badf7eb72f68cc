"""Queries: code hierarchy, taxonomy neighbours, edge-table graph operators, ingestion, evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from rillway.functions import cpv
from rillway.functions.text import confidence, hash_share, min_max, safe_ratio
from rillway.operators import evaluate as E, graph as G
from rillway.operators.components import connected_components
from rillway.session import spread, table

MAIN = "regexp_extract(main_cpv_code, '([0-9]{8})', 1)"


# code hierarchy


def _predicted(spark, d):
    """Each notice's main code against the code of its documents, as prediction and gold."""
    n = table(spark, d, "ted_notices").select("publication_number", F.expr(MAIN).alias("gold")).where("gold <> ''").distinct()
    p = table(spark, d, "documents").where("cpv_code is not null").select("doc_id", "publication_number", F.col("cpv_code").alias("predicted"))
    return p.join(n, "publication_number")


def cpv_hierarchy_match(spark: SparkSession, d: str) -> DataFrame:
    lv = cpv.level(F.col("predicted"), F.col("gold"))
    return _predicted(spark, d).select("doc_id", "predicted", "gold", lv.alias("level"), cpv.match_score(F.col("predicted"), F.col("gold")).alias("score"), cpv.distance(F.col("predicted"), F.col("gold")).alias("distance"))


def cpv_match_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return cpv_hierarchy_match(spark, d).groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("mean_distance"))


def cpv_confusions_top10(spark: SparkSession, d: str) -> DataFrame:
    p = _predicted(spark, d).where("predicted <> gold").select(F.substring("gold", 1, 2).alias("gold_division"), F.substring("predicted", 1, 2).alias("predicted_division"))
    return p.groupBy("gold_division", "predicted_division").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold_division", "predicted_division").limit(10)


def cpv_best_match(spark: SparkSession, d: str) -> DataFrame:
    """Best level of each document's code with any main code of its notice's deliveries."""
    g = _predicted(spark, d).groupBy("doc_id", "predicted").agg(F.array_sort(F.collect_set("gold")).alias("golds"))
    return g.select("doc_id", cpv.best_level(F.col("predicted"), F.col("golds")).alias("best_level"), F.size("golds").alias("n_gold"))


def taxonomy_parents(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cpv_catalog").select("code", cpv.inferred_parent(F.col("code")).alias("parent"))
    known = c.select(F.col("code").alias("parent"), F.lit(1).alias("is_known"))
    return c.join(known, "parent", "left").select("code", "parent", F.coalesce("is_known", F.lit(0)).alias("parent_known"))


def taxonomy_ancestors(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cpv_catalog").select("code", F.posexplode(cpv.ancestors(F.col("code"))).alias("distance", "ancestor"))
    return c.select("code", "ancestor", (F.col("distance") + 1).alias("distance"))


def taxonomy_siblings(spark: SparkSession, d: str) -> DataFrame:
    """Each code's next sibling in code order and its number of siblings: a chain that holds all of them without pairing them."""
    c = table(spark, d, "cpv_catalog").select("code", cpv.inferred_parent(F.col("code")).alias("parent")).where("parent is not null")
    w = Window.partitionBy("parent").orderBy("code")
    return c.select("code", "parent", F.lead("code").over(w).alias("next_sibling"), (F.count("*").over(Window.partitionBy("parent")) - 1).alias("n_siblings"))


def branch_support(spark: SparkSession, d: str) -> DataFrame:
    """Branches of four digits with at least five notices and the division's dominant one."""
    n = table(spark, d, "ted_notices").select(F.expr(MAIN).alias("code")).where("code <> ''")
    b = n.groupBy(F.substring("code", 1, 4).alias("branch")).agg(F.count("*").alias("n")).where("n >= 5")
    w = Window.partitionBy(F.substring("branch", 1, 2)).orderBy(F.desc("n"), "branch")
    return b.select("branch", "n", (F.row_number().over(w) == 1).cast("int").alias("is_dominant"))


# channels


def _channel(spark, d):
    """Examples as hits of a channel: query = language, code, score by text length."""
    e = table(spark, d, "cpv_notice_examples")
    return e.select(F.col("source_field").alias("qid"), "cpv_code", "example_id", "publication_number", (F.length("example_text") / 280.0).alias("score"))


def channel_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Per query and code: .7 best + .3 mean of the three best + a bonus for support, and the best row; three rows are kept per group before they are gathered."""
    c = _channel(spark, d)
    w = Window.partitionBy("qid", "cpv_code").orderBy(F.desc("score"), "example_id")
    r = c.withColumn("r", F.row_number().over(w)).where("r <= 3")
    head = r.groupBy("qid", "cpv_code").agg(F.max("score").alias("best"), F.avg("score").alias("mean3"), F.max(F.when(F.col("r") == 1, F.col("example_id"))).alias("best_row"))
    n = c.groupBy("qid", "cpv_code").agg(F.count("*").alias("n"))
    return head.join(n, ["qid", "cpv_code"]).select("qid", "cpv_code", F.round(0.7 * F.col("best") + 0.3 * F.col("mean3") + F.least(F.lit(0.15), 0.03 * (F.col("n") - 1)), 6).alias("score"), "best_row", "n")


def channel_fuse(spark: SparkSession, d: str) -> DataFrame:
    a = channel_aggregate(spark, d).where("qid is not null")
    top = a.groupBy("cpv_code").agg(F.max("score").alias("example_score"))
    p = table(spark, d, "documents").where("cpv_code is not null").groupBy("cpv_code").agg(F.count("*").alias("k"))
    p = p.select("cpv_code", (F.col("k") / (F.col("k") + 5)).alias("profile_score"))
    both = F.when(F.col("example_score").isNotNull() & F.col("profile_score").isNotNull(), 0.05).otherwise(0.0)
    return top.join(p, "cpv_code", "full").select("cpv_code", F.round(0.44 * F.coalesce("profile_score", F.lit(0.0)) + 0.56 * F.coalesce("example_score", F.lit(0.0)) + both, 6).alias("score"))


def score_normalise(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("qid")
    a = channel_aggregate(spark, d)
    return a.select("qid", "cpv_code", F.round(min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w)), 6).alias("scaled"), F.round(confidence(F.col("score")), 6).alias("confidence"))


# knowledge graph: customers, nations, regions and orders as triples


def _edges(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("s"), F.lit("in_nation").alias("p"), F.concat(F.lit("n"), "c_nationkey").alias("o"), F.lit(0.5).alias("w"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("s"), F.lit("in_region").alias("p"), F.concat(F.lit("r"), "n_regionkey").alias("o"), F.lit(0.9).alias("w"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("s"), F.lit("in_nation").alias("p"), F.concat(F.lit("n"), "s_nationkey").alias("o"), F.lit(0.7).alias("w"))
    return c.unionByName(n).unionByName(s)


def kg_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Relations once each, with how often they were stated: supplier supplies part."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("subject"), F.lit("supplies").alias("predicate"), F.concat(F.lit("p"), "l_partkey").alias("object")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


def kg_degree(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    n = e.select(F.col("s").alias("node"), "p").unionByName(e.select(F.col("o").alias("node"), "p"))
    return n.groupBy("node").agg(F.count("*").alias("degree"), F.count_distinct("p").alias("n_predicates"))


def kg_components(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the connected components of suppliers and the nations of one region each."""
    e = _edges(spark, d)
    return connected_components(e, "s", "o").groupBy("component").agg(F.count("*").alias("n"))


def kg_predicate_entropy(spark: SparkSession, d: str) -> DataFrame:
    c = _edges(spark, d).groupBy("p").agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("t"))
    return c.join(F.broadcast(t), F.lit(True)).agg(F.round(F.sum(-(F.col("n") / F.col("t")) * F.log2(F.col("n") / F.col("t"))), 6).alias("entropy"), F.max("t").alias("edges"))


def kg_edge_dropout(spark: SparkSession, d: str) -> DataFrame:
    return G.dropout(_edges(spark, d), ["s", "p", "o"], "q1", 0.3).select("s", "p", "o")


def kg_hop_expand(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "region").where("r_regionkey = 1").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(1.0).alias("score"))
    h = G.hop_scores(_edges(spark, d), "s", "o", "w", seeds, 2, 0.55)
    return h.select("node", F.round("score", 6).alias("score"))


def kg_ppr(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit(1.0).alias("score"))
    e = _edges(spark, d)
    return G.personalised_pagerank(e, "s", "o", "w", seeds, 0.85, 3).select("node", F.round("score", 6).alias("score"))


# ingestion


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each notice; ties go to the larger row id."""
    w = Window.partitionBy("publication_number").orderBy(F.desc_nulls_last("ingested_at"), F.desc("notice_row_id"))
    t = table(spark, d, "ted_notices").withColumn("r", F.row_number().over(w)).where("r = 1")
    return t.select("publication_number", "notice_row_id", "main_cpv_code", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested"))


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ted_notices").select("publication_number").where("publication_number is not null").distinct()
    return t.select("publication_number", F.when(hash_share(F.col("publication_number")) < 0.2, "test").otherwise("train").alias("split"))


def top_languages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).where("trim(lang) <> ''").orderBy(F.desc("n"), "lang").limit(8)


def catalog_from_notices(spark: SparkSession, d: str) -> DataFrame:
    """Codes with at least three different example texts: first text in id order, number of texts and of notices."""
    e = table(spark, d, "cpv_notice_examples")
    g = e.groupBy("cpv_code").agg(F.count_distinct("example_text").alias("n_texts"), F.count_distinct("publication_number").alias("n_notices"), F.min_by("example_text", "example_id").alias("first_text"))
    return g.where("n_texts >= 3")


def example_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Best twelve different texts of each code, by source, length and number of tokens."""
    e = table(spark, d, "cpv_notice_examples").where("example_text is not null")
    weight = F.when(F.col("source_field").contains("title"), 0.3).when(F.col("source_field").contains("desc"), 0.2).otherwise(0.1)
    toks = F.size(F.filter(F.split("example_text", r"\s+"), lambda w: w != ""))
    score = F.round(weight + F.least(toks, F.lit(18)) * 0.015 - F.abs(F.length("example_text") - 140) / 700.0, 6)
    one = e.select("cpv_code", "example_text", "example_id", score.alias("score")).groupBy("cpv_code", "example_text").agg(F.max("score").alias("score"), F.min("example_id").alias("example_id"))
    w = Window.partitionBy("cpv_code").orderBy(F.desc("score"), "example_id")
    return one.withColumn("rank", F.row_number().over(w)).where("rank <= 12").select("cpv_code", "rank", "example_id", "score")


def asof_version(spark: SparkSession, d: str) -> DataFrame:
    """For each order, the customer's latest earlier order on a day before (as-of by window, not by join)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    days = o.groupBy("o_custkey", "day").agg(F.max_by("o_totalprice", "o_orderkey").alias("price"), F.max("o_orderkey").alias("last_key"))
    w = Window.partitionBy("o_custkey").orderBy("day")
    prev = days.select("o_custkey", "day", F.lag("last_key").over(w).alias("previous_key"), F.round(F.lag("price").over(w), 2).alias("previous_price"))
    return o.join(prev, ["o_custkey", "day"]).select("o_orderkey", "previous_key", "previous_price")


def prepared_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Wide predictions to ranked rows: the main code with its score, and every code of the list cell at a millionth less each; ordered by score, slot and place."""
    codes = F.regexp_extract_all(F.coalesce("all_cpv_codes_json", F.lit("")), F.lit(r"\d{8}"), F.lit(0))
    n = table(spark, d, "ted_notices").select("notice_row_id", F.array(F.expr(MAIN)).alias("c1"), codes.alias("c2"))
    long = n.select("notice_row_id", F.expr("stack(2, 1, c1, 0.9, 2, c2, 0.6) as (slot, cs, s)")).select("notice_row_id", "slot", "s", F.posexplode("cs").alias("at", "code")).where("code <> ''")
    long = long.withColumn("score", F.round(F.col("s").cast("double") - F.col("at") * 1e-6, 6))
    w = Window.partitionBy("notice_row_id").orderBy(F.desc("score"), "slot", "at")
    return long.select("notice_row_id", "code", "score", F.row_number().over(w).alias("rank"))


# evaluation tables


def confidence_calibration(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return E.calibration(li, F.col("l_quantity") / 50.0, F.col("l_returnflag") == "R")


def metrics_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Means by event type, and over all, in one pass."""
    e = table(spark, d, "events")
    return e.rollup("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.count_distinct("user_id").alias("users"))


def claim_support(spark: SparkSession, d: str) -> DataFrame:
    """Share of each paragraph's different tokens longer than two letters that its section has, and the verdict."""
    toks = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)[^\W_]+"), F.lit(0)), lambda t: F.length(t) > 2))
    s = table(spark, d, "doc_sections").groupBy("doc_id", "section_id").agg(F.min_by("text", "section_row_id").alias("sec"))
    s = spread(s).select("doc_id", "section_id", toks(F.col("sec")).alias("u"))  # tokens once per section, before the join repeats them
    p = spread(table(spark, d, "doc_paragraphs").select("paragraph_row_id", "doc_id", "section_id", "text")).select("paragraph_row_id", "doc_id", "section_id", toks(F.col("text")).alias("t"))
    j = p.join(s, ["doc_id", "section_id"]).select("paragraph_row_id", safe_ratio(F.size(F.array_intersect("t", "u")), F.size("t")).alias("share"))
    return j.select("paragraph_row_id", F.round("share", 6).alias("support"), F.when(F.col("share") >= 0.62, "supported").when(F.col("share") >= 0.35, "partial").otherwise("unsupported").alias("verdict"))


# design comparisons


def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("quality"), F.round("p_retailprice", 0).alias("cost"))
    return E.pareto(p, "quality", "cost")


def group_top_values(spark: SparkSession, d: str) -> DataFrame:
    """The three most frequent part types of each brand, with shares."""
    p = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_brand")
    r = p.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "p_type")))
    return r.where("rank <= 3")


QUERIES = {f.__name__: f for f in (cpv_hierarchy_match, cpv_match_breakdown, cpv_confusions_top10, cpv_best_match, taxonomy_parents, taxonomy_ancestors, taxonomy_siblings, branch_support, channel_aggregate, channel_fuse, score_normalise, kg_dedupe, kg_degree, kg_components, kg_predicate_entropy, kg_edge_dropout, kg_hop_expand, kg_ppr, upsert_latest, hash_split, top_languages, catalog_from_notices, example_ranking, asof_version, prepared_unpivot, confidence_calibration, metrics_by_type, claim_support, pareto_frontier, group_top_values)}

_PRED = f"""with n as (select distinct publication_number, {MAIN.replace("'([0-9]{8})', 1", "'[0-9]{8}'")} gold from ted_notices where regexp_matches(main_cpv_code, '[0-9]{{8}}')),
 p as (select doc_id, publication_number, cpv_code predicted, gold from documents join n using (publication_number) where cpv_code is not null),
 h as (select doc_id, predicted, gold, case when predicted = gold then 8 when substr(predicted, 1, 6) = substr(gold, 1, 6) then 6 when substr(predicted, 1, 4) = substr(gold, 1, 4) then 4 when substr(predicted, 1, 2) = substr(gold, 1, 2) then 2 else 0 end as level from p),
 hh as (select *, level / 8.0 score, (case level when 8 then 0 when 0 then 8 else 8 - level end)::int distance from h)
"""
_PAR = "case when length(rtrim(code, '0')) > 2 then rpad(substr(code, 1, length(rtrim(code, '0')) - 1), 8, '0') end"
_CH = """with c as (select source_field qid, cpv_code, example_id, length(example_text) / 280.0 score from cpv_notice_examples),
 r as (select *, row_number() over (partition by qid, cpv_code order by score desc, example_id) r, count(*) over (partition by qid, cpv_code) n from c),
 a as (select qid, cpv_code, round(0.7 * max(score) + 0.3 * avg(score) + least(0.15, 0.03 * (any_value(n) - 1)), 6) score, max(case when r = 1 then example_id end) best_row, any_value(n) n from r where r <= 3 group by all)
"""
_ED = """with e as (select 'c' || c_custkey s, 'in_nation' p, 'n' || c_nationkey o, 0.5 w from customer union all select 'n' || n_nationkey, 'in_region', 'r' || n_regionkey, 0.9 from nation
 union all select 's' || s_suppkey, 'in_nation', 'n' || s_nationkey, 0.7 from supplier), b as (select s u, o v, w from e union all select o, s, w from e),
 bs as (select u, v, sum(w) w from b group by all), bp as (select u, v, w / sum(w) over (partition by u) p from bs), bm as (select u, v, max(w) w from b group by all)
"""
_HOP = "select v node, max(s * w * 0.55) s from {} f join bm on bm.u = f.node group by 1"
_PPR = "select coalesce(f.node, s.node) node, 0.15 * coalesce(s.s, 0) + 0.85 * coalesce(f.f, 0) s from (select v node, sum(s * p) f from bp join {} x on x.node = bp.u group by 1) f full join s0 s on f.node = s.node"
ORACLE = {
    "cpv_hierarchy_match": _PRED + "select * from hh",
    "cpv_match_breakdown": _PRED + "select level, count(*) n, round(avg(distance), 6) mean_distance from hh group by 1",
    "cpv_confusions_top10": _PRED + "select substr(gold, 1, 2) gold_division, substr(predicted, 1, 2) predicted_division, count(*) n from p where predicted <> gold group by all order by 3 desc, 1, 2 limit 10",
    "cpv_best_match": _PRED + "select doc_id, max(level) best_level, count(distinct gold)::int n_gold from h group by 1",
    "taxonomy_parents": f"with c as (select code, {_PAR} parent from cpv_catalog) select code, parent, (parent in (select code from cpv_catalog) and parent is not null)::int parent_known from c",
    "taxonomy_ancestors": f"with recursive t as (select code, {_PAR} ancestor, 1 distance from cpv_catalog union all select code, {_PAR.replace('code', 'ancestor')}, distance + 1 from t where ancestor is not null) select code, ancestor, distance from t where ancestor is not null",
    "taxonomy_siblings": f"with c as (select code, {_PAR} parent from cpv_catalog) select code, parent, lead(code) over w next_sibling, count(*) over (partition by parent) - 1 n_siblings from c where parent is not null window w as (partition by parent order by code)",
    "branch_support": "with n as (select substr(regexp_extract(main_cpv_code, '[0-9]{8}'), 1, 4) branch, count(*) n from ted_notices where regexp_matches(main_cpv_code, '[0-9]{8}') group by 1 having count(*) >= 5) select branch, n, (row_number() over (partition by substr(branch, 1, 2) order by n desc, branch) = 1)::int is_dominant from n",
    "channel_aggregate": _CH + "select * from a",
    "channel_fuse": _CH + ", t as (select cpv_code, max(score) es from a where qid is not null group by 1), p as (select cpv_code, count(*) / (count(*) + 5) ps from documents where cpv_code is not null group by 1) select cpv_code, round(0.44 * coalesce(ps, 0) + 0.56 * coalesce(es, 0) + case when ps is not null and es is not null then 0.05 else 0 end, 6) score from t full join p using (cpv_code)",
    "score_normalise": _CH + ", m as (select *, min(score) over (partition by qid) lo, max(score) over (partition by qid) hi from a) select qid, cpv_code, round(case when hi - lo < 1e-12 then (case when hi > 0 then 1.0 else 0.0 end) else (score - lo) / (hi - lo) end, 6) scaled, round(case when score < 0 then 0.0 when score > 1 then score / (1 + score) else score end, 6) confidence from m",
    "kg_dedupe": "select 's' || l_suppkey subject, 'supplies' predicate, 'p' || l_partkey as object, count(*) n, min(l_orderkey) first_order from lineitem group by all",
    "kg_degree": _ED + "select node, count(*) degree, count(distinct p) n_predicates from (select s node, p from e union all select o, p from e) group by 1",
    "kg_components": "select min('c' || c_custkey) component, count(*) + (select count(*) from supplier s join nation on s_nationkey = n_nationkey where n_regionkey = r) + (select count(*) from nation where n_regionkey = r) + 1 n from (select c_custkey, n_regionkey r from customer join nation on c_nationkey = n_nationkey) group by r",
    "kg_predicate_entropy": _ED + ", c as (select p, count(*) n from e group by 1), t as (select sum(n) t from c) select round(sum(-(n / t) * log2(n / t)), 6) entropy, max(t)::bigint edges from c, t",
    "kg_edge_dropout": _ED + "select s, p, o from e where ('0x' || substr(sha256('q1|' || s || '|' || p || '|' || o), 1, 8))::bigint / 4294967295.0 >= 0.3",
    "kg_hop_expand": _ED + f", s0 as (select 'r' || r_regionkey node, 1.0 s from region where r_regionkey = 1), f1 as ({_HOP.format('s0')}), g1 as (select node, max(s) s from (select * from s0 union all select * from f1) group by 1), f2 as ({_HOP.format('f1')}) select node, round(max(s)::double, 6) score from (select * from g1 union all select * from f2) group by 1",
    "kg_ppr": _ED + f", s0 as (select 's' || s_suppkey node, 1.0 s from supplier where s_acctbal < 0), x1 as ({_PPR.format('s0')}), x2 as ({_PPR.format('x1')}), x3 as ({_PPR.format('x2')}) select node, round(s::double, 6) score from x3",
    "upsert_latest": "select publication_number, notice_row_id, main_cpv_code, strftime(ingested_at at time zone 'UTC', '%Y-%m-%d %H:%M:%S') ingested from (select *, row_number() over (partition by publication_number order by ingested_at desc nulls last, notice_row_id desc) r from ted_notices) where r = 1",
    "hash_split": "select distinct publication_number, case when ('0x' || substr(sha256(publication_number), 1, 8))::bigint / 4294967295.0 < 0.2 then 'test' else 'train' end split from ted_notices where publication_number is not null",
    "top_languages": "select lang, count(*) n from documents where trim(lang) <> '' group by 1 order by 2 desc, 1 limit 8",
    "catalog_from_notices": "select cpv_code, count(distinct example_text) n_texts, count(distinct publication_number) n_notices, min_by(example_text, example_id) first_text from cpv_notice_examples group by 1 having count(distinct example_text) >= 3",
    "example_ranking": r"""with e as (select cpv_code, example_text, max(round(case when contains(source_field, 'title') then 0.3 when contains(source_field, 'desc') then 0.2 else 0.1 end + least(len(list_filter(regexp_split_to_array(example_text, '\s+'), lambda w: w <> '')), 18) * 0.015 - abs(length(example_text) - 140) / 700.0, 6)) score, min(example_id) example_id from cpv_notice_examples where example_text is not null group by all)
        select cpv_code, rank, example_id, score from (select *, row_number() over (partition by cpv_code order by score desc, example_id) rank from e) where rank <= 12""",
    "asof_version": "with o as (select o_orderkey, o_custkey, o_orderdate::date d, o_totalprice from orders) select a.o_orderkey, b.o_orderkey previous_key, round(b.o_totalprice, 2) previous_price from o a left join lateral (select * from o b where b.o_custkey = a.o_custkey and b.d < a.d order by d desc, o_orderkey desc limit 1) b on true",
    "prepared_unpivot": r"with w as (select notice_row_id, regexp_extract(main_cpv_code, '[0-9]{8}') c1, regexp_extract_all(coalesce(all_cpv_codes_json, ''), '\d{8}') c2 from ted_notices), l as (select notice_row_id, 1 slot, 0 i, c1 code, 0.9::double score from w where c1 <> '' union all select notice_row_id, 2, i, c2[i + 1], round(0.6 - i * 1e-6, 6) from (select *, unnest(range(0, len(c2))) i from w)) select notice_row_id, code, score, row_number() over (partition by notice_row_id order by score desc, slot, i) rank from l",
    "confidence_calibration": "with d as (select greatest(0, least(1, l_quantity / 50.0)) c, (l_returnflag = 'R')::int y from lineitem) select least(floor(c * 5), 4)::int bin, count(*) n, round(avg(c), 6) mean_confidence, round(avg(y), 6) accuracy, round(abs(avg(c) - avg(y)), 6) gap, round(avg((c - y) ** 2), 6) brier from d group by 1",
    "metrics_by_type": "select event_type, count(*) n, round(avg(value), 4) mean_value, count(distinct user_id) users from events group by rollup (event_type)",
    "claim_support": r"""with s as (select doc_id, section_id, min_by(text, section_row_id) sec from doc_sections group by all), j as (select paragraph_row_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+'), lambda t: length(t) > 2)) t, list_distinct(list_filter(regexp_extract_all(lower(sec), '[\p{L}\p{N}\p{M}]+'), lambda t: length(t) > 2)) u from doc_paragraphs join s using (doc_id, section_id)),
        k as (select paragraph_row_id, case when len(t) > 0 then len(list_intersect(t, u)) / len(t) end x from j) select paragraph_row_id, round(x, 6) support, case when x >= 0.62 then 'supported' when x >= 0.35 then 'partial' else 'unsupported' end verdict from k""",
    "pareto_frontier": "with p as (select p_partkey, p_size::double quality, round(p_retailprice, 0) cost from part) select * from p a where not exists (select 1 from p b where b.quality >= a.quality and b.cost <= a.cost and (b.quality > a.quality or b.cost < a.cost))",
    "group_top_values": "with c as (select p_brand, p_type, count(*) n from part group by all) select * from (select *, round(n / sum(n) over (partition by p_brand), 6) share, row_number() over (partition by p_brand order by n desc, p_type) rank from c) where rank <= 3",
}
