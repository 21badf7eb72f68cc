"""Queries: codes for documents – candidates, reranking, branches, learned scorer, confidence, diagnosis, expansion along the hierarchy.

A query is the text of a document that carries a code, which is its gold code; codes are those of the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillway.functions.text import tokens
from rillway.operators import labels as L
from rillway.session import Scratch, spread, table

K, DEPTH = 10, 20
LANGUAGES = ["en", "de", "fr", "es", "pt", "it", "nl", "pl", "sv", "el", "bg"]
#: Words of procurement actions.
ACTIONS = ["supply", "services", "works", "maintenance", "lieferung", "wartung", "suministro", "servicios", "fourniture", "fornitura", "levering", "dostawa"]


def _queries(spark, d):
    t = spread(table(spark, d, "documents").where("cpv_code is not null and text is not null").select(F.col("doc_id").alias("qid"), "text", F.array("cpv_code").alias("golds")))
    words = lambda c: F.array_distinct(tokens(c))
    return t.select(
        "qid", "golds", F.element_at("golds", 1).alias("gold"), words(F.col("text")).alias("q"), words(F.substring("text", 1, 80)).alias("t_object"), words(F.col("text")).alias("t_translated"),
        F.array_intersect(words(F.col("text")), F.array(*map(F.lit, ACTIONS))).alias("t_action"), words(F.substring("text", 1, 40)).alias("t_main"), words(F.substring("text", 81, 80)).alias("t_side"), words(F.substring("text", 161, 80)).alias("t_exclude"),
        F.size(tokens(F.col("text"))).alias("n_words"),
    )


def _profiles(spark, d):
    ex = table(spark, d, "cpv_notice_examples").where("example_text is not null").select("cpv_code", "example_id", "example_text")
    return Scratch(spark).cut(L.profiles(table(spark, d, "cpv_catalog"), ex, LANGUAGES))


def _candidates(spark, d):
    """Queries, profiles and the candidates with the texts of both sides; both tables are cut, as every step reads them again."""
    q, p = Scratch(spark).cut(_queries(spark, d)), _profiles(spark, d)
    c = L.candidates(q, p, DEPTH)
    return q, p, Scratch(spark).cut(c.join(q.drop("golds", "gold", "n_words"), "qid").join(F.broadcast(p), "code"))


_SHOWN = ("qid", "code", "bonus", "score", "rank")


def label_candidates(spark: SparkSession, d: str) -> DataFrame:
    return L.candidates(_queries(spark, d), _profiles(spark, d), DEPTH)


def label_features(spark: SparkSession, d: str) -> DataFrame:
    return L.label_features(_candidates(spark, d)[2]).select("qid", "code", *["f_" + f for f in L.FEATURES])


def zero_shot_scores(spark: SparkSession, d: str) -> DataFrame:
    return L.zero_shot(L.label_features(_candidates(spark, d)[2]), 15).select(*_SHOWN)


def canonical_rerank(spark: SparkSession, d: str) -> DataFrame:
    return L.canonical_rerank(_candidates(spark, d)[2]).select(*_SHOWN)


def object_focus_rerank(spark: SparkSession, d: str) -> DataFrame:
    return L.object_focus(_candidates(spark, d)[2]).select(*_SHOWN)


def dominant_branch(spark: SparkSession, d: str) -> DataFrame:
    return L.dominant_branch(_candidates(spark, d)[2])


def branch_selector(spark: SparkSession, d: str) -> DataFrame:
    return L.branch_selector(_candidates(spark, d)[2]).select(*_SHOWN)


def specificity_bias(spark: SparkSession, d: str) -> DataFrame:
    return L.specificity(_candidates(spark, d)[2]).select(*_SHOWN)


def hierarchical_beam(spark: SparkSession, d: str) -> DataFrame:
    return L.beam(_candidates(spark, d)[2]).select(*_SHOWN, "stage")


def local_branch_decision(spark: SparkSession, d: str) -> DataFrame:
    return L.local_branch(_candidates(spark, d)[2]).select(*_SHOWN)


def post_refine(spark: SparkSession, d: str) -> DataFrame:
    return L.post_refine(_candidates(spark, d)[2], K).select(*_SHOWN, "n_related")


def decision_gates(spark: SparkSession, d: str) -> DataFrame:
    return L.decision_gates(_candidates(spark, d)[2])


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    return L.hard_negatives(_queries(spark, d).select("qid", "gold", "q"), _profiles(spark, d))


def _pairs(spark, d):
    """Gold codes and hard negatives of all queries with features: training pairs; the sample of queries is bounded by the model's fit on 2,000 of them."""
    q, p, _ = _candidates(spark, d)
    some = q.orderBy(F.md5(F.col("qid").cast("string"))).limit(2000)
    good = some.select("qid", F.col("gold").alias("code"), F.lit(1).alias("y"), F.lit(1.0).alias("weight"))
    bad = L.hard_negatives(some.select("qid", "gold", "q"), p).select("qid", F.col("negative").alias("code"), F.lit(0).alias("y"), "weight")
    return L.label_features(good.unionByName(bad).join(q.drop("golds", "gold", "n_words"), "qid").join(F.broadcast(p), "code"))


def learned_label_scorer(spark: SparkSession, d: str) -> DataFrame:
    """Candidates ranked by a logistic regression trained on gold codes and hard negatives (at most 2,000 labelled queries)."""
    c = L.label_features(_candidates(spark, d)[2])
    return L.learned_scores(c, L.fit_label_scorer(_pairs(spark, d))).select("qid", "code", F.round("score", 3).alias("score"), "rank")


def pair_scorer(spark: SparkSession, d: str) -> DataFrame:
    """The head scored by a function in Arrow batches; here the share of the code's words that the query has, in place of a model."""

    def share(a, b):
        return [len(set(x.split()) & set(y.split())) / max(1, len(set(y.split()))) for x, y in zip(a, b)]

    return L.pair_scorer(_candidates(spark, d)[2], share, head=15).select("qid", "code", "score", "rank")


def stage_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return L.stage_prefixes(_candidates(spark, d)[2], 4)


def rank_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return L.rank_diagnostics(L.candidates(_queries(spark, d), _profiles(spark, d), DEPTH), _queries(spark, d).select("qid", "golds", "n_words"), K)


def rank_diagnostics_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts and rates over all queries and over the wrong ones, by failure mode."""
    r = rank_diagnostics(spark, d)
    flags = ("high_confidence_wrong", "low_margin", "duplicate_pressure", "low_diversity", "short_query")
    return r.rollup("failure_mode").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(f).cast("int")), 5).alias(f + "_rate") for f in flags], F.round(F.avg("margin"), 4).alias("mean_margin"), F.round(F.avg("best_hierarchy"), 4).alias("mean_best_hierarchy"))


def ranked_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return L.ranked_evaluation(L.candidates(_queries(spark, d), _profiles(spark, d), DEPTH), _queries(spark, d).select("qid", "golds"), K)[0]


def ranked_evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.ranked_evaluation(L.candidates(_queries(spark, d), _profiles(spark, d), DEPTH), _queries(spark, d).select("qid", "golds"), K)[1]


def scorer_benchmark(spark: SparkSession, d: str) -> DataFrame:
    q, _, c = _candidates(spark, d)
    return L.scorer_only(c, L.canonical_rerank(c), q.select("qid", "golds"))


def taxonomy_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return L.neighbours(table(spark, d, "cpv_catalog").select("code"), 8, 12)


def supported_branches(spark: SparkSession, d: str) -> DataFrame:
    return L.supported_branches(_candidates(spark, d)[2], 6)


def _pool(spark, d, name):
    q, p, c = _candidates(spark, d)
    return q, c, L.expand_pool(c, table(spark, d, "cpv_catalog").select("code"), q, p, name)


def taxonomy_pool_expand(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d, "balanced")[2]


def taxonomy_pool_walk(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d, "exploratory")[2]


def taxonomy_pool_safe(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d, "safe_branch")[2]


def taxonomy_pool_metrics(spark: SparkSession, d: str) -> DataFrame:
    q, c, pool = _pool(spark, d, "balanced")
    return L.pool_metrics(c, pool, q.select("qid", "golds"), K)


def query_feedback(spark: SparkSession, d: str) -> DataFrame:
    _, p, c = _candidates(spark, d)
    return L.feedback_terms(c.drop("t_label"), p)


QUERIES = {f.__name__: f for f in (label_candidates, label_features, zero_shot_scores, canonical_rerank, object_focus_rerank, dominant_branch, branch_selector, specificity_bias, hierarchical_beam, local_branch_decision, post_refine, decision_gates, hard_negatives, learned_label_scorer, pair_scorer, stage_prefixes, rank_diagnostics, rank_diagnostics_summary, ranked_evaluation, ranked_evaluation_summary, scorer_benchmark, taxonomy_neighbours, supported_branches, taxonomy_pool_expand, taxonomy_pool_walk, taxonomy_pool_safe, taxonomy_pool_metrics, query_feedback)}


# oracles


def tok(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}\p{{M}}]+'))"


def ov(a: str, b: str) -> str:
    return f"(case when len({a}) > 0 and len({b}) > 0 then len(list_intersect({a}, {b})) / len({a}) else 0.0 end)"


def mm(x: str, part: str = "partition by qid") -> str:
    return f"(case when max({x}) over ({part}) - min({x}) over ({part}) < 1e-12 then (case when max({x}) over ({part}) > 0 then 1.0 else 0.0 end) else ({x} - min({x}) over ({part})) / (max({x}) over ({part}) - min({x}) over ({part})) end)"


def level(a: str, b: str) -> str:
    return f"(case when {a} = {b} then 8 when substr({a}, 1, 6) = substr({b}, 1, 6) then 6 when substr({a}, 1, 4) = substr({b}, 1, 4) then 4 when substr({a}, 1, 2) = substr({b}, 1, 2) then 2 else 0 end)"


def bonus(source: str, extra: str, more: str = "") -> str:
    return f"select qid, code, bonus::double bonus, score, row_number() over (partition by qid order by score desc{', ' + more + ' desc' if more else ''}, code)::int rank{', ' + more if more else ''} from (select *, round(score0 + bonus, 6) score from (select *, score score0, round({extra} + 1e-9, 6) bonus from ({source})) s0) s1".replace("select *, round(score0", "select * exclude (score), round(score0")


_PARENT = "case when length(rtrim(code, '0')) > 2 then rpad(substr(code, 1, length(rtrim(code, '0')) - 1), 8, '0') end"
_CODES = f"""with recursive cat as (select code, coalesce(en, '') label, concat_ws(' ', {', '.join(x for x in LANGUAGES if x != 'en')}) alias, {_PARENT} parent from cpv_catalog),
 anc(code, d, a) as (select code, 0, parent from cat where parent is not null union all select anc.code, d + 1, {_PARENT.replace('code', 'anc.a')} from anc where {_PARENT.replace('code', 'anc.a')} is not null)
"""
_PROF = _CODES + f""", hi as (select anc.code, string_agg(label, ' ' order by d) hierarchy from anc join cat c on c.code = anc.a group by 1),
 ki as (select parent code, array_to_string(list(label order by code)[1:8], ' ') children from cat where parent is not null group by 1),
 si as (select x.code, array_to_string(list(y.label order by y.code)[1:8], ' ') siblings from cat x join cat y on x.parent = y.parent and x.code <> y.code group by 1),
 ex as (select cpv_code code, arg_min(example_text, example_id) example from cpv_notice_examples where example_text is not null group by 1),
 pf as (select c.code, c.parent, (case when c.code = rpad(substr(c.code, 1, 2), 8, '0') then 2 when c.code = rpad(substr(c.code, 1, 4), 8, '0') then 4 when c.code = rpad(substr(c.code, 1, 6), 8, '0') then 6 else 8 end) code_level,
   {tok('c.label')} t_label, {tok('c.alias')} t_alias, {tok("concat_ws(' ', hierarchy, p.label)")} t_hierarchy, {tok('p.label')} t_parent_label, {tok('children')} t_children, {tok('siblings')} t_siblings, {tok('example')} t_example, {tok("concat_ws(' ', c.label, c.alias, hierarchy)")} t_canonical
   from cat c left join hi using (code) left join ki using (code) left join si using (code) left join ex using (code) left join cat p on p.code = c.parent),
 qs as (select doc_id qid, [cpv_code] golds, cpv_code gold, {tok('text')} q, {tok('substr(text, 1, 80)')} t_object, {tok('text')} t_translated, list_intersect({tok('text')}, {ACTIONS}) t_action, {tok('substr(text, 1, 40)')} t_main, {tok('substr(text, 81, 80)')} t_side, {tok('substr(text, 161, 80)')} t_exclude,
   len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')) n_words from documents where cpv_code is not null and text is not null),
 te as (select code, unnest(list_distinct(list_concat(t_label, t_alias))) t from pf), nn as (select count(*) n from pf),
 ws as (select t, ln(1 + n / count(*)) w from te, nn group by t, n having count(*) <= 0.25 * n),
 c0 as (select * from (select qid, code, score, row_number() over (partition by qid order by score desc, code)::int rank from (select qid, code, round(sum(w), 6) score from (select qid, unnest(q) t from qs) join te using (t) join ws using (t) group by all)) where rank <= {DEPTH}),
 c as (select c0.*, pf.* exclude (code), q, t_object, t_translated, t_action, t_main, t_side, t_exclude from c0 join pf using (code) join qs using (qid))
"""
_FORMS = ("q", "t_object", "t_translated")


def _best(t: str) -> str:
    return "greatest(" + ", ".join(ov(q, t) for q in _FORMS) + ")"


_VARIANTS = [ov(q, t) for q in _FORMS for t in ("t_label", "t_alias", "t_hierarchy")]
_F = {
    "label": _best("t_canonical"), "variant_max": f"greatest({', '.join(_VARIANTS)})", "variant_mean": f"({' + '.join(_VARIANTS)}) / 9", "name": _best("t_label"), "description": _best("t_children"), "hierarchy": _best("t_hierarchy"), "alias": _best("t_alias"),
    "example": _best("t_example"), "parent": ov("t_object", "t_parent_label"), "action": ov("t_action", "t_canonical"),
}
_FEAT = _PROF + ", f as (select c.*, " + ", ".join(f"round({v}, 6) f_{k}" for k, v in _F.items()) + " from c)\n"
_ZS = "0.22 * f_label + 0.16 * f_variant_max + 0.08 * f_variant_mean + 0.18 * f_hierarchy + 0.16 * f_alias + 0.12 * f_example + 0.08 * f_action + 0.08 * prior + case when code_level >= 8 then 0.04 when code_level >= 6 then 0.02 else 0.0 end"
_CO, _CE = f"greatest({ov('q', 't_canonical')}, {ov('t_object', 't_canonical')})", f"greatest({ov('q', 't_example')}, {ov('t_object', 't_example')})"


def _dominant(widths: tuple[int, ...], source: str = "c") -> str:
    rel = " union all ".join(f"select qid, {i} i, substr(code, 1, {w}) branch, norm from hd" for i, w in enumerate(widths))
    return f""", hd as (select qid, code, {mm('score')} norm from {source} where rank <= 8),
 br as (select *, row_number() over (partition by qid, i order by round(w, 6) desc, branch) p from (select qid, i, branch, sum(norm) w, count(*) n from ({rel}) group by all)),
 dm as (select qid, arg_min(branch, i) branch from br where p = 1 and n >= 2 and round(w, 6) >= 0.8 group by 1)
"""


_GATES = f"""select qid, max(score) filter (rank = 1) s1, max(score) filter (rank = 2) s2, max(code) filter (rank = 1) k1, max(code) filter (rank = 2) k2, count(distinct case when rank <= 3 then substr(code, 1, 5) end) b5, count(distinct case when rank <= 4 then substr(code, 1, 6) end) b6 from c0 group by 1"""
_CONF = "(case when s1 < 0 then 0.0 when s1 > 1 then s1 / (1 + s1) else s1 end)"
_DIAG = _PROF + f""", tp as (select g.qid, g.n_words, code, rank, score, {level('code', 'gold')} lv, code = gold hit, case when sum(score) over (partition by g.qid) > 0 then score / sum(score) over (partition by g.qid) end sh from qs g left join (select * from c0 where rank <= {K}) using (qid)),
 gd as (select qid, any_value(n_words) n_words, count(code) n, min(rank) filter (hit) gold_rank, max(score) filter (rank = 1) s1, max(score) filter (rank = 2) s2, max(code) filter (rank = 1) top1, sum(case when sh > 0 then -sh * ln(sh) end) h, count(distinct code) uc, count(distinct substr(code, 1, 2)) ud, coalesce(max(lv), 0) / 8 best from tp group by 1),
 ge as (select *, round(s1 - s2, 6) margin, {_CONF} conf, case when gold_rank = 1 then 'ok' when gold_rank is not null then 'gold_present_but_not_ranked_first' when best >= 0.75 then 'same_class_wrong_code' when best >= 0.25 then 'same_branch_wrong_code' else 'gold_missing_from_top_k' end failure_mode from gd),
 gf as (select *, coalesce(gold_rank, 0) <> 1 and (coalesce(margin >= 1.2, false) or coalesce(conf >= 0.55, false)) high_confidence_wrong, coalesce((n - uc) / nullif(n, 0), 0) dup from ge),
 gg as (select qid, top1, gold_rank::int gold_rank, failure_mode, case when high_confidence_wrong then 'confidence_calibration' when failure_mode = 'ok' then 'none' when failure_mode = 'gold_present_but_not_ranked_first' then 'reranker_or_prompt_selection' when failure_mode = 'same_class_wrong_code' then 'sibling_disambiguation' when failure_mode = 'same_branch_wrong_code' then 'hierarchy_disambiguation' else 'candidate_generation_or_retriever' end likely_bottleneck,
   margin, round(case when n > 1 then h / ln(n) end, 6) entropy, uc::int unique_codes, ud::int unique_divisions, round(dup, 6) duplicate_rate, round(best, 3) best_hierarchy, high_confidence_wrong, coalesce(margin <= 0.8, false) low_margin, dup >= 0.1 or (n >= 3 and ud <= 2 and best >= 0.25) duplicate_pressure, n > 1 and ud <= 1 low_diversity, n_words <= 3 short_query, round(conf, 6) confidence from gf)
"""
_DIST = f"(case {level('code', 'gold')} when 8 then 0 when 0 then 8 else 8 - {level('code', 'gold')} end)"
_EVAL = _PROF + f""", e0 as (select g.qid, code, rank, coalesce(code = gold, false) hit, coalesce({level('code', 'gold')} / 8, 0) gain, case when code is not null then {_DIST} end near from qs g left join (select * from c0 where rank <= {K}) using (qid)),
 e1 as (select *, row_number() over (partition by qid order by gain desc, rank) p from e0),
 e2 as (select qid, coalesce(max(hit::int) filter (rank = 1), 0) top1, count(*) filter (hit) hits, count(code) ret, min(rank) filter (hit) fr, sum(gain / log2(rank + 1)) dcg, sum(gain / log2(p + 1)) idcg, min(near) best_distance, max(gain) bm, max(gain) filter (rank = 1) tm from e1 group by 1),
 e3 as (select qid, top1, (hits > 0)::int hit, round(hits / {K}, 6) precision_at_k, round(coalesce(hits / nullif(ret, 0), 0), 6) precision_returned, round(coalesce(1 / fr, 0), 6) reciprocal_rank, round(coalesce(dcg / nullif(idcg, 0), 0), 6) ndcg, best_distance, round(bm, 3) best_match, round(coalesce(tm, 0), 3) top1_match,
   case when ret = 0 then 'no_prediction' when top1 = 1 then 'ok' when hits > 0 then 'ranked_too_low' else 'missing' end reason from e2)
"""


def _neighbours(siblings: int, children: int) -> str:
    return f""", kd as (select *, row_number() over (partition by parent order by code) r from cat where parent is not null),
 nb0 as (select anc.code, a "to", 0 o, 'ancestor' relation from anc join cat c on c.code = anc.a
  union all select code, "to", 1, 'sibling' from (select x.code, y.code "to", row_number() over (partition by x.code order by y.code) n from kd x join kd y on x.parent = y.parent and x.code <> y.code) where n <= {siblings}
  union all select k.parent, k.code, 2, 'child' from kd k join cat c on c.code = k.parent where r <= {children}),
 nb as (select code, "to", arg_min(relation, o) relation from nb0 group by all)
"""


def _expand(name: str) -> str:
    s = L.PROFILES[name]
    dec = lambda t: "(case relation " + " ".join(f"when '{k}' then {v}" for k, v in t.items()) + " end)"
    sql = _PROF + _neighbours(s["siblings"], s["children"]) + f""", bs as (select qid, code, rank, round({mm('score')}, 6) base from c),
 sd as (select qid, code, round(greatest(base, 1 / rank), 6) p from bs where rank <= {s['seeds']})
"""
    walk = "sd"
    if s["strict"]:
        sql += f""", sb as (select qid, prefix from (select qid, unnest([substr(code, 1, 6), substr(code, 1, 4)]) prefix from (select qid, code, rank, {mm('score')} norm from c) where rank <= {s['seeds']} and norm >= 0.12) group by all having count(*) >= 2),
 wk as (select * from sd where exists (select 1 from sb where sb.qid = sd.qid and starts_with(sd.code, sb.prefix)))
"""
        walk = "wk"
    sql += f""", st0 as (select qid, nb."to" code, p * {dec(L.DECAY)} p, relation from {walk} join nb using (code)), fr0 as (select qid, code, p from sd)\n"""
    rels = ["select qid, code, p, relation from st0", "select qid, code, p, 'seed' from sd"]
    for i in range(s["steps"]):
        sql += f""", st{i + 1} as (select qid, nb."to" code, f.p * {dec(L.STEP_DECAY)} * {L.STEP_LOSS**i!r} p, 'ppr_' || relation relation from fr{i} f join nb using (code)), fr{i + 1} as (select qid, code, max(p) p from st{i + 1} group by all)\n"""
        rels.append(f"select qid, code, p, relation from st{i + 1}")
    sql += f""", rc as (select qid, code, round(max(p), 6) proximity, arg_min(relation, (-round(p, 6), relation)) relation from ({' union all '.join(rels)}) group by all),
 pl as (select *, row_number() over (partition by qid, base is not null order by proximity desc nulls last, code) r from (select qid, code, base, proximity, relation from bs full join rc using (qid, code))),
 pm as (select pl.qid, pl.code, coalesce(base, 0.0) base, coalesce(proximity, 0.0) proximity, case when base is not null then 'base' else relation end relation, {ov('q', 't_canonical')} lex from pl join qs using (qid) join pf using (code) where base is not null or r <= {s['added']}),
 pn as (select *, {s['proximity']} * proximity + {1 - s['proximity']!r} * {mm('lex')} raw from pm), po as (select qid, code, base, proximity, round({mm('raw')}, 6) graph, relation from pn)
"""
    return sql


_PM = _expand("balanced") + f""", pq as (select po.*, golds, gold, {level('po.code', 'gold')} lv, row_number() over (partition by qid order by round(base + graph, 6) desc, po.code) f from po join qs using (qid)),
 pr as (select qid, count(*) pool_size, count(*) filter (relation <> 'base') n_added, max((code = gold)::int) pool_hit, max((code = gold and f <= {K})::int) final_hit, count(*) filter (relation <> 'base' and lv = 0) nz, count(*) filter (relation <> 'base' and lv > 0) n_useful, max(case when f <= {K} then lv end) bl,
   count(*) filter (f <= {K} and relation <> 'base') np, count(*) filter (f <= {K} and relation like '%sibling%') ns, count(*) filter (f <= {K} and relation like 'ppr_%') nt from pq group by 1),
 bh as (select qid, max((code = gold)::int) base_hit from c0 join qs using (qid) where rank <= {K} group by 1)
 select qid, pool_size, n_added, n_useful, round(coalesce(nz / nullif(n_added, 0), 0), 6) noise_rate, coalesce(base_hit, 0) base_hit, pool_hit, final_hit, (coalesce(base_hit, 0) = 0 and final_hit = 1)::int gold_delta, (pool_hit = 1 and final_hit = 0)::int pool_gap, (bl >= 2)::int branch_recall, (bl >= 6)::int class_recall,
   round(coalesce(ns / nullif(np, 0), 0), 6) sibling_path_share, round(coalesce(nt / nullif(np, 0), 0), 6) step_path_share from pr left join bh using (qid)"""

_MEANS = ("top1", "hit", "precision_at_k", "precision_returned", "reciprocal_rank", "ndcg", "best_distance", "best_match", "top1_match")
_FLAGS = ("high_confidence_wrong", "low_margin", "duplicate_pressure", "low_diversity", "short_query")
_BEAM = _PROF + "".join(
    f""", b{w} as (select qid, p, s, row_number() over (partition by qid order by s desc, p) n from (select qid, p, round(0.7 * max(score) + 0.3 * avg(score), 6) s from (select qid, substr(code, 1, {w}) p, score, row_number() over (partition by qid, substr(code, 1, {w}) order by score desc, code) r from c0) where r <= 3 group by all))\n"""
    for w in L.BEAMS
)
ORACLE = {
    "label_candidates": _PROF + "select qid, code, score, rank from c0",
    "label_features": _FEAT + "select qid, code, " + ", ".join("f_" + f for f in L.FEATURES) + " from f",
    "zero_shot_scores": _FEAT + bonus(f"select *, {mm('score', 'partition by qid, rank <= 15')} prior from f", f"case when rank <= 15 then {_ZS} else 0.0 end"),
    "canonical_rerank": _PROF + bonus(f"select *, {mm('score')} norm from c", f"0.18 * {_CO} + 0.06 * {ov('t_action', 't_canonical')} + 0.05 * norm + case when {_CO} >= {_CE} then 0.04 else 0.0 end"),
    "object_focus_rerank": _PROF + bonus("select * from c", f"0.18 * {ov('t_main', 't_canonical')} + 0.06 * {ov('t_action', 't_canonical')} + 0.02 * {ov('t_side', 't_canonical')} - case when {ov('t_exclude', 't_canonical')} > {ov('t_main', 't_canonical')} then 0.10 * {ov('t_exclude', 't_canonical')} else 0.0 end"),
    "dominant_branch": _PROF + _dominant((6, 4)) + "select qid, branch from dm",
    "branch_selector": _PROF + _dominant((6, 4)) + bonus("select c.*, branch from c left join dm using (qid)", f"case when starts_with(code, branch) then (case when length(branch) >= 6 then 0.12 else 0.08 end) + (case when {ov('t_object', 't_canonical')} >= 0.18 then 0.05 else 0.0 end) + (case when {ov('q', 't_siblings')} > 0.08 then 0.03 else 0.0 end) - (case when code_level < 8 and {ov('q', 't_children')} > 0.10 then 0.04 else 0.0 end) else 0.0 end"),
    "specificity_bias": _PROF + f", ft as (select *, round({_CO}, 6) fit from c)\n" + bonus("select a.*, u.fit pfit, (select max(k.fit) from ft k where k.qid = a.qid and k.parent = a.code) cfit from ft a left join ft u on u.qid = a.qid and u.code = a.parent", "case when code_level >= 8 and fit >= round(pfit - 0.03, 6) then 0.09 else 0.0 end - case when code_level < 8 and cfit >= round(fit - 0.02, 6) then 0.10 else 0.0 end"),
    "hierarchical_beam": _BEAM + bonus("select c0.*, round(b2.s / 3 + b4.s / 3 + b6.s / 3, 6) stage, b2.n n2, b4.n n4, b6.n n6 from c0 join b2 on b2.qid = c0.qid and b2.p = substr(code, 1, 2) join b4 on b4.qid = c0.qid and b4.p = substr(code, 1, 4) join b6 on b6.qid = c0.qid and b6.p = substr(code, 1, 6)", "(case when n2 <= 4 then 0.03 else 0.0 end) + (case when n4 <= 6 then 0.05 else 0.0 end) + (case when n6 <= 10 then 0.07 else 0.0 end)", "stage"),
    "local_branch_decision": _PROF + _dominant((6, 4, 2)) + f", lb as (select qid, code, {mm('score')} norm, row_number() over (partition by qid order by score desc, code) r, count(*) over (partition by qid) n from c0 join dm using (qid) where starts_with(code, branch))\n" + bonus("select c0.*, norm, r from c0 left join (select * from lb where n >= 2) using (qid, code)", "coalesce(0.08 * norm + greatest(0.0, 0.08 - 0.01 * (r - 1)), 0.0)"),
    "post_refine": _PROF + f", t as (select c0.*, parent from c0 join cat using (code) where rank <= {K}), rl as (select a.qid, a.code, avg(b.score) support, count(*) n from t a join t b on a.qid = b.qid and a.code <> b.code where a.parent = b.parent or {level('a.code', 'b.code')} >= 4 or exists (select 1 from anc where anc.code = a.code and anc.a = b.code) or exists (select 1 from anc where anc.code = b.code and anc.a = a.code) group by all)\n" + bonus("select t.*, coalesce(support, 0) support, coalesce(n, 0) n_related from t left join rl using (qid, code)", "0.10 * support + least(0.03, 0.01 * n_related)").replace("select qid, code, bonus::double bonus, score,", "select qid, code, bonus::double bonus, score, n_related,"),
    "decision_gates": _PROF + f""", g as (select *, round(s1 - s2, 6) m, {level('k1', 'k2')} pr from ({_GATES})), h as (select *, case when s2 is null then 'not_enough_candidates' when m <= 0.10 then 'close_score_margin' when m <= 0.16 and (pr >= 4 or b6 <= 2) then 'same_branch_cluster' else 'high_confidence' end y from g)
        select qid, m margin, round(case when s2 is null then {_CONF} else greatest(0.05, least(1.0, {_CONF} * (0.45 + 0.55 * least(1.0, greatest(0.0, m) / 0.12)) * case when b5 <= 1 then 1.0 when b5 = 2 then 0.72 else 0.55 end)) end, 6) confidence, y in ('close_score_margin', 'same_branch_cluster') rerank, y rerank_reason,
        y in ('close_score_margin', 'same_branch_cluster') and (m <= 0.35 or (m <= 0.8 and (b5 <= 2 or pr >= 2))) ask_model from h""",
    "hard_negatives": _PROF + f""", p0 as (select qid, gold, n.code negative, {level('gold', 'n.code')} lv, coalesce(g.parent = n.parent, false) sib, round(0.60 * {ov('q', 'n.t_canonical')} + 0.25 * {ov('g.t_canonical', 'n.t_canonical')} + 0.15 * {level('gold', 'n.code')} / 8.0, 6) conf from qs join pf g on g.code = gold join pf n on n.code <> gold),
        p1 as (select *, case when sib then 4.5 when lv >= 6 then 4.0 when lv >= 4 then 3.0 when lv >= 2 then 2.0 else 1.0 end weight, md5(qid::varchar || '|' || negative) h, unnest(list_filter([case when sib or lv >= 4 then 0 end, case when sib then 1 end, case when lv >= 6 then 2 end, case when lv = 4 then 3 end, case when lv = 2 then 4 end, 5], lambda x: x is not null)) bucket from p0),
        p2 as (select *, row_number() over (partition by qid, bucket order by h, negative) dr from p1), p3 as (select *, row_number() over (partition by qid, bucket order by conf desc, negative) r from p2 where bucket in (0, 5) or dr <= 8),
        p4 as (select qid, gold, negative, weight, min(bucket * 10 + r) pl from p3 where r <= 3 group by all) select qid, gold, negative, weight::double weight from (select *, row_number() over (partition by qid order by pl, negative) n from p4) where n <= 6""",
    "stage_prefixes": _PROF + """, s0 as (select qid, substr(code, 1, 4) prefix, score, row_number() over (partition by qid, substr(code, 1, 4) order by score desc, code) r from c0), s1 as (select qid, prefix, round(0.55 * avg(score) filter (r <= 3) + 0.40 * max(score) + least(0.05, 0.01 * count(*)), 6) score from s0 group by all)
        select qid, prefix, score from (select *, row_number() over (partition by qid order by score desc, prefix) i, max(score) over (partition by qid) b from s1) where i <= 2 or score >= 0.9 * b""",
    "rank_diagnostics": _DIAG + "select * from gg",
    "rank_diagnostics_summary": _DIAG + "select failure_mode, count(*) n, " + ", ".join(f"round(avg({f}::int), 5) {f}_rate" for f in _FLAGS) + ", round(avg(margin), 4) mean_margin, round(avg(best_hierarchy), 4) mean_best_hierarchy from gg group by rollup (failure_mode)",
    "ranked_evaluation": _EVAL + "select * from e3",
    "ranked_evaluation_summary": _EVAL + "select count(*) n, " + ", ".join(f"round(avg({m}), 5) {m}" for m in _MEANS) + ", " + ", ".join(f"count(*) filter (reason = '{r}') n_{r}" for r in ("ok", "ranked_too_low", "missing", "no_prediction")) + " from e3",
    "taxonomy_neighbours": _CODES + _neighbours(8, 12) + 'select code, "to", relation from nb',
    "supported_branches": _PROF + f"select qid, prefix from (select qid, unnest([substr(code, 1, 6), substr(code, 1, 4)]) prefix from (select qid, code, rank, {mm('score')} norm from c) where rank <= 6 and norm >= 0.12) group by all having count(*) >= 2",
    "taxonomy_pool_expand": _expand("balanced") + "select * from po",
    "taxonomy_pool_walk": _expand("exploratory") + "select * from po",
    "taxonomy_pool_safe": _expand("safe_branch") + "select * from po",
    "taxonomy_pool_metrics": _PM,
    "query_feedback": _PROF + """, h0 as (select qid, unnest(list_filter(t_label, lambda w: not list_contains(q, w))) hint from c where rank <= 8), h1 as (select qid, hint, count(*) n from h0 where length(hint) > 2 group by all)
        select qid, hint, n from (select *, row_number() over (partition by qid order by n desc, hint) r from h1) where r <= 6""",
}
