"""Queries: comparison of designs over a real sweep – three rankings of codes at two depths over all queries of plans.labels –, attribution and advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillway.functions import cpv
from rillway.functions.text import confidence
from rillway.operators import answers as A, design as D, evaluate as E, labels as L
from rillway.plans import answers as PA, labels as PL
from rillway.session import Scratch, table

FACTORS = ["reranker", "top_k"]
DEPTHS = (5, 10)


def _trace(spark, d):
    """(experiment, qid, …): outcome of every query under every design, scored; cut, as the tables below read it often."""
    q, _, c = PL._candidates(spark, d)
    keep = ["qid", "code", "score", "rank"]
    every = None
    for name, r in (("none", c), ("canonical", L.canonical_rerank(c)), ("focus", L.object_focus(c))):
        r = r.select(F.lit(name).alias("reranker"), *keep)
        every = r if every is None else every.unionByName(r)
    every = every.withColumn("top_k", F.explode(F.array(*map(F.lit, DEPTHS)))).where("rank <= top_k").join(q.select("qid", "gold", "n_words"), "qid")
    by = ["reranker", "top_k", "qid", "n_words"]
    lv = cpv.level(F.col("code"), F.col("gold"))
    from pyspark.sql.window import Window

    every = every.withColumn("gain", lv / 8.0).withColumn("hit", F.col("code") == F.col("gold")).withColumn("p", F.row_number().over(Window.partitionBy("reranker", "top_k", "qid").orderBy(F.desc("gain"), "rank")))
    g = every.groupBy(*by).agg(
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("gold_rank"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("gain") / F.log2(F.col("p") + 1)).alias("idcg"), F.max("gain").alias("best"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
    )
    right = F.coalesce(F.col("gold_rank") == 1, F.lit(False))
    reason = F.when(right, "ok").when(F.col("gold_rank").isNotNull(), "gold_present_but_not_ranked_first").when(F.col("best") >= 0.75, "same_class_wrong_code").when(F.col("best") >= 0.25, "same_branch_wrong_code").otherwise("gold_missing_from_top_k")
    t = g.select(
        F.concat_ws("-", "reranker", "top_k").alias("experiment"), "qid", F.when(F.col("n_words") <= 40, "short").otherwise("long").alias("question_type"), "reranker", "top_k", F.lit("overlap").alias("retriever"), F.round(F.coalesce(1 / F.col("gold_rank"), F.lit(0.0)), 6).alias("mrr_at_k"),
        F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")), 6).alias("ndcg_at_k"), F.col("gold_rank").isNotNull().cast("double").alias("recall_at_k"), right.cast("double").alias("auto_correct"), F.when(right, "correct").otherwise("incorrect").alias("auto_flag"), reason.alias("primary_reason"),
        F.round(confidence(F.col("s1")), 6).alias("prediction_confidence"), ((F.col("reranker") != "none").cast("double") + F.col("top_k") / 10.0).alias("cost"),
    )
    return Scratch(spark).cut(D.scored(t))


def design_trace(spark: SparkSession, d: str) -> DataFrame:
    return _trace(spark, d).select("experiment", "qid", "question_type", "mrr_at_k", "ndcg_at_k", "recall_at_k", "auto_flag", "primary_reason", F.round("retrieval_score", 6).alias("retrieval_score"), F.round("calibration_score", 6).alias("calibration_score"), "cost", "quality")


def design_comparisons(spark: SparkSession, d: str) -> DataFrame:
    return D.comparisons(_trace(spark, d), FACTORS)


def design_effects(spark: SparkSession, d: str) -> DataFrame:
    t = _trace(spark, d)
    return D.effects(t, D.comparisons(t, FACTORS), FACTORS)


def task_type_effects(spark: SparkSession, d: str) -> DataFrame:
    t = _trace(spark, d)
    return D.effects(t, D.comparisons(t, FACTORS), FACTORS, "question_type")


def failure_attribution(spark: SparkSession, d: str) -> DataFrame:
    t = _trace(spark, d)
    return D.failure_attribution(t, D.comparisons(t, FACTORS)).select("experiment", "qid", "primary_reason", "component", "suspects", "n_fixes", "best_fix", "best_delta")


def component_attribution(spark: SparkSession, d: str) -> DataFrame:
    return D.component_attribution(_trace(spark, d))


def cost_attribution(spark: SparkSession, d: str) -> DataFrame:
    return D.cost_attribution(_trace(spark, d))


def design_pareto(spark: SparkSession, d: str) -> DataFrame:
    return D.pareto_frontier(D.cost_attribution(_trace(spark, d)))


def group_explanations(spark: SparkSession, d: str) -> DataFrame:
    t = _trace(spark, d)
    p = D.comparisons(t, FACTORS)
    return D.group_explanations(D.failure_attribution(t, p), p)


def strategy_improvements(spark: SparkSession, d: str) -> DataFrame:
    return D.improvements(_trace(spark, d), "none-5")


def metrics_by_question_type(spark: SparkSession, d: str) -> DataFrame:
    return D.by_type(_trace(spark, d))


def score_experiments(spark: SparkSession, d: str) -> DataFrame:
    t = _trace(spark, d)
    s = t.groupBy("experiment").agg(F.count("*").alias("n"), F.count_if(F.col("auto_flag") == "correct").alias("n_correct"), F.count_if(F.col("recall_at_k") == 1).alias("n_partial"), F.avg("ndcg_at_k").alias("ndcg"), F.avg("mrr_at_k").alias("mrr"), F.avg("recall_at_k").alias("ragas_recall"))
    missing = ("faithfulness", "grounded", "claim_f1", "factual_f1", "attribution_f1", "noise", "context_recall", "entities_recall")
    return D.experiment_scores(s.select("*", *[F.lit(None).cast("double").alias(m) for m in missing]))


def _diagnostics(spark, d):
    r = PL.rank_diagnostics(spark, d)
    return r.withColumnRenamed("low_margin", "low_margin_decision").withColumn("prediction_confidence", F.col("confidence")).withColumn("auto_flag", F.when(F.col("failure_mode") == "ok", "correct").otherwise("incorrect"))


def row_advice(spark: SparkSession, d: str) -> DataFrame:
    return D.row_advice(_diagnostics(spark, d), "qid")


def answer_advice(spark: SparkSession, d: str) -> DataFrame:
    """Rules over answer metrics."""
    m = A.answer_metrics(PA._items(spark, d), PA._chunks(spark, d)).withColumnRenamed("grounded_ratio", "grounded_claim_ratio").withColumnRenamed("entities_recall", "context_entities_recall").withColumnRenamed("answer_claim_f1", "factual_correctness_f1")
    m = m.withColumn("proxy_faithfulness", F.col("faithfulness")).withColumn("answer_gold_support", F.col("gold_support")).withColumn("answer_is_good", F.col("label") == "correct").withColumn("gold_answer", F.lit("given"))
    return D.row_advice(m, "qid")


def _summary(spark, d):
    r = _diagnostics(spark, d)
    wrong = F.col("failure_mode") != "ok"
    rate = lambda c: F.round(F.avg(F.when(wrong, F.col(c).cast("int"))), 6)
    return r.agg(
        F.mode(F.when(wrong, F.col("likely_bottleneck")), True).alias("dominant_bottleneck"), F.round(F.avg(F.col("gold_rank").isNotNull().cast("int")), 6).alias("gold_present_rate"), F.round(F.avg(F.col("gold_rank").isNotNull().cast("int")), 6).alias("hit_at_k"), F.round(F.avg((~wrong).cast("int")), 6).alias("top1"),
        F.round(F.avg(F.col("high_confidence_wrong").cast("int")), 6).alias("high_conf_wrong_rate"), rate("duplicate_pressure").alias("error_duplicate_pressure_rate"), rate("low_diversity").alias("error_low_diversity_rate"), rate("short_query").alias("error_short_query_rate"), F.round(F.avg("best_hierarchy"), 6).alias("hierarchy_similarity"),
    )


def summary_advice(spark: SparkSession, d: str) -> DataFrame:
    return D.summary_advice(_summary(spark, d))


def run_advice(spark: SparkSession, d: str) -> DataFrame:
    return D.run_advice(_diagnostics(spark, d), "qid", _summary(spark, d))


def evidence_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of the wrong predictions."""
    q, _, c = PL._candidates(spark, d)
    top3 = c.where("rank <= 3").groupBy("qid").agg(F.count_distinct(F.substring("code", 1, 5)).alias("top3_branches"), F.count("*").alias("n_top3"))
    r = _diagnostics(spark, d).where("failure_mode <> 'ok' and top1 is not null").join(q.select("qid", "gold"), "qid").join(top3, "qid")
    return D.error_patterns(r.select(F.col("top1").alias("predicted"), "gold", cpv.inferred_parent(F.col("top1")).alias("p_parent"), cpv.inferred_parent(F.col("gold")).alias("g_parent"), F.col("low_margin_decision").alias("low_margin"), "duplicate_pressure", "high_confidence_wrong", "short_query", "low_diversity", F.col("gold_rank").isNotNull().alias("gold_present"), "top3_branches", "n_top3"))


def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    t = _diagnostics(spark, d)
    return D.expected_calibration_error(E.calibration(t, F.col("confidence"), F.col("failure_mode") == "ok"))


def decision_policy(spark: SparkSession, d: str) -> DataFrame:
    m = A.claim_metrics(PA._items(spark, d), A.claim_map(PA._items(spark, d), PA._chunks(spark, d))).select("qid", "unsupported_claims")
    o = A.overlaps(PA._items(spark, d), PA._chunks(spark, d)).select("qid", F.col("refusal").alias("abstained"))
    e = A.runtime_evidence(PA._items(spark, d), PA._chunks(spark, d)).select("qid", "status", F.col("score").alias("confidence"))
    return D.decision_policy(e.join(m, "qid").join(o, "qid"), "qid")


def parsing_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and lengths of the sections and paragraphs of each document."""
    s = table(spark, d, "doc_sections").groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("n_empty"), F.round(F.avg(F.coalesce(F.length("text"), F.lit(0))), 4).alias("mean_chars"), F.min(F.coalesce(F.length("text"), F.lit(0))).alias("min_chars"), F.max(F.coalesce(F.length("text"), F.lit(0))).alias("max_chars"))
    return s.join(table(spark, d, "doc_paragraphs").groupBy("doc_id").agg(F.count("*").alias("n_paragraphs")), "doc_id", "left").na.fill(0, ["n_paragraphs"])


QUERIES = {f.__name__: f for f in (design_trace, design_comparisons, design_effects, task_type_effects, failure_attribution, component_attribution, cost_attribution, design_pareto, group_explanations, strategy_improvements, metrics_by_question_type, score_experiments, row_advice, answer_advice, summary_advice, run_advice, evidence_patterns, calibration_error, decision_policy, parsing_diagnostics)}

_TR = PL._PROF + f""", rk as (select 'none' reranker, qid, code, score, rank from c0 union all select 'canonical', qid, code, score, rank from ({PL.ORACLE['canonical_rerank'][len(PL._PROF):]}) union all select 'focus', qid, code, score, rank from ({PL.ORACLE['object_focus_rerank'][len(PL._PROF):]})),
 ek as (select rk.*, top_k, gold, n_words, {PL.level('rk.code', 'gold')} / 8 gain, rk.code = gold hit from rk join qs using (qid), (select unnest([5, 10]) top_k) where rank <= top_k),
 ep as (select *, row_number() over (partition by reranker, top_k, qid order by gain desc, rank) p from ek),
 eg as (select reranker, top_k, qid, n_words, min(rank) filter (hit) gr, sum(gain / log2(rank + 1)) dcg, sum(gain / log2(p + 1)) idcg, max(gain) best, max(score) filter (rank = 1) s1 from ep group by all),
 t0 as (select reranker || '-' || top_k experiment, qid, case when n_words <= 40 then 'short' else 'long' end question_type, reranker, top_k, round(coalesce(1 / gr, 0), 6) mrr_at_k, round(case when idcg > 0 then dcg / idcg end, 6) ndcg_at_k, (gr is not null)::int::double recall_at_k, coalesce(gr = 1, false)::int::double auto_correct,
   case when gr = 1 then 'correct' else 'incorrect' end auto_flag, case when gr = 1 then 'ok' when gr is not null then 'gold_present_but_not_ranked_first' when best >= 0.75 then 'same_class_wrong_code' when best >= 0.25 then 'same_branch_wrong_code' else 'gold_missing_from_top_k' end primary_reason,
   round(case when s1 < 0 then 0.0 when s1 > 1 then s1 / (1 + s1) else s1 end, 6) prediction_confidence, (reranker <> 'none')::int + top_k / 10.0 as cost from eg),
 t1 as (select *, list_avg(list_filter([mrr_at_k, ndcg_at_k, recall_at_k], lambda x: x is not null)) retrieval_score, auto_correct generation_score, auto_flag <> 'correct' failed, case when auto_flag <> 'correct' then 1 - prediction_confidence else prediction_confidence end calibration_score, 1 / (1 + cost) cost_score from t0),
 tr as (select *, round((retrieval_score + generation_score) / 2, 6) quality from t1)
"""
_CMP = _TR + """, lo as (select qid, question_type, quality, 'reranker' factor, reranker "value", top_k::varchar rest from tr union all select qid, question_type, quality, 'top_k', top_k::varchar, reranker from tr),
 on1 as (select qid, question_type, factor, rest, "value", max(quality) quality from lo group by all),
 cp as (select a.qid, a.question_type, a.factor, a."value" left_value, b."value" right_value, round(b.quality - a.quality, 6) delta from on1 a join on1 b on a.qid = b.qid and a.factor = b.factor and a.rest = b.rest and a."value" < b."value"),
 sd as (select qid, question_type, factor, right_value "value", delta from cp union all select qid, question_type, factor, left_value, -delta from cp)
"""


def _effects(more: str = "") -> str:
    return _CMP + f""", vv as (select *, 'reranker' factor, reranker "value" from tr union all select *, 'top_k', top_k::varchar from tr),
 ef as (select {more} factor, "value", count(*) n_rows, count(distinct qid) n_questions, round(avg(quality), 5) mean_quality, round(avg(retrieval_score), 5) mean_retrieval, round(avg(generation_score), 5) mean_generation, round(avg(cost), 5) mean_cost, count(*) filter (failed) failures from vv group by all),
 md as (select {more} factor, "value", arg_min(primary_reason, (-n, primary_reason)) top_reason from (select {more} factor, "value", primary_reason, count(*) n from vv group by all) group by all),
 dl as (select {more} factor, "value", count(*) n_pairs, round(avg(delta), 5) mean_delta, round(avg(delta) - case when count(*) > 1 then 1.96 * stddev_samp(delta) / sqrt(count(*)) else 0 end, 5) ci_low, round(avg(delta) + case when count(*) > 1 then 1.96 * stddev_samp(delta) / sqrt(count(*)) else 0 end, 5) ci_high,
   round(avg((delta > 0)::int), 5) win_rate, round(avg((delta < 0)::int), 5) loss_rate, round(avg((delta = 0)::int), 5) tie_rate from sd group by all)
 select * from ef join md using ({more} factor, "value") left join dl using ({more} factor, "value")"""


def _nulls(conditions: list[str], have: set[str]) -> str:
    missing = sorted(set().union(*map(D.names_in, conditions)) - have)
    kind = lambda n: "boolean" if n in ("kg_enabled", "expected_answerable", "over_answered", "false_refusal", "likely_gold_over_specified", "answer_is_good") else "varchar" if n.endswith("reason") or n in ("runtime_status", "gold_answer", "claim_diagnostic") or n.startswith("dominant") else "double"
    return "".join(f", null::{kind(n)} {n}" for n in missing)


_T_COLS = {"mrr_at_k", "ndcg_at_k", "recall_at_k", "auto_flag", "primary_reason", "prediction_confidence", "retrieval_score", "generation_score", "calibration_score", "cost"}
_COMP = "case " + " ".join(f"when {c} then '{n}'" for n, c in D.COMPONENT_RULES) + " else 'unknown' end"
_CNULL = _nulls([c for _, c in D.COMPONENT_RULES] + [c for _, c in D.SUSPECT_RULES], _T_COLS)
_SUS = "list_filter([" + ", ".join(f"case when {c} then '{f.replace(' ', ',')}' end" for f, c in D.SUSPECT_RULES) + "], lambda x: x is not null)"
_D_COLS = {"failure_mode", "likely_bottleneck", "low_margin_decision", "duplicate_pressure", "low_diversity", "short_query", "prediction_confidence", "auto_flag"}
_DG = PL._DIAG + ", dg as (select * rename (low_margin as low_margin_decision), confidence prediction_confidence, case when failure_mode = 'ok' then 'correct' else 'incorrect' end auto_flag from gg)\n"
_RC = [r[4] for r in D.ROW_RULES] + [D.NO_ISSUE[3]]


def _fired() -> str:
    out, seen = [], {}
    for chain, comp, prio, issue, cond in D.ROW_RULES:
        c = f"coalesce({cond}, false)"
        if chain:
            prev = seen.get(chain)
            seen[chain] = f"{prev} or {c}" if prev else c
            c = f"{c} and not ({prev})" if prev else c
        out.append(f"case when {c} then {{'component': '{comp}', 'priority': '{prio}', 'issue': '{issue}'}} end")
    return "list_filter([" + ", ".join(out) + "], lambda x: x is not null)"


_ADV = _DG + f", ra as (select qid, {_fired()} a from (select *{_nulls(_RC, _D_COLS)} from dg)), rw as (select qid, x.component component, x.priority priority, x.issue issue from (select qid, unnest(a) x from ra))\n"
_S_COLS = {"dominant_bottleneck", "gold_present_rate", "hit_at_k", "top1", "high_conf_wrong_rate", "error_duplicate_pressure_rate", "error_low_diversity_rate", "error_short_query_rate", "hierarchy_similarity"}
_SUM = f""", sm as (select (select likely_bottleneck from dg where failure_mode <> 'ok' group by 1 order by count(*) desc, 1 limit 1) dominant_bottleneck, round(avg((gold_rank is not null)::int), 6) gold_present_rate, round(avg((gold_rank is not null)::int), 6) hit_at_k, round(avg((failure_mode = 'ok')::int), 6) top1, round(avg(high_confidence_wrong::int), 6) high_conf_wrong_rate,
  round(avg(duplicate_pressure::int) filter (failure_mode <> 'ok'), 6) error_duplicate_pressure_rate, round(avg(low_diversity::int) filter (failure_mode <> 'ok'), 6) error_low_diversity_rate, round(avg(short_query::int) filter (failure_mode <> 'ok'), 6) error_short_query_rate, round(avg(best_hierarchy), 6) hierarchy_similarity from dg),
 sr as (select x.component component, x.priority priority, x.issue issue from (select unnest(list_filter([{', '.join(f"case when {c} then {{'component': '{a}', 'priority': '{p}', 'issue': '{i}'}} end" for a, p, i, c in D.SUMMARY_RULES)}], lambda x: x is not null)) x from (select *{_nulls([r[3] for r in D.SUMMARY_RULES], _S_COLS)} from sm)))
"""
_PAR = lambda c: PL._PARENT.replace("code", c)
ORACLE = {
    "design_trace": _TR + "select experiment, qid, question_type, mrr_at_k, ndcg_at_k, recall_at_k, auto_flag, primary_reason, round(retrieval_score, 6) retrieval_score, round(calibration_score, 6) calibration_score, cost, quality from tr",
    "design_comparisons": _CMP + "select * from cp",
    "design_effects": _effects(),
    "task_type_effects": _effects("question_type, "),
    "failure_attribution": _CMP + f""", fa as (select experiment, qid, primary_reason, {_COMP} component, {_SUS} su from (select *{_CNULL} from tr where failed)), fx as (select qid, factor, "value", max(delta) delta from sd where abs(delta) >= 0.05 and delta > 0 group by all),
        fr as (select *, row_number() over (partition by qid order by delta desc, factor, "value") r from fx), fg as (select qid, count(*) n_fixes, arg_min(factor || '=' || "value", r) best_fix, round(max(delta), 5) best_delta from fr where r <= 5 group by 1)
        select experiment, qid, primary_reason, component, case when len(su) = 0 then 'manual_review' else array_to_string(list_distinct_ordered, ',') end suspects, coalesce(n_fixes, 0) n_fixes, best_fix, best_delta from (select *, list_filter(string_split(array_to_string(su, ','), ','), lambda x, i: list_position(string_split(array_to_string(su, ','), ','), x) = i) list_distinct_ordered from fa) left join fg using (qid)""",
    "component_attribution": _TR + f""", ca as (select *, case when failed then {_COMP} else 'success' end component from (select *{_CNULL} from tr)), cm as (select component, arg_min(primary_reason, (-n, primary_reason)) top_reason from (select component, primary_reason, count(*) n from ca group by all) group by 1), cq as (select component, arg_min(question_type, (-n, question_type)) top_question_type from (select component, question_type, count(*) n from ca group by all) group by 1)
        select component, count(*) n_rows, count(*) filter (failed) n_failures, any_value(top_reason) top_reason, any_value(top_question_type) top_question_type, round(avg(quality), 5) mean_quality, round(avg(retrieval_score), 5) mean_retrieval, round(avg(generation_score), 5) mean_generation, round(avg(calibration_score), 5) mean_calibration, round(avg(cost_score), 5) mean_cost_score from ca join cm using (component) join cq using (component) group by 1""",
    "cost_attribution": _TR + "select experiment, count(*) n_questions, round(sum(cost), 4) total_cost, round(avg(cost), 5) mean_cost, round(avg(quality), 5) mean_quality from tr group by 1",
    "design_pareto": _TR + ", co as (select experiment, round(avg(cost), 5) mean_cost, round(avg(quality), 5) mean_quality from tr group by 1) select experiment, mean_quality, mean_cost, (not exists (select 1 from co o where o.mean_quality >= co.mean_quality and o.mean_cost <= co.mean_cost and (o.mean_quality > co.mean_quality or o.mean_cost < co.mean_cost)))::int is_optimal from co",
    "strategy_improvements": _TR + ", im as (select t.experiment, round(t.quality - b.quality, 6) g from tr t join tr b on b.experiment = 'none-5' and b.qid = t.qid where t.experiment <> 'none-5') select experiment, count(*) filter (g > 0) improved, count(*) filter (g < 0) degraded, count(*) filter (g = 0) unchanged, round(avg(g), 5) mean_gain from im group by 1",
    "metrics_by_question_type": _TR + "select experiment, question_type, count(*) n, round(avg(quality), 5) mean_quality, round(avg(mrr_at_k), 5) mean_mrr, round(avg(recall_at_k), 5) mean_recall, round(avg(failed::int), 5) failure_rate from tr group by grouping sets ((experiment), (experiment, question_type))",
    "score_experiments": _TR + """, se as (select experiment, count(*) n, count(*) filter (auto_flag = 'correct') n_correct, 0.1::double answer_score, round((count(*) filter (auto_flag = 'correct') + 0.5 * count(*) filter (recall_at_k = 1)) / count(*), 6) correctness_score, round(0.3 * coalesce(avg(ndcg_at_k), 0) + 0.25 * avg(mrr_at_k) + 0.15 * avg(recall_at_k), 6) retrieval_score from tr group by 1),
        sf as (select *, round(0.45 * answer_score + 0.35 * correctness_score + 0.20 * retrieval_score, 6) total from se), sg as (select *, row_number() over (order by total desc, n_correct desc, experiment)::int rank from sf) select *, case when rank = 1 then 'best: ' || experiment || ' with total ' || printf('%.3f', total) end recommendation from sg""",
    "row_advice": _ADV + "select * from rw",
    "summary_advice": _DG + _SUM + "select * from sr",
    "run_advice": _ADV + _SUM + ", al as (select component, issue, min(priority) priority, count(*) n from rw where component <> 'none' group by 1, 2 union all select component, issue, priority, 0 from sr), ag as (select component, issue, min(priority) priority, sum(n)::bigint n from al group by 1, 2) select * from ag order by priority, n desc, component, issue limit 8",
    "evidence_patterns": _DG + f""", t3 as (select qid, count(distinct substr(code, 1, 5)) b, count(*) n3 from c0 where rank <= 3 group by 1), er as (select dg.*, gold, {_PAR('top1')} pp, {_PAR('gold')} gp, b, n3 from dg join qs using (qid) join t3 using (qid) where failure_mode <> 'ok' and top1 is not null),
        es as (select *, coalesce(pp = gold or gp = top1, false) pc from er), ec as (select count(*) n_errors, count(*) filter (pc) parent_child, count(*) filter (pp = gp and top1 <> gold and not pc) sibling, count(*) filter (substr(top1, 1, 2) = substr(gold, 1, 2)) same_division, count(*) filter (low_margin_decision and b <= 1) low_margin_same_branch, count(*) filter (b <= 1 and n3 >= 2) one_branch_top3,
        count(*) filter (duplicate_pressure) duplicate, count(*) filter (high_confidence_wrong) high_confidence, count(*) filter (short_query and gold_rank is null) short_query_missing, count(*) filter (low_diversity and gold_rank is null) low_diversity_missing from es)
        select *, round(greatest(parent_child, sibling) / n_errors, 6) hierarchy_signal, round(low_margin_same_branch / n_errors, 6) selection_signal, round(low_diversity_missing / n_errors, 6) retriever_signal, round(short_query_missing / n_errors, 6) query_enrichment_signal, round(duplicate / n_errors, 6) duplicate_pressure_error_rate, round(high_confidence / n_errors, 6) calibration_signal from ec""",
    "calibration_error": _DG + ", cb as (select least(floor(confidence * 5), 4) b, count(*) n, round(abs(avg(confidence) - avg((failure_mode = 'ok')::int)), 6) gap, round(avg((confidence - (failure_mode = 'ok')::int) ^ 2), 6) brier from dg where confidence is not null group by 1) select round(sum(n * gap) / sum(n), 6) ece, round(sum(n * brier) / sum(n), 6) brier, sum(n)::bigint n from cb",
    "parsing_diagnostics": "select s.*, coalesce(n_paragraphs, 0) n_paragraphs from (select doc_id, count(*) n_sections, count(*) filter (coalesce(length(text), 0) = 0) n_empty, round(avg(coalesce(length(text), 0)), 4) mean_chars, min(coalesce(length(text), 0)) min_chars, max(coalesce(length(text), 0)) max_chars from doc_sections group by 1) s left join (select doc_id, count(*) n_paragraphs from doc_paragraphs group by 1) p using (doc_id)",
}
