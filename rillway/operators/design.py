"""Comparison of experiment designs: traces, paired comparisons, effects, attribution of failures, advice by rule tables.

A trace has a row per experiment and question with design factors, metrics and outcome. Rules are tables of SQL conditions
over the columns of a relation; a column that the relation lacks counts as null, and a null condition doesn't hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rillway.functions.text import rounded

#: Scores of a trace and the metrics they are the means of.
COMPONENTS = {
    "retrieval_score": ("mrr_at_k", "ndcg_at_k", "recall_at_k", "ragas_recall_at_k"), "generation_score": ("auto_correct", "answer_claim_recall", "factual_correctness_recall"), "grounding_score": ("grounded_claim_ratio", "evidence_attribution_f1"),
    "kg_score": ("gold_kg_relation_evidence_recall", "kg_graph_gain_at_k", "kg_added_evidence_precision", "kg_path_correctness"),
}
#: Rules of advice for a question: chain (of one chain only the first rule that holds counts), component, priority, issue, condition.
ROW_RULES = (
    ("c", "retriever", "P1", "Expected answer is missing from the candidate list", "failure_mode <> 'ok' and likely_bottleneck = 'candidate_generation_or_retriever'"),
    ("c", "selection", "P1", "Expected answer is retrieved but not selected", "failure_mode <> 'ok' and likely_bottleneck = 'reranker_or_prompt_selection'"),
    ("c", "hierarchy", "P2", "Prediction is in a related hierarchy branch but still wrong", "failure_mode <> 'ok' and likely_bottleneck in ('sibling_disambiguation', 'hierarchy_disambiguation')"),
    ("c", "calibration", "P1", "Wrong answer is predicted with high confidence", "failure_mode <> 'ok' and likely_bottleneck = 'confidence_calibration'"),
    ("", "prompt", "P2", "Top candidates are too close to choose blindly", "failure_mode <> 'ok' and low_margin_decision"),
    ("", "retriever", "P2", "Candidate list contains duplicate answers", "failure_mode <> 'ok' and duplicate_pressure"),
    ("", "retriever", "P2", "Candidate list stays inside one broad branch", "failure_mode <> 'ok' and low_diversity and not coalesce(duplicate_pressure, false)"),
    ("", "benchmark", "P3", "Query may be too short or ambiguous", "failure_mode <> 'ok' and short_query"),
    ("", "abstention", "P0", "Over-answering on unanswerable question", "not expected_answerable and over_answered"),
    ("", "abstention", "P1", "False refusal", "expected_answerable and false_refusal"),
    ("e", "retrieval", "P1", "Low evidence coverage", "context_claim_recall < 0.35 and not coalesce(likely_gold_over_specified, false)"),
    ("e", "retrieval", "P2", "Partial evidence coverage", "context_claim_recall < 0.7 and not coalesce(likely_gold_over_specified, false)"),
    ("", "retrieval", "P2", "Top result is useful but evidence set is incomplete", "mrr >= 0.9 and recall < 0.25 and not coalesce(answer_is_good, false)"),
    ("", "reranking", "P1", "Relevant evidence exists but is ranked too low", "mrr < 0.5 and recall >= 0.5"),
    ("", "generation", "P1", "Grounding failure despite available evidence", "context_claim_recall >= 0.75 and grounded_claim_ratio < 0.65"),
    ("", "generation", "P2", "Answer incomplete from available context", "context_claim_recall >= 0.75 and context_utilization < 0.7 and not coalesce(answer_is_good, false)"),
    ("", "retrieval", "P2", "Reference entities are not well covered in context", "context_entities_recall < 0.6"),
    ("", "generation", "P2", "Answer is grounded but still not factually complete", "factual_correctness_f1 < 0.6 and grounded_claim_ratio >= 0.7"),
    ("", "attribution", "P2", "Weak source attribution", "grounded_claim_ratio >= 0.75 and attribution_f1 < 0.7 and not coalesce(likely_gold_over_specified, false)"),
    ("", "attribution", "P1", "Invalid cited chunk IDs", "invalid_attribution_count > 0"),
    ("", "runtime_gate", "P2", "Runtime evaluator sees weak evidence", "runtime_status in ('weak_evidence', 'missing_evidence') and coalesce(expected_answerable, true)"),
    ("", "calibration", "P1", "Overconfident wrong prediction", "prediction_confidence >= 0.85 and auto_flag in ('incorrect', 'unsupported')"),
    ("", "evaluation", "P1", "Possible judge/evaluator false negative", "primary_reason in ('generation_hallucination', 'answer_unsupported') and answer_gold_support >= 0.8 and proxy_faithfulness >= 0.75"),
    ("", "benchmark", "P2", "Reference answer may include extra details beyond the question", "likely_gold_over_specified"),
    ("", "benchmark", "P1", "Answerable question lacks a reference answer", "expected_answerable and coalesce(gold_answer, '') = ''"),
)
#: The rule that holds where no other does.
NO_ISSUE = ("none", "P3", "No immediate issue detected", "claim_diagnostic = 'claim_level_ok'")
#: Rules of advice for a whole run: component, priority, issue, condition.
SUMMARY_RULES = (
    ("retriever", "P1", "Candidate coverage limits the maximum score", "dominant_bottleneck = 'candidate_generation_or_retriever' or gold_present_rate < 0.7"),
    ("selection", "P1", "Retrieved candidates are not being selected well", "dominant_bottleneck = 'reranker_or_prompt_selection' or hit_at_k - top1 >= 0.1"),
    ("hierarchy", "P2", "Errors are concentrated inside related hierarchy branches", "dominant_bottleneck in ('sibling_disambiguation', 'hierarchy_disambiguation')"),
    ("calibration", "P1", "Too many wrong predictions are high-confidence", "high_conf_wrong_rate >= 0.1"),
    ("retriever", "P2", "Top-k candidates contain too many duplicates", "error_duplicate_pressure_rate >= 0.2"),
    ("retriever", "P2", "Candidate lists lack hierarchy diversity", "error_low_diversity_rate >= 0.4"),
    ("benchmark", "P3", "Many queries may be under-specified", "error_short_query_rate >= 0.4"),
    ("reranking", "P1", "Correct candidate often exists but is not selected as top-1", "hit_at_k - top1 >= 0.15"),
    ("hierarchy", "P2", "Most errors are close rather than random", "hierarchy_similarity >= 0.7 and top1 < 0.7"),
    ("calibration", "P1", "Confidence is not reliable enough for automatic decisions", "ece >= 0.15"),
    ("explanation", "P2", "Not enough explanations are returned for failure analysis", "explanation_coverage < 0.8"),
    ("latency", "P3", "Classifier latency may become a deployment bottleneck", "latency_ms > 1500"),
    ("generation", "P1", "Evidence is available, but final answers still miss or distort facts", "mean_context_claim_recall >= 0.75 and mean_factual_f1 < 0.6"),
    ("retrieval", "P1", "Coverage is weak at both fact and entity level", "mean_context_claim_recall < 0.45 and mean_entity_recall < 0.6"),
    ("robustness", "P2", "The system is too sensitive to noisy or weakly relevant context", "mean_noise >= 0.25"),
    ("retrieval", "P1", "The dominant bottleneck is missing evidence early in the pipeline", "dominant_reason = 'retrieval_claim_miss' and mean_mrr < 0.5"),
    ("hierarchy", "P1", "Evidence graph shows repeated parent-child or sibling confusions", "hierarchy_signal >= 0.18"),
    ("selection", "P1", "Evidence graph shows many low-margin same-branch failures", "selection_signal >= 0.2"),
    ("retriever", "P2", "Evidence graph shows gold missing together with low candidate diversity", "retriever_signal >= 0.12"),
    ("query_enrichment", "P2", "Evidence graph shows many short-query misses where the gold code never enters top-k", "query_enrichment_signal >= 0.1"),
    ("examples", "P2", "Evidence graph suggests example quality or profile evidence may bias specific wrong codes", "examples_signal >= 0.3"),
    ("deduplication", "P3", "Evidence graph shows repeated duplicate-candidate pressure in failures", "duplicate_pressure_error_rate >= 0.15"),
    ("graph_coverage", "P1", "Graph-aware QA summary shows repeated misses where the required section or evidence path never enters context", "graph_coverage_signal >= 0.15"),
    ("context_selection", "P2", "Graph-aware QA summary shows related-rule or cross-version confusions inside the retrieved neighborhood", "context_selection_signal >= 0.12"),
    ("bridge_composition", "P2", "Graph-aware QA summary shows missing bridge facts on multi-hop or relation questions", "bridge_signal >= 0.1"),
    ("answer_synthesis", "P1", "Graph-aware QA summary shows answers failing even when graph-supported evidence is already available", "answer_synthesis_signal >= 0.2"),
    ("refusal_policy", "P2", "Graph-aware QA summary shows false refusals despite evidence-supported context", "refusal_policy_signal >= 0.12"),
    ("graph_noise", "P2", "Graph-aware QA summary shows noisy KG expansion around wrong answers", "graph_noise_signal >= 0.2"),
)
#: Which component a failed row points to: the first condition that holds.
COMPONENT_RULES = (
    ("document_parsing", "primary_reason like '%parse%' or primary_reason like '%empty_section%'"), ("chunking", "primary_reason like '%chunk%'"),
    ("answer_generation", "primary_reason like '%answer_incomplete_from_good_context%' and context_claim_recall >= 0.8 and grounding_score >= 0.8"),
    ("candidate_generation", "primary_reason like '%gold_missing%' or primary_reason like '%expected_answer_missing%' or primary_reason like '%candidate_generation%'"),
    ("candidate_ranking", "primary_reason like '%gold_present_but_not_ranked_first%' or primary_reason like '%ranking%' or primary_reason like '%rerank%'"),
    ("candidate_generation", "(primary_reason like '%weak_evidence%' or primary_reason like '%missing_evidence%' or primary_reason like '%retrieval%') and retrieval_score < 0.35"),
    ("context_selection", "primary_reason like '%weak_evidence%' or primary_reason like '%missing_evidence%' or primary_reason like '%retrieval%'"),
    ("candidate_generation", "recall_at_k < 0.35"), ("context_selection", "context_claim_recall < 0.5"), ("candidate_ranking", "mrr_at_k < 0.5 and recall_at_k >= 0.5"),
    ("taxonomy_disambiguation", "primary_reason like '%hierarchy_near_miss%' or primary_reason like '%same_branch%' or primary_reason like '%same_class%'"),
    ("calibration", "primary_reason like '%calibration%' or primary_reason like '%confidence%' or calibration_score < 0.4"), ("answer_generation", "primary_reason like '%hallucination%' or claim_diagnostic like '%hallucinated%'"),
    ("answer_generation", "(primary_reason like '%incomplete%' or primary_reason like '%claim%') and generation_score < 0.5"), ("context_selection", "primary_reason like '%incomplete%' or primary_reason like '%claim%'"),
    ("citation_attribution", "primary_reason like '%attribution%' or primary_reason like '%citation%' or grounding_score < 0.5"), ("benchmark_ambiguity", "primary_reason like '%ambiguous%' or primary_reason like '%benchmark%' or secondary_reason like '%ambiguous%'"),
    ("kg_noise", "kg_graph_noise_at_k > 0.25"), ("kg_expansion", "kg_enabled and kg_graph_gain_at_k <= 0"),
)
#: Design factors that a failed row makes suspect.
SUSPECT_RULES = (
    ("retriever top_k chunking_strategy chunk_size overlap document_parsing", "context_claim_recall < 0.5"), ("rerank_top_n rerank_weight score_fusion", "mrr_at_k < 0.5 and recall_at_k >= 0.5"), ("answer_mode prompt llm_model", "grounded_claim_ratio < 0.7 and context_claim_recall >= 0.7"),
    ("answer_mode prompt llm_model context_mode", "hallucinated_claim_ratio > 0.25"), ("kg_profile kg_graph_weight kg_quality_threshold kg_algorithm", "kg_graph_noise_at_k > 0.25"), ("kg_profile kg_algorithm kg_max_added_chunks", "kg_graph_gain_at_k <= 0 and kg_enabled"),
    ("answer_mode citation_schema prompt", "evidence_attribution_f1 < 0.7"), ("abstain_on_weak_evidence decision_thresholds runtime_retrieval_evaluator", "primary_reason in ('over_answering', 'false_refusal')"),
)
#: Causes in the design of a group of failures, in order; better_x is the paired value that does best, x the group's most frequent value.
_FINE = "(mean_context >= 0.85 and mean_grounded >= 0.85 and mean_hallucinated <= 0.1)"
_SYNTH = f"coalesce(component = 'answer_generation' and {_FINE}, false)"
GROUP_RULES = (
    ("refuses_with_evidence", "primary_reason = 'false_refusal' and mean_context >= 0.6"), ("refuses_on_thin_evidence", "primary_reason = 'false_refusal' and mean_recall < 0.35"), ("synthesis_incomplete", f"primary_reason = 'answer_incomplete_from_good_context' and {_FINE}"),
    ("ungrounded_despite_retrieval", "primary_reason = 'generation_hallucination' and mean_recall >= 0.5"), ("weak_attribution", "primary_reason = 'generation_hallucination' and mean_recall >= 0.5 and mean_attribution_f1 < 0.3"),
    ("extractive_by_design", f"{_SYNTH} and coalesce(answer_mode, '') in ('', 'extractive', 'extractive_answer')"), ("better_answer_mode_for_synthesis", f"{_SYNTH} and coalesce(answer_mode, '') not in ('', 'extractive', 'extractive_answer') and better_answer_mode is not null"),
    ("retriever_mismatch", f"better_retriever is not null and better_retriever <> retriever and not {_SYNTH}"), ("lexical_retriever", f"retriever in ('bm25', 'tfidf') and low_recall_rate > 0.6 and question_type in ('multi_hop', 'relation', 'summary_global') and not {_SYNTH}"),
    ("dense_misses_wording", f"retriever = 'dense' and component in ('taxonomy_disambiguation', 'candidate_generation') and low_recall_rate > 0.5 and not {_SYNTH}"), ("chunking_mismatch", f"better_chunking is not null and better_chunking <> chunking_strategy and not {_SYNTH}"),
    ("fixed_windows", f"chunking_strategy in ('fixed_words', 'fixed_tokens') and component in ('candidate_generation', 'context_selection') and low_recall_rate > 0.5 and not {_SYNTH}"), ("depth_mismatch", f"better_top_k is not null and better_top_k <> top_k and not {_SYNTH}"),
    ("depth_too_small", f"better_top_k is null and top_k <= 5 and low_recall_rate > 0.5 and not {_SYNTH}"), ("fusion_balance", f"better_hybrid_alpha is not null and not {_SYNTH}"), ("context_order", "better_context is not null"), ("context_drops_evidence", "better_context is null and context_mode in ('ranked', 'dedupe_section') and mean_context < 0.7 and component = 'context_selection'"),
    ("augmentation_underpowered", "better_query_aug is not null"), ("augmentation_off", "better_query_aug is null and coalesce(query_augmentation, '') in ('', 'none') and component in ('candidate_generation', 'context_selection') and question_type in ('multi_hop', 'relation', 'summary_global')"),
    ("answer_mode_mismatch", "better_answer_mode is not null"), ("answer_side_weak", f"better_answer_mode is null and coalesce(answer_mode, '') in ('', 'extractive', 'extractive_answer') and mean_context >= 0.8 and mean_grounded >= 0.8 and not {_SYNTH}"), ("model_matters", "better_llm_model is not null"),
    ("kg_missing", "better_kg_enabled in ('true', '1')"), ("kg_profile_mismatch", "better_kg_profile is not null"), ("kg_walk_mismatch", "better_kg_algorithm is not null"), ("kg_off", "kg_enabled_share < 0.5 and question_type in ('multi_hop', 'relation') and component in ('candidate_generation', 'context_selection') and low_recall_rate > 0.5"),
    ("coverage_low_after_first_hit", f"mean_mrr >= 0.7 and mean_recall < 0.5 and not {_SYNTH}"), ("poor_order", "mean_mrr < 0.45 and mean_recall >= 0.7"), ("reranking_off", "component = 'candidate_ranking' and coalesce(reranker, '') in ('', '0', 'none')"), ("ranking_knobs", "better_reranker is not null"),
    ("hallucination_rate", "mean_hallucinated > 0.25"), ("no_safety_layer", "high_hallucination_rate > 0.4 and retry_enabled_share = 0 and critique_enabled_share = 0"), ("kg_noisy", "component in ('kg_expansion', 'kg_noise') or high_kg_noise_rate > 0.25"), ("kg_doesnt_recover", "kg_enabled_share >= 0.5 and component = 'kg_expansion' and mean_recall < 0.5"),
    ("low_recall_everywhere", "component in ('candidate_generation', 'context_selection') and low_recall_rate > 0.6"), ("retrieval_still_weak", "component = 'answer_generation' and mean_recall < 0.5 and coalesce(mean_context < 0.8, true)"),
    ("confidence_untrustworthy", "component = 'calibration' and (high_confidence_share >= 0.5 or mean_confidence >= 0.75)"), ("ranking_quality_weak", "component = 'calibration' and mean_ndcg < 0.5"), ("context_lost_early", "low_context_rate > 0.5 and component = 'context_selection'"),
)


def names_in(condition: str) -> set[str]:
    import re

    words = set(re.findall(r"[a-z_][a-z_0-9]*", re.sub(r"'[^']*'", "", condition)))
    return words - {"and", "or", "not", "in", "is", "null", "like", "coalesce", "true", "false"}


def with_columns_for(df: DataFrame, conditions: list[str]) -> DataFrame:
    """df with null columns for the names that conditions use and df lacks."""
    flags = {"low_margin_decision", "duplicate_pressure", "low_diversity", "short_query", "expected_answerable", "over_answered", "false_refusal", "likely_gold_over_specified", "answer_is_good", "kg_enabled"}
    missing = sorted(set().union(*map(names_in, conditions)) - set(df.columns))
    text = lambda n: n in ("failure_mode", "likely_bottleneck", "runtime_status", "auto_flag", "gold_answer", "claim_diagnostic", "question_type", "component", "retriever", "chunking_strategy", "answer_mode", "context_mode", "query_augmentation", "reranker") or n.endswith("reason") or n.startswith(("better_", "dominant_"))
    return df.select("*", *[F.lit(None).cast("boolean" if n in flags else "string" if text(n) else "double").alias(n) for n in missing])


def first_rule(rules: tuple, default: str) -> Column:
    out = F.when(F.expr(rules[0][1]), rules[0][0])
    for name, cond in rules[1:]:
        out = out.when(F.expr(cond), name)
    return out.otherwise(default)


def row_advice(rows: DataFrame, key: str) -> DataFrame:
    """(key, component, priority, issue): what the rules say of each row; 'none' where no rule holds and the claims are in order."""
    conds = [r[4] for r in ROW_RULES] + [NO_ISSUE[3]]
    d = with_columns_for(rows, conds)
    fired, chains = [], {}
    for chain, comp, prio, issue, cond in ROW_RULES:
        c = F.coalesce(F.expr(cond), F.lit(False))
        if chain:
            before = chains.get(chain)
            chains[chain] = c if before is None else before | c
            c = c if before is None else c & ~before
        fired.append(F.when(c, F.struct(F.lit(comp).alias("component"), F.lit(prio).alias("priority"), F.lit(issue).alias("issue"))))
    d = d.withColumn("advice", F.array_compact(F.array(*fired)))
    none = F.when(F.coalesce(F.expr(NO_ISSUE[3]), F.lit(False)), F.array(F.struct(*[F.lit(x).alias(n) for x, n in zip(NO_ISSUE, ("component", "priority", "issue"))])))
    return d.select(key, F.inline(F.when(F.size("advice") > 0, F.col("advice")).otherwise(none)))


def summary_advice(summary: DataFrame) -> DataFrame:
    """(component, priority, issue) of the rules for a whole run that hold for its one row."""
    d = with_columns_for(summary, [r[3] for r in SUMMARY_RULES])
    rules = [F.when(F.coalesce(F.expr(c), F.lit(False)), F.struct(F.lit(a).alias("component"), F.lit(p).alias("priority"), F.lit(i).alias("issue"))) for a, p, i, c in SUMMARY_RULES]
    return d.select(F.inline(F.array_compact(F.array(*rules))))


def run_advice(rows: DataFrame, key: str, summary: DataFrame, most: int = 8) -> DataFrame:
    """The most urgent issues of a run, of questions and of the whole: by best priority, then number of questions; the advice 'none' only where there is no other."""
    a = row_advice(rows, key).where("component <> 'none'").groupBy("component", "issue").agg(F.min("priority").alias("priority"), F.count("*").alias("n"))
    b = summary_advice(summary).select("component", "issue", "priority", F.lit(0).cast("long").alias("n"))
    g = a.unionByName(b).groupBy("component", "issue").agg(F.min("priority").alias("priority"), F.sum("n").alias("n"))
    return g.orderBy("priority", F.desc("n"), "component", "issue").limit(most)


def mean_of(*columns: str) -> Column:
    """Mean of the columns that aren't null; null if all are."""
    a = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a))


def scored(trace: DataFrame) -> DataFrame:
    """A trace with component scores, costs' score and design quality; metrics that it lacks are null."""
    d = with_columns_for(trace, [" and ".join(m for ms in COMPONENTS.values() for m in ms), "hallucinated_claim_ratio and kg_graph_noise_at_k and prediction_confidence and kg_enabled and cost and primary_reason"])
    for name, metrics in COMPONENTS.items():
        d = d.withColumn(name, mean_of(*metrics))
    pair = lambda a, noise: F.when(F.col(noise).isNull(), F.col(a)).otherwise(F.coalesce((F.col(a) + 1 - F.col(noise)) / 2, 1 - F.col(noise)))
    d = d.withColumn("grounding_score", pair("grounding_score", "hallucinated_claim_ratio")).withColumn("kg_score", pair("kg_score", "kg_graph_noise_at_k"))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction_confidence")))
    d = d.withColumn("failed", F.coalesce(F.col("auto_flag") != "correct", F.col("primary_reason") != "ok", F.lit(False))).withColumn("calibration_score", F.when(F.col("failed"), 1 - c).otherwise(c)).withColumn("cost_score", 1 / (1 + F.col("cost")))
    d = d.withColumn("kg_part", F.when(F.col("kg_enabled"), F.col("kg_score")))
    return d.withColumn("quality", rounded(F.coalesce(mean_of("retrieval_score", "generation_score", "grounding_score", "kg_part"), F.lit(0.0)), 6)).drop("kg_part")


def comparisons(trace: DataFrame, factors: list[str]) -> DataFrame:
    """(qid, question_type, factor, left_value, right_value, delta): of each question the values of one factor under equal other factors, by quality; of several rows of a value the best counts."""
    long = trace.select("qid", "question_type", "quality", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("value"), F.concat_ws("\x01", *[F.coalesce(F.col(o).cast("string"), F.lit("")) for o in factors if o != f]).alias("rest")) for f in factors])).alias("x"))
    one = long.select("qid", "question_type", "x.*", "quality").where("value <> ''").groupBy("qid", "question_type", "factor", "rest", "value").agg(F.max("quality").alias("quality"))
    right = one.select("qid", "question_type", "factor", "rest", F.col("value").alias("right_value"), F.col("quality").alias("right_quality"))
    p = one.withColumnRenamed("value", "left_value").join(right, ["qid", "question_type", "factor", "rest"]).where("left_value < right_value")
    return p.select("qid", "question_type", "factor", "left_value", "right_value", rounded(F.col("right_quality") - F.col("quality"), 6).alias("delta"))


def _both_sides(pairs: DataFrame) -> DataFrame:
    """Each comparison from the side of both values."""
    return pairs.select("qid", "question_type", "factor", F.col("right_value").alias("value"), "delta").unionByName(pairs.select("qid", "question_type", "factor", F.col("left_value").alias("value"), (-F.col("delta")).alias("delta")))


def _deltas(d: DataFrame, *by: str) -> DataFrame:
    half = F.when(F.count("*") > 1, 1.96 * F.stddev_samp("delta") / F.sqrt(F.count("*"))).otherwise(0.0)
    r = lambda c: F.round(c, 5)
    return d.groupBy(*by).agg(F.count("*").alias("n_pairs"), r(F.avg("delta")).alias("mean_delta"), r(F.avg("delta") - half).alias("ci_low"), r(F.avg("delta") + half).alias("ci_high"), r(F.avg((F.col("delta") > 0).cast("int"))).alias("win_rate"), r(F.avg((F.col("delta") < 0).cast("int"))).alias("loss_rate"), r(F.avg((F.col("delta") == 0).cast("int"))).alias("tie_rate"))


def _values(trace: DataFrame, factors: list[str]) -> DataFrame:
    return trace.select("qid", "question_type", "failed", "primary_reason", "quality", "retrieval_score", "generation_score", "cost", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("value")) for f in factors])).alias("x")).select("*", "x.factor", "x.value").where("value <> ''").drop("x")


def _mode(c: str) -> Column:
    """Most frequent value, the smallest of equals."""
    return F.mode(c, True)


def effects(trace: DataFrame, pairs: DataFrame, factors: list[str], *more: str) -> DataFrame:
    """Per value of each factor (and further columns such as question_type): means, failures, and how it does in paired comparisons with an interval of 95 %. Factors of one value are left out."""
    v = _values(trace, factors)
    several = v.groupBy("factor").agg(F.count_distinct("value").alias("k")).where("k > 1").select("factor")
    by = [*more, "factor", "value"]
    r = lambda c: F.round(c, 5)
    m = v.join(several, "factor", "left_semi").groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_distinct("qid").alias("n_questions"), r(F.avg("quality")).alias("mean_quality"), r(F.avg("retrieval_score")).alias("mean_retrieval"), r(F.avg("generation_score")).alias("mean_generation"), r(F.avg("cost")).alias("mean_cost"), F.count_if("failed").alias("failures"), _mode("primary_reason").alias("top_reason"))
    return m.join(_deltas(_both_sides(pairs), *by), by, "left")


def failure_attribution(trace: DataFrame, pairs: DataFrame, fixes: int = 5, least: float = 0.05) -> DataFrame:
    """Of every failed row: suspect factors, likely component, and the best observed change of one factor for the same question, from the value that the row has."""
    conds = [c for _, c in COMPONENT_RULES] + [c for _, c in SUSPECT_RULES]
    d = with_columns_for(trace.where("failed"), conds)
    sus = F.array_distinct(F.flatten(F.array_compact(F.array(*[F.when(F.coalesce(F.expr(c), F.lit(False)), F.array(*map(F.lit, f.split()))) for f, c in SUSPECT_RULES]))))
    d = d.withColumn("component", first_rule(COMPONENT_RULES, "unknown")).withColumn("suspects", F.when(F.size(sus) > 0, F.array_join(sus, ",")).otherwise("manual_review"))
    better = _both_sides(pairs.where(F.abs("delta") >= least)).where("delta > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("delta"), "factor", "value")
    top = better.groupBy("qid", "factor", "value").agg(F.max("delta").alias("delta")).withColumn("r", F.row_number().over(w)).where(f"r <= {fixes}")
    f = top.groupBy("qid").agg(F.count("*").alias("n_fixes"), F.min_by(F.concat_ws("=", "factor", "value"), "r").alias("best_fix"), rounded(F.max("delta"), 5).alias("best_delta"))
    return d.join(f, "qid", "left").select("experiment", "qid", "question_type", "primary_reason", "component", "suspects", F.coalesce("n_fixes", F.lit(0)).alias("n_fixes"), "best_fix", "best_delta", "recall_at_k", "mrr_at_k", "prediction_confidence", "quality", *[c for c in ("retriever", "reranker", "top_k") if c in d.columns])


def component_attribution(trace: DataFrame) -> DataFrame:
    """Rows by likely component ('success' for those that didn't fail) with means and most frequent values."""
    d = with_columns_for(trace, [c for _, c in COMPONENT_RULES]).withColumn("component", F.when(F.col("failed"), first_rule(COMPONENT_RULES, "unknown")).otherwise("success"))
    r = lambda c: F.round(F.avg(c), 5)
    return d.groupBy("component").agg(F.count("*").alias("n_rows"), F.count_if("failed").alias("n_failures"), _mode("primary_reason").alias("top_reason"), _mode("question_type").alias("top_question_type"), r("quality").alias("mean_quality"), r("retrieval_score").alias("mean_retrieval"), r("generation_score").alias("mean_generation"), r("calibration_score").alias("mean_calibration"), r("cost_score").alias("mean_cost_score"))


def cost_attribution(trace: DataFrame) -> DataFrame:
    return trace.groupBy("experiment").agg(F.count("*").alias("n_questions"), F.round(F.sum("cost"), 4).alias("total_cost"), F.round(F.avg("cost"), 5).alias("mean_cost"), F.round(F.avg("quality"), 5).alias("mean_quality"))


def pareto_frontier(costs: DataFrame) -> DataFrame:
    """Experiments with whether another has at least their quality at no more cost and is better in one; one row per experiment, so the table is small."""
    o = costs.select(F.col("mean_quality").alias("oq"), F.col("mean_cost").alias("oc"))
    beaten = costs.join(F.broadcast(o), (F.col("oq") >= F.col("mean_quality")) & (F.col("oc") <= F.col("mean_cost")) & ((F.col("oq") > F.col("mean_quality")) | (F.col("oc") < F.col("mean_cost"))), "left_semi").select("experiment", F.lit(0).alias("is_optimal"))
    return costs.join(beaten, "experiment", "left").select("experiment", "mean_quality", "mean_cost", F.coalesce("is_optimal", F.lit(1)).alias("is_optimal"))


def group_explanations(failures: DataFrame, pairs: DataFrame, most: int = 8) -> DataFrame:
    """(component, question_type, primary_reason, n, causes): failures in groups with the causes in the design that the rules find, at most eight, 'manual_review' where none."""
    by = ["component", "question_type", "primary_reason"]
    r = lambda c: F.avg(c)
    g = failures.groupBy(*by).agg(
        F.count("*").alias("n"), r("recall_at_k").alias("mean_recall"), r("mrr_at_k").alias("mean_mrr"), r("prediction_confidence").alias("mean_confidence"), r((F.col("recall_at_k") < 0.5).cast("int")).alias("low_recall_rate"), r((F.col("prediction_confidence") >= 0.8).cast("int")).alias("high_confidence_share"),
        *[_mode(c).alias(c) for c in ("retriever", "reranker", "top_k") if c in failures.columns],
    )
    mine = failures.select("qid", *by).distinct().join(_both_sides(pairs.where("abs(delta) >= 0.03")).where("delta > 0").drop("question_type"), "qid")
    best = mine.groupBy(*by, "factor", "value").agg(F.count("*").alias("k"), F.avg("delta").alias("m"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy(*by, "factor").orderBy(F.desc("k"), F.desc(F.round("m", 6)), "value"))).where("r = 1")
    wide = best.groupBy(*by).agg(*[F.max(F.when(F.col("factor") == f, F.col("value"))).alias("better_" + f) for f in ("retriever", "reranker", "top_k")])
    d = with_columns_for(g.join(wide, by, "left"), [c for _, c in GROUP_RULES])
    fired = F.slice(F.array_compact(F.array(*[F.when(F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in GROUP_RULES])), 1, most)
    return d.select(*by, "n", F.round("mean_recall", 5).alias("mean_recall"), F.round("low_recall_rate", 5).alias("low_recall_rate"), F.when(F.size(fired) > 0, F.array_join(fired, ",")).otherwise("manual_review").alias("causes"))


def experiment_scores(summary: DataFrame, answer: float = 0.45, correctness: float = 0.35, retrieval: float = 0.20) -> DataFrame:
    """(experiment, answer_score, correctness_score, retrieval_score, total, rank, recommendation): experiments in order of the weighted total, then of correct answers; missing means count 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    a = 0.15 * z("faithfulness") + 0.20 * z("grounded") + 0.25 * z("claim_f1") + 0.20 * z("factual_f1") + 0.10 * z("attribution_f1") + 0.10 * (1 - z("noise"))
    c = F.when(F.col("n") > 0, (F.col("n_correct") + 0.5 * F.coalesce("n_partial", F.lit(0))) / F.col("n")).otherwise(0.0)
    q = 0.3 * z("ndcg") + 0.25 * z("mrr") + 0.15 * z("ragas_recall") + 0.15 * z("context_recall") + 0.15 * z("entities_recall")
    d = summary.select("experiment", "n", "n_correct", F.round(a, 6).alias("answer_score"), F.round(c, 6).alias("correctness_score"), F.round(q, 6).alias("retrieval_score"))
    d = d.withColumn("total", F.round(answer * F.col("answer_score") + correctness * F.col("correctness_score") + retrieval * F.col("retrieval_score"), 6))
    d = d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), F.desc("n_correct"), "experiment")))  # one row per experiment
    return d.withColumn("recommendation", F.when(F.col("rank") == 1, F.concat(F.lit("best: "), "experiment", F.lit(" with total "), F.format_number("total", 3))))


def improvements(trace: DataFrame, base: str) -> DataFrame:
    """(experiment, improved, degraded, unchanged, mean_gain): how each experiment changes the quality of the questions of a base experiment."""
    b = trace.where(F.col("experiment") == base).select("qid", F.col("quality").alias("q0"))
    d = trace.where(F.col("experiment") != base).join(b, "qid").withColumn("gain", F.round(F.col("quality") - F.col("q0"), 6))
    return d.groupBy("experiment").agg(F.count_if(F.col("gain") > 0).alias("improved"), F.count_if(F.col("gain") < 0).alias("degraded"), F.count_if(F.col("gain") == 0).alias("unchanged"), F.round(F.avg("gain"), 5).alias("mean_gain"))


def by_type(trace: DataFrame) -> DataFrame:
    """Means per experiment, over all and by question type, in one pass."""
    return trace.groupingSets([["experiment"], ["experiment", "question_type"]], "experiment", "question_type").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 5).alias("mean_quality"), F.round(F.avg("mrr_at_k"), 5).alias("mean_mrr"), F.round(F.avg("recall_at_k"), 5).alias("mean_recall"), F.round(F.avg(F.col("failed").cast("int")), 5).alias("failure_rate"))


def error_patterns(errors: DataFrame) -> DataFrame:
    """One row of counters, rates and signals over wrong predictions (predicted, gold, parents, flags, top-3 branches)."""
    c, n = F.col, F.count("*")
    d = errors.withColumn("pc", (c("p_parent") == c("gold")) | (c("g_parent") == c("predicted"))).withColumn("sb", (c("p_parent") == c("g_parent")) & (c("predicted") != c("gold")) & ~F.coalesce(c("pc"), F.lit(False)))
    one = c("top3_branches") <= 1
    k = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    g = d.agg(
        n.alias("n_errors"), k(c("pc")).alias("parent_child"), k(c("sb")).alias("sibling"), k(F.substring("predicted", 1, 2) == F.substring("gold", 1, 2)).alias("same_division"), k(c("low_margin") & one).alias("low_margin_same_branch"), k(one & (c("n_top3") >= 2)).alias("one_branch_top3"),
        k(c("duplicate_pressure")).alias("duplicate"), k(c("high_confidence_wrong")).alias("high_confidence"), k(c("short_query") & ~c("gold_present")).alias("short_query_missing"), k(c("low_diversity") & ~c("gold_present")).alias("low_diversity_missing"),
    )
    rate = lambda x: F.round(F.when(c("n_errors") > 0, c(x) / c("n_errors")).otherwise(0.0), 6)
    return g.select("*", F.greatest(rate("parent_child"), rate("sibling")).alias("hierarchy_signal"), rate("low_margin_same_branch").alias("selection_signal"), rate("low_diversity_missing").alias("retriever_signal"), rate("short_query_missing").alias("query_enrichment_signal"), rate("duplicate").alias("duplicate_pressure_error_rate"), rate("high_confidence").alias("calibration_signal"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """(ece, brier, n) from bins (n, gap, brier), weighted by their size."""
    return bins.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.round(F.sum(F.col("n") * F.col("brier")) / F.sum("n"), 6).alias("brier"), F.sum("n").alias("n"))


def decision_policy(rows: DataFrame, key: str, accept: float = 0.8, review: float = 0.5) -> DataFrame:
    """(key, decision, reasons): abstain on missing evidence or a refusal, review on weak evidence, low confidence or unsupported claims, else accept."""
    c = F.col
    why = F.array_compact(F.array(F.when(c("status") == "missing_evidence", "missing_evidence"), F.when(c("abstained"), "refusal"), F.when(c("status") == "weak_evidence", "weak_evidence"), F.when(c("confidence") < review, "low_confidence"), F.when((c("confidence") >= review) & (c("confidence") < accept), "medium_confidence"), F.when(c("unsupported_claims") > 0, "unsupported_claims")))
    decision = F.when((c("status") == "missing_evidence") | c("abstained"), "abstain").when(F.size(why) > 0, "manual_review").otherwise("auto_accept")
    return rows.select(key, decision.alias("decision"), F.array_join(why, ",").alias("reasons"))
