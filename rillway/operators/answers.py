"""Evaluation of answers against gold answers and retrieved context, set at a time: claims, attribution, labels, diagnosis.

Items hold (qid, question, gold, answer, keywords, answerable), chunks (qid, rank, chunk_id, text). Texts are analysed
once each; claims are rows, so a long answer never has to fit one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rillway.functions import matching as M

SUPPORTED, IN_ANSWER, CONTRADICTS = 0.62, 0.55, 0.55


def claims(text: Column) -> Column:
    """Statements of a text in order: parts between sentence ends, semicolons, line ends, dashes and bullets, cut again before a capital or number after and, or, und, oder."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[;\n]", ". ")
    parts = F.split(flat, r"(?<=[.!?])\s+|\s+-\s+|\s+•\s+")
    parts = F.transform(parts, lambda p: F.regexp_replace(p, r"^[ \-•\t\r\n]+|[ \-•\t\r\n]+$", ""))
    cut = F.flatten(F.transform(parts, lambda p: F.split(p, r"\s+(?:und|oder|and|or)\s+(?=[A-ZÄÖÜ0-9])")))
    return F.array_distinct(F.filter(F.transform(cut, lambda c: F.regexp_replace(c, "^[ ,]+|[ ,]+$", "")), lambda c: c != ""))


def claim_rows(items: DataFrame, text: str) -> DataFrame:
    """(qid, no, claim and its forms): the claims of a text with at least two informative words."""
    rows = M.analysed(items.select("qid", F.posexplode(claims(F.col(text))).alias("no", "claim")), "claim", "c_")
    # two informative words, repeated ones counted
    return rows.where(F.size(F.filter("c_words", lambda w: F.length(w) > 2)) >= 2)


def reference_claims(items: DataFrame) -> DataFrame:
    """Claims of the gold answer; where it has none, its keywords."""
    gold = claim_rows(items, "gold")
    none = items.join(gold.select("qid").distinct(), "qid", "left_anti")
    keys = M.analysed(none.select("qid", F.posexplode(F.array_distinct(F.transform("keywords", lambda k: F.trim(k)))).alias("no", "claim")), "claim", "c_").where("size(c_tokens) > 0")
    return gold.unionByName(keys)


def reference_units(text: Column) -> Column:
    """Lines, sentences and bullets of eight characters and more, each once."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n+|(?<=[.!?])\s+|[-•]\s+")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(M.squeeze(p)) >= 8))


def support(p: str) -> Column:
    """How well the evidence with forms <p>* supports the claim of the row: covered words, .65 of that if a number is missing, at least .95 if it is there as a phrase or with all words."""
    cover = F.when((F.size("c_tokens") == 0) | (F.size(p + "tokens") == 0), 0.0).otherwise(M.share(F.col("c_tokens"), F.col(p + "tokens")))
    known = M.matches_keyword(F.col(p + "lemma"), F.col(p + "words"), F.col("c_lemma"), F.col("c_words"))
    short = F.when((F.size("c_numbers") > 0) & ~M.subset(F.col("c_numbers"), F.col(p + "numbers")), 0.65).otherwise(1.0)
    return F.when(cover == 0, 0.0).when(known, F.greatest(cover, F.lit(0.95))).otherwise(cover * short)


def contradicted(p: str) -> Column:
    """Both have numbers but none in common, and the claim's other words are largely in the evidence."""
    terms = F.array_except("c_tokens", "c_numbers")
    return (F.size("c_numbers") > 0) & (F.size(p + "numbers") > 0) & ~F.arrays_overlap("c_numbers", p + "numbers") & F.coalesce(M.share(terms, F.array_except(p + "tokens", p + "numbers")) >= CONTRADICTS, F.lit(False))


_FORMS = ("normal", "words", "lemma", "tokens", "numbers")


def _forms(df: DataFrame, text: str, p: str) -> DataFrame:
    return M.analysed(df.select("qid", text), text, p).drop(text)


def contexts(chunks: DataFrame) -> DataFrame:
    """(qid, context): the chunks of each item in rank order, as one text."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text")))
    return chunks.groupBy("qid").agg(F.array_join(F.transform(rows, lambda r: F.coalesce(r["text"], F.lit(""))), "\n").alias("context"))


def claim_map(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, claim_type, no, claim, in_context, in_answer, in_gold, contradicted, n_supporting, best_chunk, best_support): one row per claim of gold and answer.

    in_context is support by the context as a whole, n_supporting the chunks that support the claim by themselves.
    """
    context = _forms(items.select("qid").join(contexts(chunks), "qid", "left"), "context", "x_")
    answer = _forms(items, "answer", "a_")
    single = M.analysed(chunks.select("qid", "rank", "chunk_id", "text"), "text", "k_").drop("text", "k_normal")
    gold, said = reference_claims(items), claim_rows(items, "answer")
    both = gold.withColumn("claim_type", F.lit("gold")).unionByName(said.withColumn("claim_type", F.lit("answer")))
    # the evidence for each claim, one chunk at a time
    s = support("k_")
    per = both.join(single, "qid").select("qid", "claim_type", "no", "chunk_id", "rank", s.alias("s")).where(f"s >= {SUPPORTED}")
    per = per.groupBy("qid", "claim_type", "no").agg(F.count("*").alias("n_supporting"), F.min_by("chunk_id", F.struct(-F.col("s"), "rank")).alias("best_chunk"), F.round(F.max("s"), 6).alias("best_support"))
    # an answer's claim is in the gold answer if any of its claims supports it
    ref = gold.select("qid", *[F.col("c_" + f).alias("g_" + f) for f in _FORMS])
    in_gold = said.join(ref, "qid").groupBy("qid", "no").agg(F.max(support("g_") >= IN_ANSWER).alias("in_gold")).withColumn("claim_type", F.lit("answer"))
    told = both.join(context, "qid").join(answer, "qid").select(
        "qid", "claim_type", "no", "claim", (support("x_") >= SUPPORTED).alias("in_context"), (support("a_") >= IN_ANSWER).alias("in_answer"), contradicted("x_").alias("contradicted")
    )
    return told.join(in_gold, ["qid", "claim_type", "no"], "left").join(per, ["qid", "claim_type", "no"], "left").withColumn("n_supporting", F.coalesce("n_supporting", F.lit(0)))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r))


def claim_diagnostic() -> Column:
    """The first rule that holds, over the columns of claim_metrics."""
    c = F.col
    gold = c("gold_claims") > 0
    return (
        F.when((c("gold_claims") == 0) & (c("answer_claims") == 0), "no_claims_to_evaluate")
        .when(gold & (F.coalesce("context_claim_recall", F.lit(0.0)) < 0.35), "retrieval_claim_miss")
        .when(gold & (F.coalesce("context_claim_recall", F.lit(0.0)) < 0.7), "partial_evidence_retrieved")
        .when(c("contradicted_claims") > 0, "claim_contradiction")
        .when((F.coalesce("hallucinated_ratio", F.lit(0.0)) >= 0.35) | F.coalesce(c("grounded_ratio") < 0.65, F.lit(False)), "unsupported_generated_claims")
        .when(gold & (F.coalesce("answer_claim_recall", F.lit(0.0)) < 0.7), F.when(c("context_utilization") < 0.7, "answer_incomplete_from_available_context").otherwise("answer_incomplete"))
        .when(c("answer_claim_precision") < 0.75, "answer_contains_extra_claims")
        .otherwise("claim_level_ok")
    )


def claim_metrics(items: DataFrame, mapped: DataFrame) -> DataFrame:
    """Counts, ratios, attribution and noise of the claims of each item, and the claim diagnostic. Items without claims keep a row."""
    g, a = F.col("claim_type") == "gold", F.col("claim_type") == "answer"
    n = mapped.groupBy("qid").agg(
        F.count_if(g).alias("gold_claims"), F.count_if(a).alias("answer_claims"), F.count_if(g & F.col("in_context")).alias("gold_in_context"), F.count_if(g & F.col("in_answer")).alias("gold_in_answer"),
        F.count_if(g & F.col("in_context") & F.col("in_answer")).alias("gold_used"), F.count_if(a & F.col("in_gold")).alias("answer_in_gold"), F.count_if(a & F.col("in_context")).alias("answer_in_context"),
        F.count_if(a & F.col("contradicted")).alias("contradicted_claims"), F.count_if(a & (F.col("n_supporting") > 0)).alias("attributed_answer_claims"), F.count_if(g & (F.col("n_supporting") > 0)).alias("attributed_gold_claims"),
        F.count_if(a & (F.col("n_supporting") > 0) & ~F.coalesce("in_gold", F.lit(False))).alias("beside_gold"),
    )
    d = items.select("qid").join(n, "qid", "left").na.fill(0)
    c = F.col
    d = d.select(
        "*", ratio(c("gold_in_context"), c("gold_claims")).alias("context_claim_recall"), ratio(c("gold_in_answer"), c("gold_claims")).alias("answer_claim_recall"),
        ratio(c("answer_in_gold"), c("answer_claims")).alias("answer_claim_precision"), ratio(c("answer_in_context"), c("answer_claims")).alias("grounded_ratio"),
        ratio(c("answer_claims") - c("answer_in_context"), c("answer_claims")).alias("hallucinated_ratio"), ratio(c("gold_used"), c("gold_in_context")).alias("context_utilization"),
        ratio(c("attributed_answer_claims"), c("answer_claims")).alias("attribution_precision"), ratio(c("attributed_gold_claims"), c("gold_claims")).alias("attribution_recall"),
        ratio(F.least(c("answer_claims"), c("answer_claims") - c("answer_in_context") + c("contradicted_claims")), c("answer_claims")).alias("noise_relevant"), ratio(c("beside_gold"), c("answer_claims")).alias("noise_irrelevant"),
    )
    d = d.withColumn("answer_claim_f1", harmonic(c("answer_claim_precision"), c("answer_claim_recall"))).withColumn("attribution_f1", harmonic(c("attribution_precision"), c("attribution_recall")))
    return d.withColumn("unsupported_claims", c("answer_claims") - c("answer_in_context")).withColumn("missing_gold_claims", c("gold_claims") - c("gold_in_answer")).withColumn("claim_diagnostic", claim_diagnostic())


def overlaps(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Overlaps of question, answer, gold answer and context of each item, refusal, polarity and proxy entities; null where there is nothing to compare with."""
    d = items.join(contexts(chunks), "qid", "left")
    for t, p in (("question", "q_"), ("answer", "a_"), ("gold", "g_"), ("context", "x_")):
        d = M.analysed(d, t, p)
    c = F.col
    for t, p in (("answer", "a_"), ("gold", "g_"), ("context", "x_")):
        d = d.withColumn(p + "names", M.proxy_entities(F.coalesce(t, F.lit("")), c(p + "normal")))
    has_context, has_gold = F.trim(F.coalesce("context", F.lit(""))) != "", F.trim(F.coalesce("gold", F.lit(""))) != ""
    over = lambda a, b: F.coalesce(M.share(c(a), c(b)), F.lit(None).cast("double"))
    return d.select(
        "qid", "answerable", "gold", "answer",
        F.when(has_context, over("q_tokens", "x_tokens")).alias("context_relevance"), F.when(has_context, over("a_tokens", "x_tokens")).alias("faithfulness"),
        F.when(has_gold, over("g_tokens", "a_tokens")).alias("gold_overlap"), F.when(has_gold, M.new_support(c("a_tokens"), c("q_tokens"), c("g_tokens"))).alias("gold_support"),
        F.when(has_gold, F.contains("a_normal", "g_normal")).alias("has_gold"), M.refuses(c("a_normal")).alias("refusal"), M.polarity(c("g_normal")).alias("gold_polarity"), M.polarity(c("a_normal")).alias("answer_polarity"),
        M.share(c("g_names"), c("x_names")).alias("entities_recall"), F.when(F.size("g_names") > 0, M.share(c("a_names"), c("g_names"))).alias("entity_precision"),
    )


def answer_label() -> Column:
    """Label of an answer by ordered rules over overlaps, claim diagnostic and decisive markers; needs a BOOLEAN decisive."""
    c = F.col
    f, over, sup, diag = c("faithfulness"), F.coalesce("gold_overlap", F.lit(0.0)), F.coalesce("gold_support", F.lit(0.0)), c("claim_diagnostic")
    ok, bad = f.isNull() | (f >= 0.45), F.coalesce(f < 0.35, F.lit(False))
    worse = F.when(bad, "unsupported").otherwise("incorrect")
    soft = diag.isin("answer_contains_extra_claims", "claim_contradiction", "unsupported_generated_claims")
    incomplete = F.when(ok & (over >= 0.20), "correct").when((over >= 0.12) | (~(ok & (over >= 0.12)) & (sup >= 0.04)), "partially_correct").otherwise("incorrect")
    missed = F.when(sup < 0.05, worse).when(ok & (over >= 0.25), "correct").when(over >= 0.20, "partially_correct").otherwise("incorrect")
    return (
        F.when(F.coalesce("has_gold", F.lit(False)) & ok, "correct")
        .when(c("refusal"), worse)
        .when(c("gold_polarity") != c("answer_polarity"), "incorrect")
        .when(ok & ((sup >= 0.75) | (c("decisive") & ((over >= 0.25) | soft))), "correct")
        .when(diag.isin("unsupported_generated_claims", "claim_contradiction"), worse)
        .when(diag == "answer_incomplete_from_available_context", incomplete)
        .when(diag == "retrieval_claim_miss", missed)
        .when(ok & (over >= 0.25) & (sup >= 0.05), "correct")
        .when(ok & (((over >= 0.20) & (sup >= 0.03)) | (over >= 0.15) | (sup >= 0.06)), "partially_correct")
        .when(bad, "unsupported")
        .when((over >= 0.20) | (sup >= 0.05), "partially_correct")
        .otherwise("incorrect")
    )


def answer_metrics(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """All answer-level figures of each item: overlaps, claim metrics, abstention and the final label."""
    d = overlaps(items, chunks).join(claim_metrics(items, claim_map(items, chunks)), "qid")
    d = d.withColumn("decisive", M.decisively_covered(M.markers("gold"), M.markers("answer")))
    c = F.col
    over, sup = F.coalesce("gold_overlap", F.lit(0.0)), F.coalesce("gold_support", F.lit(0.0))
    claims_ok = F.coalesce(c("answer_claim_f1") >= 0.8, F.lit(False)) & (c("grounded_ratio").isNull() | (c("grounded_ratio") >= 0.75))
    same_side = F.coalesce(c("gold_polarity") == c("answer_polarity"), F.lit(False))
    answer_ok = (c("first") == "correct") & (F.coalesce("has_gold", F.lit(False)) | (sup >= 0.75) | ((over >= 0.5) & (sup >= 0.35)) | c("decisive") | (same_side & (over >= 0.35)))
    diag = c("claim_diagnostic")
    second = (
        F.when(diag.isin("claim_contradiction", "unsupported_generated_claims") & (c("first") == "partially_correct"), "unsupported")
        .when(diag.isin("answer_incomplete", "answer_incomplete_from_available_context") & (c("first") == "correct") & ~claims_ok & ~answer_ok, "partially_correct")
        .when(claims_ok & c("first").isin("incorrect", "partially_correct"), "correct")
        .otherwise(c("first"))
    )
    able = F.coalesce("answerable", F.lit(True))
    d = d.withColumn("first", answer_label()).withColumn("second", second)
    return d.select(
        *[x for x in d.columns if x not in ("first", "second", "gold", "answer", "answerable")], able.alias("expected_answerable"), c("refusal").alias("abstained"), (c("refusal") != able).alias("abstention_correct"),
        (~able & ~c("refusal")).alias("over_answered"), (able & c("refusal")).alias("false_refusal"),
        F.when(~able, F.when(c("refusal"), "correct").otherwise("unsupported")).when(c("refusal"), "incorrect").otherwise(c("second")).alias("label"),
    )


def runtime_evidence(items: DataFrame, chunks: DataFrame, least_relevance: float = 0.18, least_score: float = 0.08) -> DataFrame:
    """(qid, status, action, score, relevance, top_score): whether what was retrieved (chunks with a score) is enough to answer from."""
    top = chunks.groupBy("qid").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("top_score"))
    d = items.select("qid", "question").join(contexts(chunks), "qid", "left").join(top, "qid", "left")
    d = M.analysed(M.analysed(d, "question", "q_"), "context", "x_")
    stop = F.array(*map(F.lit, sorted(set(M.STOPWORDS))))
    content = lambda t: F.filter(F.array_except(t, stop), lambda w: F.length(w) > 3)
    d = d.withColumn("relevance", F.when(F.col("top_score").isNotNull(), F.coalesce(M.share(content("q_tokens"), content("x_tokens")), F.lit(0.0))))
    r, s = F.col("relevance"), F.col("top_score")
    good = (r >= least_relevance) | ((s >= least_score) & (r >= 0.6 * least_relevance))
    weak = (r >= 0.6 * least_relevance) | ((s >= 0.6 * least_score) & (r > 0))
    status = F.when(s.isNull(), "missing_evidence").when(good, "good_evidence").when(weak, "weak_evidence").otherwise("missing_evidence")
    score = F.when(s.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(r, 0.5 * F.least(s / least_score, F.lit(1.0)), F.lit(0.0))))
    d = d.select("qid", status.alias("status"), score.alias("score"), "relevance", "top_score")
    act = F.create_map(*[F.lit(x) for kv in {"good_evidence": "answer", "weak_evidence": "retrieve_more_or_rewrite", "missing_evidence": "abstain"}.items() for x in kv])
    return d.withColumn("action", act[F.col("status")])


#: Diagnoses that follow from the claim diagnostic alone: claim diagnostic -> (primary, secondary).
BY_CLAIMS = {
    "retrieval_claim_miss": ("retrieval_claim_miss", "missing_gold_evidence"), "partial_evidence_retrieved": ("partial_retrieval", "missing_gold_claims"),
    "claim_contradiction": ("claim_contradiction", "generation_or_context_conflict"), "answer_incomplete_from_available_context": ("answer_incomplete_from_good_context", "low_context_utilization"),
    "answer_incomplete": ("answer_incomplete", "missing_gold_claims"), "answer_contains_extra_claims": ("answer_contains_extra_claims", "low_claim_precision"),
}


def diagnose() -> Column:
    """(primary, secondary) reason of a failure: the first rule that holds, over answer metrics, mrr, ndcg, recall, ragas_recall, first_relevant_rank and llm_failed."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    strong = yes(c("mrr") >= 1) | yes(c("ndcg") >= 0.75) | yes(c("ragas_recall") >= 0.7)
    weak = yes(c("mrr") == 0) | yes(c("ndcg") < 0.35) | yes(c("ragas_recall") < 0.35)
    partial = ~strong & ~weak & (yes(c("recall") < 0.2) | yes(c("ragas_recall") < 0.6))
    failed, label, diag = yes(c("llm_failed")), c("label"), c("claim_diagnostic")
    why = lambda a, b="none": F.struct(F.lit(a).alias("primary"), F.lit(b).alias("secondary"))
    rules = [
        (~c("expected_answerable") & c("abstained"), why("ok", "correct_abstention")), (~c("expected_answerable"), why("over_answering", "unanswerable_question")), (c("false_refusal"), why("false_refusal", "answerable_question")),
        *[(diag == k, why(*v)) for k, v in BY_CLAIMS.items()],
        ((diag == "unsupported_generated_claims") & weak, why("retrieval_and_grounding_failure", "unsupported_generated_claims")), (diag == "unsupported_generated_claims", why("generation_hallucination", "unsupported_generated_claims")),
        ((label == "unsupported") & weak, why("retrieval_and_grounding_failure", "generation_unsupported")), ((label == "unsupported") & failed, why("extractive_fallback_unsupported", "llm_call_failed")),
        (label == "unsupported", why("answer_unsupported")), (label == "correct", why("ok")),
        (yes(c("faithfulness") < 0.5) & weak, why("retrieval_miss", "generation_hallucination")), (yes(c("faithfulness") < 0.5) & failed, why("extractive_fallback_failure", "llm_call_failed")), (yes(c("faithfulness") < 0.5), why("generation_hallucination")),
        ((label == "incorrect") & weak & c("first_relevant_rank").isNull(), why("retrieval_miss")), ((label == "incorrect") & weak, why("wrong_chunks_ranked_high", "partial_retrieval")),
        ((label == "incorrect") & partial, why("partial_retrieval", "answer_incomplete_from_partial_context")), ((label == "incorrect") & strong & failed, why("llm_call_failed", "extractive_fallback_failure")),
        ((label == "incorrect") & strong, why("answer_synthesis_failure")), (label == "incorrect", why("answer_incorrect")),
        ((label == "partially_correct") & (partial | weak), why("answer_incomplete", "partial_retrieval")), ((label == "partially_correct") & failed, why("answer_incomplete", "llm_call_failed")),
        (label == "partially_correct", why("answer_incomplete_from_good_context")),
    ]
    out = F.when(*rules[0])
    for cond, reason in rules[1:]:
        out = out.when(cond, reason)
    return out.otherwise(why("ok"))


def keyword_grades(pairs: DataFrame) -> DataFrame:
    """pairs (qid, chunk_id, gold, keywords ARRAY, text) with a grade 0 to 3 by the share of keywords matched and of the gold answer's words covered."""
    d = M.analysed(M.analysed(pairs, "text", "x_"), "gold", "g_")
    keys = M.analysed(pairs.select("qid", "keywords").distinct().select("qid", F.explode("keywords").alias("key")), "key", "k_").groupBy("qid").agg(F.collect_list(F.struct("k_lemma", "k_words")).alias("keys"))
    d = d.join(keys, "qid", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<struct<k_lemma:string,k_words:array<string>>>")))
    hit = F.size(F.filter("keys", lambda k: M.matches_keyword(F.col("x_lemma"), F.col("x_words"), k["k_lemma"], k["k_words"])))
    d = d.withColumn("n_keys", hit).withColumn("cover", F.coalesce(ratio(hit, F.size("keys")), F.lit(0.0))).withColumn("over", F.coalesce(M.share(F.col("g_tokens"), F.col("x_tokens")), F.lit(0.0)))
    best = F.greatest("cover", "over")
    grade = F.when(best >= 0.6, 3).when((best >= 0.35) | (F.col("n_keys") >= 3), 2).when((best >= 0.15) | (F.col("n_keys") >= 1), 1).otherwise(0)
    return d.select("qid", "chunk_id", "n_keys", F.round("cover", 6).alias("coverage"), F.round("over", 6).alias("overlap"), grade.alias("grade"))


def extractive_answer(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, answer): the sentence of the chunks that shares most words with the question, the first of equals; else the first 400 characters; else 'No context.'"""
    q = M.analysed(questions.select("qid", "question"), "question", "q_").select("qid", "q_tokens")
    sents = chunks.select("qid", "rank", "text", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+")).alias("no", "sentence"))
    s = M.analysed(sents, "sentence", "s_").join(q, "qid").withColumn("n", F.size(F.array_intersect("q_tokens", "s_tokens")))
    best = s.groupBy("qid").agg(F.min_by(F.trim("sentence"), F.struct(-F.col("n"), "rank", "no")).alias("sentence"), F.min_by(F.substring("text", 1, 400), "rank").alias("head"))
    return questions.select("qid").join(best, "qid", "left").select("qid", F.coalesce(F.nullif("sentence", F.lit("")), "head", F.lit("No context.")).alias("answer"))


def evidence_spans(items: DataFrame, chunks: DataFrame, most: int = 4, least: float = 0.35) -> DataFrame:
    """(qid, claim, chunk_id, support, snippet): the best supporting chunk of each claim of an answer with a stretch of text around the first of the claim's words, at most four an item."""
    from pyspark.sql.window import Window

    said = claim_rows(items, "answer")
    single = M.analysed(chunks.select("qid", "rank", "chunk_id", "text"), "text", "k_")
    pairs = said.join(single, "qid").withColumn("s", F.round(support("k_"), 6)).where(f"s >= {least}")
    best = pairs.groupBy("qid", "no", "claim").agg(F.min_by(F.struct("chunk_id", "text", "c_tokens", "s"), F.struct(-F.col("s"), "rank")).alias("b"))
    at = F.array_min(F.filter(F.transform("b.c_tokens", lambda w: F.instr(F.lower("b.text"), w)), lambda i: i > 0))
    start = F.greatest(F.coalesce(at, F.lit(1)) - 80, F.lit(1))
    ranked = best.select("qid", "no", "claim", "b.chunk_id", F.col("b.s").alias("support"), F.trim(F.substr("b.text", start, F.lit(240))).alias("snippet"))
    w = Window.partitionBy("qid").orderBy(F.desc("support"), "no")
    return ranked.withColumn("r", F.row_number().over(w)).where(f"r <= {most}").drop("r")


def cards(chunks: DataFrame, mapped: DataFrame) -> DataFrame:
    """(qid, n_chunks, n_texts, best, margin, grounding): what is shown beside an answer: how much was retrieved, how far the best chunk is ahead, and the share of the answer's claims that the context supports."""
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    c = chunks.groupBy("qid").agg(F.count("*").alias("n_chunks"), F.count_distinct("text").alias("n_texts"), F.round(at(1), 6).alias("best"), F.round(at(1) - at(2), 6).alias("margin"))
    g = mapped.where("claim_type = 'answer'").groupBy("qid").agg(F.round(F.avg(F.col("in_context").cast("int")), 6).alias("grounding"))
    return c.join(g, "qid", "left")


def benchmark_warnings(items: DataFrame) -> DataFrame:
    """(warning, n): questions without a text, without a gold answer though answerable, with a gold answer though not, without keywords, and questions that occur more than once."""
    able = F.coalesce("answerable", F.lit(True))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    flags = {"no_question": blank("question"), "no_gold_answer": able & blank("gold"), "gold_though_unanswerable": ~able & ~blank("gold"), "no_keywords": F.coalesce(F.size("keywords"), F.lit(0)) <= 0}
    a = items.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))
    twice = items.where(~blank("question")).groupBy("question").agg(F.count("*").alias("k")).where("k > 1").agg(F.sum("k").alias("n")).where("n > 0").select(F.lit("repeated_question").alias("warning"), "n")
    return a.unionByName(twice)
