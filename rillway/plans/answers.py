"""Queries: normal forms, claims, answer metrics, evidence, diagnosis.

An item is a publication: its question is the English label of its document's code, its answer the text of that document,
its gold answer the longest of the publication's examples, and its retrieved chunks are those examples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from rillway.functions import matching as M
from rillway.operators import answers as A
from rillway.session import spread, table


def _items(spark, d):
    docs = table(spark, d, "documents").where("publication_number is not null")
    one = docs.groupBy("publication_number").agg(F.min_by(F.struct("text", "cpv_code"), "doc_id").alias("a"))
    ex = table(spark, d, "cpv_notice_examples").where("example_text is not null")
    gold = ex.groupBy("publication_number").agg(F.min_by("example_text", F.struct(-F.length("example_text"), "example_id")).alias("gold"))
    cat = table(spark, d, "cpv_catalog").select(F.col("code").alias("cpv_code"), "en", "de")
    j = one.select("publication_number", F.col("a.text").alias("answer"), F.col("a.cpv_code").alias("cpv_code")).join(gold, "publication_number", "left").join(cat, "cpv_code", "left")
    return spread(j.select(F.col("publication_number").alias("qid"), F.col("en").alias("question"), "answer", "gold", F.array_compact(F.array("en", "de")).alias("keywords"), (F.length("answer") % 7 != 0).alias("answerable")))


def _chunks(spark, d):
    ex = table(spark, d, "cpv_notice_examples").where("example_text is not null")
    w = Window.partitionBy("publication_number").orderBy("example_id")
    r = ex.select(F.col("publication_number").alias("qid"), F.col("example_id").alias("chunk_id"), F.col("example_text").alias("text"), F.row_number().over(w).alias("rank"))
    return r.withColumn("score", 0.2 / F.col("rank"))


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Normal form, lemmas, informative words and numbers of all documents."""
    t = M.analysed(spread(table(spark, d, "documents").select("doc_id", "text")), "text", "")
    return t.select("doc_id", F.md5("normal").alias("normal"), F.md5("lemma").alias("lemma"), F.size("tokens").alias("n_tokens"), F.array_join(F.array_sort("numbers"), " ").alias("numbers"))


def claims_split(spark: SparkSession, d: str) -> DataFrame:
    items = spread(table(spark, d, "documents").select(F.col("doc_id").alias("qid"), "text"))
    return A.claim_rows(items, "text").select(F.col("qid").alias("doc_id"), "claim", F.size("c_tokens").alias("n_tokens"))


def reference_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_paragraphs").select("paragraph_row_id", F.explode(A.reference_units(F.col("text"))).alias("unit"))


def claim_map(spark: SparkSession, d: str) -> DataFrame:
    m = A.claim_map(_items(spark, d), _chunks(spark, d))
    return m.select("qid", "claim_type", "claim", "in_context", "in_answer", F.coalesce("in_gold", F.lit(False)).alias("in_gold"), "contradicted", "n_supporting", "best_chunk", "best_support")


def claim_metrics(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    m = A.claim_metrics(items, A.claim_map(items, _chunks(spark, d)))
    return m.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in m.dtypes])


def answer_overlaps(spark: SparkSession, d: str) -> DataFrame:
    o = A.overlaps(_items(spark, d), _chunks(spark, d)).drop("gold", "answer", "answerable")
    return o.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in o.dtypes])


def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = A.answer_metrics(_items(spark, d), _chunks(spark, d))
    return m.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in m.dtypes])


def answer_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means, counts by label and rates over all items."""
    m = A.answer_metrics(_items(spark, d), _chunks(spark, d))
    means = ("gold_overlap", "gold_support", "faithfulness", "context_relevance", "context_claim_recall", "answer_claim_recall", "answer_claim_precision", "answer_claim_f1", "grounded_ratio", "hallucinated_ratio", "context_utilization", "attribution_f1", "noise_relevant", "noise_irrelevant", "entities_recall", "entity_precision")
    return m.agg(
        F.count("*").alias("n"), *[F.round(F.avg(c), 5).alias("mean_" + c) for c in means], *[F.count_if(F.col("label") == x).alias("n_" + x) for x in ("correct", "partially_correct", "incorrect", "unsupported")],
        F.count_if("over_answered").alias("n_over_answered"), F.count_if("false_refusal").alias("n_false_refusal"), F.round(F.avg(F.col("abstention_correct").cast("int")), 5).alias("abstention_accuracy"), F.sum("unsupported_claims").alias("unsupported_claims"), F.sum("missing_gold_claims").alias("missing_gold_claims"),
    )


def runtime_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = A.runtime_evidence(_items(spark, d), _chunks(spark, d))
    return e.select("qid", "status", "action", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"), F.round("top_score", 6).alias("top_score"))


def keyword_relevance(spark: SparkSession, d: str) -> DataFrame:
    pairs = _items(spark, d).select("qid", "gold", "keywords").join(_chunks(spark, d), "qid")
    return A.keyword_grades(pairs)


def _retrieval(spark, d):
    """Ranking figures of each item's chunks, judged by keyword grades."""
    g = A.keyword_grades(_items(spark, d).select("qid", "gold", "keywords").join(_chunks(spark, d), "qid")).join(_chunks(spark, d).select("qid", "chunk_id", "rank"), ["qid", "chunk_id"])
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "rank"))
    rel = F.col("grade") >= 2
    m = g.withColumn("ideal", ideal).groupBy("qid").agg(
        F.min(F.when(rel, F.col("rank"))).alias("first_relevant_rank"), F.sum(F.when(F.col("rank") <= 5, gain / F.log2(F.col("rank") + 1))).alias("dcg"), F.sum(F.when(F.col("ideal") <= 5, gain / F.log2(F.col("ideal") + 1))).alias("idcg"),
        F.count_if(rel & (F.col("rank") <= 5)).alias("hits"), F.count_if(rel).alias("relevant"),
    )
    return m.select("qid", "first_relevant_rank", F.coalesce(1 / F.col("first_relevant_rank"), F.lit(0.0)).alias("mrr"), F.when(F.col("idcg") > 0, F.least(F.lit(1.0), F.col("dcg") / F.col("idcg"))).alias("ndcg"), A.ratio(F.col("hits"), F.col("relevant")).alias("recall"))


def keyword_retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = _retrieval(spark, d)
    return m.select("qid", "first_relevant_rank", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"))


def diagnose_failure(spark: SparkSession, d: str) -> DataFrame:
    m = A.answer_metrics(_items(spark, d), _chunks(spark, d)).join(_retrieval(spark, d), "qid", "left")
    m = m.withColumn("ragas_recall", F.col("context_claim_recall")).withColumn("llm_failed", F.lit(False)).withColumn("why", A.diagnose())
    return m.select("qid", "label", "claim_diagnostic", F.col("why.primary").alias("primary_reason"), F.col("why.secondary").alias("secondary_reason"))


def diagnosis_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts by primary reason and by claim diagnostic, with the share of all and whether it is the most frequent (ties by name)."""
    w = diagnose_failure(spark, d)
    long = w.select(F.expr("stack(2, 'primary_reason', primary_reason, 'claim_diagnostic', claim_diagnostic) as (kind, reason)"))
    c = long.groupBy("kind", "reason").agg(F.count("*").alias("n"))
    by = Window.partitionBy("kind")
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(by), 6)).withColumn("is_most", (F.row_number().over(by.orderBy(F.desc("n"), "reason")) == 1).cast("int"))


def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    return A.extractive_answer(_items(spark, d), _chunks(spark, d))


def evidence_spans(spark: SparkSession, d: str) -> DataFrame:
    return A.evidence_spans(_items(spark, d), _chunks(spark, d))


def answer_cards(spark: SparkSession, d: str) -> DataFrame:
    return A.cards(_chunks(spark, d), A.claim_map(_items(spark, d), _chunks(spark, d)))


def benchmark_warnings(spark: SparkSession, d: str) -> DataFrame:
    return A.benchmark_warnings(_items(spark, d))


def decisive_markers(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "documents").select("doc_id", "text"))
    return t.select("doc_id", F.explode(M.markers("text")).alias("marker"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs, identifiers and metadata forms of program names."""
    t = table(spark, d, "doc_sections").select("section_row_id", "program_name", "doc_path")
    return t.select("section_row_id", M.slug(F.col("program_name")).alias("slug"), M.metadata_value(F.col("program_name")).alias("metadata_value"), M.stable_id(M.name_form(F.col("program_name")), F.lit("program")).alias("stable_id"))


def program_filter(spark: SparkSession, d: str) -> DataFrame:
    """Sections whose program name matches that of a question by the fuzzy rules; the questions are all program names of the smallest path of each program."""
    t = table(spark, d, "doc_sections").select("section_row_id", "program_id", M.metadata_value(F.col("program_name")).alias("actual"))
    q = table(spark, d, "doc_sections").groupBy("program_id").agg(F.min("program_name").alias("wanted")).select("program_id", M.metadata_value(F.col("wanted")).alias("expected"))
    return t.join(q, "program_id").select("section_row_id", M.metadata_matches(F.col("actual"), F.col("expected")).cast("int").alias("matches"))


QUERIES = {f.__name__: f for f in (text_forms, claims_split, reference_units, claim_map, claim_metrics, answer_overlaps, answer_metrics, answer_summary, runtime_evidence, keyword_relevance, keyword_retrieval_metrics, diagnose_failure, diagnosis_summary, extractive_answer, evidence_spans, answer_cards, benchmark_warnings, decisive_markers, slugs, program_filter)}


# oracles

_IRR = " ".join(f"when '{k}' then '{v}'" for k, v in M.IRREGULAR.items())


_WIDE, _NARROW = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def norm(x: str) -> str:
    return rf"trim(regexp_replace(replace(replace(lower(replace(replace(translate(nfc_normalize(coalesce({x}, '')), 'ªº²³¹{_WIDE}', 'ao231{_NARROW}'), '…', '...'), 'ำ', 'ํา')), 'ß', 'ss'), 'ς', 'σ'), '[\s\p{{Z}}]+', ' ', 'g'))"


def lemma(w: str) -> str:
    return rf"case when length({w}) <= 4 or regexp_matches({w}, '\p{{N}}') then {w} else case {w} {_IRR} else regexp_replace({w}, '^(.{{4,}}?)(?:{M.ENDINGS})$', '\1') end end"


def words(n: str) -> str:
    return rf"list_transform(list_filter(string_split(trim(regexp_replace({n}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: {lemma('w')})"


def tokens(ws: str) -> str:
    return f"list_distinct(list_filter({ws}, lambda w: length(w) > 2))"


def numbers(n: str) -> str:
    return rf"list_distinct(regexp_extract_all({n}, '\p{{Nd}}+(?:[.,]\p{{Nd}}+)?'))"


def forms(rel: str, key: str, text: str, p: str) -> str:
    """SQL of a relation with the forms of its text under the prefix p."""
    a = f"(select {key}, {norm(text)} n_ from {rel})"
    b = f"(select *, {words('n_')} w_ from {a})"
    return f"(select {key}, n_ {p}n, w_ {p}w, array_to_string(w_, ' ') {p}l, {tokens('w_')} {p}t, {numbers('n_')} {p}d from {b})"


def split_claims(text: str) -> str:
    a = rf"regexp_replace(regexp_replace(coalesce({text}, ''), '[;\n]', '. ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g')"
    b = rf"list_transform(regexp_split_to_array({a}, '\x01|\s+-\s+|\s+•\s+'), lambda p: regexp_replace(p, '^[ \-•\t\r\n]+|[ \-•\t\r\n]+$', '', 'g'))"
    c = rf"flatten(list_transform({b}, lambda p: string_split(regexp_replace(p, '\s+(?:und|oder|and|or)\s+([A-ZÄÖÜ0-9])', chr(2) || '\1', 'g'), chr(2))))"
    return f"list_filter(list_transform({c}, lambda c: regexp_replace(c, '^[ ,]+|[ ,]+$', '', 'g')), lambda c: c <> '')"


def claim_rel(rel: str, key: str, text: str) -> str:
    f = forms(f"(select distinct {key}, unnest({split_claims(text)}) claim from {rel})", f"{key}, claim", "claim", "c_")
    return f"(select * from {f} where len(list_filter(c_w, lambda w: length(w) > 2)) >= 2)"


def share(a: str, b: str) -> str:
    return f"case when len({a}) > 0 then len(list_intersect({a}, {b})) / len({a}) end"


def support(p: str) -> str:
    cover = f"coalesce({share('c_t', p + 't')}, 0.0)"
    known = f"(c_l <> '' and (contains({p}l, c_l) or len(list_filter(c_w, lambda w: not list_contains({p}w, w))) = 0))"
    miss = f"len(list_filter(c_d, lambda w: not list_contains({p}d, w))) > 0"
    return f"case when {cover} = 0 then 0.0 when {known} then greatest({cover}, 0.95) when {miss} then {cover} * 0.65 else {cover} end"


_QA = f"""with it as (select a.publication_number qid, c.en question, a.answer, g.gold, list_filter([c.en, c.de], lambda k: k is not null) keywords, (length(a.answer) % 7 <> 0) answerable
  from (select publication_number, arg_min(coalesce(text, chr(3)), doc_id) answer, arg_min(coalesce(cpv_code, ''), doc_id) cpv_code from documents where publication_number is not null group by 1) a
  left join (select publication_number, arg_min(example_text, (-length(example_text), example_id)) gold from cpv_notice_examples where example_text is not null group by 1) g using (publication_number)
  left join cpv_catalog c on c.code = a.cpv_code),
 ch as (select publication_number qid, example_id chunk_id, example_text as text, row_number() over (partition by publication_number order by example_id) rank from cpv_notice_examples where example_text is not null),
 ctx as (select qid, string_agg(text, chr(10) order by rank) context from ch group by 1)
"""
_TERMS = "list_filter(c_t, lambda w: not list_contains(c_d, w))"
_CLAIMS = _QA + f""", gold0 as (select * from {claim_rel('it', 'qid', 'gold')}),
 gold1 as (select qid, claim, c_n, c_w, c_l, c_t, c_d from gold0 union all select qid, claim, c_n, c_w, c_l, c_t, c_d from {forms('(select distinct qid, unnest(keywords) claim from it where qid not in (select qid from gold0))', 'qid, claim', 'claim', 'c_')} where len(c_t) > 0),
 said as (select * from {claim_rel('it', 'qid', 'answer')}),
 bo as (select 'gold' claim_type, * from gold1 union all by name select 'answer' claim_type, * from said),
 xf as (select * from {forms('(select qid, context from it left join ctx using (qid))', 'qid', 'context', 'x_')}), af as (select * from {forms('it', 'qid', 'answer', 'a_')}),
 kf as (select * from {forms('ch', 'qid, chunk_id, rank', 'text', 'k_')}),
 per as (select qid, claim_type, claim, count(*) n_supporting, arg_min(chunk_id, (-s, rank)) best_chunk, round(max(s), 6) best_support from (select qid, claim_type, claim, chunk_id, rank, {support('k_')} s from bo join kf using (qid)) where s >= {A.SUPPORTED} group by all),
 gf as (select qid, c_n g_n, c_w g_w, c_l g_l, c_t g_t, c_d g_d from gold1),
 ig as (select qid, claim, max({support('g_')}) >= {A.IN_ANSWER} in_gold from said join gf using (qid) group by all),
 mp as (select b.qid, b.claim_type, b.claim, {support('x_')} >= {A.SUPPORTED} in_context, {support('a_')} >= {A.IN_ANSWER} in_answer, coalesce(ig.in_gold and b.claim_type = 'answer', false) in_gold,
   len(c_d) > 0 and len(x_d) > 0 and len(list_intersect(c_d, x_d)) = 0 and coalesce(({share(_TERMS, 'list_filter(x_t, lambda w: not list_contains(x_d, w))')}) >= {A.CONTRADICTS}, false) contradicted, coalesce(n_supporting, 0) n_supporting, best_chunk, best_support
   from bo b join xf using (qid) join af using (qid) left join ig on ig.qid = b.qid and ig.claim = b.claim left join per on per.qid = b.qid and per.claim_type = b.claim_type and per.claim = b.claim)
"""
_N = """, cn as (select qid, count(*) filter (claim_type = 'gold') gold_claims, count(*) filter (claim_type = 'answer') answer_claims, count(*) filter (claim_type = 'gold' and in_context) gold_in_context,
   count(*) filter (claim_type = 'gold' and in_answer) gold_in_answer, count(*) filter (claim_type = 'gold' and in_answer and in_context) gold_used, count(*) filter (claim_type = 'answer' and in_gold) answer_in_gold,
   count(*) filter (claim_type = 'answer' and in_context) answer_in_context, count(*) filter (claim_type = 'answer' and contradicted) contradicted_claims, count(*) filter (claim_type = 'answer' and n_supporting > 0) attributed_answer_claims,
   count(*) filter (claim_type = 'gold' and n_supporting > 0) attributed_gold_claims, count(*) filter (claim_type = 'answer' and n_supporting > 0 and not in_gold) beside_gold from it left join mp using (qid) group by 1),
 cr as (select *, gold_in_context / nullif(gold_claims, 0) context_claim_recall, gold_in_answer / nullif(gold_claims, 0) answer_claim_recall, answer_in_gold / nullif(answer_claims, 0) answer_claim_precision, answer_in_context / nullif(answer_claims, 0) grounded_ratio,
   (answer_claims - answer_in_context) / nullif(answer_claims, 0) hallucinated_ratio, gold_used / nullif(gold_in_context, 0) context_utilization, attributed_answer_claims / nullif(answer_claims, 0) attribution_precision, attributed_gold_claims / nullif(gold_claims, 0) attribution_recall,
   least(answer_claims, answer_claims - answer_in_context + contradicted_claims) / nullif(answer_claims, 0) noise_relevant, beside_gold / nullif(answer_claims, 0) noise_irrelevant from cn),
 cm as (select *, case when answer_claim_precision + answer_claim_recall > 0 then 2 * answer_claim_precision * answer_claim_recall / (answer_claim_precision + answer_claim_recall) end answer_claim_f1,
   case when attribution_precision + attribution_recall > 0 then 2 * attribution_precision * attribution_recall / (attribution_precision + attribution_recall) end attribution_f1, answer_claims - answer_in_context unsupported_claims, gold_claims - gold_in_answer missing_gold_claims,
   case when gold_claims = 0 and answer_claims = 0 then 'no_claims_to_evaluate' when gold_claims > 0 and context_claim_recall < 0.35 then 'retrieval_claim_miss' when gold_claims > 0 and context_claim_recall < 0.7 then 'partial_evidence_retrieved'
    when contradicted_claims > 0 then 'claim_contradiction' when hallucinated_ratio >= 0.35 or grounded_ratio < 0.65 then 'unsupported_generated_claims'
    when gold_claims > 0 and answer_claim_recall < 0.7 then case when context_utilization < 0.7 then 'answer_incomplete_from_available_context' else 'answer_incomplete' end
    when answer_claim_precision < 0.75 then 'answer_contains_extra_claims' else 'claim_level_ok' end claim_diagnostic from cr)
"""
_CM = ("context_claim_recall", "answer_claim_recall", "answer_claim_precision", "grounded_ratio", "hallucinated_ratio", "context_utilization", "attribution_precision", "attribution_recall", "noise_relevant", "noise_irrelevant", "answer_claim_f1", "attribution_f1")
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(M.STOPWORDS))) + "]"
_CONTENT = "list_filter({0}, lambda w: length(w) > 3 and not list_contains(" + _STOP + ", w))"
_KEYS = "select qid, list({'l': c_l, 'w': c_w}) ks from " + forms("(select distinct qid, unnest(keywords) claim from it)", "qid, claim", "claim", "c_") + " group by 1"
_GRADES = _QA + f""", xk as (select * from {forms('ch', 'qid, chunk_id, rank', 'text', 'x_')}), gq as (select * from {forms('it', 'qid', 'gold', 'g_')}), kk as ({_KEYS}),
 kg as (select *, nk / nullif(len(ks), 0) cv from (select qid, chunk_id, rank, coalesce(ks, []) ks, len(list_filter(coalesce(ks, []), lambda k: k.l <> '' and (contains(x_l, k.l) or len(list_filter(k.w, lambda w: not list_contains(x_w, w))) = 0))) nk, coalesce({share('g_t', 'x_t')}, 0) ov from xk join gq using (qid) left join kk using (qid))),
 gr as (select qid, chunk_id, rank, nk n_keys, round(coalesce(cv, 0.0), 6) coverage, round(ov, 6) overlap, case when greatest(coalesce(cv, 0), ov) >= 0.6 then 3 when greatest(coalesce(cv, 0), ov) >= 0.35 or nk >= 3 then 2 when greatest(coalesce(cv, 0), ov) >= 0.15 or nk >= 1 then 1 else 0 end grade from kg)
"""
ORACLE = {
    "text_forms": f"select doc_id, md5(n) normal, md5(l) lemma, len(t)::int n_tokens, array_to_string(list_sort(d), ' ') numbers from {forms('documents', 'doc_id', 'text', '')}",
    "claims_split": f"select doc_id, claim, len(c_t)::int n_tokens from {claim_rel('documents', 'doc_id', 'text')}",
    "reference_units": rf"""select distinct paragraph_row_id, trim(u) unit from (select paragraph_row_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+|\x01|[-•]\s+')) u from doc_paragraphs)
        where length(trim(regexp_replace(trim(u), '[\s\p{{Z}}]+', ' ', 'g'))) >= 8""",
    "claim_map": _CLAIMS + "select * from mp",
    "claim_metrics": _CLAIMS + _N + "select * replace (" + ", ".join(f"round({c}, 6) as {c}" for c in _CM) + ") from cm",
    "runtime_evidence": _QA + f""", f as (select q.qid, case when x.qid is not null and exists(select 1 from ch where ch.qid = q.qid) then coalesce({share(_CONTENT.format('q_t'), _CONTENT.format('x_t'))}, 0.0) end relevance, (select max(0.2 / rank) from ch where ch.qid = q.qid) top_score
        from {forms('it', 'qid', 'question', 'q_')} q left join {forms('(select qid, context from it left join ctx using (qid))', 'qid', 'context', 'x_')} x using (qid)),
        s as (select *, case when top_score is null then 'missing_evidence' when relevance >= 0.18 or (top_score >= 0.08 and relevance >= 0.6 * 0.18) then 'good_evidence' when relevance >= 0.6 * 0.18 or (top_score >= 0.6 * 0.08 and relevance > 0) then 'weak_evidence' else 'missing_evidence' end status from f)
        select qid, status, case status when 'good_evidence' then 'answer' when 'weak_evidence' then 'retrieve_more_or_rewrite' else 'abstain' end as action, round(case when top_score is null then 0.0 else least(1.0, greatest(relevance, 0.5 * least(top_score / 0.08, 1.0))) end, 6) score, round(relevance, 6) relevance, round(top_score, 6) top_score from s""",
    "answer_cards": _CLAIMS + ", cc as (select qid, count(*) n_chunks, count(distinct text) n_texts, round(0.2 / min(rank), 6) best, round(0.2 - max(case when rank = 2 then 0.1 end), 6) margin from ch group by 1), gc as (select qid, round(avg(in_context::int), 6) grounding from mp where claim_type = 'answer' group by 1) select * from cc left join gc using (qid)",
    "benchmark_warnings": _QA + """, w as (select *, coalesce(answerable, true) a, trim(coalesce(question, '')) = '' nq, trim(coalesce(gold, '')) = '' ng from it), x as (select case when nq then 'no_question' end w from w union all select case when a and ng then 'no_gold_answer' end from w union all select case when not a and not ng then 'gold_though_unanswerable' end from w union all select case when len(keywords) = 0 then 'no_keywords' end from w)
        select w warning, count(*) n from x where w is not null group by 1 union all select * from (select 'repeated_question', sum(k)::bigint n from (select count(*) k from w where not nq group by question having count(*) > 1)) where n > 0""",
    "keyword_relevance": _GRADES + "select qid, chunk_id, n_keys, coverage, overlap, grade from gr",
    "keyword_retrieval_metrics": _GRADES + """, i as (select *, row_number() over (partition by qid order by grade desc, rank) p from gr), m as (select qid, min(rank) filter (grade >= 2) fr, sum(case when rank <= 5 then (2 ^ grade - 1) / log2(rank + 1) end) dcg, sum(case when p <= 5 then (2 ^ grade - 1) / log2(p + 1) end) idcg, count(*) filter (grade >= 2 and rank <= 5) h, count(*) filter (grade >= 2) r from i group by 1)
        select qid, fr::int first_relevant_rank, round(coalesce(1 / fr, 0), 6) mrr, round(case when idcg > 0 then least(1.0, dcg / idcg) end, 6) ndcg, round(h / nullif(r, 0), 6) recall from m""",
    "extractive_answer": _QA + rf""", se as (select distinct qid, rank, text, no, s[no] sentence from (select *, unnest(range(1, len(s) + 1)) no from (select *, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) s from ch))),
        fs as (select * from {forms('se', 'qid, rank, no, sentence', 'sentence', 's_')} join {forms('it', 'qid', 'question', 'q_')} using (qid)),
        b as (select qid, arg_min(trim(sentence), (-len(list_intersect(q_t, s_t)), rank, no)) sentence from fs group by 1), h as (select qid, arg_min(substr(text, 1, 400), rank) head from ch group by 1)
        select qid, coalesce(nullif(sentence, ''), head, 'No context.') answer from it left join b using (qid) left join h using (qid)""",
    "slugs": r"""select section_row_id, coalesce(nullif(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(coalesce(program_name, '')), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') slug,
        trim(regexp_replace(lower(strip_accents(replace(coalesce(program_name, ''), '&', ' and '))), '[^a-z0-9]+', ' ', 'g')) metadata_value,
        substr(sha1(trim(regexp_replace(lower(coalesce(program_name, '')), '[^\p{L}\p{N}_§.,\-]+', ' ', 'g')) || '|program'), 1, 16) stable_id from doc_sections""",
    "program_filter": """select section_row_id, (case when e = '' then true when a = '' then false else a = e or contains(a, e) or contains(e, a) end)::int matches from
        (select section_row_id, trim(regexp_replace(lower(strip_accents(coalesce(program_name, ''))), '[^a-z0-9]+', ' ', 'g')) a, trim(regexp_replace(lower(strip_accents(coalesce(min(program_name) over (partition by program_id), ''))), '[^a-z0-9]+', ' ', 'g')) e from doc_sections)""",
}
