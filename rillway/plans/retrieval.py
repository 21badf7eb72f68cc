"""Queries: chunking, lexical and dense retrieval, fusion, reranking, context, ranking metrics.

Questions are the catalogue's English labels with their code as gold; candidates are the documents, graded by
how much of the code they share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillway.functions import cpv
from rillway.functions.text import clean_text as clean, overlap, tokens
from rillway.functions import matching as M
from rillway.operators import evaluate as E, hooks as H, retrieval as R
from rillway.operators.sections import strip
from rillway.session import Scratch, spread, table

K, DEPTH = 10, 50


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "cpv_code", "source", "lang", "publication_number"))


def _questions(spark, d):
    return table(spark, d, "cpv_catalog").where("en is not null").select(F.col("code").alias("qid"), F.col("en").alias("question"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_paragraphs").select("paragraph_row_id", clean(F.col("text")).alias("cleaned"))


def chunk_fixed_words(spark: SparkSession, d: str) -> DataFrame:
    return R.chunks(_docs(spark, d), "doc_id", F.col("text"), 120, 20)


def chunk_by_section(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "doc_sections")
    return t.where("trim(text) <> ''").select("section_row_id", "doc_id", "section_id", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n_words"))


def chunk_by_paragraph(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "doc_sections").select("section_row_id", F.posexplode(F.filter(F.transform(F.split("text", r"\n\s*\n"), strip), lambda p: p != "")).alias("paragraph_index", "text"))
    return t.select("section_row_id", "paragraph_index", F.length("text").alias("n_chars"))


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    p = R.postings(_docs(spark, d), "doc_id", F.col("text"))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _bm25(spark, d):
    return R.bm25(_docs(spark, d), "doc_id", F.col("text"), _questions(spark, d), "qid", F.col("question"))


def _ranked(spark, d, kind, k):
    """The head of a ranking, without rows for terms of documents."""
    return R.retrieve(kind, _docs(spark, d), "doc_id", F.col("text"), _questions(spark, d), "qid", F.col("question"), k).select("qid", "doc_id", "score", "rank")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(_bm25(spark, d), "qid", "doc_id", K).select("qid", "doc_id", "score", "rank")


def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "tfidf", K)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_top_k(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, K).select("qid", F.col("key").alias("vec_id"), "score", "rank")


def _channels(spark, d):
    """The heads of both rankings from the same passes over the texts, cut: what is fused is small."""
    both = R.lexical_top_k(("tfidf", "bm25"), _docs(spark, d), "doc_id", F.col("text"), _questions(spark, d), "qid", F.col("question"), DEPTH)
    both = Scratch(spark).cut(both.select("kind", "qid", "doc_id", "score"))
    return tuple(both.where(F.col("kind") == kind).drop("kind") for kind in (0, 1))


def hybrid_alpha_topk(spark: SparkSession, d: str) -> DataFrame:
    both = R.fuse_alpha(*_channels(spark, d), "qid", "doc_id", 0.6)
    return R.top_k(both, "qid", "doc_id", K).select("qid", "doc_id", "score", "rank")


def rrf_fusion_topk(spark: SparkSession, d: str) -> DataFrame:
    first, second = _channels(spark, d)
    both = R.fuse_rrf([("tfidf", 1.0, first), ("bm25", 0.8, second)], "qid", "doc_id", DEPTH)
    return R.top_k(both, "qid", "doc_id", K).select("qid", "doc_id", "score", "n_channels", "rank")


def metadata_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    """Only documents of two sources are scored, by the statistics of all, so k rows come back where there are as many."""
    docs = _docs(spark, d)
    allowed = docs.where("source in ('national_portal', 'utility_board')")
    return R.retrieve("bm25", docs, "doc_id", F.col("text"), _questions(spark, d), "qid", F.col("question"), K, allowed=allowed).select("qid", "doc_id", "score", "rank")


def fulltext_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.retrieve("fulltext", _docs(spark, d), "doc_id", F.col("text"), _questions(spark, d), "qid", F.col("question"), K).select("qid", "doc_id", "score", "rank")


def evidence_rerank(spark: SparkSession, d: str) -> DataFrame:
    top = R.top_k(_bm25(spark, d), "qid", "doc_id", 20).join(_docs(spark, d).select("doc_id", "text", "source"), "doc_id").join(_questions(spark, d), "qid")
    return R.evidence_rerank(top, "qid", "doc_id", F.col("question"), F.col("source"), F.col("text")).select("qid", "doc_id", "final", "new_rank")


def context_modes(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of all modes in one relation; the source of a document stands for its file, its language for its section."""
    top = Scratch(spark).cut(R.top_k(_bm25(spark, d), "qid", "doc_id", 20).join(_docs(spark, d).select("doc_id", "text", F.col("source").alias("doc"), "lang"), "doc_id").withColumn("source", F.when(F.col("rank") % 5 == 0, "graph").otherwise("vector")))
    out = None
    for mode in ("ranked", "kg_first", "group_by_doc", "dedupe_section"):
        c = R.context(top, "qid", "doc", "lang", "text", mode, 8, 4000).select(F.lit(mode).alias("mode"), "qid", "doc_id", "place")
        out = c if out is None else out.unionByName(c)
    return out


def cross_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The head reranked by a pair scorer in Arrow batches; here its stand-in, the share of common words."""
    top = R.top_k(_bm25(spark, d), "qid", "doc_id", 20).join(_docs(spark, d).select("doc_id", "text"), "doc_id").join(_questions(spark, d), "qid")
    return H.cross_rerank(top, "qid", "doc_id", "question", "text").select("qid", "doc_id", "score", "rank")


def metadata_fuzzy_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents by fuzzy metadata: any of two sources, and not one language."""
    forms = _docs(spark, d).select("doc_id", M.metadata_value(F.col("source")).alias("source_form"), M.metadata_value(F.col("lang")).alias("lang_form"))
    return forms.where(M.metadata_predicate({"source": ["National-Portal", "utility board"], "lang": {"exclude": "de"}})).select("doc_id")


def self_exclusion_topk(spark: SparkSession, d: str) -> DataFrame:
    """Documents that carry the question's own code are taken out before the top k."""
    own = _docs(spark, d).select(F.col("cpv_code").alias("qid"), "doc_id")
    return R.top_k(_bm25(spark, d).join(own, ["qid", "doc_id"], "left_anti"), "qid", "doc_id", K).select("qid", "doc_id", "score", "rank")


def lexical_rerank(spark: SparkSession, d: str) -> DataFrame:
    top = R.top_k(_bm25(spark, d), "qid", "doc_id", 20)
    full = top.join(_docs(spark, d).select("doc_id", "text"), "doc_id").join(F.broadcast(_questions(spark, d)), "qid")
    full = full.withColumn("ov", overlap(tokens(F.col("question")), tokens(F.col("text"))))
    return R.rerank_head(full, "qid", "doc_id", F.col("ov"), 0.35, K).select("qid", "doc_id", "rank", "new_rank", "final")


def context_char_budget(spark: SparkSession, d: str) -> DataFrame:
    top = R.top_k(_bm25(spark, d), "qid", "doc_id", K).join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    return R.context_budget(top, "qid", "text", 3000).select("qid", "doc_id", "rank", "chars_upto")


def context_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The best document of each source in each ranking."""
    from pyspark.sql.window import Window

    top = R.top_k(_bm25(spark, d), "qid", "doc_id", K).join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    first = F.row_number().over(Window.partitionBy("qid", "source").orderBy("rank"))
    return top.withColumn("r", first).where("r = 1").select("qid", "source", "doc_id", "rank")


def _graded(spark, d):
    """Documents against questions by common code levels: 8 digits grade 3, 4 digits grade 2, 2 digits grade 1."""
    lv = cpv.level(F.col("qid"), F.col("cpv_code"))
    return F.when(lv == 8, 3).when(lv >= 4, 2).when(lv == 2, 1).otherwise(0)


def relevance_grades(spark: SparkSession, d: str) -> DataFrame:
    top = R.top_k(_bm25(spark, d), "qid", "doc_id", K).join(_docs(spark, d).select("doc_id", "cpv_code"), "doc_id")
    return top.select("qid", "doc_id", "rank", F.coalesce(_graded(spark, d), F.lit(0)).alias("grade"))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    ranked = relevance_grades(spark, d)
    q = _questions(spark, d).select("qid", F.substring("qid", 1, 2).alias("division"))
    codes = _docs(spark, d).where("cpv_code is not null").groupBy("cpv_code").agg(F.count("*").alias("n"))
    # the pool by code, not by document: copies are spread out only up to the k that the ideal needs
    pairs = q.join(codes.withColumn("division", F.substring("cpv_code", 1, 2)), "division").withColumn("grade", _graded(spark, d))
    pool = pairs.groupBy("qid", "grade").agg(F.sum("n").alias("n"))
    ideal = pool.withColumn("i", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(K)).cast("int")))).select("qid", "grade")
    m = E.ranking_metrics(ranked, "qid", "grade", ideal, K).drop("recall")
    n_rel = pool.where("grade >= 2").groupBy("qid").agg(F.sum("n").alias("n_relevant"))
    hits = ranked.where("grade >= 2").groupBy("qid").agg(F.count("*").alias("hits"))
    return m.join(n_rel, "qid", "left").join(hits, "qid", "left").select(
        "qid", "mrr", "ndcg", "precision", "first_relevant_rank", F.round(F.when(F.col("n_relevant") > 0, F.coalesce("hits", F.lit(0)) / F.col("n_relevant")), 6).alias("recall")
    )


def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    m = retrieval_metrics(spark, d).withColumn("division", F.substring("qid", 1, 2))
    return m.rollup("division").agg(F.count("*").alias("n"), F.round(F.avg("mrr"), 5).alias("mrr"), F.round(F.avg("ndcg"), 5).alias("ndcg"), F.round(F.avg("recall"), 5).alias("recall"), F.count_if(F.col("first_relevant_rank").isNull()).alias("no_hit"))


def ranked_eval_dense(spark: SparkSession, d: str) -> DataFrame:
    """Vector neighbours judged by their label: accuracy at 1, hits, precision, reciprocal rank."""
    lab = table(spark, d, "embeddings").select("vec_id", "label")
    t = dense_topk(spark, d).join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("qid"), F.col("label").alias("gold")), "qid")
    ok = F.col("label") == F.col("gold")
    return t.groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, ok.cast("int"))).alias("top1"), F.count_if(ok).alias("hits"), F.round(F.coalesce(1 / F.min(F.when(ok, F.col("rank"))), F.lit(0.0)), 6).alias("rr"), F.round(F.count_if(ok) / F.lit(K), 6).alias("precision")
    )


def rank_profile(spark: SparkSession, d: str) -> DataFrame:
    r = relevance_grades(spark, d)
    return r.groupBy("rank").agg(F.count("*").alias("n"), F.round(F.avg((F.col("grade") >= 2).cast("int")), 6).alias("relevance_rate"), F.round(F.avg("grade"), 6).alias("mean_grade"))


def unique_chunks_by_k(spark: SparkSession, d: str) -> DataFrame:
    """Different documents, and relevant ones, among all rankings up to each rank."""
    from pyspark.sql.window import Window

    r = relevance_grades(spark, d)
    first = r.groupBy("doc_id").agg(F.min("rank").alias("rank"), F.min(F.when(F.col("grade") >= 2, F.col("rank"))).alias("rel_rank"))
    a = first.groupBy("rank").agg(F.count("*").alias("new"))
    b = first.where("rel_rank is not null").groupBy(F.col("rel_rank").alias("rank")).agg(F.count("*").alias("new_rel"))
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # at most K rows
    return a.join(b, "rank", "full").select("rank", F.sum(F.coalesce("new", F.lit(0))).over(upto).alias("unique_docs"), F.sum(F.coalesce("new_rel", F.lit(0))).over(upto).alias("unique_relevant"))


def score_margin(spark: SparkSession, d: str) -> DataFrame:
    """Difference of the two best scores and entropy of the scores of each ranking."""
    t = bm25_topk(spark, d)
    top = t.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"), F.sum("score").alias("total"), F.count("*").alias("n"))
    h = t.join(top, "qid").groupBy("qid").agg(F.sum(-(F.col("score") / F.col("total")) * F.log(F.col("score") / F.col("total"))).alias("h"))
    return top.join(h, "qid").select("qid", F.round(F.col("s1") - F.coalesce("s2", F.lit(0.0)), 3).alias("margin"), F.round(F.when(F.col("n") > 1, F.col("h") / F.log("n")), 3).alias("entropy"))


QUERIES = {f.__name__: f for f in (clean_text, chunk_fixed_words, chunk_by_section, chunk_by_paragraph, vocabulary, bm25_topk, tfidf_topk, dense_topk, hybrid_alpha_topk, rrf_fusion_topk, metadata_filtered_topk, fulltext_topk, evidence_rerank, context_modes, cross_rerank, metadata_fuzzy_filter, self_exclusion_topk, lexical_rerank, context_char_budget, context_dedupe, relevance_grades, retrieval_metrics, retrieval_summary, ranked_eval_dense, rank_profile, unique_chunks_by_k, score_margin)}

_TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}\p{{M}}]+')"
_GRAMS = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
_LEX = f"""with dt as (select doc_id, unnest({_TOK.format('text')}) term from documents),
 p as (select doc_id, term, count(*) tf from dt group by all),
 len as (select doc_id, len({_TOK.format('text')}) n from documents), st as (select count(*) nn, avg(n) avgdl from len),
 dfs as (select term, count(*) df from p group by 1),
 q as (select code qid, term, count(*) qtf from (select code, unnest({_TOK.format('en')}) term from cpv_catalog where en is not null) group by all),
 i0 as (select term, ln(nn - df + 0.5) - ln(df + 0.5) idf from dfs, st), im as (select avg(idf) m from i0),
 idf as (select term, case when idf < 0 then 0.25 * m else idf end idf from i0, im),
 bm as (select q.qid, p.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avgdl))) score from p join q using (term) join idf using (term) join len using (doc_id), st group by all),
 dg as (select doc_id, term, count(*) tf from (select doc_id, unnest({_GRAMS}) term from (select doc_id, list_filter({_TOK.format('text')}, lambda x: length(x) > 1) t from documents)) group by all),
 qg as (select qid, term, count(*) qtf from (select qid, unnest({_GRAMS}) term from (select code qid, list_filter({_TOK.format('en')}, lambda x: length(x) > 1) t from cpv_catalog where en is not null)) group by all),
 tg as (select term, count(*) df, row_number() over (order by sum(tf) desc, term) r from dg group by 1),
 ti as (select term, ln((1 + nn) / (1 + df)) + 1 idf from tg, st where r <= 50000),
 tw as (select doc_id, term, tf * idf w from dg join ti using (term)), tn as (select doc_id, sqrt(sum(w * w)) nrm from tw group by 1),
 qw as (select qid, term, qtf * idf w from qg join ti using (term)), qn as (select qid, sqrt(sum(w * w)) nrm from qw group by 1),
 tf as (select qid, doc_id, sum(tw.w * qw.w) / any_value(tn.nrm) / any_value(qn.nrm) score from tw join qw using (term) join tn using (doc_id) join qn using (qid) group by all)
"""


def _top(rel: str, k: int, name: str) -> str:
    return f", {name} as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) rank from (select * replace (round(score, 6) as score) from {rel})) where rank <= {k})\n"


_BM = _LEX + _top("bm", K, "b")
_MM = "case when max(score) over w - min(score) over w < 1e-12 then (case when max(score) over w > 0 then 1.0 else 0.0 end) else (score - min(score) over w) / (max(score) over w - min(score) over w) end"
_GRADE = "case when qid = cpv_code then 3 when substr(qid, 1, 4) = substr(cpv_code, 1, 4) then 2 when substr(qid, 1, 2) = substr(cpv_code, 1, 2) then 1 else 0 end"
_GR = _BM + f", g as (select qid, doc_id, rank, {_GRADE} grade from b join documents using (doc_id))\n"
_MET = _GR + f""", pool as (select code qid, {_GRADE.replace('qid', 'code')} grade from cpv_catalog join documents on substr(code, 1, 2) = substr(cpv_code, 1, 2) where en is not null),
 pr as (select *, row_number() over (partition by qid order by grade desc) p from pool), idl as (select qid, sum(case when p <= {K} then (2 ^ grade - 1) / log2(p + 1) end) idcg, count(*) filter (grade >= 2) n_relevant from pr group by 1),
 gg as (select qid, sum((2 ^ grade - 1) / log2(rank + 1)) dcg, min(rank) filter (grade >= 2) fr, count(*) filter (grade >= 2) hits from g group by 1),
 m as (select qid, round(coalesce(1 / fr, 0.0), 6) mrr, round(coalesce(least(dcg / idcg, 1.0), 0.0), 6) ndcg, round(hits / {K}, 6) "precision", fr::int first_relevant_rank, round(case when n_relevant > 0 then hits / n_relevant end, 6) recall from gg left join idl using (qid))
"""
_DENSE = f""", dn as (select * from (select q.vec_id qid, e.vec_id, round(list_inner_product(q.embedding::double[], e.embedding::double[]), 6) score, row_number() over (partition by q.vec_id order by round(list_inner_product(q.embedding::double[], e.embedding::double[]), 6) desc, e.vec_id) rank
 from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 100 = 0) where rank <= {K})"""
ORACLE = {
    "clean_text": r"""select paragraph_row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '-\n([a-zäöüß])', '\1', 'g'), '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g') cleaned from doc_paragraphs""",
    "chunk_by_paragraph": r"""select section_row_id, (i - 1)::int paragraph_index, length(p[i])::int n_chars from (select section_row_id, p, unnest(range(1, len(p) + 1)) i from (select section_row_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')), lambda x: x <> '') p from doc_sections))""",
    "chunk_fixed_words": r"""select doc_id, i::int chunk_index, (i * 100)::int start_word, least(i * 100 + 120, len(w))::int end_word, array_to_string(w[i * 100 + 1 : i * 100 + 120], ' ') as text
        from (select doc_id, w, unnest(range(0, 1 + ceil(greatest(len(w) - 120, 0) / 100)::int)) i from (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') w from documents) where len(w) > 0)""",
    "chunk_by_section": r"select section_row_id, doc_id, section_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::int n_words from doc_sections where trim(text) <> ''",
    "vocabulary": f"with dt as (select doc_id, unnest({_TOK.format('text')}) term from documents) select term, count(distinct doc_id) df, count(*) cf from dt group by 1",
    "bm25_topk": _BM + "select qid, doc_id, score, rank from b",
    "tfidf_topk": _LEX + _top("tf", K, "b") + "select qid, doc_id, score, rank from b",
    "dense_topk": _DENSE.replace(", dn", "with dn", 1) + " select * from dn",
    "hybrid_alpha_topk": _LEX + _top("tf", DEPTH, "t1") + _top("bm", DEPTH, "b1") + f""", a1 as (select qid, doc_id, {_MM} s from t1 window w as (partition by qid)), a2 as (select qid, doc_id, {_MM} s from b1 window w as (partition by qid)),
        hy as (select qid, doc_id, 0.6 * coalesce(a1.s, 0) + 0.4 * coalesce(a2.s, 0) score from a1 full join a2 using (qid, doc_id))""" + _top("hy", K, "b") + "select qid, doc_id, score, rank from b",
    "rrf_fusion_topk": _LEX + _top("tf", DEPTH, "t1") + _top("bm", DEPTH, "b1") + ", rr as (select qid, doc_id, sum(part) score, count(*)::int n_channels from (select qid, doc_id, 1.0 / (60 + rank) part from t1 union all select qid, doc_id, 0.8 / (60 + rank) from b1) group by all)" + _top("rr", K, "b") + "select qid, doc_id, score, n_channels, rank from b",
    "metadata_filtered_topk": _LEX + ", f as (select * from bm where doc_id in (select doc_id from documents where source in ('national_portal', 'utility_board')))" + _top("f", K, "b") + "select qid, doc_id, score, rank from b",
    "fulltext_topk": _LEX + ", fi as (select term, greatest(ln(nn - df + 0.5) - ln(df + 0.5), 1e-6) idf from dfs, st), f as (select q.qid, p.doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avgdl))) score from p join q using (term) join fi using (term) join len using (doc_id), st group by all)" + _top("f", K, "b") + "select qid, doc_id, score, rank from b",
    "evidence_rerank": _LEX + _top("bm", 20, "b") + f""", o as (select qid, doc_id, score, list_filter(list_distinct({_TOK.format('en')}), lambda x: length(x) > 2) qw, list_distinct({_TOK.format("concat_ws(' ', source, text)")}) tw, list_distinct({_TOK.format('source')}) sw, list_distinct(regexp_extract_all(en, '[0-9]+(?:[.,][0-9]+)?')) qn, list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)?')) tn from b join documents using (doc_id) join cpv_catalog on code = qid),
        z as (select qid, doc_id, round(0.50 * ({_MM}) + 0.30 * (case when len(qw) > 0 then len(list_intersect(qw, tw)) / len(qw) else 0.0 end) + 0.15 * (case when len(qn) > 0 then len(list_intersect(qn, tn)) / len(qn) else 1.0 end) + 0.05 * (case when len(qw) > 0 then len(list_intersect(qw, sw)) / len(qw) else 0.0 end), 6) final from o window w as (partition by qid))
        select qid, doc_id, final, row_number() over (partition by qid order by final desc, doc_id)::int new_rank from z""",
    "context_modes": _LEX + _top("bm", 20, "b") + """, t as (select qid, doc_id, rank, text, coalesce(source, chr(3)) doc, coalesce(lang, chr(3)) lang from b join documents using (doc_id)),
        m as (select 'ranked' mode, *, rank o from t union all select 'kg_first', *, case when rank % 5 = 0 then rank else 100 + rank end from t union all select 'group_by_doc', * exclude (g), dense_rank() over (partition by qid order by g, doc) * 100 + rank from (select *, min(rank) over (partition by qid, doc) g from t) union all select 'dedupe_section', * exclude (s), rank from (select *, row_number() over (partition by qid, doc, lang order by rank) s from t) where s = 1),
        pl as (select *, row_number() over (partition by mode, qid order by o) place from m), u as (select *, sum(length(text)) over (partition by mode, qid order by place) c from pl where place <= 8) select mode, qid, doc_id, place::int place from u where c <= 4000 or place = 1""",
    "cross_rerank": _LEX + _top("bm", 20, "b") + f""", o as (select qid, doc_id, score s0, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(en), '\\s+'), lambda x: x <> '')), list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) / greatest(1, len(list_distinct(list_filter(regexp_split_to_array(lower(en), '\\s+'), lambda x: x <> '')))) mx from b join documents using (doc_id) join cpv_catalog on code = qid),
        z as (select qid, doc_id, round(0.65 * ({_MM.replace('score', 'mx')}) + 0.35 * ({_MM.replace('score', 's0')}), 6) score from o window w as (partition by qid)) select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id)::int rank from z""",
    "metadata_fuzzy_filter": "select doc_id from documents where (contains(coalesce(source, ''), 'national') and contains(source, 'portal') or source in ('utility_board', 'board', 'utility')) and coalesce(lang, '') not in ('de')",
    "self_exclusion_topk": _LEX + ", f as (select bm.* from bm join documents using (doc_id) where cpv_code is distinct from qid)" + _top("f", K, "b") + "select qid, doc_id, score, rank from b",
    "lexical_rerank": _LEX + _top("bm", 20, "b") + f""", o as (select b.*, len(list_intersect(list_distinct({_TOK.format('en')}), list_distinct({_TOK.format('text')}))) / len(list_distinct({_TOK.format('en')})) ov from b join documents using (doc_id) join cpv_catalog on code = qid),
        z as (select *, case when rank > {K} then score else round(0.65 * ({_MM}) + 0.35 * ov, 6) end final from o window w as (partition by qid))
        select qid, doc_id, rank, row_number() over (partition by qid order by rank > {K}, final desc, doc_id) new_rank, final from z""",
    "context_char_budget": _BM + "select * from (select qid, doc_id, rank, sum(length(text)) over (partition by qid order by rank)::bigint chars_upto from b join documents using (doc_id)) where chars_upto <= 3000 or rank = 1",
    "context_dedupe": _BM + "select qid, source, doc_id, rank from (select *, row_number() over (partition by qid, source order by rank) r from b join documents using (doc_id)) where r = 1",
    "relevance_grades": _GR + "select * from g",
    "retrieval_metrics": _MET + "select * from m",
    "retrieval_summary": _MET + "select substr(qid, 1, 2) division, count(*) n, round(avg(mrr), 5) mrr, round(avg(ndcg), 5) ndcg, round(avg(recall), 5) recall, count(*) filter (first_relevant_rank is null) no_hit from m group by rollup (substr(qid, 1, 2))",
    "ranked_eval_dense": _DENSE.replace(", dn", "with dn", 1) + f" select qid, max(case when rank = 1 then (a.label = g.label)::int end) top1, count(*) filter (a.label = g.label) hits, round(coalesce(1 / min(rank) filter (a.label = g.label), 0.0), 6) rr, round(count(*) filter (a.label = g.label) / {K}, 6) \"precision\" from dn join embeddings a on a.vec_id = dn.vec_id join embeddings g on g.vec_id = qid group by 1",
    "rank_profile": _GR + "select rank, count(*) n, round(avg((grade >= 2)::int), 6) relevance_rate, round(avg(grade), 6) mean_grade from g group by 1",
    "unique_chunks_by_k": _GR + "select k.rank, (select count(distinct doc_id) from g where g.rank <= k.rank) unique_docs, (select count(distinct doc_id) from g where g.rank <= k.rank and grade >= 2) unique_relevant from (select distinct rank from g) k",
    "score_margin": _BM + "select qid, round(max(score) filter (rank = 1) - coalesce(max(score) filter (rank = 2), 0), 3) margin, round(case when count(*) > 1 then sum(-(score / t) * ln(score / t)) / ln(count(*)) end, 3) entropy from (select *, sum(score) over (partition by qid) t from b) group by 1",
}
