"""Queries: knowledge graph of the sections of documents. Questions are the titles of sections, their gold triples the section's place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from rillway.functions.matching import name_form
from rillway.operators import answers as A, kg as K
from rillway.session import Scratch, spread, table


def _chunks(spark, d):
    """Sections, repeated ones once."""
    s = table(spark, d, "doc_sections").where("text is not null").groupBy("doc_id", "section_position").agg(F.min_by(F.struct("section_row_id", "program_name", "section_id", "title", "text"), "section_row_id").alias("s"))
    return spread(s.select(F.col("s.section_row_id").alias("chunk_id"), "doc_id", F.col("s.program_name").alias("program"), F.col("s.section_id").alias("section_id"), F.col("s.title").alias("title"), F.col("s.text").alias("text")))


def kg_entities(spark: SparkSession, d: str) -> DataFrame:
    return K.entities(_chunks(spark, d)).select("entity_id", "chunk_id", "sentence_id", "name", "entity_type", "norm", "start_char", "end_char", "start_word")


def kg_structure(spark: SparkSession, d: str) -> DataFrame:
    return K.structure(_chunks(spark, d)).select("chunk_id", "subject", "predicate", "object")


def _graph(spark, d, lean=False):
    s = Scratch(spark)
    c = s.cut(_chunks(spark, d))
    e = s.cut(K.entities(c, lean=lean).drop("start_word"))  # which nothing here reads, and which needs the whole text beside every entity
    return c, e, s.cut(K.relations(e))


def kg_relations(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[2].select("relation_id", "chunk_id", "subject_norm", "predicate", "object_norm")


def kg_predicates(spark: SparkSession, d: str) -> DataFrame:
    r = _graph(spark, d)[2]
    return r.groupBy("predicate", "object_type").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("n_chunks"))


def kg_quality(spark: SparkSession, d: str) -> DataFrame:
    c, e, r = _graph(spark, d)
    return K.quality(e, r, c)


def _questions(c):
    return c.where("title is not null").groupBy("doc_id").agg(F.min_by(F.struct("title", F.substring("text", 1, 60).alias("head")), "chunk_id").alias("x")).select(F.col("doc_id").alias("qid"), F.concat_ws(" ", "x.title", F.lit("Frist"), "x.head").alias("question"))


def _retrieved(c, k=3):
    """Chunks of the question's document by length, as a stand-in ranking of a retriever."""
    w = Window.partitionBy("qid").orderBy(F.desc("n"), "chunk_id")
    return c.select(F.col("doc_id").alias("qid"), "chunk_id", F.length("text").alias("n")).select("qid", "chunk_id", F.row_number().over(w).alias("rank")).where(f"rank <= {k}").withColumn("score", 1.0 / F.col("rank"))


def kg_augmented_retrieval(spark: SparkSession, d: str) -> DataFrame:
    c, e, r = _graph(spark, d)
    return K.augmented_retrieval(_questions(c), _retrieved(c), e, r, c, "balanced")


def kg_augmented_direct(spark: SparkSession, d: str) -> DataFrame:
    c, e, r = _graph(spark, d)
    return K.augmented_retrieval(_questions(c), _retrieved(c), e, r, c, "direct_only")


def _triples(c):
    return c.select(F.col("doc_id").alias("qid"), F.col("section_id").alias("subject"), F.lit("stands_in").alias("predicate"), F.col("title").alias("object"), F.col("doc_id").alias("evidence_doc"), F.col("section_id").alias("evidence_section"), F.array().cast("array<string>").alias("cues"))


def kg_triple_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Gold triples (section, stands in, title) against what is retrieved."""
    c = _chunks(spark, d)
    ctx = _retrieved(c).join(c, "chunk_id").select("qid", "doc_id", "section_id", F.concat_ws(" ", "section_id", "title", "text").alias("text"))
    return K.triple_hits(_triples(c), ctx)


def kg_expansion_gain(spark: SparkSession, d: str) -> DataFrame:
    c, e, r = _graph(spark, d)
    show = lambda x: x.join(c, "chunk_id").select("qid", "doc_id", "section_id", F.concat_ws(" ", "section_id", "title", "text").alias("text"))
    got = K.augmented_retrieval(_questions(c), _retrieved(c), e, r, c, "exploratory")
    return K.expansion_gain(K.triple_hits(_triples(c), show(_retrieved(c))), K.triple_hits(_triples(c), show(got)))


def kg_added_noise(spark: SparkSession, d: str) -> DataFrame:
    c, e, r = _graph(spark, d, lean=True)
    return K.added_noise(K.augmented_retrieval(_questions(c), _retrieved(c, 1), e, r, c, "exploratory"), c, _questions(c), _triples(c))


def kg_path_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Claims of each document's longest section against its other sections, and whether the supporting ones hold relations."""
    c, e, r = _graph(spark, d)
    long = Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "chunk_id")
    top = c.withColumn("n", F.row_number().over(long))
    items = top.where("n = 1").select(F.col("doc_id").alias("qid"), F.col("text").alias("answer"), F.col("title").alias("gold"), F.lit("").alias("question"), F.array("title").alias("keywords"), F.lit(True).alias("answerable"))
    chunks = top.where("n > 1").select(F.col("doc_id").alias("qid"), "chunk_id", F.col("n").alias("rank"), "text")
    m = A.claim_map(items, chunks).where("claim_type = 'answer'").select("qid", F.col("best_chunk").alias("chunk_id"), "in_context")
    return K.path_grounding(m, r.join(c.select("chunk_id", F.col("doc_id").alias("qid")), "chunk_id"))


def kg_supervision(spark: SparkSession, d: str) -> DataFrame:
    return K.supervision_terms(_triples(_chunks(spark, d)).where("subject is not null and object is not null"))


def relation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Intent and faithfulness of every relation against its own section's title."""
    c, _, r = _graph(spark, d)
    j = r.join(c.select("chunk_id", name_form(F.col("title")).alias("qn"), "section_id", F.col("title").alias("question"), "doc_id"), "chunk_id")
    return j.select(
        "relation_id", F.round(K.intent_score(F.col("qn"), F.col("predicate"), F.col("subject_norm"), F.col("object_norm"), F.lower("evidence")), 6).alias("intent"), F.round(K.faithfulness(F.col("predicate"), F.col("subject_norm"), F.col("object_norm"), name_form(F.col("evidence"))), 6).alias("faithfulness"),
        K.chunk_quality(F.col("question"), F.col("doc_id"), F.col("section_id")).alias("quality"),
    )


QUERIES = {f.__name__: f for f in (kg_entities, kg_structure, kg_relations, kg_predicates, kg_quality, kg_augmented_retrieval, kg_augmented_direct, kg_triple_evaluation, kg_expansion_gain, kg_added_noise, kg_path_grounding, kg_supervision, relation_scores)}

_CH = """with ch as (select section_row_id chunk_id, doc_id, coalesce(program_name, '') program, coalesce(section_id, '') section_id, coalesce(title, '') title, text from doc_sections s where text is not null and section_row_id = (select min(section_row_id) from doc_sections t where t.doc_id = s.doc_id and t.section_position = s.section_position and t.text is not null))"""
_NF = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[\"''`´„“”‘’«»]', '', 'g'), '[^\p{{L}}\p{{N}}_§.,\-\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_IN = "({1} <> '' and (contains({0}, {1}) or len(list_filter(string_split({1}, ' '), lambda w: not list_contains(string_split({0}, ' '), w))) = 0))"
ORACLE = {
    "kg_structure": _CH + r""", c as (select chunk_id, doc_id, trim(regexp_replace(program, '\s+', ' ', 'g')) program, trim(regexp_replace(section_id, '\s+', ' ', 'g')) section_id, trim(regexp_replace(title, '\s+', ' ', 'g')) title from ch)
        select * from (select chunk_id, doc_id subject, 'applies_to' predicate, program "object" from c union all select chunk_id, doc_id, 'contains', section_id from c union all select chunk_id, section_id, 'part_of', doc_id from c union all select chunk_id, section_id, 'contains', title from c where title <> section_id
        union all select chunk_id, doc_id, 'amends', program from c where regexp_matches(lower(doc_id), 'aenderung|änderung') union all select chunk_id, doc_id, 'replaces', program from c where contains(lower(doc_id), 'auslauf')) where subject <> '' and "object" <> ''""",
    "kg_triple_evaluation": _CH + f""", rt as (select doc_id qid, chunk_id, section_id, title, text from (select *, row_number() over (partition by doc_id order by length(text) desc, chunk_id) r from ch) where r <= 3),
        cx as (select qid, {_NF.format("array_to_string(list_sort(list(concat_ws(' ', section_id, nullif(title, ''), text))), ' ')")} x, list(distinct section_id) ids from rt group by 1),
        t as (select doc_id qid, section_id, {_NF.format('section_id')} sn, {_NF.format('title')} o from ch where trim(section_id) <> '' and trim(title) <> ''),
        h as (select qid, list_contains(ids, section_id) sec, {_IN.format('x', 'sn')} s, {_IN.format('x', 'o')} o, {_IN.format('x', 'sn')} and {_IN.format('x', 'o')} and contains(x, '§') r from t join cx using (qid))
        select qid, count(*) n_triples, 1.0::double doc_recall, round(avg(sec::int), 6) section_recall, round(avg(s::int), 6) subject_recall, round(avg(o::int), 6) object_recall, round(avg(r::int), 6) relation_evidence_recall, null::double relation_recall,
        case when bool_or(not sec) then 'missing_section' when bool_or(not s) and bool_or(not o) then 'entities_missing' when bool_or(not s) then 'subject_missing' when bool_or(not o) then 'object_missing' when bool_or(not r) then 'entities_found_relation_missing' else 'ok' end error from h group by 1""",
}
