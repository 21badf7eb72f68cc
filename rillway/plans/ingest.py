"""Queries: sections, paragraphs, tables as text, sentences; notices to records, examples, catalogues and splits; document versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from rillway.operators import notices as N, sections as S
from rillway.session import Scratch, spread, table


def _documents(spark, d):
    """Whole documents: their sections under their headings, in order; repeated sections count once."""
    s = table(spark, d, "doc_sections").groupBy("doc_id", "section_position").agg(F.min_by(F.struct("section_id", "title", "text"), "section_row_id").alias("s"))
    part = F.concat_ws("\n", F.when(F.col("s.section_id") != "PREAMBLE", F.concat_ws(" ", "s.section_id", "s.title")), "s.text")
    g = s.select("doc_id", F.struct("section_position", part.alias("t")).alias("p")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "\n").alias("text"))
    return spread(g)


def sectioniser(spark: SparkSession, d: str) -> DataFrame:
    s = S.sections(_documents(spark, d), "doc_id", "text")
    return s.select("doc_id", "section_position", "section_id", "title", F.md5("text").alias("text"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "doc_sections").select("section_row_id", F.posexplode(S.paragraphs(F.col("text"))).alias("paragraph_index", "text"))
    return t.select("section_row_id", "paragraph_index", F.length("text").alias("n_chars"), F.md5("text").alias("text"))


def toc_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "doc_sections").select("section_row_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(S.is_toc_line(F.trim("line"))).select("section_row_id", "pos")


def table_text(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue's labels of each division as a table in text."""
    c = table(spark, d, "cpv_catalog").select(F.substring("code", 1, 2).alias("division"), F.struct("code", F.array("code", "en", "de", "bg").alias("r")).alias("x"))
    g = c.groupBy("division").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return g.select("division", S.table_text(F.transform("xs", lambda x: x["r"]), F.col("division").cast("int")).alias("text"))


def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "doc_paragraphs").select("paragraph_row_id", "text"))
    return t.select("paragraph_row_id", F.inline(S.sentences(F.col("text")))).select("paragraph_row_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.md5("text").alias("text"))


def chunk_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all strategies in one relation: windows of words over sections and paragraphs, whole sections, whole paragraphs."""
    s, p = table(spark, d, "doc_sections").select(F.col("section_row_id").alias("unit"), "text"), table(spark, d, "doc_paragraphs").select(F.col("paragraph_row_id").alias("unit"), "text")
    kinds = (("fixed_words", s, 120, 100), ("fixed_tokens", p, 120, 100), ("by_section", s, 0, 0), ("by_paragraph", p, 0, 0))
    out = None
    for name, units, size, step in kinds:
        c = S.chunks_of(spread(units), "unit", "text", size, step).select(F.lit(name).alias("strategy"), "unit", "chunk_index", "start_word", "end_word", "n_words", F.md5("text").alias("text"))
        out = c if out is None else out.unionByName(c)
    return out


def _records(spark, d):
    return N.records(spread(table(spark, d, "ted_notices").select("notice_row_id", "raw_notice_json")), "notice_row_id", "raw_notice_json")


def notice_records(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    return r.select("notice_row_id", "publication_number", "main_cpv_code", F.array_join("all_cpv_codes", ",").alias("all_cpv_codes"), "notice_title", "title_proc", "buyer_name", F.array_join("official_languages", ",").alias("official_languages"), "language_count", F.md5("combined_text").alias("combined_text"))


def notice_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return N.catalogue_rows(_records(spark, d), "notice_row_id", 2)


def split_queries(spark: SparkSession, d: str) -> DataFrame:
    return N.split_dataset(_records(spark, d), "notice_row_id")[1]


def notice_examples(spark: SparkSession, d: str) -> DataFrame:
    return N.example_variants(_records(spark, d), "notice_row_id")


def example_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "cpv_notice_examples").where("example_text is not null")
    return e.select("example_id", N.example_key(F.col("example_text")).alias("k"), N.low_signal(F.col("example_text")).cast("int").alias("low_signal"), N.example_score(F.col("source_field"), F.col("example_text")).alias("score"), N.trimmed(F.col("example_text"), 130).alias("head"))


def example_selection(spark: SparkSession, d: str) -> DataFrame:
    return N.select_examples(table(spark, d, "cpv_notice_examples"))


def _versions(spark, d):
    p = table(spark, d, "doc_sections").groupBy("doc_id", "program_id").agg(F.min_by("text", "section_position").alias("text"))
    return p.select("doc_id", "program_id", N.doc_type(F.col("doc_id")).alias("kind"), N.doc_year(F.col("doc_id"), F.col("text")).alias("doc_year"))


def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d)


def asof_document_version(spark: SparkSession, d: str) -> DataFrame:
    """For each program and year from 2018 to 2026 the documents in force; kinds and years come from the numbers of the documents."""
    docs = table(spark, d, "doc_sections").select("doc_id", "program_id").distinct()
    n = F.regexp_extract("doc_id", r"(\d+)\.pdf$", 1).cast("int")
    docs = docs.select("doc_id", "program_id", F.when(n % 3 == 0, "base").when(n % 3 == 1, "amendment").otherwise("correction").alias("kind"), (2016 + n % 10).alias("doc_year"))
    years = docs.select("program_id").distinct().select("program_id", F.explode(F.sequence(F.lit(2018), F.lit(2026))).alias("year")).withColumn("qid", F.concat_ws("-", "program_id", "year"))
    return N.version_as_of(docs, years)


def question_types(spark: SparkSession, d: str) -> DataFrame:
    """Sorts of question of the notices' titles by how many documents and codes they have."""
    n = table(spark, d, "ted_notices").select("notice_row_id", "title_proc", F.size(F.regexp_extract_all(F.coalesce("all_cpv_codes_json", F.lit("")), F.lit(r"\d{8}"), F.lit(0))).alias("k"))
    return n.select("notice_row_id", N.question_type(F.lit(""), F.col("title_proc"), F.lit(1), F.col("k")).alias("question_type"))


def catalogue_merge(spark: SparkSession, d: str) -> DataFrame:
    """The official catalogue with that learned from examples."""
    o = table(spark, d, "cpv_catalog").select("code", F.col("en").alias("label"), F.col("de").alias("description"), F.array_compact(F.array("fr", "es")).alias("examples"))
    e = table(spark, d, "cpv_notice_examples").where("example_text is not null").groupBy("cpv_code", "example_text").agg(F.min("example_id").alias("i"))
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("cpv_code").orderBy("i"))).where("r <= 3").groupBy("cpv_code").agg(F.array_sort(F.collect_list(F.struct("r", "example_text"))).alias("x"))
    t = e.select(F.col("cpv_code").alias("code"), F.col("x")[0]["example_text"].alias("label"), F.lit(None).cast("string").alias("description"), F.transform("x", lambda r: r["example_text"]).alias("examples"))
    return N.catalogue_merge(o, t).select("code", "label", "description", F.array_join("examples", " || ").alias("examples"))


QUERIES = {f.__name__: f for f in (sectioniser, paragraphs, toc_lines, table_text, sentence_spans, chunk_strategies, notice_records, notice_catalogue, split_queries, notice_examples, example_keys, example_selection, document_kinds, asof_document_version, question_types, catalogue_merge)}

_WS = r"[\s\p{Z}\x{85}]+"


def st(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"


_TOC = r"(regexp_matches({0}, '\.{{5,}}\s*\d*\s*$') or (regexp_matches({0}, '^[IVX]+\.\s+\S') and len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')) <= 6) or (regexp_matches({0}, '^Anlage(?:\(n\))?:') and regexp_matches({0}, '\b\d+\b')))"
_CLEAN = r"replace(trim({0}, e' \t\n\r'), chr(10), ' / ')"


def chunk_sql(name: str, rel: str, key: str, size: int, step: int) -> str:
    w = f"(select {key} unit, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') w from {rel})"
    if not size:
        return f"select '{name}' strategy, unit, 0 chunk_index, 0 start_word, len(w)::int end_word, len(w)::int n_words, md5(array_to_string(w, ' ')) as text from {w} where len(w) > 0"
    return f"select '{name}' strategy, unit, i::int chunk_index, (i * {step})::int start_word, least(i * {step} + {size}, len(w))::int end_word, len(w[i * {step} + 1 : i * {step} + {size}])::int n_words, md5(array_to_string(w[i * {step} + 1 : i * {step} + {size}], ' ')) as text from (select unit, w, unnest(range(0, 1 + ceil(greatest(len(w) - {size}, 0) / {step})::int)) i from {w} where len(w) > 0)"


def _lang(key: str) -> str:
    one = lambda j: f"(case json_type({j}) when 'ARRAY' then list_filter(from_json({j}, '[\"VARCHAR\"]'), lambda v: coalesce(trim(v), '') <> '')[1] when 'VARCHAR' then {j} ->> '$' end)"
    v = f"json_extract(j, '$.\"{key}\"')"
    pref = ", ".join(f"nullif(trim({one(f'json_extract({v}, ' + chr(39) + '$.' + x + chr(39) + ')')}), '')" for x in N.PREFERRED)
    rest = f"list_filter(list_transform(json_keys({v}), lambda k: {one(f'json_extract({v}, ' + chr(39) + '$.' + chr(39) + ' || k)')}), lambda t: coalesce(trim(t), '') <> '')[1]"
    return f"trim(regexp_replace(coalesce(case json_type({v}) when 'OBJECT' then coalesce({pref}, {rest}) else {one(v)} end, ''), '{_WS}', ' ', 'g'))"


def _listed(key: str) -> str:
    v = f"json_extract(j, '$.\"{key}\"')"
    return f"list_filter(list_transform(case json_type({v}) when 'ARRAY' then from_json({v}, '[\"VARCHAR\"]') when 'VARCHAR' then [{v} ->> '$'] else [] end, lambda x: trim(x)), lambda x: coalesce(x, '') <> '')"


_LANGS = " || ".join(_listed(k) for k in N.LANGUAGE_KEYS)
_REC = f"""with v as (select notice_row_id, raw_notice_json::json j from ted_notices where json_valid(raw_notice_json) and raw_notice_json like '{{%'),
 r0 as (select notice_row_id, trim(coalesce(j ->> '$."publication-number"', '')) publication_number, {_listed('main-classification-proc')} mc, {_listed('additional-classification-proc')} ac, {', '.join(f'{_lang(t.replace("_", "-"))} {t}' for t in (*N.TEXTS, 'buyer_name'))}, {_LANGS} lg from v),
 rc as (select *, coalesce(mc[1], '') main_cpv_code, list_filter(lg, lambda x, i: list_position(list_transform(lg, lambda y: lower(y)), lower(x)) = i) ls, array_to_string(list_filter([notice_title, title_proc, description_proc, description_lot], lambda t: t <> ''), chr(10)) combined_text from r0)
"""
_NOISE = "regexp_matches(lower({0}), '" + "|".join(N.NOISE) + "')"
_US = _REC + f""", us as (select *, main_cpv_code code, list_filter([title_proc, description_proc, description_lot, notice_title], lambda t: length(t) >= 20 and not {_NOISE.format('t')}) texts,
  case when notice_title = '' then main_cpv_code when contains(notice_title, ' – ') and len(list_filter(list_transform(string_split(notice_title, ' – '), lambda p: trim(p)), lambda p: p <> '')) >= 3 then list_filter(list_transform(string_split(notice_title, ' – '), lambda p: trim(p)), lambda p: p <> '')[2] else notice_title end label from rc where main_cpv_code <> '' and not {_NOISE.format('notice_title')}),
 uu as (select * from us where len(texts) > 0)
"""


def _cat(where: str, least: int) -> str:
    return f""", ct as (select code, t, min(notice_row_id * 100 + i) p from (select code, notice_row_id, unnest(texts) t, unnest(range(1, len(texts) + 1)) i from uu where {where}) group by all),
 cr as (select *, row_number() over (partition by code order by p, t) r from ct), cg as (select code, arg_min(t, r) description, count(*) n_examples, string_agg(t, ' || ' order by r) examples from cr where r <= 12 group by 1 having count(*) >= {least}),
 cl as (select code, arg_min(label, notice_row_id) label from uu where {where} group by 1)
"""


_BUCKET = "(('0x' || substr(sha256(publication_number), 1, 8))::bigint / 4294967295)"
_SQ = "trim(regexp_replace({0}, '" + _WS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"
_WORDS = "len(regexp_extract_all({0}, '[A-Za-zÀ-ÖØ-öø-ÿ]{{3,}}'))"
_EX = f"(select example_id, source_field, {_SQ.format('example_text')} t from cpv_notice_examples where example_text is not null)"
_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '(^|[^\p{L}\p{N}_])[a-z]{1,4}\d{2,}[/_-]?\d+($|[^\p{L}\p{N}_])', '\1 \2', 'g'), '(^|[^\p{L}\p{N}_])\d{4,}($|[^\p{L}\p{N}_])', '\1 \2', 'g'), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
_DOCS = r"""with s as (select doc_id, section_position, arg_min(section_id, section_row_id) sid, arg_min(coalesce(title, chr(3)), section_row_id) ti, arg_min(coalesce(text, chr(3)), section_row_id) tx from doc_sections group by all),
 dc as (select doc_id, string_agg(case when sid <> 'PREAMBLE' then case when ti = chr(3) then sid else sid || ' ' || ti end || case when tx = chr(3) then '' else chr(10) || tx end when tx = chr(3) then '' else tx end, chr(10) order by section_position) as text from s group by 1)
"""
ORACLE = {
    "sectioniser": _DOCS + rf""", l0 as (select doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) raw, unnest(range(0, len(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))))) pos from dc), ln as (select doc_id, pos, {st('raw')} line from l0),
        lx as (select *, regexp_matches(line, '^§\s*\d+[a-zA-Z]?\s+.+$') hd, regexp_extract(line, '^§\s*(\d+[a-zA-Z]?)\s+(.+)$', 1) nr, trim(regexp_extract(line, '^§\s*(\d+[a-zA-Z]?)\s+(.+)$', 2)) ti, {_TOC.format('line')} toc from ln),
        so as (select *, concat_ws(' ', line, lead(line, 1) over w, lead(line, 2) over w, lead(line, 3) over w) ahead, hd and not toc and not regexp_matches(ti, '^(?:Abs\.|Absatz|Satz)(?:\s|$)') and not regexp_matches(ti, '^\p{{Ll}}') fits from lx where line <> '' window w as (partition by doc_id order by pos)),
        sf as (select *, min(case when fits and nr = '1' and contains(ahead, '(1)') then pos end) over (partition by doc_id) f from so),
        al as (select lx.doc_id, lx.pos, lx.line, lx.nr, lx.ti, coalesce(sf.fits and sf.f is not null and lx.pos >= sf.f, false) h, coalesce((sf.f is null or lx.pos < sf.f) and (lx.hd or lx.toc) and lx.line <> '', false) dr from lx left join sf using (doc_id, pos)),
        nn as (select *, sum(h::int) over (partition by doc_id order by pos) n from al where not dr),
        gg as (select doc_id, n, max('§ ' || nr) filter (h) id, max(ti) filter (h) title, {st("coalesce(string_agg(line, chr(10) order by pos) filter (not h), '')")} as text from nn group by all)
        select doc_id, (row_number() over (partition by doc_id order by n) - 1)::int section_position, coalesce(id, 'PREAMBLE') section_id, coalesce(title, 'Preamble') title, md5(text) as text from gg where text <> ''""",
    "paragraphs": rf"""select section_row_id, (i - 1)::int paragraph_index, length(p[i])::int n_chars, md5(p[i]) as text from (select section_row_id, p, unnest(range(1, len(p) + 1)) i from (select section_row_id, case when len(a) > 0 then a else b end p from
        (select section_row_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: {st('x')}), lambda x: x <> '') a, list_filter(list_transform(string_split(text, chr(10)), lambda x: {st('x')}), lambda x: x <> '') b from doc_sections)))""",
    "toc_lines": f"select section_row_id, pos::int pos from (select section_row_id, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) pos from doc_sections) where {_TOC.format('trim(line)')}",
    "table_text": "select substr(code, 1, 2) division, '[TABLE ' || substr(code, 1, 2)::int || ']' || chr(10) || string_agg(code || ' | ' || coalesce(nullif(trim(en), ''), '[EMPTY]') || ' | ' || coalesce(nullif(trim(de), ''), '[EMPTY]') || ' | ' || coalesce(nullif(trim(bg), ''), '[EMPTY]'), chr(10) order by code) as text from cpv_catalog group by 1, substr(code, 1, 2)",
    "chunk_strategies": " union all ".join((chunk_sql("fixed_words", "doc_sections", "section_row_id", 120, 100), chunk_sql("fixed_tokens", "doc_paragraphs", "paragraph_row_id", 120, 100), chunk_sql("by_section", "doc_sections", "section_row_id", 0, 0), chunk_sql("by_paragraph", "doc_paragraphs", "paragraph_row_id", 0, 0))),
    "notice_records": _REC + "select notice_row_id, publication_number, main_cpv_code, array_to_string(mc || ac, ',') all_cpv_codes, notice_title, title_proc, buyer_name, array_to_string(ls, ',') official_languages, len(ls)::int language_count, md5(combined_text) combined_text from rc",
    "notice_catalogue": _US + _cat("true", 2) + "select code, label, description, n_examples, examples from cg join cl using (code)",
    "split_queries": _US + _cat(f"{_BUCKET} < 0.8", 1) + f", q as (select texts[1] query, code gold, min(notice_row_id) k, arg_min(publication_number, notice_row_id) id, arg_min(notice_title, notice_row_id) notes from uu where {_BUCKET} >= 0.8 group by all) select id, query, gold, notes from (select * from q where gold in (select code from cg) order by k limit 100)",
    "example_keys": f"""select example_id, {_KEY} k, (length(t) < 10 or {_WORDS.format('t')} < 2)::int low_signal, round(coalesce(case source_field {' '.join(f"when '{k}' then {v}" for k, v in N.SOURCE_WEIGHT.items())} end, 0.7) + least({_WORDS.format('t')}, 18) * 0.015 - abs(least(length(t), 220) - 140) / 700.0
        - {' - '.join(f"case when contains(lower(t), '{g}') then 0.035 else 0 end" for g in N.GENERIC)} - case when regexp_matches(t, '^[A-Z0-9/_ -]{{8,}}$') then 0.08 else 0 end, 6) score,
        case when length(t) <= 130 then t else regexp_replace(case when length(regexp_extract(substr(t, 1, 130), '^(.*) [^ ]*$', 1)) >= 120 then regexp_extract(substr(t, 1, 130), '^(.*) [^ ]*$', 1) else substr(t, 1, 130) end, '[ ,;:\\-]+$', '') || '...' end head from {_EX}""",
    "asof_document_version": r"""with dd as (select distinct doc_id, program_id, regexp_extract(doc_id, '(\d+)\.pdf$', 1)::int n from doc_sections), dv as (select doc_id, program_id, case n % 3 when 0 then 'base' when 1 then 'amendment' else 'correction' end kind, 2016 + n % 10 doc_year from dd),
        qy as (select program_id, y.y::int "year", program_id || '-' || y.y qid from (select distinct program_id from dd), range(2018, 2027) y(y)), j as (select qid, doc_id, kind, doc_year, "year", max(case when kind = 'base' and doc_year <= "year" then doc_year end) over w b, max(case when doc_year <= "year" then doc_year end) over w l, min(doc_year) over w e from qy join dv using (program_id) window w as (partition by qid))
        select qid, doc_id from j where case when b is not null then (kind = 'base' and doc_year = b) or (kind <> 'base' and doc_year between b and "year") else doc_year = coalesce(l, e) end""",
    "question_types": r"""select notice_row_id, case when regexp_matches(q, '\b(?:which kind|what type|category|kategorie|art von)\b') then 'taxonomy' when regexp_matches(q, '\b(?:summar\w*|overview|overall|überblick|zusammenfass\w*)\b') then 'summary_global' when regexp_matches(q, '\b(?:relation|between|zusammenhang|zwischen|depends|abhäng\w*)\b') then 'relation' when k > 1 then 'multi_hop' else 'single_hop' end question_type
        from (select notice_row_id, lower(coalesce(title_proc, '')) q, len(regexp_extract_all(coalesce(all_cpv_codes_json, ''), '\d{8}')) k from ted_notices)""",
    "catalogue_merge": """with e as (select cpv_code code, example_text t, row_number() over (partition by cpv_code order by min(example_id)) r from cpv_notice_examples where example_text is not null group by cpv_code, example_text), g as (select code, list(t order by r) ts from e where r <= 3 group by 1),
        o as (select code, en l1, de d1, list_filter([fr, es], lambda x: x is not null) e1 from cpv_catalog), u as (select coalesce(o.code, g.code) code, coalesce(l1, ts[1]) label, d1 description, coalesce(e1, []) e1, coalesce(ts, []) ts from o full join g on o.code = g.code)
        select code, label, description, array_to_string(e1 || list_filter(ts, lambda x: not list_contains(e1, x)), ' || ') examples from u""",
}
