"""Notices as received to records, example texts, catalogues and splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rillway.functions.cpv import prefix8
from rillway.functions.text import hash_share

#: Languages in order of preference, texts that mark a notice as noise, weights of example sources and phrases that say nothing.
PREFERRED = ("eng", "deu", "fra", "ita", "spa")
NOISE = ("test", "please disregard", "lorem ipsum", "dolor sit amet", "galisum", "rem eveniet", "qui ipsa totam", "optio necessitatibus", "ipsam officia", "qui sequi excepturi")
SOURCE_WEIGHT = {"title_plus_description_lead": 1.0, "title_proc_clean": 0.97, "description_proc_lead": 0.94, "description_lot_lead": 0.9, "title_proc": 0.88, "notice_title": 0.82, "description_proc": 0.72, "description_lot": 0.68}
GENERIC = ("framework agreement", "contract notice", "procurement of", "supply and delivery of", "invitation to tender", "call for tenders", "open procedure", "negotiated procedure")
LANGUAGE_KEYS = ("official-language", "additional-notice-language", "notice-language", "languages", "lang")
TEXTS = ("notice_title", "title_proc", "description_proc", "description_lot")
MOST_EXAMPLES, PER_PUBLICATION = 12, 3


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def _first(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda v: F.coalesce(F.trim(v), F.lit("")) != ""), F.lit(1))


def _one(v: Column) -> Column:
    """A JSON value as text: a string as it is, of a list the first element that isn't blank."""
    return F.when(v.startswith("["), _first(F.from_json(v, "array<string>"))).otherwise(v)


def pick_language(raw: Column, key: str) -> Column:
    """Text of a field that is a string, a list or a map of languages: of a map the preferred languages first, then any; null where there is none."""
    v = F.get_json_object(raw, f"$['{key}']")
    m = F.from_json(v, "map<string,string>")
    by_language = F.coalesce(*[F.nullif(F.trim(_one(F.try_element_at(m, F.lit(x)))), F.lit("")) for x in PREFERRED], _first(F.transform(F.map_values(m), _one)))
    return F.when(v.startswith("{"), by_language).otherwise(_one(v))


def languages(raw: Column) -> Column:
    """Languages named by a notice in order, each once without regard to case."""
    one = lambda k: F.get_json_object(raw, f"$['{k}']")
    listed = lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).when(v.startswith("{"), F.map_keys(F.from_json(v, "map<string,string>"))).when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<string>"))
    every = F.filter(F.transform(F.flatten(F.array(*[F.coalesce(listed(one(k)), F.array().cast("array<string>")) for k in LANGUAGE_KEYS])), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    pairs = F.transform(every, lambda x: F.lower(x))
    return F.filter(F.zip_with(every, F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1))), lambda x, i: F.when(F.array_position(pairs, F.lower(x)) == i, x)), lambda x: x.isNotNull())


def records(notices: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, publication_number, main_cpv_code, all_cpv_codes, notice_title … buyer_name, official_languages, combined_text) of raw notices; unusable JSON gives no record."""
    n = notices.where(F.call_function("try_parse_json", F.col(raw)).isNotNull()).where(F.col(raw).rlike(r"^\s*\{"))
    r = F.col(raw)
    listed = lambda k: F.filter(F.transform(F.coalesce(F.when(F.get_json_object(r, f"$['{k}']").startswith("["), F.from_json(F.get_json_object(r, f"$['{k}']"), "array<string>")).when(F.get_json_object(r, f"$['{k}']").isNotNull(), F.array(F.get_json_object(r, f"$['{k}']"))), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    d = n.select(
        key, F.trim(F.coalesce(F.get_json_object(r, "$['publication-number']"), F.lit(""))).alias("publication_number"), listed("main-classification-proc").alias("main"), listed("additional-classification-proc").alias("more"),
        *[squeeze(pick_language(r, t.replace("_", "-"))).alias(t) for t in (*TEXTS, "buyer_name")], languages(r).alias("official_languages"),
    )
    return d.select(
        key, "publication_number", F.coalesce(F.try_element_at("main", F.lit(1)), F.lit("")).alias("main_cpv_code"), F.concat("main", "more").alias("all_cpv_codes"), *TEXTS, "buyer_name", "official_languages",
        F.size("official_languages").alias("language_count"), F.array_join(F.filter(F.array(*TEXTS), lambda t: t != ""), "\n").alias("combined_text"),
    )


def noisy(text: Column) -> Column:
    return F.lower(text).rlike("|".join(NOISE))


def text_candidates() -> Column:
    """Texts of a record that can stand for it: title, description, lot and notice title of 20 characters and more without noise."""
    return F.filter(F.array("title_proc", "description_proc", "description_lot", "notice_title"), lambda t: (F.length(t) >= 20) & ~noisy(t))


def title_label() -> Column:
    """The middle of a title 'country – label – title'; else the title, or the code where there is none."""
    parts = F.filter(F.transform(F.split("notice_title", " – "), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.col("notice_title") == "", F.col("main_cpv_code")).when(F.contains("notice_title", F.lit(" – ")) & (F.size(parts) >= 3), F.try_element_at(parts, F.lit(2))).otherwise(F.col("notice_title"))


def usable(recs: DataFrame) -> DataFrame:
    """Records with a code, a title without noise and a text to stand for them: adds code, label, texts."""
    d = recs.where("main_cpv_code <> ''").where(~noisy(F.col("notice_title"))).withColumn("texts", text_candidates()).where("size(texts) > 0")
    return d.withColumn("label", title_label()).withColumn("code", F.col("main_cpv_code"))


def catalogue_rows(recs: DataFrame, key: str, least: int = 1, most: int = MOST_EXAMPLES) -> DataFrame:
    """(code, label, description, n_examples, examples): per code the label of its first record and its first different texts, in order of key; codes with too few texts are left out."""
    u = usable(recs)
    first = u.groupBy("code").agg(F.min_by("label", key).alias("label"))
    texts = u.select("code", key, F.posexplode("texts").alias("i", "t")).where(F.col("i") < most).groupBy("code", "t").agg(F.min(F.struct(key, "i")).alias("at"))
    kept = texts.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("at", "t"))).where(F.col("r") <= most)
    g = kept.groupBy("code").agg(F.count("*").alias("n_examples"), F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("ts")).where(F.col("n_examples") >= least)
    return g.join(first, "code").select("code", "label", F.element_at("ts", 1).alias("description"), "n_examples", F.array_join("ts", " || ").alias("examples"))


def split_dataset(recs: DataFrame, key: str, train: float = 0.8, most_queries: int = 100) -> tuple[DataFrame, DataFrame]:
    """(catalogue of the training part, test queries): notices are split by a hash of their number; a query is a test text whose code is in the catalogue, each (text, code) once, the first ones in order of key."""
    bucket = hash_share(F.col("publication_number"))
    cat = catalogue_rows(recs.where(bucket < train), key)
    q = usable(recs.where(bucket >= train)).select(key, "publication_number", F.element_at("texts", 1).alias("query"), F.col("code").alias("gold"), F.col("notice_title").alias("notes"))
    one = q.groupBy("query", "gold").agg(F.min(key).alias(key), F.min_by("publication_number", key).alias("id"), F.min_by("notes", key).alias("notes"))
    return cat, one.join(cat.select(F.col("code").alias("gold")), "gold", "left_semi").orderBy(key).limit(most_queries).select("id", "query", "gold", "notes")


# example texts


def example_key(text: Column) -> Column:
    """What makes two examples the same: lower case, without codes, long numbers and punctuation."""
    t = F.lower(squeeze(text))
    for pattern in (r"(?U)\b[a-z]{1,4}\d{2,}[/_-]?\d+\b", r"(?U)\b\d{4,}\b", r"(?U)[^\p{L}\p{N}_\s]+", r"(?U)\s+"):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(t)


def without_prefix(text: Column) -> Column:
    """A title without the reference numbers it begins with."""
    t = F.regexp_replace(squeeze(text), r"^[A-Z]{1,6}\d{0,4}(?:[/_-]\d{2,6})+(?:\s*[-:]\s*|\s+)", "")
    return F.regexp_replace(F.regexp_replace(t, r"^\d{4,}(?:[/_-]\d{2,6})?(?:\s*[-:]\s*|\s+)", ""), r"^[ \-:]+|[ \-:]+$", "")


def trimmed(text: Column, most: int) -> Column:
    """At most so many characters, cut at a blank if there is one after 120, then three dots."""
    t, head = squeeze(text), F.substring(squeeze(text), 1, most)
    last = F.length(head) - F.length(F.regexp_extract(head, r"[^ ]*$", 0))
    cut = F.when(last - 1 >= 120, F.substr(head, F.lit(1), last - 1)).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:\-]+$", ""), F.lit("...")))


def collapsed(text: Column) -> Column:
    """A lead that stands twice at the beginning, once."""
    return squeeze(F.regexp_replace(squeeze(text), r"(?i)^(.{8,160}?)[.!?]\s+\1[.!?](\s+.*)?$", "$1.$2"))


def low_signal(text: Column) -> Column:
    return (F.length(squeeze(text)) < 10) | (F.size(F.regexp_extract_all(squeeze(text), F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]{3,}"), F.lit(0))) < 2)


def example_variants(recs: DataFrame, key: str) -> DataFrame:
    """(key, publication_number, cpv_code, language, source_field, example_text): texts of each record in up to three variants a field, for each of its codes and languages, each text once in that order."""
    lead = lambda c, n: F.array_join(F.slice(F.filter(F.split(squeeze(F.col(c)), r"(?<=[.!?])\s+"), lambda s: s != ""), 1, n), " ")
    some = lambda name, cond, text: F.when(cond, F.struct(F.lit(name).alias("field"), text.alias("text")))
    out = []
    for f in ("notice_title", "title_proc"):
        base, bare = squeeze(F.col(f)), without_prefix(F.col(f))
        ok, head = ~low_signal(base), F.coalesce(F.nullif(bare, F.lit("")), base)
        first = lead("description_proc", 1)
        both = F.when(F.startswith(example_key(first), example_key(head)), first).otherwise(F.concat(head, F.lit(". "), first))
        out += [some(f, ok, collapsed(trimmed(base, 220))), some("title_proc_clean", ok & (bare != "") & (bare != base) & ~low_signal(bare), collapsed(trimmed(bare, 220))), some("title_plus_description_lead", ok & (first != ""), collapsed(trimmed(both, 260)))]
    for f in ("description_proc", "description_lot"):
        base = squeeze(F.col(f))
        out += [some(f + "_lead", ~low_signal(base), collapsed(trimmed(lead(f, 2), 260))), some(f, ~low_signal(base), collapsed(trimmed(base, 320)))]
    d = recs.select(key, "publication_number", F.posexplode(F.array_compact(F.array(*out))).alias("i", "v"), F.when(F.size("all_cpv_codes") > 0, F.col("all_cpv_codes")).otherwise(F.array("main_cpv_code")).alias("codes"), F.when(F.size("official_languages") > 0, F.col("official_languages")).otherwise(F.array(F.lit("und"))).alias("langs"))
    d = d.select(key, "publication_number", "i", F.col("v.field").alias("source_field"), F.col("v.text").alias("example_text"), example_key(F.col("v.text")).alias("k"), "codes", "langs").where("k <> ''").where(~low_signal(F.col("example_text")))
    one = d.groupBy(key, "k").agg(F.min_by(F.struct("publication_number", "source_field", "example_text", "codes", "langs"), "i").alias("x")).select(key, "x.*")
    return one.select(key, "publication_number", F.explode(F.array_distinct(F.filter("codes", lambda c: c != ""))).alias("cpv_code"), "langs", "source_field", "example_text").select(key, "publication_number", "cpv_code", F.explode(F.array_distinct("langs")).alias("language"), "source_field", "example_text")


def example_score(source: Column, text: Column) -> Column:
    t = squeeze(text)
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHT.items() for x in kv]), source), F.lit(0.7))
    words = F.size(F.regexp_extract_all(t, F.lit("[A-Za-zÀ-ÖØ-öø-ÿ]{3,}"), F.lit(0)))
    generic = sum((F.when(F.contains(F.lower(t), F.lit(g)), 0.035).otherwise(0.0) for g in GENERIC), F.lit(0.0))
    return F.round(weight + F.least(words, F.lit(18)) * 0.015 - F.abs(F.least(F.length(t), F.lit(220)) - 140) / 700.0 - generic - F.when(t.rlike(r"^[A-Z0-9/_ -]{8,}$"), 0.08).otherwise(0.0), 6)


def select_examples(examples: DataFrame, most: int = MOST_EXAMPLES, per: int = PER_PUBLICATION) -> DataFrame:
    """(cpv_code, place, publication_number, source_field, example_text, score): the best examples of each code, each key once and at most so many of one publication.

    A row that its publication's cap shuts out doesn't use up its key, so rows are taken one after the other. Before that,
    windows leave only rows that can matter: of a publication and code as many keys as could be taken by others plus its own,
    of a key one row of each of the first publications (only most / per publications can be full), and of a code no more
    than these can shut out. So at most (most + per) * (most / per) + most * (most / per + 2) rows of a code meet in a task.
    """
    full = most // per
    d = examples.select("cpv_code", F.coalesce("publication_number", F.lit("")).alias("publication_number"), "source_field", squeeze(F.col("example_text")).alias("example_text")).where("example_text <> '' and cpv_code <> ''").where(~low_signal(F.col("example_text")))
    d = d.withColumn("score", example_score(F.col("source_field"), F.col("example_text"))).withColumn("k", example_key(F.col("example_text"))).where("k <> ''")
    order = [F.desc("score"), F.length("example_text"), "publication_number", "source_field", "example_text"]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    d = d.withColumn("r", rank("cpv_code", "publication_number", "k")).where("r = 1")
    d = d.withColumn("r", rank("cpv_code", "publication_number")).where(f"r <= {most + per} or publication_number = ''")
    d = d.withColumn("r", rank("cpv_code", "k")).where(f"r <= {full + 1}")
    d = d.withColumn("r", rank("cpv_code")).where(f"r <= {(most + per) * full + most * (full + 2)}")

    def take(g: pd.DataFrame) -> pd.DataFrame:
        keys, used, out = set(), {}, []
        for i in g.sort_values("r").index:
            p = g.at[i, "publication_number"]
            if len(out) < most and g.at[i, "k"] not in keys and not (p and used.get(p, 0) >= per):
                keys.add(g.at[i, "k"])
                used[p] = used.get(p, 0) + 1
                out.append(i)
        t = g.loc[out, ["cpv_code", "publication_number", "source_field", "example_text", "score"]]
        t.insert(1, "place", range(1, len(t) + 1))
        return t

    return d.groupBy("cpv_code").applyInPandas(take, "cpv_code string, place int, publication_number string, source_field string, example_text string, score double")


# documents: type, year, kind of question

#: Parts of file names by the class of document.
DOC_TYPES = {"phase_out": "auslauf", "amendment": "aenderung|änderung|amend", "correction": "berichtigung|korrektur|correction"}


def doc_type(path: Column) -> Column:
    p = F.lower(F.coalesce(path, F.lit("")))
    out = F.lit("base")
    for name, pattern in reversed(DOC_TYPES.items()):
        out = F.when(p.rlike(pattern), name).otherwise(out)
    return out


def doc_year(path: Column, text: Column) -> Column:
    """Year of a document: one from 1990 to 2100 after a word for its version or date in the first 2500 characters, else one in its path."""
    head = F.regexp_extract(F.substring(F.coalesce(text, F.lit("")), 1, 2500), r"(?iU)(?:vom|fassung|stand|version|dated|rev\.?)\D{0,20}((?:19[9]|20\d)\d)", 1)
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"(?<!\d)((?:199|20\d)\d)(?!\d)", 1)
    return F.coalesce(F.nullif(head, F.lit("")), F.nullif(name, F.lit(""))).cast("int")


def question_type(explicit: Column, question: Column, n_docs: Column, n_triples: Column) -> Column:
    """What sort of question it is: the given one, else by words for kinds, overviews and relations, or by how many documents and triples it needs."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return (
        F.when(F.trim(explicit) != "", F.lower(F.trim(explicit))).when(q.rlike(r"\b(?:which kind|what type|category|kategorie|art von)\b"), "taxonomy").when(q.rlike(r"\b(?:summar\w*|overview|overall|überblick|zusammenfass\w*)\b"), "summary_global")
        .when(q.rlike(r"\b(?:relation|between|zusammenhang|zwischen|depends|abhäng\w*)\b"), "relation").when((n_docs > 1) | (n_triples > 1), "multi_hop").otherwise("single_hop")
    )


def version_as_of(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, doc_id): for each question (qid, program_id, year) the base document in force – the latest base of its program not after its year – with the amendments and corrections since; where no base is that old, the nearest document.

    Documents are (doc_id, program_id, kind, year); those without a year count where nothing else does.
    """
    j = questions.join(docs, "program_id")
    before = F.col("doc_year") <= F.col("year")
    w = Window.partitionBy("qid")
    j = j.withColumn("base", F.max(F.when((F.col("kind") == "base") & before, F.col("doc_year"))).over(w)).withColumn("late", F.max(F.when(before, F.col("doc_year"))).over(w)).withColumn("early", F.min("doc_year").over(w))
    near = F.coalesce("late", "early")
    keep = F.when(F.col("base").isNotNull(), ((F.col("kind") == "base") & (F.col("doc_year") == F.col("base"))) | (F.col("kind").isin("amendment", "correction") & before & (F.col("doc_year") >= F.col("base")))).when(near.isNotNull(), F.col("doc_year") == near).otherwise(True)
    return j.where(F.coalesce(keep, F.lit(False))).select("qid", "doc_id")


def catalogue_merge(official: DataFrame, learned: DataFrame) -> DataFrame:
    """(code, label, description, examples): both catalogues; the official label and description first, examples of both, each once."""
    o = official.select(prefix8(F.col("code")).alias("code"), F.col("label").alias("l1"), F.col("description").alias("d1"), F.col("examples").alias("e1"))
    t = learned.select(prefix8(F.col("code")).alias("code"), F.col("label").alias("l2"), F.col("description").alias("d2"), F.col("examples").alias("e2"))
    none = F.array().cast("array<string>")
    return o.join(t, "code", "full").select("code", F.coalesce("l1", "l2").alias("label"), F.coalesce("d1", "d2").alias("description"), F.array_union(F.coalesce("e1", none), F.coalesce("e2", none)).alias("examples"))
