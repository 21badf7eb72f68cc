"""Sections, notices, examples: edge cases and brute force."""

import json
import random

from pyspark.sql import functions as F

from rillway.operators import enrich as N2, notices as N, sections as S


def test_sectioniser(spark):
    text = "Inhalt ........ 3\n§ 2 Zu früh\n§ 1 Anfang\nVorwort\n§ 1 Geltung\n(1) Es gilt.\n§ 3 Abs. 2 gilt\n§ 2 klein\n\n§ 2 Fristen\nText\n§ 4 Leer"
    got = S.sections(spark.createDataFrame([("a", text), ("b", None), ("c", "nur Text")], "doc string, t string"), "doc", "t").orderBy("doc", "section_position").collect()
    assert [(r.doc, r.section_position, r.section_id, r.title) for r in got] == [("a", 0, "§ 1", "Anfang"), ("a", 1, "§ 1", "Geltung"), ("a", 2, "§ 2", "Fristen"), ("c", 0, "PREAMBLE", "Preamble")]
    a = [r for r in got if r.doc == "a"]
    assert any(r.title == "Fristen" and r.text == "Text" for r in a) and all(r.text for r in got)
    assert a[1].text == "(1) Es gilt.\n§ 3 Abs. 2 gilt\n§ 2 klein"


def test_paragraphs_tables_sentences(spark):
    df = spark.createDataFrame([("a\n\n b \n \n\n",), ("x\ny",), ("",), (None,)], "t string")
    assert [r.p for r in df.select(S.paragraphs(F.col("t")).alias("p")).collect()] == [["a", "b"], ["x\ny"], [], []]
    rows = spark.createDataFrame([([["a", None], ["", " "], ["b\nc"]],), ([],), (None,)], "r array<array<string>>")
    assert [r.t for r in rows.select(S.table_text(F.col("r"), F.lit(2)).alias("t")).collect()] == ["[TABLE 2]\na | [EMPTY]\nb / c | [EMPTY]", "", ""]
    t = "Ein Satz. Noch einer! (1) Drei\nvier 𝒳. Ende"
    for s in spark.createDataFrame([(t,)], "t string").select(F.inline(S.sentences(F.col("t")))).collect():
        assert t[s.start : s.end] == s.text


def test_records_of_odd_notices(spark):
    raws = [
        {"publication-number": " 1 ", "notice-title": {"fra": "", "deu": ["", "Titel  eins"]}, "title-proc": ["", "zwei"], "main-classification-proc": "45000000", "additional-classification-proc": ["33000000", None], "official-language": ["DE", "de", "fr"], "lang": {"nld": "x"}},
        {"publication-number": 2, "notice-title": {"xx": "anders"}, "buyer-name": None},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)] + [(7, "{broken"), (8, None), (9, "[]"), (10, "")], "k long, j string")
    got = {r.k: r for r in N.records(df, "k", "j").collect()}
    assert set(got) == {0, 1} and got[0].notice_title == "Titel eins" and got[0].title_proc == "zwei" and got[0].all_cpv_codes == ["45000000", "33000000"] and got[0].official_languages == ["DE", "fr", "nld"]
    assert got[1].notice_title == "anders" and got[1].main_cpv_code == "" and got[1].language_count == 0


def test_example_selection_is_the_greedy_one(spark):
    rnd = random.Random(5)
    words = ["alpha works", "beta supplies", "gamma services", "delta roads", "epsilon bridge", "zeta school", "eta clinic"]
    rows = [("c%d" % rnd.randint(0, 2), "p%d" % rnd.randint(0, 6), rnd.choice(list(N.SOURCE_WEIGHT)), f"{rnd.choice(words)} {rnd.choice(words)} " + "x" * rnd.randint(0, 5)) for _ in range(900)]
    df = spark.createDataFrame(rows + [(None, "p", "title_proc", "null code text"), ("c0", None, "title_proc", "without any publication"), ("c1", "p", None, None)], "cpv_code string, publication_number string, source_field string, example_text string")
    got = {(r.cpv_code, r.place): (r.publication_number, r.example_text) for r in N.select_examples(df).collect()}
    scored = df.where("cpv_code is not null and example_text is not null").select("cpv_code", F.coalesce("publication_number", F.lit("")).alias("p"), F.coalesce("source_field", F.lit("")).alias("s"), N.squeeze(F.col("example_text")).alias("t"), N.example_key(F.col("example_text")).alias("k"), N.example_score(F.col("source_field"), F.col("example_text")).alias("v"), N.low_signal(F.col("example_text")).alias("low")).collect()
    for code in {r.cpv_code for r in scored}:
        taken, keys, used = [], set(), {}
        for r in sorted((r for r in scored if r.cpv_code == code and r.k and not r.low), key=lambda r: (-r.v, len(r.t), r.p, r.s, r.t)):
            if len(taken) < 12 and r.k not in keys and not (r.p and used.get(r.p, 0) >= 3):
                taken.append((r.p, r.t))
                keys.add(r.k)
                used[r.p] = used.get(r.p, 0) + 1
        assert [got[code, i + 1] for i in range(len(taken))] == taken and (code, len(taken) + 1) not in got


def test_versions_and_questions(spark):
    docs = spark.createDataFrame([("b15", "p", "base", 2015), ("a18", "p", "amendment", 2018), ("b20", "p", "base", 2020), ("x", "q", "base", None)], "doc_id string, program_id string, kind string, doc_year int")
    qs = spark.createDataFrame([("q14", "p", 2014), ("q19", "p", 2019), ("q21", "p", 2021), ("qx", "q", 2000)], "qid string, program_id string, year int")
    got = {}
    for r in N.version_as_of(docs, qs).collect():
        got.setdefault(r.qid, set()).add(r.doc_id)
    assert got == {"q14": {"b15"}, "q19": {"b15", "a18"}, "q21": {"b20"}, "qx": {"x"}}


def test_enrichment(spark):
    df = spark.createDataFrame([("Supply and installation of traffic monitoring cameras with maintenance",), ("Lieferung von Mobiliar",), ("",), (None,)], "t string")
    r = N2.enrich(df, "t").collect()
    assert r[0].action == "supply and installation" and "traffic monitoring cameras" in r[0].main_object and r[0].side_terms == ["maintenance"] and r[0].domain == "traffic monitoring" and r[0].kind == "goods"
    assert "supply" in r[1].translated and len(r) == 4 and r[3].channels == []
