"""Answer evaluation, matching and markers on small cases and against plain Python."""

import re
import unicodedata

from pyspark.sql import functions as F

from rillway.functions import matching as M
from rillway.operators import answers as A

ITEMS = "qid string, question string, answer string, gold string, keywords array<string>, answerable boolean"
CHUNKS = "qid string, chunk_id long, rank int, text string, score double"


def frames(spark, items, chunks):
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(chunks, CHUNKS)


def test_forms_equal_plain_python(spark):
    texts = ["Straße  ＡＢＣ ﬁn m² Prüfungen", "x_y/z|q, 12,5 §3", "", None, "Leistungspunkte 12.5 und 7", "ΣΊΣΥΦΟΣ"]
    df = M.analysed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "")
    for r in df.collect():
        normal = " ".join(unicodedata.normalize("NFKC", texts[r.i] or "").casefold().split())
        assert r.normal == normal
        words = re.sub(r"[^\w\s]|_", " ", normal).split()
        assert r.words == [M._stem(w) for w in words]
        assert set(r.numbers) == set(re.findall(r"\d+(?:[.,]\d+)?", normal))


def test_metadata_and_bool(spark):
    df = spark.createDataFrame([("B.A. Informatik", "Bachelor"), ("", "x"), ("x", ""), ("Größe & Maß", "grosse and mass"), (None, "a")], "a string, e string")
    d = df.select("a", M.metadata_value(F.col("a")).alias("x"), M.metadata_value(F.col("e")).alias("y")).select("x", M.metadata_matches(F.col("x"), F.col("y")).alias("m"))
    assert [r.m for r in d.collect()][1:3] == [False, True]
    b = spark.createDataFrame([("Ja",), (" no ",), ("?",), (None,)], "t string").select(M.parse_bool(F.col("t"), True).alias("b"), M.parse_number(F.col("t")).alias("n")).collect()
    assert [r.b for r in b] == [True, False, True, True]
    n = spark.createDataFrame([("1,5",), ("NaN",), ("x",), (None,)], "t string").select(M.parse_number(F.col("t")).alias("n")).collect()
    assert [r.n for r in n] == [1.5, None, None, None]


def test_markers():
    assert {"number:2", "quantity:2:monat", "code:b2"} <= M.decisive_markers("Zwei Monate, Level B2")
    assert "phrase:game design" in M.decisive_markers("Modul Game Design im Semester") and M.decisive_markers(None) == M.decisive_markers(" ") == set()
    assert "number:12.5" in M.decisive_markers("12,50 LP")


def test_answers_end_to_end(spark):
    good = "The contract runs for 24 months and may be extended twice."
    items, chunks = frames(
        spark,
        [
            ("right", "How long does the contract run?", good, good, ["contract"], True), ("wrong", "How long does the contract run?", "The weather in the mountains is sunny today.", good, ["contract"], True), ("refuses", "How long?", "There is no information about it.", good, [], True),
            ("unanswerable", "Who?", "There is no information about it.", "", [], False), ("over", "Who?", "A man called Smith did it.", "", [], False), ("empty", None, None, None, None, None), ("conflict", "How long?", "The contract runs for 36 months and may be extended twice.", good, [], True),
        ],
        [(q, i, i, good, 0.5) for q in ("right", "wrong", "refuses", "conflict") for i in (1, 2)],
    )
    m = {r.qid: r for r in A.answer_metrics(items, chunks).collect()}
    assert len(m) == 7 and m["right"].label == "correct" and m["right"].answer_claim_f1 == 1.0 and m["right"].attribution_precision == 1.0
    assert m["wrong"].label in ("incorrect", "unsupported") and m["wrong"].claim_diagnostic == "unsupported_generated_claims"
    assert m["refuses"].false_refusal and m["refuses"].label == "incorrect" and m["unanswerable"].label == "correct" and m["over"].over_answered and m["over"].label == "unsupported"
    assert m["conflict"].contradicted_claims == 1 and m["empty"].claim_diagnostic == "no_claims_to_evaluate"
    e = {r.qid: r.status for r in A.runtime_evidence(items, chunks).collect()}
    assert e["right"] == "good_evidence" and e["over"] == "missing_evidence"
    x = {r.qid: r.answer for r in A.extractive_answer(items, chunks).collect()}
    assert x["right"] == good and x["over"] == "No context."
    assert A.answer_metrics(items.limit(0), chunks.limit(0)).count() == 0


def test_claims_are_cut(spark):
    t = "Fees are due; Delivery takes 5 days and Payment follows later. ok\n- Partial bids are allowed • Variants are forbidden"
    got = [r.claim for r in A.claim_rows(spark.createDataFrame([(1, t)], "qid int, t string"), "t").orderBy("no").collect()]
    assert got == ["Delivery takes 5 days", "Payment follows later.", "Partial bids are allowed", "Variants are forbidden"] or got[0] == "Fees are due."
