"""Sinks, sources and hooks with their failures."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rillway import __main__ as cli, pipeline as P
from rillway.operators import hooks as H
from rillway.sinks import writers as W
from rillway.sources import documents as D


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(f"k{i}", 1, "a") for i in range(100)], "k string, t int, v string")
    W.upsert(spark, first, "k", ["t"], path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert W.upsert(spark, spark.createDataFrame([("k1", 2, "b"), ("k1", 1, "z"), ("new", 1, "c")], "k string, t int, v string"), "k", ["t"], path) <= 2
    rows = {r.k: r.v for r in W.read_upserted(spark, path).collect()}
    assert len(rows) == 101 and rows["k1"] == "b" and rows["k2"] == "a"
    kept = [p for p in (tmp_path / "t").rglob("*.parquet") if p in before and p.stat().st_mtime_ns == before[p]]
    assert len(kept) >= len(before) - 2
    n = spark.createDataFrame([("p1", 1, None, "x")], "publication_number string, notice_row_id long, ingested_at timestamp, title string")
    e = spark.createDataFrame([("p1", "c", "t1"), ("p1", "d", "t2")], "publication_number string, cpv_code string, example_text string")
    W.upsert_notices(spark, n, e, str(tmp_path / "n"))
    W.upsert_notices(spark, n, e.where("cpv_code = 'c'"), str(tmp_path / "n"))
    assert [len(r.examples) for r in W.read_upserted(spark, str(tmp_path / "n/examples")).collect()] == [1]


def test_index_is_built_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b"), (3, None)], "i long, t string")
    path = str(tmp_path / "i")
    assert W.ensure_index(spark, docs, "i", "t", path) and not W.ensure_index(spark, docs.orderBy(F.desc("i")), "i", "t", path)
    assert W.ensure_index(spark, docs, "i", "t", path, "other model") and W.ensure_index(spark, docs.limit(2), "i", "t", path, "other model")
    assert spark.read.parquet(path + "/postings").where("term = 'b'").count() == 2


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("a|b", 1.5, [1, 2]), (None, None, None)], "n string, v double, l array<int>")
    W.write_table(d, str(tmp_path / "c"), "csv")
    assert D.preview(spark, str(tmp_path / "c")).count() == 2
    W.write_object(spark, {"x": {"y": "ä"}}, str(tmp_path / "o"))
    assert D.read_object(spark, str(tmp_path / "o")) == {"x": {"y": "ä"}} and D.tail(spark, str(tmp_path / "o"), 3).strip() == "}}"
    (tmp_path / "bad.json").write_text("nope")
    assert D.read_object(spark, str(tmp_path / "bad.json")) == {}
    assert "a\\|b" in W.report("T", {"p": d}) and W.bar_chart(d, "n", "v", "<t>").count("<rect") == 2 and "&lt;t&gt;" in W.scatter_chart(d, "v", "v", "<t>")
    assert W.shaped(d, ["v", "none"], ["n"]).columns == ["v", "l"]
    c = spark.createDataFrame([("45000000", "works"), ("45100000", "site"), ("45200000", "x")], "code string, label string")
    W.export_code_graph(spark, c, str(tmp_path / "g"))
    assert D.preview(spark, str(tmp_path / "g/edges")).groupBy("type").count().count() == 3
    assert D.list_files(spark, str(tmp_path), "*.csv").count() >= 2 and {r.run for r in D.list_runs(spark, str(tmp_path)).collect()} >= {"c", "g", "o"}


def sheet(rows):
    cells = lambda i, r: "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + j)}{i}"><v>{v}</v></c>' for j, v in enumerate(r) if v is not None)
    body = "".join(f'<row r="{i}">{cells(i, r)}</row>' for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_spreadsheet_of_prepared_results(spark, tmp_path):
    (tmp_path / "r.xlsx").write_bytes(sheet([["Record ID", "Query Text", "Expected CPV", "Predicted CPV 1", "Score 1", "Predicted CPV 2", "Score 2"], ["a", "roads", "45000000", "45000000 and 45100000", "0,9", "33000000", 0.5], [None, None], ["b", "x", "33000000", "44000000", 1.0]]))
    got = D.prepared_results(D.load_sheet(spark, str(tmp_path / "r.xlsx")))
    rows = {(r.id, r.rank): r.code for r in got.collect()}
    assert rows == {("a", 1): "45000000", ("a", 2): "45100000", ("a", 3): "33000000", ("b", 1): "44000000"}
    s = P.run_prepared(got)["summary"].first()
    assert s.n == 2 and s.top1 == 0.5 and s.n_missing == 1


def test_questions_and_documents(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"question": "a?"}, {"id": "x", "question": "b?", "must_have_triples": [{"subject": "s", "predicate": "p", "object": "o"}]}]}))
    assert [(r.id, r.gold_answer) for r in D.load_questions(spark, str(tmp_path / "q.json")).collect()] == [("q1", ""), ("x", "")]
    (tmp_path / "bad.json").write_text('[{"id": "x"}]')
    with pytest.raises(Exception, match="no question"):
        D.load_questions(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "docs/Prog A").mkdir(parents=True)
    (tmp_path / "docs/Prog A/d.txt").write_text("§ 1 Eins\n(1) Text")
    files = D.document_files(spark, str(tmp_path / "docs"), str(tmp_path / "docs"))
    r = D.document_text(files).first()
    assert (r.doc_id, r.program_name, r.program_id, r.text) == ("Prog A/d.txt", "Prog A", "prog_a", "§ 1 Eins\n(1) Text")
    assert D.document_text(files, lambda b: [("S", [[["a", None]]])]).first().text == "S\n\n[TABLE 1]\na | [EMPTY]" and D.document_text(files, lambda b: 1 / 0).first().text == ""


def test_search_service():
    pages, waits = [{"notices": [{"publication-number": i} for i in range(3)], "iterationNextToken": "t"}, {"notices": [{"publication-number": 9}]}], []

    def post(body, state={"n": 0, "fails": 2}):  # noqa: B006
        if state["fails"]:
            state["fails"] -= 1
            raise OSError("busy")
        state["n"] += 1
        assert (state["n"] > 1) == ("iterationNextToken" in body)
        return pages[state["n"] - 1]

    assert [n["publication-number"] for n in D.fetch_pages(post, "*", ["a"], sleep=waits.append)] == [0, 1, 2, 9] and waits[:2] == [1, 2]
    with pytest.raises(OSError):
        list(D.fetch_pages(lambda b: (_ for _ in ()).throw(OSError("down")), "*", [], tries=2, sleep=lambda s: None))


def test_hooks_never_raise(spark):
    q = spark.createDataFrame([("1", "roads"), ("2", "fail")], "id string, query string")

    def remote(body):
        if body["query"] == "fail":
            raise OSError("down")
        return {"top_k_answers": [{"cpv_code": "45000000", "confidence": 0.5}], "explanation": "e"}

    got = {r.id: (r.code, r.status) for r in D.classify_remote(q, remote).collect()}
    assert got["1"] == ("45000000", "success") and got["2"][1].startswith("error")
    a = H.ask(q.withColumnRenamed("query", "question"), H.prompt("rewrite"), lambda p: 1 / 0 if "fail" in p else p.upper())
    assert {r.id: r.answer_status.split(":")[0] for r in a.collect()} == {"1": "success", "2": "error"} and H.ask(q, F.lit("x"), None).first().answer_status == "disabled"
    v = H.encode(q, "query").collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in v)
    rk = spark.createDataFrame([(1, k, float(s), i, "roads", t) for i, (k, s, t) in enumerate([("a", 3, "x"), ("b", 2, "roads here"), ("c", 1, "y")], 1)], "qid int, key string, score double, rank int, question string, text string")
    assert [r.key for r in H.cross_rerank(rk, "qid", "key", "question", "text").orderBy("rank").collect()][0] == "b"
    assert [r.key for r in H.model_order(rk, "qid", "question", "text", lambda p: "3, 1, 2", 0.9).orderBy("rank").collect()] == ["c", "a", "b"]
    assert [r.key for r in H.model_order(rk, "qid", "question", "text", None).orderBy("rank").collect()] == ["a", "b", "c"]
    j = spark.createDataFrame([(1, 'text {"gold_claims": [{"claim": "g", "context_nli": "Entailed"}], "answer_claims": [{"claim": "a", "context_nli": "supported", "gold_nli": "no", "supporting_chunk_ids": ["c1", "zz"]}]} end', ["c1"]), (2, "nothing", [])], "qid int, p string, v array<string>")
    m = {r.qid: r for r in H.judge_metrics(j, "qid", "p", "v").collect()}
    assert m[1].context_claim_recall == 1.0 and m[1].invalid_attributions == 1 and m[1].attribution_precision == 1.0 and m[2].gold_claims == 0 and m[2].grounded_ratio is None


def test_designs_and_command_line(capsys):
    d = P.sweep(("fixed_words", "by_section"), (300, 450), (40,), ("bm25",))
    assert len(d) == 3 and len({x.name for x in d}) == 3
    assert cli.main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
