import json

import pytest

from rillway.sources.files import load_catalogue, load_notice_export, load_queries
from rillway.sinks.writers import read_upserted
from rillway.streaming.ingest import upsert_stream, windowed_counts


def test_queries(spark, tmp_path):
    rows = [{"id": "a", "query": "x", "gold_cpv_code": "45000000"}, {"query": "y", "gold_cpv_code": "33000000"}]
    for name, body in (("l.json", rows), ("o.json", {"queries": rows})):
        (tmp_path / name).write_text(json.dumps(body))
        assert [(r.id, r.query) for r in load_queries(spark, str(tmp_path / name)).collect()] == [("a", "x"), ("q2", "y")]
    (tmp_path / "bad.json").write_text(json.dumps([{"query": "", "gold_cpv_code": "1"}]))
    with pytest.raises(Exception, match="no query"):
        load_queries(spark, str(tmp_path / "bad.json")).collect()


def test_csv_sources(spark, tmp_path):
    (tmp_path / "n.csv").write_text('﻿ID,PUB_NUMBER,MAIN_CPV,TITLE,TEXT,BUYER,LANGUAGE,CONTRACT_TYPE\n1,A,45000000-7,t,"a\n""b""",x,en,w\n2,B,45,t,,,,\n3,,45000000,t,,,,\n4,C,45000000,,,,,\n')
    assert [(r.PUB_NUMBER, r.MAIN_CPV, r.TEXT) for r in load_notice_export(spark, str(tmp_path / "n.csv")).collect()] == [("A", "45000000", 'a\n"b"')]
    (tmp_path / "m.csv").write_text("CODE,EN,DE\n45000000-7,works,Bau\n33000000,,Geräte\n")
    assert {(r.code, r.label) for r in load_catalogue(spark, str(tmp_path / "m.csv")).collect()} == {("45000000", "works"), ("33000000", "Geräte")}
    (tmp_path / "l.csv").write_text("code,label,description,parent_code,examples\n45100000,site,,45000000,a || b\n")
    r = load_catalogue(spark, str(tmp_path / "l.csv")).first()
    assert (r.parent_code, r.examples) == ("45000000", ["a", "b"])


def test_stream_upsert(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, rows in enumerate(([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z"), ("c", 1, "w")])):
        spark.createDataFrame(rows, "k string, t int, v string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k string, t int, v string").option("maxFilesPerTrigger", 1).parquet(src)
    q = upsert_stream(stream, "k", ["t"], str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.k, r.t, r.v) for r in read_upserted(spark, str(tmp_path / "out")).collect()} == {("a", 2, "z"), ("b", 1, "y"), ("c", 1, "w")}


def test_windowed_counts(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "a")], "s string, k string").selectExpr("cast(s as timestamp) ts", "k")
    assert sorted(r.n for r in windowed_counts(e, "ts", "k").collect()) == [1, 2]
