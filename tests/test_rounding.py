"""Halves are rounded as the SQL oracles round them."""

import duckdb
from pyspark.sql import functions as F

from rillway.functions.text import rounded
from rillway.operators import design as D, labels as L


def test_rounded_equals_duckdb(spark):
    values = [0.078605, 0.125375, 0.13651749999999999, -0.078605, 0.5, 1.0000005, 0.0, -0.0000005, 123.4567895, None]
    d = spark.createDataFrame([(v,) for v in values], "x double")
    for n in (5, 6):
        got = [r[0] for r in d.select(rounded(F.col("x"), n)).collect()]
        assert got == [duckdb.execute(f"select round(?::double, {n})", [v]).fetchone()[0] for v in values]


def test_best_fix_of_a_half(spark):
    """a gain whose sixth digit is a five."""
    t = spark.createDataFrame([("none-5", 1, True, "ranking", "none", "5")], "experiment string, qid int, failed boolean, primary_reason string, reranker string, top_k string").selectExpr("*", "'short' question_type", "0.2D recall_at_k", "0.2D mrr_at_k", "0.5D prediction_confidence", "0.1D quality", "0.1D retrieval_score", "0.1D calibration_score", "0.1D generation_score", "'incorrect' auto_flag")
    p = spark.createDataFrame([(1, "short", "top_k", "10", "5", -0.078605)], "qid int, question_type string, factor string, left_value string, right_value string, delta double")
    assert [r.best_delta for r in D.failure_attribution(t, p).collect()] == [duckdb.execute("select round(0.078605::double, 5)").fetchone()[0]]


def test_graph_score_of_a_half(spark):
    """.7 of a proximity of six digits falls on a half of the sixth."""
    scores = [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.195025, 0.1, 0.09, 0.08, 0.07, 0.06, 0.05, 0.0]
    rows = [(1, f"{i + 11}000000", s, i + 1) for i, s in enumerate(scores)]
    c = spark.createDataFrame(rows, "qid int, code string, score double, rank int")
    q = spark.createDataFrame([(1, ["a"])], "qid int, q array<string>")
    p = spark.createDataFrame([(r[1], ["a" if r[3] == 1 else "b"]) for r in rows], "code string, t_canonical array<string>")
    got = {r.code: (r.base, r.proximity, r.graph) for r in L.expand_pool(c, c.select("code"), q, p, "balanced").collect()}
    assert got["17000000"] == (0.195025, 0.195025, duckdb.execute("select round(0.7::double * 0.195025::double, 6)").fetchone()[0])
