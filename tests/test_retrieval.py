"""Retrieval by blocks finds what the join over common terms finds."""

import random

import pytest
from pyspark.sql import functions as F

from rillway.operators import retrieval as R


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = spark.createDataFrame([(f"d{i:03d}", text(rng.randint(0, 30))) for i in range(300)], "doc string, text string")
    return docs, spark.createDataFrame([(i, text(rng.randint(0, 6))) for i in range(120)], "q int, question string")


@pytest.mark.parametrize("kind", ["bm25", "tfidf"])
def test_blocks_equal_joins(corpus, kind):
    docs, queries = corpus
    args = (docs, "doc", F.col("text"), queries, "q", F.col("question"))
    want = R.top_k((R.bm25 if kind == "bm25" else R.tfidf)(*args), "q", "doc", 8).select("q", "doc", "score", "rank").collect()
    got = R.retrieve(kind, *args, 8)
    # pairs with a common term were rows, which are as many as questions times chunks
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "qtf" not in plan and "qw" not in plan
    assert sorted(map(tuple, got.select("q", "doc", "score", "rank").collect())) == sorted(map(tuple, want))


def test_small_blocks(corpus):
    docs, queries = corpus
    p = docs.select("doc", F.explode(F.array_distinct(F.split("text", " "))).alias("term")).withColumn("w", F.length("term") * 1.5)
    q = queries.select("q", F.explode(F.array_distinct(F.split("question", " "))).alias("term")).withColumn("w", F.lit(0.5))
    a, b = (sorted(map(tuple, R.sparse_top_k(p, "doc", q, "q", 5, *size).select("q", "doc", "rank").collect())) for size in ((7, 11), (2048, 4096)))
    assert a == b and a


def test_run_ranks_by_blocks(spark):
    """a whole run takes its ranking from blocks, a question without known words stays in the diagnosis."""
    from rillway import pipeline as P

    s = spark.createDataFrame([(f"s{i}", f"d{i}", "1", f"Lot {i} covers roads. Works start in May {2000 + i}.") for i in range(6)], "unit string, doc_id string, section_id string, text string")
    items = spark.createDataFrame([("a", "roads in lot 3", "Lot 3 covers roads", ["roads"], True), ("b", "xyzzy", "none", ["none"], True)], "qid string, question string, gold string, keywords array<string>, answerable boolean")
    run = P.run_experiment(s, s, items, P.Design("by_section", 0, 0, "bm25", 3))
    assert [(r.qid, r.rank) for r in run["retrieved"].orderBy("qid", "rank").collect()] == [("a", 1), ("a", 2), ("a", 3)]
    assert run["retrieved"].where("rank = 1").first().doc_id == "d3"
    assert {r.qid for r in run["diagnosis"].collect()} == {"a", "b"}


@pytest.mark.parametrize("name", ["hybrid_alpha_topk", "rrf_fusion_topk"])
def test_fusion_plans_one_ranking_at_a_time(spark, tables, name):
    """both rankings with all their counting were one plan."""
    from rillway.plans import retrieval

    plan = retrieval.QUERIES[name](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "idf" not in plan


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Tables in which some documents have several rows, and some no text or no key."""
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(3000)] + list("abc")
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    d = str(tmp_path_factory.mktemp("repeated"))
    docs = [(rng.choice([None, *range(60)]), text(rng.randint(0, 25)) if i % 10 else None, "01", "x", "en", "p") for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, cpv_code string, source string, lang string, publication_number string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(f"{i:08d}", text(rng.randint(1, 5)) if i % 7 else None) for i in range(40)], "code string, en string").coalesce(1).write.parquet(f"{d}/cpv_catalog.parquet")
    return d


def agrees(spark, d, name):
    import duckdb

    from rillway.plans import retrieval

    con = duckdb.connect()
    for t in ("documents", "cpv_catalog"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = [tuple(r) for r in retrieval.QUERIES[name](spark, d).orderBy("qid", "rank").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(con.execute(retrieval.ORACLE[name]).fetchall(), key=lambda r: (r[0], r[-1]))
    assert want and got == want


def test_tfidf_topk_counts_within_batches(spark, tables, repeated):
    """each term of each document was a row, three times over; rows of one document are one document, as in SQL."""
    from rillway.plans import retrieval

    plan = retrieval.tfidf_topk(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "qtf" not in plan
    agrees(spark, repeated, "tfidf_topk")


def test_hybrid_alpha_topk_ranks_within_batches(spark, repeated):
    """the terms of documents were rows in both rankings; rows of one document are one document, as in SQL."""
    agrees(spark, repeated, "hybrid_alpha_topk")


def test_rrf_fusion_topk_reads_texts_twice(spark, repeated, monkeypatch):
    """F2: each ranking cut the texts for itself, again and again; one pass counts and one scores for both."""
    from rillway.operators import retrieval as O

    passes = []
    monkeypatch.setattr(O, "tokens", lambda c, real=O.tokens: passes.append(str(c)) or real(c))
    agrees(spark, repeated, "rrf_fusion_topk")
    assert len([p for p in passes if "question" not in p]) == 2
