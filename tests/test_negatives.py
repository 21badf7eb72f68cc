from rillway.operators import labels as L
from rillway.plans import labels as PL


def test_no_pairs_of_queries_and_codes(spark, tables):
    """F8: every query met every code as a row; the rows themselves are compared with the SQL in test_queries."""
    p = PL._profiles(spark, tables)
    plan = L.hard_negatives(PL._queries(spark, tables).select("qid", "gold", "q"), p)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_few_codes(spark):
    """Three codes: the sibling first, then the rest; a gold code that isn't in the catalogue gives nothing."""
    p = spark.createDataFrame([("45210000", "45200000", ["a"]), ("45220000", "45200000", ["b"]), ("90000000", None, ["a", "c"])], "code string, parent string, t_canonical array<string>")
    q = spark.createDataFrame([(1, "45210000", ["a", "c"]), (2, "11111111", ["a"]), (3, "90000000", []), (4, "90000000", None)], "qid long, gold string, q array<string>")
    got = [tuple(r) for r in L.hard_negatives(q, p).collect()]
    assert sorted(got) == sorted([(1, "45210000", "45220000", 4.5), (1, "45210000", "90000000", 1.0)] + [(i, "90000000", c, 1.0) for i in (3, 4) for c in ("45210000", "45220000")])
