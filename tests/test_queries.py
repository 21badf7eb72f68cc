"""Every query of the core that has an oracle gives the oracle's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from rillway.plans import analytics, catalogue, ingest, retrieval, training

#: Of the families whose queries share their steps, one for each kind of step; RILLWAY_ALL=1 runs them all.
SHARED = {
    "claim_metrics", "answer_metrics", "diagnose_failure", "keyword_retrieval_metrics", "label_features", "hierarchical_beam", "specificity_bias", "hard_negatives", "ranked_evaluation", "rank_diagnostics", "taxonomy_neighbours", "taxonomy_pool_walk",
    "kg_quality", "kg_augmented_retrieval", "kg_triple_evaluation", "failure_attribution", "group_explanations", "run_advice", "evidence_patterns", "kind_bias", "code_profiles", "query_enrichment", "result_merge",
}
OWN = {k for m in (analytics, ingest, retrieval, training) for k in m.QUERIES}
NAMES = sorted(catalogue.QUERIES) if os.environ.get("RILLWAY_ALL") else sorted(OWN | SHARED)


def value(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        return round(float(v), 4)
    except (TypeError, ValueError):
        return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for f in os.listdir(tables):
        con.execute(f"create view {f[:-8]} as select * from '{tables}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, duck, name):
    df = catalogue.QUERIES[name](spark, tables)
    got = rows_of(df.columns, df.collect())
    if name in catalogue.ORACLE:
        cur = duck.execute(catalogue.ORACLE[name])
        columns = [x[0] for x in cur.description]
        assert sorted(columns) == sorted(df.columns)
        want = rows_of(columns, cur.fetchall())
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-4)) for x, y in zip(a, b)), (a, b)


def test_core_stands_alone():
    """Nothing outside of the text subpackage imports it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "rillway")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as h:
                    assert "rillway.llm" not in h.read(), f
