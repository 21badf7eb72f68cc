"""Every query of the text subpackage on the smallest tables: rows without repetition where they are sets, oracles, and invariants of packing and mixing."""

import math
import os

import duckdb
import pytest

from rillway.llm import catalogue, pack

SETS = {"p2_found", "p3_found", "p5_found", "p6_found", "p7_found", "p10_found"}


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for f in os.listdir(tables):
        con.execute(f"create view {f[:-8]} as select * from '{tables}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - {"p8_containers", "p9_copies", "p3_paragraphs"}))
def test_query(spark, tables, duck, name):
    rows = [tuple(r) for r in catalogue.QUERIES[name](spark, tables).collect()]
    assert rows or name in ("p5_found", "p7_found")
    if name in SETS:
        assert len(rows) == len(set(rows))
    if name in catalogue.ORACLE:
        cur = duck.execute(catalogue.ORACLE[name])
        columns = [x[0] for x in cur.description]
        order = [columns.index(c) for c in catalogue.QUERIES[name](spark, tables).columns]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in order)) for r in cur.fetchall())


def test_containers_and_their_bound(spark, tables):
    sizes = {r.container_name: r.capacity_tokens for r in spark.read.parquet(f"{tables}/pack_sizes.parquet").collect()}
    n_docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id").distinct().count()
    fill, docs, parts = {}, {}, {}
    for r in catalogue.QUERIES["p8_containers"](spark, tables).collect():
        fill[r.container_name, r.container_id] = fill.get((r.container_name, r.container_id), 0) + r.n_tokens
        docs.setdefault(r.container_name, set()).add(r.doc_id)
        parts.setdefault((r.container_name, r.doc_id), []).append(r.n_tokens)
    assert all(v <= sizes[k] for (k, _), v in fill.items()) and all(len(docs[k]) == n_docs for k in sizes)
    assert all(len(v) == max(1, math.ceil(sum(v) / sizes[k])) for (k, _), v in parts.items())  # cut only where it exceeds the capacity
    report = {r.container_name: r for r in catalogue.QUERIES["p8_report"](spark, tables).collect()}
    for k, cap in sizes.items():
        all_sizes = [n for (name, _), v in parts.items() if name == k for n in v]
        assert report[k].least == pack.lower_bound(all_sizes, cap) and report[k].least <= report[k].containers <= 1.02 * report[k].least + 1


def test_mixture_keeps_its_caps(spark, tables):
    targets = {r.source: r for r in spark.read.parquet(f"{tables}/mix_targets.parquet").collect()}
    tokens, total = {}, 0
    for r in catalogue.QUERIES["p9_copies"](spark, tables).collect():
        assert r.source in targets and 0 <= r.copies <= targets[r.source].max_repeats
        tokens[r.source] = tokens.get(r.source, 0) + r.copies * r.n_tokens
        total += r.copies * r.n_tokens
    shares = catalogue.QUERIES["p9_shares"](spark, tables).collect()
    there = sum(r.target_share for r in shares if r.items)  # a source without documents leaves its share to the others
    for r in shares:
        assert abs(r.actual_share - tokens.get(r.source, 0) / total) < 1e-4
        if r.items:
            assert abs(r.actual_share - r.target_share / there) < 0.02  # a hundred documents; at 10,000 the shares are within 0.002
