"""Command line: list and run queries, sweep designs, evaluate prepared results, export the code graph."""

from __future__ import annotations

import argparse
import sys

from rillway.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rillway", description=__doc__)
    p.add_argument("--tables", default=".", help="folder of the Parquet tables")
    p.add_argument("--cpus", default="*")
    s = p.add_subparsers(dest="command", required=True)
    s.add_parser("list", help="names of the queries")
    r = s.add_parser("run", help="run a query and write its rows")
    r.add_argument("query")
    r.add_argument("--out", help="folder; shown if it isn't given")
    r.add_argument("--form", choices=("parquet", "csv", "json"), default="parquet")
    w = s.add_parser("sweep", help="compare designs over the sections of documents")
    w.add_argument("--strategies", default="by_section,by_paragraph")
    w.add_argument("--sizes", default="300,450")
    w.add_argument("--overlaps", default="40,60")
    w.add_argument("--retrievers", default="bm25,tfidf")
    w.add_argument("--out")
    e = s.add_parser("prepared", help="evaluate prepared results of a spreadsheet")
    e.add_argument("sheet")
    e.add_argument("--out")
    g = s.add_parser("graph", help="export the code graph")
    g.add_argument("out")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from rillway.plans import catalogue, experiments

    if a.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    from rillway.session import table
    from rillway.sinks import writers as W

    spark = build_session("rillway", a.cpus)
    show = lambda df, out, form="parquet": W.write_table(df, out, form) if out else print(W.markdown_table(df))
    if a.command == "run":
        if a.query not in catalogue.QUERIES:
            print(f"no query {a.query}", file=sys.stderr)
            return 2
        show(catalogue.QUERIES[a.query](spark, a.tables), a.out, a.form)
    elif a.command == "sweep":
        from rillway.pipeline import run_sweep, sweep

        split = lambda x, f=str: tuple(f(v.strip()) for v in x.split(",") if v.strip())
        designs = sweep(split(a.strategies), split(a.sizes, int), split(a.overlaps, int), split(a.retrievers))
        show(run_sweep(*experiments.sweep_inputs(spark, a.tables), designs), a.out)
    elif a.command == "prepared":
        from rillway.pipeline import run_prepared
        from rillway.sources.documents import load_sheet, prepared_results

        show(run_prepared(prepared_results(load_sheet(spark, a.sheet)))["summary"], a.out)
    elif a.command == "graph":
        W.export_code_graph(spark, table(spark, a.tables, "cpv_catalog").select("code", "en").withColumnRenamed("en", "label"), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
