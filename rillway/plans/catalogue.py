"""All queries of the core and their SQL oracles."""

from __future__ import annotations

from rillway.plans import analytics, answers, design, experiments, graph, ingest, labels, retrieval, training

MODULES = (training, retrieval, analytics, answers, labels, ingest, graph, design, experiments)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
