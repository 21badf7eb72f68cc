"""Graph-augmented retrieval: the figures of the join over all pairs of questions and relations, without these pairs as rows."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from rillway.operators import kg as K
from rillway.plans import graph as G

#: rows, sums of score, graph and intent, as joins over all pairs gave them on the smallest tables
WANT = {"balanced": (14, 8.3764, 12.7897, 12.87681), "direct_only": (14, 8.3695, 12.77, 12.22464), "exploratory": (22, 10.9088, 19.81222, 20.87681)}


@pytest.fixture(scope="module")
def parts(spark, tables):
    return G._graph(spark, tables)


def found(parts, profile):
    c, e, r = parts
    return K.augmented_retrieval(G._questions(c), G._retrieved(c, 1), e, r, c, profile)


def figures(df):
    rows = df.collect()
    return (len(rows), *[round(sum(r[x] for r in rows), 5) for x in ("score", "graph", "intent")])


@pytest.mark.parametrize("profile", sorted(WANT))
def test_as_by_joins(parts, profile):
    assert figures(found(parts, profile)) == WANT[profile]


def test_no_pairs_of_questions_and_relations(parts):
    """every question met every relation of a common name as a row, which grows as the square of the documents."""
    assert "evidence" not in found(parts, "exploratory")._jdf.queryExecution().optimizedPlan().toString()


def test_graph_has_no_word_counts(parts):
    """the graph carried the number of words before each entity, for which every entity was given the whole text."""
    assert "start_word" not in parts[1].columns


def test_terms_are_only_tried_where_they_can_be(monkeypatch):
    """every text was tried against all terms; those that it can't hold aren't compiled for it."""
    assert all(K._plain(a) == K._plain(b) for a, b in (("Studium", "ſTUDİUM"), ("Bıs", "BIS"), ("Kolloquium", "kolloquium")))
    tried = []
    monkeypatch.setattr(K, "_any_of", lambda ts: tried.append(ts) or re.compile("|".join(map(re.escape, ts)), re.I))
    rows = [x for b in K.finder()(iter([pd.DataFrame({"chunk_id": ["a", "b"], "section_id": [None, None], "sentence_id": ["a|s0", "b|s0"], "sentence": ["Das ſtudıum endet.", "Nichts davon."], "at": [0, 0]})])) for x in b.itertuples()]
    assert [(r.chunk_id, r.name, r.entity_type, r.start_char, r.end_char) for r in rows] == [("a", "ſtudıum", "Concept", 4, 11)]
    assert set(tried) == {("Studium",)}


def test_noise_of_what_is_found(spark, tables):
    """the whole query, as by joins over all pairs: every question with added chunks has its row."""
    c, e, r = G._graph(spark, tables)
    new = {x.qid: 0 for x in found((c, e, r), "exploratory").where("source = 'graph'").collect()}
    rows = G.kg_added_noise(spark, tables).collect()
    assert {x.qid for x in rows} == set(new) and all(x.n_noise <= x.n_added <= 4 for x in rows)


def graph_of(folder, n, rng):
    """An index of n chunks with random relations and names, some names in every tenth chunk."""
    names = ["bis", "sar", "verfahren", *(f"{x:02}.01.2024" for x in range(40))]
    rel = lambda c: (c, rng.choice(["has_deadline", "allows", "requires"]), rng.choice(names[: 3 if rng.random() < 0.1 else None]), rng.choice(names), rng.random() < 0.3)
    c = pd.DataFrame({"chunk_id": range(n), "place": [f"p {2020 + x % 7} {x}" for x in range(n)], "preamble": [x % 9 == 0 for x in range(n)]})
    r = pd.DataFrame([rel(x) for x in range(n) for _ in range(x % 4)], columns=["chunk_id", "predicate", "subject_norm", "object_norm", "stated"])
    m = pd.DataFrame([(x, rng.choice(names)) for x in range(n) for _ in range(x % 3)], columns=["chunk_id", "norm"])
    for name, t in (("r", r), ("n", m), ("c", c)):
        t.to_parquet(folder / name)
    return K._Index(*[f"file:{folder / x}" for x in ("r", "n", "c")])


@pytest.mark.parametrize("n,questions", [(60, 40), (6000, 6)])
def test_only_chunks_that_can_be_added_are_scored(tmp_path, monkeypatch, n, questions):
    """every question scored every chunk, so time grew as the square of the documents; the best are those of all chunks scored."""
    rng, scored = random.Random(n), []
    ix, of = graph_of(tmp_path, n, rng), K._Scored.of
    monkeypatch.setattr(K._Scored, "of", lambda self, chunks: scored.append(len(chunks)) or of(self, chunks))
    for profile in sorted(WANT) * questions:
        algorithm, most, least, rounds, damping, by_intent = K.PROFILES[profile]
        question = rng.choice(["Fristen bis 03.01.2024", "Verfahren 2023 kann", "Preamble Frist bis sar"])
        view = ix.view(ix.quality(question))
        seeds = {x: rng.choice([1.0, 0.65]) for x in rng.sample(ix.names, rng.randint(1, 4))}
        x = K._Scored(ix, view, K._spread_scores(ix, view, question.lower(), seeds, algorithm, rounds, damping), 0.35, by_intent)
        own, least, floor = np.array([rng.randrange(n)]), max(0.5, least), max(least * 0.1, 0.08)
        found, g, i = of(x, np.arange(n))
        s = x.score(0.0, g, i)
        want = sorted((-s[j], j) for j in range(n) if found[j] and view.chunk_quality[j] >= least and g[j] >= floor and j != own[0])[:most]
        assert [(-t, j) for j, t, *_ in x.best(most, own, least, floor)] == want
    assert n < 1000 or sum(scored) < n * 3 * questions / 2


def test_lean_graph_is_enough(spark, tables, parts):
    """sections were entities of every sentence; without most of them relations and chunks found are the same."""
    c, e, r = G._graph(spark, tables, lean=True)
    assert e.count() < parts[1].count() / 2
    assert sorted(map(tuple, r.collect())) == sorted(map(tuple, parts[2].collect()))
    assert sorted(map(tuple, found((c, e, r), "exploratory").collect())) == sorted(map(tuple, found(parts, "exploratory").collect()))
