import random

from rillway.operators.components import connected_components
from rillway.operators.graph import hop_scores, personalised_pagerank
from rillway.operators.hierarchy import ancestor_paths, hierarchy


def brute(parent):
    out = {}
    for n in parent:
        path, x = [n], n
        while parent.get(x) is not None and parent[x] not in path:
            x = parent[x]
            path.append(x)
        out[n] = None if parent.get(x) is not None else path[::-1]
    return out


def test_random_forests_with_cycles(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for scope in ("a", "b"):
        names = [f"{i:03d}" for i in range(120)]
        parent = {n: rng.choice(names[: max(1, i // 3)]) if i and rng.random() < 0.95 else None for i, n in enumerate(names)}
        parent["050"], parent["051"], parent["060"] = "051", "050", "060"
        chain = [f"c{i:03d}" for i in range(70)]
        parent |= {c: (chain[i - 1] if i else "000") for i, c in enumerate(chain)}
        rows += [(scope, n, p, n) for n, p in parent.items()]
        want |= {(scope, n): path for n, path in brute(parent).items()}
    rows += rows[:40] + [("a", None, "000", "x"), ("a", "001", "nowhere", "x")]
    tree = hierarchy(spark.createDataFrame(rows, "s string, n string, p string, node string"), "s", "n", "p").cache()
    got = {(r.scope, r.node): r for r in tree.collect()}
    assert set(got) == set(want)
    paths = {(r.scope, r.node): r.path for r in ancestor_paths(tree).collect()}
    for k, path in want.items():
        r = got[k]
        if path is None:
            assert r.in_cycle and r.root is None and r.depth == -1
        else:
            assert (r.root, r.depth, paths[k]) == (path[0], len(path) - 1, path)
            below = {x for x, p in want.items() if p and x[0] == k[0] and k[1] in p[:-1]}
            assert r.n_descendants == len(below)
            assert below == {x for x, y in got.items() if y.scope == r.scope and y.root == r.root and r.entry < y.entry < r.exit}


def test_empty_hierarchy(spark):
    assert hierarchy(spark.createDataFrame([], "s string, n string, p string"), "s", "n", "p").count() == 0


def test_components(spark):
    edges = [(f"{i}", f"{i + 1}") for i in range(30)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert {got[str(i)] for i in range(31)} == {"0"} and got["x"] == got["y"] == "x" and "z" not in got and "q" not in got


def test_propagation_keeps_mass(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 3.0)], "s string, o string, w double")
    seeds = spark.createDataFrame([("a", 1.0)], "node string, score double")
    assert abs(sum(r.score for r in personalised_pagerank(e, "s", "o", "w", seeds, 0.85, 4).collect()) - 1) < 1e-9
    assert {r.node: r.score for r in hop_scores(e, "s", "o", "w", seeds, 1, 0.5).collect()} == {"a": 1.0, "b": 0.5}
