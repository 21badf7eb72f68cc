"""Parent-child links to full hierarchies, by Euler tours and parallel list ranking.

Nothing here depends on the depth of the trees by more than its logarithm, apart from a bounded number of
leaf-peeling rounds, and no step collects a tree, a catalogue or the children of one parent into a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from rillway.session import Scratch

PEEL_ROUNDS = 4
#: Places of an interval that are laid out from one row.
INTERVAL_PART = 10_000
SIBLING_BUCKETS = 64


def clean_links(df: DataFrame, scope: str, node: str, parent: str) -> DataFrame:
    """One row (scope, node, parent) per node; parent is null for roots.

    A parent that isn't a node of the same scope is no parent. Of several different parents of one node the
    smallest valid one counts, so the result doesn't depend on the order of rows. Null scopes form the scope ''.
    Rows whose node is null are left out.
    """
    rows = df.select(
        F.coalesce(F.col(scope), F.lit("")).alias("scope"), F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent")
    ).where("node is not null")
    nodes = rows.select("scope", "node").distinct()
    links = rows.where("parent is not null").distinct()
    valid = links.join(nodes.select("scope", F.col("node").alias("parent")), ["scope", "parent"], "left_semi")
    best = valid.groupBy("scope", "node").agg(F.min("parent").alias("parent"))
    return nodes.join(best, ["scope", "node"], "left")


def find_cycles(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes (scope, node) that lie on a cycle.

    Leaves are peeled off a few times, which removes most nodes. What is left of the links is then followed by
    pointer doubling: once the set of nodes reached stops shrinking, the doubled step permutes it, so it holds
    exactly the nodes on cycles.
    """
    alive = links.where("parent is not null")
    for _ in range(PEEL_ROUNDS):
        heads = alive.select("scope", F.col("parent").alias("node")).distinct()
        alive = alive.join(heads, ["scope", "node"], "left_semi")
    jump = scratch.cut(alive.select("scope", "node", F.col("parent").alias("to")))
    before = -1
    while True:
        reached = jump.select("scope", F.col("to").alias("node")).distinct()
        now = reached.count()
        if now == before or now == 0:
            return reached
        before = now
        step = jump.select("scope", F.col("node").alias("to"), F.col("to").alias("next"))
        nxt = scratch.cut(jump.join(step, ["scope", "to"]).select("scope", "node", F.col("next").alias("to")))
        scratch.drop(jump)
        jump = nxt


def _tour(links: DataFrame) -> DataFrame:
    """Successor list of the Euler tours: (scope, elem, nxt, cnt, s, last); elem is node+ on entry, node- on exit.

    The next sibling is found in two steps, within hash-free value buckets of the node and then between the
    buckets, so that one parent with a large share of all rows is not sorted in one task.
    """
    bucket = F.pmod(F.conv(F.substring(F.sha1("node"), 1, 4), 16, 10).cast("int"), F.lit(SIBLING_BUCKETS))
    kids = links.where("parent is not null").withColumn("b", bucket)
    w = Window.partitionBy("scope", "parent", "b").orderBy("node")
    kids = kids.withColumn("sib", F.lead("node").over(w))
    firsts = kids.groupBy("scope", "parent", "b").agg(F.min("node").alias("first"))
    wb = Window.partitionBy("scope", "parent").orderBy("b")
    firsts = firsts.withColumn("next_first", F.lead("first").over(wb)).withColumn("rank", F.row_number().over(wb))
    kids = kids.join(firsts.select("scope", "parent", "b", "next_first"), ["scope", "parent", "b"], "left")
    exits = kids.select(
        "scope", "node", F.coalesce(F.concat(F.coalesce("sib", "next_first"), F.lit("+")), F.concat("parent", F.lit("-"))).alias("after")
    )
    entry = firsts.where("rank = 1").select("scope", F.col("parent").alias("node"), F.concat("first", F.lit("+")).alias("into"))
    nodes = links.select("scope", "node").join(entry, ["scope", "node"], "left").join(exits, ["scope", "node"], "left")
    both = nodes.select(
        "scope",
        F.explode(
            F.array(
                F.struct(F.concat("node", F.lit("+")).alias("elem"), F.coalesce("into", F.concat("node", F.lit("-"))).alias("nxt"), F.lit(1).cast("long").alias("s")),
                F.struct(F.concat("node", F.lit("-")).alias("elem"), F.col("after").alias("nxt"), F.lit(-1).cast("long").alias("s")),
            )
        ).alias("e"),
    )
    return both.select("scope", "e.elem", "e.nxt", F.lit(1).cast("long").alias("cnt"), "e.s", F.col("e.elem").alias("last"))


def _rank(tour: DataFrame, scratch: Scratch) -> DataFrame:
    """List ranking by pointer doubling: cnt and s become sums from the element to the end of its tour."""
    now = scratch.cut(tour)
    while not now.where("nxt is not null").isEmpty():
        ahead = now.select("scope", F.col("elem").alias("nxt"), F.col("nxt").alias("n2"), F.col("cnt").alias("c2"), F.col("s").alias("s2"), F.col("last").alias("l2"))
        moved = (
            now.where("nxt is not null")
            .join(ahead, ["scope", "nxt"])
            .select("scope", "elem", F.col("n2").alias("nxt"), (F.col("cnt") + F.col("c2")).alias("cnt"), (F.col("s") + F.col("s2")).alias("s"), F.col("l2").alias("last"))
        )
        new = scratch.cut(moved.unionByName(now.where("nxt is null")))
        scratch.drop(now)
        now = new
    return now


def hierarchy(df: DataFrame, scope: str, node: str, parent: str) -> DataFrame:
    """Full hierarchy of the links (scope, node, parent) of df.

    Returns scope, node, parent, root, depth, entry, exit, n_descendants, in_cycle: one row per node of each scope.
    entry and exit are places in the tour of the tree, counted back from its end. A node d is a descendant of a exactly when both have the same root and a.entry < d.entry < a.exit. A node on
    a cycle, or whose way up leads into one, has in_cycle true, root null and depth -1; its interval is that
    within the part below the cycle node. Repeated rows count once, empty input gives no rows, further columns of
    df are ignored. See clean_links for nulls and contradicting parents.
    """
    scratch = Scratch(df.sparkSession)
    links = scratch.cut(clean_links(df, scope, node, parent))
    cycles = scratch.cut(find_cycles(links, scratch).withColumn("ring", F.lit(True)))
    forest = links.join(cycles, ["scope", "node"], "left").withColumn("up", F.when(F.col("ring"), None).otherwise(F.col("parent")))
    ranked = _rank(_tour(forest.select("scope", "node", F.col("up").alias("parent"))), scratch)
    flat = ranked.select(
        "scope", F.expr("substring(elem, 1, length(elem) - 1)").alias("node"), F.expr("substring(last, 1, length(last) - 1)").alias("root"), F.col("elem").endswith("+").alias("enter"), "cnt", "s"
    )
    one = flat.groupBy("scope", "node", "root").agg(
        F.max(F.when(F.col("enter"), F.col("cnt"))).alias("c_in"), F.max(F.when(~F.col("enter"), F.col("cnt"))).alias("c_out"), F.max(F.when(F.col("enter"), -F.col("s"))).alias("depth")
    )
    out = one.join(links, ["scope", "node"])
    bad = cycles.select("scope", F.col("node").alias("root"), "ring")
    out = out.join(bad, ["scope", "root"], "left")
    return out.select(
        "scope",
        "node",
        "parent",
        F.when(F.col("ring"), None).otherwise(F.col("root")).alias("root"),
        F.when(F.col("ring"), F.lit(-1)).otherwise(F.col("depth")).cast("int").alias("depth"),
        (-F.col("c_in")).alias("entry"),
        (-F.col("c_out")).alias("exit"),
        ((F.col("c_in") - F.col("c_out") - 1) / 2).cast("long").alias("n_descendants"),
        F.coalesce("ring", F.lit(False)).alias("in_cycle"),
    )


def ancestor_paths(tree: DataFrame) -> DataFrame:
    """(scope, node, path): path from the root to the node, for the nodes of hierarchy() that aren't in_cycle.

    Paths are joined piece by piece with doubled pointers, so a path of n codes takes log2 n rounds.
    """
    scratch = Scratch(tree.sparkSession)
    now = scratch.cut(tree.where("not in_cycle").select("scope", "node", F.col("parent").alias("up"), F.array("node").alias("path")))
    while not now.where("up is not null").isEmpty():
        ahead = now.select("scope", F.col("node").alias("up"), F.col("up").alias("u2"), F.col("path").alias("p2"))
        moved = now.where("up is not null").join(ahead, ["scope", "up"]).select("scope", "node", F.col("u2").alias("up"), F.concat("p2", "path").alias("path"))
        new = scratch.cut(moved.unionByName(now.where("up is null")))
        scratch.drop(now)
        now = new
    return now.select("scope", "node", "path")


def descendants(tree: DataFrame) -> DataFrame:
    """(scope, node, descendant): each node of hierarchy() that isn't in_cycle with each of its descendants, from the entry-exit intervals.

    The places within a node's interval are laid out, in parts of bounded length, and met with the entries at them: an equi-join
    whose keys are all different on the side of the entries, so neither deep nor wide trees make a hot key.
    """
    t = tree.where("not in_cycle").select("scope", "root", "node", "entry", "exit")
    wide = t.where("exit - entry > 1").withColumn("k", F.explode(F.expr(f"sequence(0, cast((exit - entry - 2) div {INTERVAL_PART} as int))")))
    low = F.col("entry") + 1 + F.col("k") * INTERVAL_PART
    places = wide.select("scope", "root", "node", F.explode(F.sequence(low, F.least(low + INTERVAL_PART - 1, F.col("exit") - 1))).alias("at"))
    found = t.select("scope", "root", F.col("entry").alias("at"), F.col("node").alias("descendant"))
    return places.join(found, ["scope", "root", "at"]).select("scope", "node", "descendant")
