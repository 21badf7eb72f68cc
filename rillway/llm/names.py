"""Variant spellings of names typed by people, linked by a prefix-filtered similarity join on token q-grams.

Nothing is known of the names beforehand; what the words of a corpus of names mean is learned from all of its
different names. A rare word is joined to more frequent words by the rarest of their q-grams and counts as the most
frequent one within few slips; halves of a broken word are put together. A tail that only ever follows a full name (a
department) is left out. Of each name one word, rare itself and found among common ones, carries the identity; the
others are its role (what sort of body, which given name). Names of the same identity are compared by a soft weighted
token similarity of their roles, in which rare tokens count more and short forms match what they can abbreviate; a
pair of roles counts only where the corpus bears it out. Links make connected components.
"""

from __future__ import annotations

import math
import re
import unicodedata
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rillway.llm.canon import canonical_text
from rillway.operators.components import connected_components
from rillway.session import Scratch, spread

Q = 4
EDITS = 2
#: A swap of neighbours spoils at most Q + 1 q-grams, so texts within EDITS slips share one of this many of any order.
PREFIX = EDITS * (Q + 1) + 1
#: Least similarity of roles; of the bearers of a short form, the share that must bear a form it may stand for; the
#: largest share of a form's bearers that may also bear the other (two sorts of body in every town aren't one); the least
#: share of the short form's bearers; and the share of the best form's score that other forms need.
SIMILAR, COVERED, BESIDE, SELDOM, MUCH_LESS = 0.5, 0.7, 0.85, 0.1, 0.4
#: A tail is one where this share of its uses follow a full name; a short word is a particle where this share of a longer word's uses have it.
TAIL_SHARE, PARTICLE_SHARE, ALONE_SHARE = 0.8, 0.6, 0.05
#: Words of the longest tail that is looked for, and letters of the longest particle.
TAIL_WORDS, PARTICLE_LETTERS = 8, 3

_SPLIT = re.compile(r"[^\W_]+(?:[.'’\-‐‑]+[^\W_]+)*\.?")
_PARTS = re.compile(r"\s+[-–—|/]\s+|,\s+|\s{2,}")


def slips(a: str, b: str, most: int) -> int:
    """Insertions, losses, changes and swaps of neighbours from a to b (restricted edit distance); most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def allowed(n: int) -> int:
    """Slips forgiven in a word of n letters."""
    return EDITS if n >= 8 else 1 if n >= 5 else 0


def fold(text: str) -> str:
    t = unicodedata.normalize("NFD", text.casefold())
    return unicodedata.normalize("NFC", "".join(c for c in t if not unicodedata.combining(c))).replace("ł", "l").replace("ø", "o").replace("ς", "σ")


def parts(name: str) -> list[list[str]]:
    """Words of a name, by the parts that dashes, commas and wide gaps cut it into; a name without words is one word."""
    out = []
    for p in _PARTS.split(fold(name)):
        words = [re.sub(r"[.'’\-‐‑]", "", w) for w in _SPLIT.findall(p)]
        if words := [w for w in words if w]:
            out.append(words)
    return out or [[name.strip()]]


def spelled_by_starts(short: str, words: tuple[str, ...]) -> bool:
    """Is short made of a beginning of each of the words, in their order?"""
    if not words:
        return not short
    w = words[0]
    for k in range(1, len(short) + 1):
        if not w.startswith(short[:k]):
            return False
        if spelled_by_starts(short[k:], words[1:]):
            return True
    return False


def word_match(a: str, b: str) -> float:
    """How well word a can stand for word b: the word itself, a short form (its first letter and others in order), or a longer form."""
    if a == b:
        return 1.0
    if len(a) < len(b) and a[0] == b[0]:
        letters = iter(b)
        if all(c in letters for c in a):
            return (0.88 if b.startswith(a) else 0.8) + 0.1 * len(a) / len(b)
    return 0.6 if len(b) >= 5 and a.startswith(b) else 0.0


def common_letters(a: str, b: str) -> int:
    """Letters of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def role_similarity(short: list[str], full: list[str], uses: dict[str, int], together: dict[tuple[str, str], int], total: int) -> float:
    """Share of the weight of the words of both roles that have a counterpart; short may abbreviate full.

    A word weighs the logarithm of its rarity. A word of full without a counterpart weighs the less, the more surely it
    goes with one that has a counterpart: what can be told from the rest isn't missed.
    """
    weigh = lambda w: math.log(1 + total / max(uses.get(w, 1), 1))
    used, extra = {a: 1.0 for a in short if a in full}, []
    for a in short:
        if a in full:
            continue
        match, b = max(((word_match(a, b), b) for b in full if b not in used), default=(0.0, ""))
        if match:
            used[b] = match
            continue
        # the letters of an acronym, of which one may be a particle's
        forms = [(a, 0.85), *((a[:i] + a[i + 1 :], 0.75) for i in range(1, len(a) - 1))] if len(a) <= 8 and len(full) <= 6 else []
        found = next(((c, m) for form, m in forms for k in range(min(len(full), len(form), 4), 1, -1) for c in permutations(full, k) if spelled_by_starts(form, c)), None)
        if found:
            used.update({b: max(used.get(b, 0.0), found[1]) for b in found[0]})
        else:
            extra.append(a)
    if not used:
        return 0.0
    missed = sum(weigh(b) * (1 - max(together.get((b, x), 0) / max(uses.get(x, 1), 1) for x in used)) for b in full if b not in used)
    got = sum(weigh(b) * m for b, m in used.items())
    whole = sum(weigh(b) for b in used) + missed + sum(map(weigh, extra))
    return got / whole if whole else 0.0


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(w, right): of words (w, df), those within few slips of more frequent ones, with the most frequent of these.

    The words of five letters and more are joined on the rarest of their q-grams, of which PREFIX are enough; a q-gram must
    stand at nearly the same place. Where two words have the same number of uses the later in order counts as more frequent.
    """
    pad = F.concat(F.lit("^" * (Q - 1)), "w", F.lit("$" * (Q - 1)))
    listed = words.where("length(w) >= 5").select("w", "df", F.length("w").alias("n"), pad.alias("p")).select(
        "w", "df", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("p") - Q + 1), lambda i: F.substr("p", i, F.lit(Q)))).alias("at", "gram")
    )
    counts = listed.groupBy("gram").agg(F.count_distinct("w").alias("c")).where("c > 1")
    rare = F.rank().over(Window.partitionBy("w").orderBy("c", "gram"))
    grams = scratch.cut(listed.join(counts, "gram").withColumn("r", rare).where(f"r <= {PREFIX}").select("w", "df", "n", "at", "gram"))
    right = grams.select(F.col("w").alias("v"), F.col("df").alias("dv"), F.col("n").alias("m"), F.col("at").alias("at_v"), "gram")
    pairs = grams.join(right, "gram").where(f"(df < dv or (df = dv and w < v)) and abs(n - m) <= {EDITS} and abs(at - at_v) <= {EDITS}").select("w", "v", "dv").distinct()
    pairs = pairs.where(f"levenshtein(w, v, {2 * EDITS}) >= 0 and not (least(length(w), length(v)) < 6 and (startswith(w, v) or startswith(v, w)))")

    def verify(batches):
        for t in batches:
            yield t[[slips(a, b, EDITS) <= allowed(min(len(a), len(b))) for a, b in zip(t["w"], t["v"])]]

    good = pairs.mapInPandas(verify, "w string, v string, dv long")
    first = scratch.cut(good.groupBy("w").agg(F.max_by("v", F.struct("dv", "v")).alias("right")))
    for _ in range(2):  # what is nearest may itself be a slip
        nxt = first.select(F.col("w").alias("right"), F.col("right").alias("then"))
        first = first.join(nxt, "right", "left").select("w", F.coalesce("then", "right").alias("right"))
    return scratch.cut(first)


def _words(col: Column) -> Column:
    return F.split(col, " ")


def settled(names: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, segs) of (name, segs ARRAY<ARRAY<STRING>>) with slips undone and halves of broken words put together."""
    flat = names.select("name", F.posexplode("segs").alias("s", "ws")).select("name", "s", F.posexplode("ws").alias("i", "w"), "ws")
    flat = scratch.cut(flat.select("name", "s", "i", "w", F.try_element_at("ws", F.col("i") + 2).alias("next")))
    words = scratch.cut(flat.groupBy("w").agg(F.count_distinct("name").alias("df")))
    right = near_words(words, scratch)
    pairs = flat.where("next is not null").groupBy("w", "next").agg(F.count("*").alias("n")).withColumn("both", F.concat("w", "next"))
    whole = pairs.join(words.select(F.col("w").alias("both"), "df"), "both").where("df >= n").select("w", "next", "both")
    whole = whole.join(right.select(F.col("w").alias("both"), "right"), "both", "left").select("w", "next", F.coalesce("right", "both").alias("whole"))
    each = flat.join(right, "w", "left").join(whole, ["w", "next"], "left")
    rows = each.groupBy("name", "s").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("right", "w").alias("w"), "whole"))).alias("ws"))
    # a word that is taken up by the one before it is left out; the last of three that fit is so, too
    joined = F.aggregate(
        "ws", F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("taken")),
        lambda acc, x: F.when(acc["taken"], F.struct(acc["out"].alias("out"), F.lit(False).alias("taken"))).otherwise(F.struct(F.concat(acc["out"], F.array(F.coalesce(x["whole"], x["w"]))).alias("out"), x["whole"].isNotNull().alias("taken"))),
        lambda acc: acc["out"],
    )
    return scratch.cut(rows.select("name", "s", joined.alias("ws")).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("s", "ws"))).alias("x")).select("name", F.transform("x", lambda y: y["ws"]).alias("segs")))


def without_tails(names: DataFrame) -> DataFrame:
    """(name, words): the words of each name without the parts that only follow full names, such as departments."""
    key = lambda c: F.array_join(c, " ")
    segs = names.select(F.flatten("segs").alias("all"), F.posexplode("segs").alias("s", "ws"), "segs")
    before = F.flatten(F.slice("segs", 1, F.col("s")))
    tails = segs.where(f"s > 0 and size(ws) <= {TAIL_WORDS}").withColumn("before", before).where("size(before) > 1").groupBy(key("ws").alias("tail")).agg(F.count("*").alias("n"), F.count_distinct(key("before")).alias("heads")).where("heads > 1")
    starts = F.sequence(F.lit(1), F.size("all"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(TAIL_WORDS), F.size("all") - i + 1)), lambda k: F.array_join(F.slice("all", i, k), " "))))
    uses = names.select(F.flatten("segs").alias("all")).where("size(all) > 0").select(F.explode(runs).alias("tail")).join(tails.select("tail"), "tail", "left_semi").groupBy("tail").agg(F.count("*").alias("uses"))
    light = tails.join(uses, "tail").where(F.col("n") >= TAIL_SHARE * F.col("uses")).select("tail", F.lit(1).alias("light"))
    each = names.select("name", F.posexplode("segs").alias("s", "ws")).withColumn("tail", F.when(F.col("s") > 0, key("ws")))
    kept = each.join(light, "tail", "left").where("light is null")
    return kept.groupBy("name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", "ws"))), lambda x: x["ws"])).alias("words"))


def identities(nodes: DataFrame) -> DataFrame:
    """(node, id, role ARRAY<STRING>) of nodes (node, words): the word that carries the identity, and the others without particles.

    The identity is the word with the fewest uses against those of the rarest word beside it, on average over its names; longer
    words come first. Particles are short words that hardly ever make a role alone and that a longer word mostly has beside it.
    """
    flat = nodes.select("node", F.explode("words").alias("w"))
    df = flat.groupBy("w").agg(F.count("*").alias("df"))
    lows = flat.join(df, "w").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
    each = lows.select("node", "ws", F.explode("ws").alias("x"))
    other = F.when(F.col("ws")[0]["w"] == F.col("x.w"), F.try_element_at("ws", F.lit(2))["df"]).otherwise(F.col("ws")[0]["df"])
    beside = each.groupBy("x.w").agg(F.coalesce(F.avg(F.log(other)), F.lit(0.0)).alias("h"))
    scored = each.select("node", F.col("x.w").alias("w"), F.col("x.df").alias("df")).join(beside, "w")
    score = F.round(F.log("df") - F.col("h") - 0.1 * F.least(F.length("w"), F.lit(12)), 6)
    named = scored.groupBy("node").agg(F.min_by("w", F.struct(score, "w")).alias("id"), F.array_sort(F.collect_list("w")).alias("words"))
    return named.select("node", "id", F.array_except("words", F.array("id")).alias("role"))


def without_particles(named: DataFrame) -> DataFrame:
    short = F.length("w") <= PARTICLE_LETTERS
    roles = named.select("node", "role", F.explode("role").alias("w"))
    uses = roles.groupBy("w").agg(F.count("*").alias("n"), F.count_if(F.size("role") == 1).alias("alone"))
    pairs = roles.where(short).select("w", F.explode("role").alias("m")).where(f"length(m) > {PARTICLE_LETTERS}").groupBy("w", "m").agg(F.count("*").alias("both"))
    pairs = pairs.join(uses.select(F.col("w").alias("m"), F.col("n").alias("n_m")), "m").join(uses, "w")
    found = pairs.where(f"alone <= {ALONE_SHARE} * n and both >= {PARTICLE_SHARE} * n_m and both >= greatest(3, 0.1 * n)").select("w").distinct()
    keep = roles.join(found, "w", "left_anti").groupBy("node").agg(F.array_sort(F.collect_list("w")).alias("kept"))
    return named.join(keep, "node", "left").select("node", "id", F.coalesce("kept", F.array().cast("array<string>")).alias("role"))


def role_pairs(borne: DataFrame, scratch: Scratch) -> DataFrame:
    """(short, full, score) of roles borne (id, role): what role may stand for what other, and how well that is borne out."""
    n = scratch.cut(borne.groupBy("role").agg(F.count("*").alias("n")))
    with_n = borne.join(n, "role")
    full = with_n.select("id", F.col("role").alias("full"), F.col("n").alias("n_full"))
    both = with_n.withColumnRenamed("role", "short").join(full, "id").where("short <> full and (n < n_full or (n = n_full and full < short))")
    seen = both.groupBy("short", "full", "n", "n_full").agg(F.count("*").alias("c")).where(f"c <= {BESIDE} * n_full and c >= {SELDOM} * n")
    uses = n.select(F.explode(_words(F.col("role"))).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("uses"))
    total = n.agg(F.sum("n").alias("total"))
    pairs = n.select(F.col("role"), "n", _words(F.col("role")).alias("ws")).select("n", "ws", F.explode("ws").alias("x")).select("n", "x", F.explode("ws").alias("y")).where("x <> y").groupBy("x", "y").agg(F.sum("n").alias("together"))
    words = n.select("role", F.explode(_words(F.col("role"))).alias("w")).join(uses, "w").groupBy("role").agg(F.collect_list(F.struct("w", "uses")).alias("uses"))
    inner = n.select("role", _words(F.col("role")).alias("ws")).select("role", "ws", F.explode("ws").alias("x")).select("role", "x", F.explode("ws").alias("y")).join(pairs, ["x", "y"]).groupBy("role").agg(F.collect_list(F.struct("x", "y", "together")).alias("pairs"))
    known = scratch.cut(words.join(inner, "role", "left"))
    ready = seen.join(known.select(F.col("role").alias("short"), F.col("uses").alias("u_short")), "short").join(known.select(F.col("role").alias("full"), F.col("uses").alias("u_full"), "pairs"), "full").join(F.broadcast(total), F.lit(True))

    def score(batches):
        for t in batches:
            out = []
            for s, f, n_s, n_f, c, us, uf, ps, tot in zip(t["short"], t["full"], t["n"], t["n_full"], t["c"], t["u_short"], t["u_full"], t["pairs"], t["total"]):
                uses_of = {x["w"]: x["uses"] for x in [*us, *uf]}
                a, b = s.split(" "), f.split(" ")
                q = role_similarity(a, b, uses_of, {(x["x"], x["y"]): x["together"] for x in (ps if ps is not None else ())}, tot)
                if q < SIMILAR and len(a) == len(b) == 1 and n_s >= 3 and c >= BESIDE * n_s and 3 * c <= n_f and common_letters(s, f) >= 0.6 * len(s):
                    q = SIMILAR  # a form that its letters hardly tell, but that the corpus always has beside a much more frequent one
                out.append(q if q >= SIMILAR else None)
            yield pd.DataFrame({"short": t["short"], "full": t["full"], "n_full": t["n_full"], "score": pd.Series(out, dtype="float64", index=t.index) * t["c"] / t["n"], "n": t["n"]}).dropna()

    return scratch.cut(ready.mapInPandas(score, "short string, full string, n_full long, score double, n long").withColumn("score", F.round("score", 4)).withColumn("best", F.max("score").over(Window.partitionBy("short"))).where(f"score >= {MUCH_LESS} * best").drop("best"))


def link_names(df: DataFrame, name: str) -> DataFrame:
    """(name, entity): one row per different name as stored; names of the same bearer have the same entity.

    Exact copies and null or blank names are left out first. Names that agree once slips, tails and particles are undone form
    one node, so copies are never paired with each other. What is learned comes from all different names of df, so names
    that a few rows alone can't explain (a short form seen nowhere beside its full form) stay apart. Empty input gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    raw = df.select(F.col(name).alias("name")).where("trim(name) <> ''").distinct()
    raw = raw.select("name", F.col("name").alias("form"))
    forms = canonical_text(spread(raw), ["form"], ["name"]).select("name", "form")

    def split(batches):
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "segs": [parts(x) for x in b["form"]]})

    names = scratch.cut(forms.mapInPandas(split, "name string, segs array<array<string>>"))
    words = without_tails(settled(names, scratch))
    of = scratch.cut(words.select("name", F.array_distinct(F.array_sort("words")).alias("words")).withColumn("node", F.array_join("words", " ")))
    nodes = of.select("node", "words").distinct()
    named = without_particles(scratch.cut(identities(nodes)))
    named = scratch.cut(named.select("node", "id", F.array_join("role", " ").alias("role")))
    borne = scratch.cut(named.where("role <> ''").select("id", "role").distinct())
    may = role_pairs(borne, scratch)
    here = borne.withColumnRenamed("role", "short").join(may, "short").join(borne.withColumnRenamed("role", "full"), ["id", "full"])
    here = scratch.cut(here.groupBy("id", "short", "n").agg(F.max_by("full", F.struct("score", "n_full", "full")).alias("full")))
    covered = here.groupBy("short", "n").agg(F.count("*").alias("c")).where(F.col("c") >= COVERED * F.col("n")).select("short")
    usual = may.groupBy("short").agg(F.max_by("full", F.struct("score", "n_full", "full")).alias("usual"))
    short = borne.withColumnRenamed("role", "short").join(covered, "short", "left_semi")
    stands = short.join(here.select("id", "short", "full"), ["id", "short"], "left").join(usual, "short").select("id", "short", F.coalesce("full", "usual").alias("full"))
    key = lambda role: F.concat_ws("\x01", "id", role)
    links = scratch.cut(stands.select(key("short").alias("a"), key("full").alias("b")))
    comp = connected_components(links, "a", "b").select(F.col("node").alias("bearer"), "component")
    who = of.join(named, "node").select("name", key("role").alias("bearer"))
    return who.join(comp, "bearer", "left").select("name", F.coalesce("component", "bearer").alias("entity"))
