"""Queries taken apart for search – noise, actions, main object, side terms, kind of purchase, channels – and profiles of codes put together; all by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rillway.functions import cpv

#: Phrases of procedure, of action (the longest first), words of contracts, and signals of goods, services and works.
NOISE = "framework agreement|dynamic purchasing system|open procedure|restricted procedure|negotiated procedure|contract notice|prior information notice|public procurement|public contract|procurement notice|consultation of the market|market consultation|tender for|call for tenders|request for proposals"
ACTIONS = "delivery and installation|operation and maintenance|supply and installation|maintenance and repair|repair and maintenance|delivery and assembly|lieferung und montage|maintenance service|supply and delivery|mantenimiento|installation|consultancy|instalacion|maintenance|suministro|fourniture|lieferung|operation|entretien|fornitura|delivery|montage|service|wartung|repair|supply"
SIDE_ACTIONS = "maintenance|repair|wartung|mantenimiento|entretien|manutenzione|operation"
CONTRACT = "maintenance|repair|service|services|installation|operation|delivery|supply|lieferung|montage|wartung|suministro|instalacion|mantenimiento|fourniture|entretien|optional|associated"
GOODS = "supply|delivery|equipment|device|machine|tool|camera|vehicle|material|goods|product|apparatus|instrument|license|licence|lieferung|suministro|fourniture|fornitura"
SERVICES = "maintenance|repair|service|services|consultancy|consulting|advisory|operation|support|hosting|wartung|mantenimiento|entretien|manutenzione"
WORKS = "installation work|installation works|construction|building works|engineering works|road works|adaptation works|montage|instalacion|travaux|obra|obras"
CONNECTORS = " of | for | de | des | del | di | einer | eines | d'une | d'un | pour | para | per "
SIDE_SPLIT = r"\b(?:with|including|plus|along with|associated with|optional|avec|con|incl\.?|samt|mit optional)\b"
DOMAINS = {"traffic monitoring": "traffic monitoring|traffic control|road traffic|verkehrs", "medical": "medical|clinical|hospital|surgical|patient", "security": "security|surveillance|guarding", "information technology": "software|digital|it service|network", "cleaning": "cleaning|janitorial|sanitation", "parking": "parking|pay and display", "construction": "construction|building works|road works"}
GLOSSARY = {"lieferung": "supply", "montage": "installation", "wartung": "maintenance", "instandhaltung": "maintenance", "reparatur": "repair", "suministro": "supply", "instalacion": "installation", "mantenimiento": "maintenance", "fourniture": "supply", "entretien": "maintenance", "fornitura": "supply", "manutenzione": "maintenance", "reparation": "repair"}
#: Weight of each channel of search.
CHANNELS = {"object": 1.0, "object_english": 0.9, "full": 0.6, "nouns": 0.7, "object_action": 0.8, "domain": 0.4}
STOP = "and|or|the|a|an|for|with|of|to|in|on|optional"


def free_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\p{L}\p{N}_\s/&+]", " "), r"(?U)\s+", " "))


def _hits(text: Column, words: str) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words.split("|")]), lambda w: F.contains(text, w)))


def _object(c: Column) -> Column:
    """A candidate for the object without leading small words, with its score: words of things less words of contracts and small words in front."""
    t = c
    for _ in range(4):
        t = F.trim(F.regexp_replace(F.regexp_replace(t, r"\bfor the of\b|\bfor the\b|\bof the\b", " "), r"^(?:for|the|of|a|an|and|or|de|des|del|di|und|mit|pour|para|per|un|une|einer|eines|eine|optional|associated)\s+", ""))
    t = free_text(t)
    words = F.filter(F.split(t, " "), lambda w: F.length(w) > 2)
    contract = F.size(F.filter(words, lambda w: w.isin(*CONTRACT.split("|"))))
    small = F.size(F.filter(F.slice(F.split(t, " "), 1, 3), lambda w: w.isin("for", "the", "of", "de", "des", "del", "di")))
    return F.when(F.size(words) > 0, F.struct((-(F.size(words) - 2 * contract - small)).alias("s"), contract.alias("c"), F.size(words).alias("n"), F.length(t).alias("l"), t.alias("t")))


def enrich(queries: DataFrame, text: str) -> DataFrame:
    """queries with clean_query, main_object, action, side_terms, noise, nouns, domain, kind ('goods', 'services' or 'works'), has_service, translated and channels ARRAY<STRUCT<name, query, weight>>."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\b[0-9][0-9./%-]*\b", " ")
    d = queries.withColumn("_low", low).withColumn("noise", F.array_distinct(F.regexp_extract_all("_low", F.lit(rf"\b(?:{NOISE})\b"), F.lit(0)))).withColumn("_acts", F.slice(F.array_distinct(F.regexp_extract_all("_low", F.lit(rf"(?U)\b(?:{ACTIONS})\b"), F.lit(0))), 1, 3))
    d = d.withColumn("_first", F.filter("_acts", lambda a: ~a.rlike(SIDE_ACTIONS))).withColumn("_later", F.filter("_acts", lambda a: a.rlike(SIDE_ACTIONS)))
    bare = F.regexp_replace(F.regexp_replace("_low", rf"\b(?:{NOISE})\b", " "), r"(?U)\s+", " ")
    main_acts = "|".join(a for a in ACTIONS.split("|") if not any(s in a for s in SIDE_ACTIONS.split("|")))
    d = d.withColumn("_bare", F.trim(F.regexp_replace(F.regexp_replace(bare, rf"(?U)\b(?:{main_acts})\b", " "), r"(?U)\s+", " ")))
    segs = F.filter(F.transform(F.split("_bare", r"\s*[-:;|–—]\s*"), lambda s: F.trim(s)), lambda s: s != "")
    d = d.withColumn("_segs", segs).withColumn("_left", F.coalesce(F.try_element_at("_segs", F.lit(1)), "_bare"))
    parts = F.split("_left", SIDE_SPLIT, 2)
    d = d.withColumn("_right", F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))).withColumn("_left", F.coalesce(F.nullif(F.trim(F.element_at(parts, 1)), F.lit("")), "_left"))
    after = [F.when(F.contains("_left", F.lit(c)), F.element_at(F.split("_left", c.replace("'", "'")), -1)) for c in CONNECTORS.split("|")]
    best = F.try_element_at(F.array_sort(F.array_compact(F.array(*[_object(a) for a in after], _object(F.col("_left"))))), F.lit(1))["t"]
    d = d.withColumn("_obj", F.coalesce(best, free_text(F.col("_bare"))))
    short = (F.size(F.split("_obj", " ")) < 2) & (F.length("_obj") < 10)
    d = d.withColumn("main_object", F.when(short, free_text(F.col(text))).otherwise(F.col("_obj"))).withColumn("clean_query", F.col("main_object")).withColumn("action", free_text(F.array_join("_first", " ")))
    side = F.concat(F.array("_right"), F.slice("_segs", 2, F.greatest(F.size("_segs"), F.lit(1))), F.col("_later"))
    d = d.withColumn("side_terms", F.slice(F.array_distinct(F.filter(F.transform(side, free_text), lambda s: (s != "") & (s != F.col("main_object")))), 1, 4))
    every = free_text(F.concat_ws(" ", text, "action", F.array_join("side_terms", " ")))
    g, s, w = _hits(every, GOODS), _hits(every, SERVICES), _hits(every, WORKS)
    d = d.withColumn("kind", F.when((w > g) & (w >= s), "works").when(s > g, "services").otherwise("goods")).withColumn("has_service", s > 0)
    dom = F.lit("")
    for name, pattern in reversed(DOMAINS.items()):
        dom = F.when(every.rlike(pattern), name).otherwise(dom)
    skip = CONTRACT.split("|") + STOP.split("|")
    nouns = F.slice(F.array_distinct(F.filter(F.split(free_text(F.concat_ws(" ", "main_object", F.array_join("side_terms", " "))), " "), lambda x: (F.length(x) > 2) & ~x.isin(*skip))), 1, 8)
    table = F.create_map(*[F.lit(x) for kv in GLOSSARY.items() for x in kv])
    english = lambda c: F.array_join(F.transform(F.split(free_text(c), " "), lambda x: F.coalesce(F.try_element_at(table, x), x)), " ")
    d = d.withColumn("domain", dom).withColumn("nouns", F.array_join(nouns, " ")).withColumn("translated", english(F.col(text)))
    texts = {"object": F.col("main_object"), "object_english": english(F.col("main_object")), "full": free_text(F.col(text)), "nouns": F.col("nouns"), "object_action": F.trim(F.concat_ws(" ", "main_object", "action")), "domain": F.col("domain")}
    ch = F.array(*[F.struct(F.lit(n).alias("name"), texts[n].alias("query"), F.lit(w).alias("weight")) for n, w in CHANNELS.items()])
    return d.withColumn("channels", F.filter(ch, lambda x: x["query"] != "")).drop("_low", "_acts", "_first", "_later", "_bare", "_segs", "_left", "_right", "_obj")


def category(kind: Column) -> Column:
    """goods, services or works of a stored kind of purchase; null where none can be told."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(k.rlike("goods|equipment|supply"), "goods").when(k.rlike("work|construction|installation"), "works").when(k.rlike("service"), "services")


def kind_bias(wanted: Column, has_service: Column, kind: Column) -> Column:
    """.12 for the wanted kind, less for another: goods against services most, softened for goods with a service part."""
    c = category(kind)
    clash = lambda a, b: ((wanted == a) & (c == b)) | ((wanted == b) & (c == a))
    return F.when(c.isNull() | wanted.isNull(), 0.0).when(c == wanted, 0.12).when(has_service & (c == "services") & (wanted == "goods"), -0.08).when(clash("goods", "services"), -0.14).when(clash("goods", "works"), -0.10).otherwise(-0.08)


def keywords(*parts: Column) -> Column:
    """The first eight different words of three letters and more."""
    w = F.regexp_extract_all(F.lower(F.concat_ws(" ", *parts)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(w, lambda x: (F.length(x) > 2) & ~x.isin(*STOP.split("|")))), 1, 8)


def code_profiles(catalogue: DataFrame, languages: list[str], examples: DataFrame) -> DataFrame:
    """(code, label, parent_code, parent_label, keywords, aliases, children, siblings, kind, use_when, search_text): one denormalised row a code; lists of children and siblings hold the first eight in code order."""
    c = catalogue.select("code", F.coalesce("en", F.lit("")).alias("label"), F.array_compact(F.array(*[x for x in languages if x != "en"])).alias("aliases"), cpv.inferred_parent(F.col("code")).alias("parent_code"))
    place = F.row_number().over(Window.partitionBy("parent_code").orderBy("code"))
    nine = c.where("parent_code is not null").withColumn("r", place).where("r <= 9")
    kids = nine.where("r <= 8").groupBy(F.col("parent_code").alias("code")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("children"))
    sibs = nine.groupBy("parent_code").agg(F.array_sort(F.collect_list(F.struct("r", "code", "label"))).alias("all"))
    up = c.select(F.col("code").alias("parent_code"), F.col("label").alias("parent_label"))
    ex = examples.groupBy("cpv_code").agg(F.min_by("example_text", "example_id").alias("example")).withColumnRenamed("cpv_code", "code")
    d = c.join(up, "parent_code", "left").join(kids, "code", "left").join(sibs, "parent_code", "left").join(ex, "code", "left")
    sib = F.transform(F.slice(F.filter("all", lambda x: x["code"] != F.col("code")), 1, 8), lambda x: x["label"])
    kind = F.when(F.lower("label").rlike("construction|road works|installation"), "works").when(F.lower("label").rlike("service|maintenance|repair|cleaning"), "services").otherwise("goods")
    d = d.withColumn("kind", kind).withColumn("keywords", keywords(F.col("label"), F.coalesce("example", F.lit(""))))
    use = F.concat(F.lit("Use for "), F.col("kind"), F.lit(": "), F.lower("label"))
    text = F.concat_ws(" ", "label", F.array_join("keywords", " "), F.array_join("aliases", " "), "parent_label", "example")
    return d.select("code", "label", "parent_code", "parent_label", F.array_join("keywords", " ").alias("keywords"), F.array_join("aliases", " | ").alias("aliases"), F.array_join("children", " | ").alias("children"), F.array_join(sib, " | ").alias("siblings"), "kind", use.alias("use_when"), text.alias("search_text"))
