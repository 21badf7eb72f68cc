"""Knowledge graph of documents: entities and relations from text and structure, quality, graph-augmented retrieval, evaluation.

Chunks are (chunk_id, doc_id, program, section_id, title, text). Entities and relations are two tables; everything that
walks the graph is a join, many questions at once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rillway.functions.matching import name_form, stable_id, subset
from rillway.operators.components import connected_components
from rillway.operators.sections import sentences, strip
from rillway.session import Scratch, read_shared, shared_object

_MONTH = r"[A-Za-zÄÖÜäöüß]+"
#: Forms of entities in regulations, by type.
PATTERNS = {
    "Section": (r"§\s*\d+[a-zA-Z]?(?:\s*Abs\.\s*\d+)?", 0),
    "Deadline": (rf"\b(?:\d{{1,2}}\.\s*{_MONTH}\s*\d{{4}}|\d{{1,2}}\.\s*\d{{1,2}}\.\s*\d{{4}}|(?:binnen|innerhalb|spätestens|bis zu|nach Ablauf von)\s+(?:eines?|einer|zwei|drei|vier|fünf|sechs|sieben|acht|neun|zehn|\d+)\s+(?:Wochen?|Monaten?|Jahren?|Semestern?))\b", re.I),
    "Semester": (r"\b(?:Wintersemester|Sommersemester)\s*\d{4}(?:/\d{4})?|\b(?:ein|zwei|drei|vier|fünf|sechs|\d+)\s+Semester\b|\b(?:dritten|fünften)\s+Semester\b", re.I),
    "Requirement": (r"\b(?:\d+(?:[.,]\d+)?\s*(?:ECTS|LP|Leistungspunkte?)|(?:Englisch\s*)?(?:Level\s*)?B2|DSH\s*(?:Stufe\s*)?-?\s*\d|Note\s*[„\"]?gut[“\"]?\s*\(?\s*\d[,.]\d\s*\)?|mindestens\s+\d+(?:[.,]\d+)?\s*(?:ECTS|LP|Leistungspunkte?))\b", re.I),
    "Module": (r"\b(?:GP|P|MA|BA)-[A-Z0-9-]{2,}\b", 0),
    "Degree": (r"\b(?:Bachelor|Master)\s+of\s+(?:Arts|Science)|\b(?:B\.A\.|M\.A\.|M\.Sc\.)\b", re.I),
    "Language": (r"\b(?:Englisch|englischer Sprache|Deutsch|deutscher Sprache)\b", re.I),
    "Date": (rf"\b\d{{1,2}}\.\s*{_MONTH}\s*\d{{4}}\b", 0),
    "RepeatLimit": (r"\b(?:(?:jeweils\s+)?(?:einmal|zweimal|zwei\s+Mal|dreimal|drei\s+Mal|\d+\s*mal|\d+\s*Mal)\s+wiederholt\s+werden|Wiederholungsversuch(?:e|s)?|Prüfungsanspruch)\b", re.I),
}
#: Terms of entities, by type.
TERMS = {
    "ExamType": "Masterarbeit|Bachelorarbeit|Modulprüfung|Modulprüfungen|Kolloquium|mündliche Prüfung|Projektpräsentation|Prüfungsleistung|Abschlussarbeit|Masterprüfung|Zulassung zur Masterarbeit|Zulassung|Zulassungsvoraussetzungen|Zugangsvoraussetzungen|Sprachnachweis|Auflagen|Auswahlverfahren",
    "GovernanceBody": "Prüfungsausschuss|Zulassungskommission|Fakultätsrat|Studierenden- und Prüfungsservice|Präsidium",
    "Document": "Prüfungsordnung|Masterprüfungsordnung|Bachelorprüfungsordnung|Änderungsordnung|Auslaufordnung|Modulhandbuch|Studienverlaufsplan|Anlage 1",
    "Module": "Virtualisierung und Dienstarchitekturen|Guided Project|Team Supervision|MA Thesis|Reflection & Community|Advanced Game Development|Game Arts|Game Design|Game Programming",
    "StudyTrack": "ITM|BIS|SAR|DIS",
    "Concept": "Regelstudienzeit|Studium|Masterstudium|Studienumfang|Gesamtstudienumfang|Studienjahr|Leistungspunkt|ECTS-Punkt|Praxiszeit|Berufspraxis|praktische Tätigkeit|Mobilitätsfenster|Eignungsfeststellungsprüfung|Verfahren|Hausaufgaben|Wiederholung|Prüfungsanspruch|Änderungssatzung|Gesamtnote|Abschlussgrad|akademische Grad|Hochschulgrad|Aufnahme des Studiums|Zugang zum Masterstudium|Bachelorabschluss|Campus Gummersbach|Campus Südstadt|Lehrveranstaltungen|Bewerber|Module|Studienrichtungen|fachliche Leistung|zusätzliche Leistungen",
}
#: Words in a sentence that stand for a predicate.
KEYWORDS = {
    "requires": "voraussetz|erforderlich|beizufügen|nachzuweisen|muss|müssen|setzt voraus|required", "offered_in": "angeboten|lehrangebot|prüfungsangebot|semester", "has_deadline": "frist|fristgemäß|binnen|innerhalb|spätestens|bis zu",
    "allows": "kann|können|darf|dürfen|zulässig|zugelassen|gestrichen", "depends_on": "gemäß|nach §|entsprechende anwendung|abhängig|verweis", "has_ects": "ects|leistungspunkte|lp", "regulates": "regelt|geregelt|bestimmt",
    "awards": "verliehen|hochschulgrad|akademische grad|abschlussgrad", "has_language": "sprache|englisch|deutsch|englischer sprache", "has_duration": "regelstudienzeit|semester|dauer", "has_part": "besteht|teilen|teil", "has_goal": "ziel|befähigen|erwerb",
    "has_abbreviation": "abgekürzt|abkürzung", "has_property": "berufsqualifizierend|erfolgreich", "has_legal_status": "prüfungsanspruch|erlischt|verliert|besteht", "contains": "§|abschnitt|anlage|teil", "part_of": "§|abschnitt|anlage|teil",
    "applies_to": "studiengang|prüfungsordnung|ordnung", "amends": "änderung|änderungssatzung|geändert", "replaces": "auslauf|außer kraft|ersetzt|alte prüfungsordnung",
}
#: Words of a question that ask for a predicate.
CUES = {
    "requires": "voraussetz|erforderlich|nachweis|muss|müssen", "has_requirement": "voraussetz|erforderlich|nachweis|muss|müssen", "allows": "kann|können|darf|dürfen|zulässig|berechtigt|angeboten", "offers": "angeboten|gibt|angebot", "offered_in": "semester|angeboten",
    "has_deadline": "frist|binnen|innerhalb|spätestens|bis|wirkung", "has_duration": "semester|dauer|regelstudienzeit|monat", "has_ects": "ects|leistungspunkte|lp", "has_workload": "arbeitsaufwand|stunden", "has_language": "sprache|englisch|deutsch",
    "has_degree": "hochschulgrad|akademische|verliehen|abschlussgrad", "awards": "hochschulgrad|akademische|verliehen|abschlussgrad", "has_part": "besteht|teil|teilen", "has_goal": "ziel|befähigen|erwerb|vermitteln", "depends_on": "gemäß|gewichtung|nach", "stands_in": "§",
    "has_abbreviation": "abgekürzt", "has_property": "berufsqualifizierend|erfolgreich", "has_legal_status": "prüfungsanspruch|erlischt|verliert|besteht", "contains": "§|abschnitt|anlage|teil", "part_of": "§|abschnitt|anlage|teil", "applies_to": "studiengang|ordnung|prüfungsordnung",
    "amends": "änderung|änderungssatzung|geändert", "replaces": "auslauf|außer kraft|ersetzt|alte prüfungsordnung",
}
#: Groups of words that show what a question is after.
INTENTS = {
    "allows": "wiederhol|einmal|zweimal|prüfungsanspruch|versuch", "has_legal_status": "prüfungsanspruch|erlischt|verliert|besteht", "requires": "zulassung|voraussetzung|nachweis|bewerb|zugang", "has_requirement": "zulassung|voraussetzung|nachweis|bewerb|zugang",
    "awards": "abschlussgrad|grad|verliehen|master of|bachelor of", "has_deadline": "frist|spätestens|binnen|innerhalb|bis wann", "has_duration": "regelstudienzeit|dauer|semester", "has_ects": "ects|leistungspunkt|lp|umfang", "has_language": "sprache|englisch|deutsch|b2",
    "offered_in": "angebot|semester|wann", "amends": "änderung|geändert|fassung", "replaces": "auslauf|alte prüfungsordnung|außer kraft",
}
#: How much of a score goes on along a predicate, and along any other.
WEIGHTS = {
    "requires": 1.0, "has_requirement": 1.0, "has_deadline": 0.95, "has_duration": 0.95, "has_ects": 0.95, "has_language": 0.90, "awards": 0.90, "allows": 0.88, "has_legal_status": 0.88, "offered_in": 0.86, "contains": 0.82, "part_of": 0.82, "applies_to": 0.80, "amends": 0.78, "replaces": 0.78, "stands_in": 0.70,
}
OTHER_WEIGHT = 0.68
#: Settings of the profiles: algorithm, added chunks, least quality, rounds, damping, weight of intent.
PROFILES = {
    "safe_branch": ("direct", 1, 0.80, 2, 0.60, 0.0), "conservative": ("direct", 1, 0.75, 2, 0.62, 0.0), "balanced": ("ppr_direct", 2, 0.50, 4, 0.72, 0.0), "selection": ("ppr_direct", 2, 0.50, 4, 0.72, 0.0), "exploratory": ("ppr_direct", 4, 0.25, 6, 0.82, 0.20), "ppr_only": ("ppr", 2, 0.50, 5, 0.78, 0.0), "direct_only": ("direct", 2, 0.50, 0, 0.0, 0.0),
}
#: Predicates that may stand for one of a gold triple, and predicates of mere structure.
ALIASES = {
    "steht_in": "stands_in depends_on regulates", "details_in": "stands_in depends_on", "requires": "requires has_ects", "setzt_voraus": "requires depends_on", "frist": "has_deadline", "maximaler_umfang": "has_ects requires", "hat": "has_ects requires", "ist_pflichtmodul_in": "requires regulates", "beträgt": "has_ects offered_in has_deadline", "regelt": "regulates stands_in", "stehen_in": "stands_in depends_on",
    "has_degree": "awards", "has_duration": "has_duration offered_in has_deadline", "has_workload": "has_ects", "has_abbreviation": "has_abbreviation awards", "has_property": "has_property allows awards", "has_requirement": "requires", "offers": "offered_in allows",
}
GENERIC = ("contains", "part_of", "applies_to", "stands_in")
PREAMBLE_WORDS = "preamble|präambel|inkraft|in kraft|änderung|aenderung|auslauf|veröffentlicht|verkuendet|verkündet|datum"
ENTITY = "chunk_id string, sentence_id string, sentence string, name string, entity_type string, start_char int, end_char int"
#: What a text must hold, in plain form, if a form of an entity is in it; forms that aren't here are looked for in every text.
NEEDED = {"Section": "§", "Semester": "semester", "Requirement": "ects|lp|leistungspunkt|b2|dsh|note", "Module": "-", "Degree": "of|.a.|m.sc.", "Language": "englisch|deutsch", "RepeatLimit": "wiederhol|prüfungsanspruch"}
_WITH_ECTS = re.compile(r"([A-ZÄÖÜ][A-Za-zÄÖÜäöüß&/ -]{4,80}?)\s*\((\d+(?:[.,]\d+)?\s*(?:ECTS|LP|Leistungspunkte?))", re.I)


def _lookup(table: dict, key: Column, default=None) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def contains(text: Column, phrase: Column) -> Column:
    """A normal form of a name is in that of a text as a phrase, or with all its words."""
    return (phrase != "") & (F.contains(text, phrase) | subset(F.split(phrase, " "), F.split(text, " ")))


def _plain(text: str) -> str:
    """A text such that re.IGNORECASE finds a phrase of _PLAIN letters in it just where this form has the phrase's form."""
    return text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s")


_PLAIN = re.compile(r"[a-zA-Z0-9ÄÖÜäöüß &.,/-]+")


@lru_cache(4096)
def _any_of(terms: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, terms)), re.I)


def finder(extra: dict[str, list[str]] | None = None, lean: bool = False):
    """What mentions() does with batches of sentences."""
    forms = [(t, re.compile(p, f), NEEDED.get(t, "").split("|")) for t, (p, f) in PATTERNS.items()]
    terms = {**{t: x.split("|") for t, x in TERMS.items()}}
    for t, more in (extra or {}).items():
        terms[t] = terms.get(t, []) + [x.strip() for x in more if len(x.strip()) >= 3]
    seek = lambda ts: [(a, _plain(a) if _PLAIN.fullmatch(a) else "") for a in ts]
    listed = [(t, seek(sorted(ts, key=lambda x: (-len(re.escape(x)), re.escape(x))))) for t, ts in terms.items()]
    shorter = [(t, seek([a for a in ts if any(a.lower() in b.lower() and a != b for b in ts)])) for t, ts in terms.items()]

    def search(s):
        """(text, type, start, end) of what is in a sentence, whatever its section."""
        low = _plain(s)
        # only what can be there is looked for: trying all terms at every letter took most of the time
        ps = [(t, p) for t, p, need in forms if any(x in low for x in need)]
        ps += [(t, _any_of(here)) for t, ts in listed if (here := tuple([a for a, x in ts if x in low]))]
        ps += [(t, _any_of((a,))) for t, ts in shorter for a, x in ts if x in low]
        got = [(m[0], kind, m.start(), m.end()) for kind, p in ps for m in p.finditer(s)]
        for m in _WITH_ECTS.finditer(s) if "(" in s else ():
            got += [(m[1], "Module", m.start(1), m.end(1)), (m[2], "Requirement", m.start(2), m.end(2))]
        return got

    def find(batches):
        searched = lru_cache(1 << 15)(search)  # sentences repeat
        for b in batches:
            rows, met = [], set()
            for cid, sec, sid, s, at in zip(b["chunk_id"], b["section_id"], b["sentence_id"], b["sentence"], b["at"]):
                seen, before = set(), len(rows)
                for name, kind, i, j in [(sec, "Section", 0, 0)] * bool(sec) + searched(s):
                    name = re.sub(r"\s+", " ", name).strip(" ,.;:()[]")
                    if len(name) >= 2 and (name.casefold(), kind, i, j) not in seen:
                        seen.add((name.casefold(), kind, i, j))
                        rows.append((cid, sid, s, name, kind, at + i, at + j))
                if lean and all(x[4] == "Section" for x in rows[before:]):
                    rows[before:] = [x for x in rows[before:] if (cid, x[3]) not in met and not met.add((cid, x[3]))]
            yield pd.DataFrame(rows, columns=["chunk_id", "sentence_id", "sentence", "name", "entity_type", "start_char", "end_char"])

    return find


def mentions(chunks: DataFrame, extra: dict[str, list[str]] | None = None, lean: bool = False) -> DataFrame:
    """Entities of the chunks' sentences with their places in the chunk: the section, forms, terms, and modules with their points.

    extra holds further terms by type, such as those of gold triples; terms of less than three letters are passed over.
    lean: of sentences with sections alone, from which no relation starts, each section of a chunk is given once or a few times, not for
    every sentence; relations() and augmented_retrieval() give the same with these.
    """
    sents = chunks.select("chunk_id", "section_id", F.posexplode(sentences(F.col("text"))).alias("no", "s")).select("chunk_id", "section_id", F.concat_ws("|", "chunk_id", F.concat(F.lit("s"), "no")).alias("sentence_id"), F.col("s.text").alias("sentence"), F.col("s.start").alias("at"))
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return sents.mapInPandas(finder(extra, lean), ENTITY.replace("chunk_id string", f"chunk_id {kind}"))


def entities(chunks: DataFrame, extra: dict[str, list[str]] | None = None, lean: bool = False) -> DataFrame:
    """Mentions with identifiers, normal names and the number of words before them."""
    m = mentions(chunks, extra, lean).join(chunks.select("chunk_id", "doc_id", "program", "section_id", F.col("text").alias("_text")), "chunk_id")
    before = F.size(F.filter(F.split(F.substr("_text", F.lit(1), F.col("start_char")), r"\s+"), lambda w: w != ""))
    norm = name_form(F.col("name"))
    return m.select("chunk_id", "sentence_id", "sentence", "name", "entity_type", norm.alias("norm"), "start_char", "end_char", before.alias("start_word"), stable_id(F.col("chunk_id").cast("string"), F.col("sentence_id"), F.col("entity_type"), norm, F.col("start_char").cast("string")).alias("entity_id"), "doc_id", "program", "section_id")


def structure(chunks: DataFrame) -> DataFrame:
    """Relations that the place of a chunk gives: document, program, section and title."""
    c = chunks.select("chunk_id", *[F.coalesce(strip(F.regexp_replace(F.col(x), r"\s+", " ")), F.lit("")).alias(x) for x in ("doc_id", "program", "section_id", "title")])
    low = name_form(F.col("doc_id"))
    rel = lambda cond, s, st, p, o, ot: F.when(cond & (F.col(s) != "") & (F.col(o) != ""), F.struct(F.col(s).alias("subject"), F.lit(st).alias("subject_type"), F.lit(p).alias("predicate"), F.col(o).alias("object"), F.lit(ot).alias("object_type")))
    yes = F.lit(True)
    rows = [
        rel(yes, "doc_id", "Document", "applies_to", "program", "Program"), rel(yes, "doc_id", "Document", "contains", "section_id", "Section"), rel(yes, "section_id", "Section", "part_of", "doc_id", "Document"), rel(F.col("title") != F.col("section_id"), "section_id", "Section", "contains", "title", "SectionTitle"),
        rel(low.rlike("aenderung|änderung"), "doc_id", "Document", "amends", "program", "Program"), rel(low.contains("auslauf"), "doc_id", "Document", "replaces", "program", "Program"),
    ]
    return c.select("chunk_id", F.lit(None).cast("string").alias("sentence_id"), F.inline(F.array_compact(F.array(*rows))))


def predicates(sentence: Column, s_type: Column, o_type: Column) -> Column:
    """Predicates between two entities of a sentence, by words in it and by their types."""
    low = F.lower(sentence)
    by_word = [F.when(low.rlike(x), F.lit(p)) for p, x in KEYWORDS.items()]
    is_ = lambda t, *kinds: t.isin(*kinds)
    by_type = [
        F.when(is_(o_type, "Deadline", "Date"), F.lit("has_deadline")), F.when(o_type == "Semester", F.lit("offered_in")), F.when((o_type == "Semester") & ~low.rlike(KEYWORDS["offered_in"]), F.lit("has_duration")), F.when(o_type == "Language", F.lit("has_language")), F.when(o_type == "Degree", F.lit("awards")),
        F.when(o_type == "RepeatLimit", F.lit("allows")), F.when((s_type == "RepeatLimit") | low.contains("prüfungsanspruch"), F.lit("has_legal_status")), F.when(low.contains("verliehen") & ((s_type == "Degree") | (o_type == "Degree")), F.lit("awards")), F.when(low.rlike("wiederholt werden|wiederholungsversuch"), F.lit("allows")),
        F.when((o_type == "Requirement") & is_(s_type, "Module", "ExamType", "StudyTrack", "Document"), F.when(low.rlike(KEYWORDS["requires"]), F.lit("requires")).otherwise(F.lit("has_ects"))),
    ]
    return F.array_distinct(F.array_compact(F.array(*by_word, *by_type)))


def relations(ents: DataFrame) -> DataFrame:
    """Relations between different entities of a sentence: 'stands_in' to its section, else by predicates(); sections aren't subjects, requirements only of sections."""
    e = ents.select("chunk_id", "sentence_id", "sentence", "entity_id", "name", "entity_type", "norm")
    own = ents.where("entity_type <> 'Section' or name = section_id").select("entity_id").distinct()
    e = e.join(own, "entity_id", "left_semi")
    s = e.where("entity_type <> 'Section'").select("chunk_id", "sentence_id", "sentence", F.col("entity_id").alias("subject_id"), F.col("name").alias("subject"), F.col("entity_type").alias("subject_type"), F.col("norm").alias("subject_norm"))
    o = e.select("sentence_id", F.col("entity_id").alias("object_id"), F.col("name").alias("object"), F.col("entity_type").alias("object_type"), F.col("norm").alias("object_norm"))
    p = s.join(o, "sentence_id").where("subject_id <> object_id and (subject_type <> 'Requirement' or object_type = 'Section')")
    p = p.withColumn("predicate", F.explode(F.when(F.col("object_type") == "Section", F.array(F.lit("stands_in"))).otherwise(predicates(F.col("sentence"), F.col("subject_type"), F.col("object_type")))))
    rid = stable_id(F.col("chunk_id").cast("string"), F.col("sentence_id"), F.col("subject_norm"), F.col("predicate"), F.col("object_norm"))
    # once each, by identifier: the relation with the smallest ends
    return p.withColumn("relation_id", rid).groupBy("relation_id", "chunk_id", "sentence_id", "predicate", "subject_norm", "object_norm").agg(F.min(F.struct("subject_id", "object_id", "subject", "object", "subject_type", "object_type", F.col("sentence").alias("evidence"))).alias("x")).select("relation_id", "chunk_id", "sentence_id", "predicate", "subject_norm", "object_norm", "x.*")


def quality(ents: DataFrame, rels: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: grounding, degrees, isolated entities, components, entropy of predicates, duplicates, coverage and share of structural relations."""
    ids = ents.select("entity_id").distinct()
    ends = rels.select(F.col("subject_id").alias("entity_id")).unionByName(rels.select(F.col("object_id").alias("entity_id"))).where("entity_id is not null")
    degree = ids.join(ends.groupBy("entity_id").agg(F.count("*").alias("d")), "entity_id", "left").na.fill(0).agg(F.avg("d").alias("avg_degree"), F.avg((F.col("d") == 0).cast("int")).alias("isolated_rate"), F.count("*").alias("n"))
    comp = connected_components(rels.where("subject_id is not null"), "subject_id", "object_id")
    sizes = ids.join(comp.select(F.col("node").alias("entity_id"), "component"), "entity_id", "left").groupBy(F.coalesce("component", "entity_id").alias("c")).agg(F.count("*").alias("k")).agg(F.count("*").alias("components"), F.max("k").alias("largest"))
    by = rels.groupBy("predicate").agg(F.count("*").alias("k"))
    kinds = by.agg(F.sum("k").alias("n_relations"), F.sum(F.col("k") * F.log2("k")).alias("h"), F.sum(F.when(F.col("predicate").isin(*GENERIC), F.col("k")).otherwise(0)).alias("generic"))
    twice = ents.groupBy("norm").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") - 1).alias("dup"), F.sum("k").alias("n_mentions"))
    seen = ents.select("chunk_id").unionByName(rels.select("chunk_id")).distinct().agg(F.count("*").alias("seen"))
    total = chunks.agg(F.count_distinct("chunk_id").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"))
    docs = ents.agg(F.count_distinct("doc_id").alias("docs"))
    d = degree
    for one in (sizes, kinds, twice, seen, total, docs):  # aggregates of one row each
        d = d.join(F.broadcast(one), F.lit(True))
    r = lambda c: F.round(c, 6)
    return d.select(
        "n_mentions", "n_relations", r(F.col("avg_degree")).alias("avg_degree"), r(F.col("isolated_rate")).alias("isolated_rate"), "components", r(F.col("largest") / F.col("n")).alias("largest_ratio"), r(F.log2("n_relations") - F.col("h") / F.col("n_relations")).alias("predicate_entropy"),
        r(F.col("dup") / F.col("n_mentions")).alias("duplicate_rate"), r(F.col("docs") / F.col("n_docs")).alias("doc_coverage"), r(F.col("seen") / F.col("n_chunks")).alias("chunk_coverage"), r(F.col("generic") / F.col("n_relations")).alias("generic_share"),
    )


def chunk_quality(question: Column, where: Column, section: Column) -> Column:
    """.25 for a chunk of another year than the question names, times .2 for a preamble that isn't asked for."""
    years = F.regexp_extract_all(question, F.lit(r"\b20\d{2}\b"), F.lit(0))
    wrong = (F.size(years) > 0) & ~F.exists(years, lambda y: F.contains(where, y))
    return F.when(wrong, 0.25).otherwise(1.0) * F.when((F.lower(section) == "preamble") & ~F.lower(question).rlike(PREAMBLE_WORDS), 0.2).otherwise(1.0)


def intent_score(question: Column, predicate: Column, subject: Column, obj: Column, evidence: Column) -> Column:
    """How well a relation answers a question (normal forms): cue words .18 each up to .55, subject and object .16 each, a word of the predicate's group in question or relation .28; at most 1."""
    cues = F.split(_lookup(CUES, predicate, "\x01"), r"\|")
    hits = F.size(F.filter(cues, lambda c: contains(question, c)))
    text = F.concat_ws(" ", subject, predicate, obj, evidence)
    group = F.split(_lookup(INTENTS, predicate, "\x01"), r"\|")
    s = F.least(F.lit(0.55), hits * 0.18) + F.when(contains(question, subject), 0.16).otherwise(0.0) + F.when(contains(question, obj), 0.16).otherwise(0.0)
    return F.least(F.lit(1.0), s + F.when(F.exists(group, lambda c: F.contains(question, c) | F.contains(text, c)), 0.28).otherwise(0.0))


def faithfulness(predicate: Column, subject: Column, obj: Column, evidence: Column) -> Column:
    """Share of subject, object and a cue of the predicate that the evidence has; 0 without evidence."""
    cues = F.split(_lookup(CUES, predicate, "\x01"), r"\|")
    n = contains(evidence, subject).cast("int") + contains(evidence, obj).cast("int") + F.exists(cues, lambda c: contains(evidence, c)).cast("int")
    return F.when(F.coalesce(evidence, F.lit("")) == "", 0.0).otherwise(n / 3)


def _years_in(text: str) -> str:
    return " ".join(sorted(set(re.findall(r"(?=(20\d{2}))", text))))


def _ranges(start, stop):
    """Numbers from each start to before its stop, one range after another."""
    import numpy as np

    n = stop - start
    return np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def _up(x):
    import numpy as np

    return np.floor(x * 1e6 + 0.5) / 1e6


class _Index:
    """Relations, names and chunks of a graph as arrays; relations that differ by chunks alone are one kind with a count, as all scores of a kind are alike.

    A class are chunks of like quality for every question; an item is a kind, or a name in a class, and each has its chunks in order.
    Read by each Python worker from the tables that the executors share; nothing of it goes through the driver.
    """

    def __init__(self, relations_at: str, names_at: str, chunks_at: str):
        import numpy as np

        c, r, n = read_shared(chunks_at).sort_values("chunk_id", ignore_index=True), read_shared(relations_at), read_shared(names_at)
        self.chunk_ids, at = c["chunk_id"].to_numpy(), pd.Index(c["chunk_id"])
        kind, classes = pd.factorize(pd.Series(list(zip(c["place"].map(_years_in), c["preamble"]))), sort=False)
        self.chunk_class, self.classes = kind, list(classes)
        r["chunk"], n["chunk"] = at.get_indexer(r["chunk_id"]), at.get_indexer(n["chunk_id"])
        r, n = r[r["chunk"] >= 0], n[n["chunk"] >= 0]
        codes, names = pd.factorize(pd.concat([r["subject_norm"], r["object_norm"], n["norm"]], ignore_index=True))
        self.names, self.name_at = list(names), {x: i for i, x in enumerate(names)}
        self.several = [(i, set(x.split(" "))) for i, x in enumerate(names) if " " in x]
        self.heads: dict[str, list] = {}
        for i, x in enumerate(names):
            if x != "":
                self.heads.setdefault(x[:3], []).append((i, x))
        pred, self.predicates = pd.factorize(r["predicate"])
        s, o = codes[: len(r)], codes[len(r) : 2 * len(r)]
        one = pd.DataFrame({"a": np.r_[s, o], "b": np.r_[o, s], "s": np.r_[s, s], "o": np.r_[o, o], "p": np.r_[pred, pred], "r": np.tile(r["stated"].to_numpy(), 2), "c": np.tile(kind[r["chunk"]], 2), "chunk": np.tile(r["chunk"].to_numpy(), 2)})
        by = ["a", "b", "s", "o", "p", "r", "c"]
        k = one.groupby(by, sort=True).size().rename("n").reset_index()
        one = one.merge(k.reset_index(names="item")[[*by, "item"]], on=by)[["chunk", "item"]].drop_duplicates()
        for x in (*by, "n"):
            setattr(self, "k_" + x, k[x].to_numpy())
        alike = ~k[by[:-1]].duplicated().to_numpy()  # kinds in order: the first of those that differ by class alone
        m = pd.DataFrame({"chunk": n["chunk"].to_numpy(), "name": codes[2 * len(r) :]}).drop_duplicates()
        m["c"] = kind[m["chunk"]]
        u = m[["name", "c"]].drop_duplicates().sort_values(["name", "c"], ignore_index=True)
        m = m.merge(u.reset_index(names="item"), on=["name", "c"])[["chunk", "item"]]
        self.base = np.r_[np.cumsum(alike) - 1, alike.sum() + u["name"].to_numpy()].astype(np.int64)
        self.n_bases, self.item_class = int(alike.sum()), np.r_[self.k_c, u["c"].to_numpy()].astype(np.int64)
        chunk, item = np.r_[one["chunk"].to_numpy(), m["chunk"].to_numpy()].astype(np.int64), np.r_[one["item"].to_numpy(), m["item"].to_numpy() + len(k)].astype(np.int64)
        order = np.lexsort((item, chunk))
        self.items_of, self.at_chunk = item[order], np.searchsorted(chunk[order], np.arange(len(c) + 1))
        order = np.lexsort((chunk, item))
        self.chunks_of, self.at_item = chunk[order], np.searchsorted(item[order], np.arange(len(self.base) + 1))
        self.views: dict[bytes, _View] = {}

    def view(self, quality) -> _View:
        """The items for a quality of each class; some of the last views are kept."""
        key = quality.tobytes()
        v = self.views.pop(key, None) or _View(self, quality)
        self.views[key] = v
        if len(self.views) > 16:
            del self.views[next(iter(self.views))]
        return v

    def quality(self, question: str):
        """chunk_quality() of each class of chunks."""
        import numpy as np

        years = set(re.findall(r"\b20\d{2}\b", question, re.A))
        asked = re.search(PREAMBLE_WORDS, question.lower())
        return np.array([(0.25 if years and not years & set(ys.split()) else 1.0) * (0.2 if pre and not asked else 1.0) for ys, pre in self.classes])

    def known(self, question: str):
        """Of each name whether contains() has it in the question."""
        import numpy as np

        words, known = set(question.split(" ")), np.zeros(len(self.names), dtype=bool)
        for n in (1, 2, 3):
            for j in range(len(question) - n + 1):
                for i, x in self.heads.get(question[j : j + n], ()):
                    if question.startswith(x, j):
                        known[i] = True
        for i, ws in self.several:
            known[i] |= ws <= words
        return known


class _View:
    """Items of an index of which those that differ only by classes of one quality are one, as their scores are alike too."""

    def __init__(self, ix: _Index, quality):
        import numpy as np

        values, level = np.unique(quality, return_inverse=True)
        u, first, self.item = np.unique(ix.base * len(values) + level[ix.item_class], return_index=True, return_inverse=True)
        kinds = int(np.searchsorted(u, ix.n_bases * len(values)))
        for x in "absopr":
            setattr(self, x, getattr(ix, "k_" + x)[first[:kinds]])
        self.n, self.number = np.bincount(self.item[: len(ix.k_n)], ix.k_n, kinds), 8 * self.p + 4 * self.r
        self.quality, self.name, self.chunk_quality = values[u % max(1, len(values))] if len(u) else np.zeros(0), u[kinds:] // max(1, len(values)) - ix.n_bases, quality[ix.chunk_class]
        self.at_a = np.searchsorted(self.a, np.arange(len(ix.names) + 1))
        self.strong = np.flatnonzero(self.quality[:kinds] >= 0.5)
        self.parts, self.at_part = np.argsort(self.item, kind="stable"), np.r_[0, np.cumsum(np.bincount(self.item, minlength=len(u)))]
        self.size = np.bincount(self.item, np.diff(ix.at_item), len(u)).astype(np.int64)

    def parts_of(self, items):
        return self.parts[_ranges(self.at_part[items], self.at_part[items + 1])]

    def answered(self, question: str, known, predicates):
        """Of each kind a number; by these numbers intent_score(), whether the question has a cue of the predicate, and the predicate."""
        import numpy as np

        words = set(question.split(" "))
        has = lambda x: x != "" and (x in question or words.issuperset(x.split(" ")))
        hits = np.array([sum(map(has, CUES.get(p, "\x01").split("|"))) for p in predicates], dtype=int)
        group = np.array([any(x in question for x in INTENTS.get(p, "\x01").split("|")) for p in predicates], dtype=bool)
        p, stated, s, o = (x.ravel() for x in np.indices((len(predicates), 2, 2, 2)))
        intent = np.minimum(0.55, hits * 0.18)[p] + np.where(s, 0.16, 0.0) + np.where(o, 0.16, 0.0)
        return self.number + 2 * known[self.s] + known[self.o], np.minimum(1.0, intent + np.where(group[p] | (stated > 0), 0.28, 0.0)), (hits > 0)[p], p


def _spread_scores(ix: _Index, view: _View, qn: str, seeds: dict, algorithm: str, rounds: int, damping: float):
    """(value, intent) of each item of the view, value -inf where the graph doesn't lead, and the intents there are; None if it leads nowhere."""
    import numpy as np

    n = len(ix.names)
    seed = np.full(n, np.nan)  # nan: not in the front
    for x, v in seeds.items():
        if x in ix.name_at:
            seed[ix.name_at[x]] = v
    if np.isnan(seed).all():
        return None
    number, intents, cued, p = view.answered(qn, ix.known(qn), ix.predicates)
    k_quality, intent = view.quality[: len(view.a)], intents[number]
    weight = lambda other: np.array([WEIGHTS.get(x, other) for x in ix.predicates])[p]
    best = np.full(len(view.a), -np.inf)  # of each kind
    active = seed
    if algorithm != "direct" and rounds:
        start, k = seed / sum(seeds.values()), view.strong
        a, b, count = view.a[k], view.b[k], view.n[k]
        w = (weight(OTHER_WEIGHT) * (1 + 0.12 * intents))[number[k]] * k_quality[k]
        share = damping * w / np.bincount(a, w * count, n)[a]
        now, passed, met, front = start, share * count, None, None
        top = np.full(n, np.nan)  # the most that a name passes on in any round
        for _ in range(rounds):
            top, was, front = np.fmax(top, now), front, ~np.isnan(now)
            if was is None or (was != front).any():
                met = np.bincount(b, front[a], n) > 0
            flow = np.bincount(b, np.nan_to_num(now)[a] * passed, n)
            now = np.where(met | ~np.isnan(start), (1 - damping) * np.nan_to_num(start) + flow, np.nan)
        best[k] = np.fmax(best[k], top[a] * share)
        active = np.fmax(active, now)
    if algorithm != "ppr":
        front, w1, more = seed, weight(0.72), np.where(cued, 0.12, 0.0)
        for depth in (1, 2):
            at = np.flatnonzero(~np.isnan(front))
            k = _ranges(view.at_a[at], view.at_a[at + 1])  # the kinds that start at the front
            c = (front[view.a[k]] * 0.55**depth * w1[number[k]] + more[number[k]]) * k_quality[k]
            best[k] = np.maximum(best[k], c)
            top = np.full(n, -np.inf)
            np.maximum.at(top, view.b[k], c)
            front = np.where(np.isfinite(top) & (np.isnan(active) | (top > active)), top, np.nan)
            active = np.fmax(active, front)
    best = np.fmax(best, (active[view.a] + np.where(cued, 0.15, 0.0)[number]) * k_quality)
    lone = active[view.name] * 0.7 * view.quality[len(view.a) :]
    return np.r_[best, np.where(np.isnan(lone), -np.inf, lone)], np.r_[intent, np.zeros(len(lone))], np.unique(np.r_[0.0, intents])


class _Scored:
    """Scores of chunks for one question from those of the items: a chunk has the best value and the best intent of its items, both scaled by their maxima."""

    def __init__(self, ix: _Index, view: _View, items, graph_weight: float, by_intent: float):
        self.ix, self.view, self.graph_weight, self.by_intent = ix, view, graph_weight, by_intent
        self.value, self.intent, self.intents = items
        self.found = self.value > float("-inf")
        self.high = [x[self.found].max() if self.found.any() else 0 for x in (self.value, self.intent)]

    def scaled(self, x, which: int):
        return _up(x / self.high[which]) if self.high[which] > 0 else x * 0.0

    def score(self, base, graph, intent):
        return _up((1 - self.graph_weight) * base + self.graph_weight * ((1 - self.by_intent) * graph + self.by_intent * intent))

    def of(self, chunks):
        """(found, graph, intent) of the chunks."""
        import numpy as np

        at, to = self.ix.at_chunk[chunks], self.ix.at_chunk[chunks + 1]
        some, g = np.flatnonzero(to > at), np.full(len(chunks), -np.inf)
        i = g.copy()
        if len(some):
            x = self.view.item[self.ix.items_of[_ranges(at[some], to[some])]]
            cut = np.r_[0, np.cumsum(to[some] - at[some])[:-1]]
            g[some], i[some] = np.maximum.reduceat(self.value[x], cut), np.maximum.reduceat(np.where(self.found[x], self.intent[x], -np.inf), cut)
        found = np.isfinite(g)
        return found, self.scaled(np.where(found, g, 0.0), 0), self.scaled(np.where(found, i, 0.0), 1)

    def best(self, most: int, own, least: float, floor: float):
        """The most best chunks besides its own of at least that quality and graph score, in order of score and chunk; the same as if all chunks were scored.

        A few chunks of the best items set a bound. A chunk at or above it has an item whose value, with the best intent of all,
        reaches the bound, and one whose intent, with the best value, does; of equal chunks only those before the last one count.
        """
        import numpy as np

        ix, view = self.ix, self.view
        fit = self.found & (view.quality >= least)
        lead = np.flatnonzero(fit & (self.value >= (floor - 1e-5) * self.high[0]))
        graph = self.scaled(self.value[lead], 0)
        lead, graph = lead[graph >= floor], graph[graph >= floor]
        if not len(lead):
            return []

        def first(chunks):
            chunks = np.setdiff1d(chunks, own)
            chunks = chunks[view.chunk_quality[chunks] >= least]
            found, g, i = self.of(chunks)
            s, keep = self.score(0.0, g, i), found & (g >= floor)
            chunks, s, g, i = chunks[keep], s[keep], g[keep], i[keep]
            order = np.lexsort((chunks, -s))[:most]
            return list(zip(chunks[order], s[order], g[order], i[order]))

        alone, tried, got = self.score(0.0, graph, self.scaled(self.intent[lead], 1)), 16, []
        while len(got) < most:
            some = lead if tried >= len(lead) else lead[np.argpartition(-alone, tried - 1)[:tried]]
            at = view.parts_of(some)
            got = first(ix.chunks_of[_ranges(ix.at_item[at], np.minimum(ix.at_item[at] + most + len(own), ix.at_item[at + 1]))])
            if tried >= len(lead):
                break
            tried *= 8
        if len(got) < most:
            return got
        bound, last = got[-1][1], got[-1][0]
        by_value = self.score(0.0, graph, self.scaled(self.intent[fit].max(), 1))
        by_intent = self.score(0.0, graph.max(), self.scaled(self.intents, 1))
        least_intent = lambda x: self.intents[x].min() if x.any() else np.inf
        size = lambda x: int(view.size[x].sum())
        ways = [(lead[by_value >= bound], 0), (np.flatnonzero(fit & (self.intent >= least_intent(by_intent >= bound))), 0), (lead[by_value > bound], last), (np.flatnonzero(fit & (self.intent >= least_intent(by_intent > bound))), last)]
        more, before = min(ways, key=lambda w: size(w[0]) + w[1])
        at, seen = view.parts_of(more), np.zeros(len(ix.chunk_ids), dtype=bool)
        seen[ix.chunks_of[_ranges(ix.at_item[at], ix.at_item[at + 1])]] = True
        seen[:before] = True
        seen[[x[0] for x in got]] = True
        return first(np.flatnonzero(seen))


def augmented_retrieval(questions: DataFrame, retrieved: DataFrame, ents: DataFrame, rels: DataFrame, chunks: DataFrame, profile: str = "balanced", graph_weight: float = 0.35, k: int = 8, seeds: int = 20) -> DataFrame:
    """(qid, chunk_id, rank, score, base, graph, intent, source): the k retrieved chunks, then chunks that only the graph leads to.

    Seeds are entities named in the question (1) or in its retrieved chunks (.65), at most so many of a question in order of
    strength and name. Along relations, both ways, scores spread by restarted propagation, by two hops, or both, as the profile
    says; a chunk counts the best score of a relation or entity in it. Both sides are scaled by their maximum and mixed;
    added chunks must pass the profile's quality and a floor.

    Names as frequent as 'bis' lead from every question to most relations, so pairs of questions and relations aren't made rows:
    each question is worked out over the arrays of _Index, and only its result leaves the Python worker. Scores are spread over kinds
    of relations; only chunks that can be among the added ones get theirs.
    """
    algorithm, added, least, rounds, damping, by_intent = PROFILES[profile]
    scratch = Scratch(questions.sparkSession)
    q = questions.select("qid", name_form(F.col("question")).alias("qn"), F.col("question"))
    names = ents.where("entity_type <> 'Section' and length(norm) >= 3").groupBy("norm").agg(F.min("name").alias("name"))
    # entities named in a question: joined on each word of the name, verified as phrase or set of words
    firsts = names.select("norm", F.element_at(F.split("norm", " "), 1).alias("w"))
    in_q = q.select("qid", "qn", F.explode(F.array_distinct(F.split("qn", " "))).alias("w")).join(firsts, "w").where(contains(F.col("qn"), F.col("norm"))).select("qid", "norm", F.lit(1.0).alias("s"))
    in_r = retrieved.select("qid", "chunk_id").join(ents.where("entity_type <> 'Section' and length(norm) >= 3").select("chunk_id", "norm").distinct(), "chunk_id").select("qid", "norm", F.lit(0.65).alias("s"))
    seed = in_q.unionByName(in_r).groupBy("qid", "norm").agg(F.max("s").alias("s"))
    seed = seed.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "norm"))).where(f"r <= {seeds}").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("norm", "s"))).alias("seeds"))
    group = F.split(_lookup(INTENTS, F.col("predicate"), "\x01"), r"\|")
    text = F.concat_ws(" ", "subject_norm", "predicate", "object_norm", F.lower("evidence"))
    tables = (
        rels.where("subject_norm <> '' and object_norm <> ''").select("chunk_id", "predicate", "subject_norm", "object_norm", F.exists(group, lambda c: F.contains(text, c)).alias("stated")), ents.where("norm is not null").select("chunk_id", "norm").distinct(),
        chunks.select("chunk_id", F.concat_ws(" ", F.col("doc_id").cast("string"), "title", "section_id").alias("place"), F.coalesce(F.lower("section_id") == "preamble", F.lit(False)).alias("preamble")),
    )
    paths = tuple(scratch.path(scratch.cut(t)) for t in tables)
    base = retrieved.select("qid", F.struct("chunk_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank")).alias("x")).groupBy("qid").agg(F.array_sort(F.collect_list("x")).alias("base"))
    floor = max(least * 0.10, 0.08 if graph_weight <= 0.4 else 0.05)

    def work(batches):
        import numpy as np

        ix = shared_object(_Index, *paths)
        for batch in batches:
            rows, qualities = [], [ix.quality(x) for x in batch["question"]]
            for nth in sorted(range(len(batch)), key=lambda x: qualities[x].tobytes()):  # those with one view together
                qid, qn, seed, base = (batch[x].iat[nth] for x in ("qid", "qn", "seeds", "base"))
                view = ix.view(qualities[nth])
                items = _spread_scores(ix, view, qn, {x["norm"]: x["s"] for x in (seed if seed is not None else ())}, algorithm, rounds, damping)
                own = {x["chunk_id"]: x for x in (base if base is not None else ())}
                where = {c: j for c in own if (j := np.searchsorted(ix.chunk_ids, c)) < len(ix.chunk_ids) and ix.chunk_ids[j] == c}
                high = max([x["score"] for c, x in own.items() if c in where and x["score"] is not None], default=0)
                at = np.array(list(where.values()), dtype=np.int64)
                b = _up(np.array([(own[c]["score"] or 0.0) / high if high > 0 else 0.0 for c in where]))
                if items is None:
                    found, graph, intent, new = np.zeros(len(at), dtype=bool), np.zeros(len(at)), np.zeros(len(at)), []
                    score = _up((1 - graph_weight) * b)
                else:
                    x = _Scored(ix, view, items, graph_weight, by_intent)
                    found, graph, intent = x.of(at)
                    score, new = x.score(b, graph, intent), x.best(added, at, max(0.5, least), floor)
                first = sorted((n for n, c in enumerate(where) if own[c]["rank"] <= k), key=lambda n: (own[ix.chunk_ids[at[n]]]["rank"], -score[n], at[n]))
                out = [(at[n], score[n], b[n], graph[n], intent[n], "vector+graph" if found[n] else "vector") for n in first] + [(j, s, 0.0, g, i, "graph") for j, s, g, i in new]
                rows += [(qid, ix.chunk_ids[j], n, *x) for n, (j, *x) in enumerate(out, 1)]
            yield pd.DataFrame(rows, columns=["qid", "chunk_id", "rank", "score", "base", "graph", "intent", "source"])

    d = q.join(seed, "qid", "left").join(base, "qid", "left").where("seeds is not null or base is not null")
    kind = lambda t, c: t.schema[c].dataType.simpleString()
    d = d.repartition(4 * d.sparkSession.sparkContext.defaultParallelism, "qid")
    return d.mapInPandas(work, f"qid {kind(questions, 'qid')}, chunk_id {kind(chunks, 'chunk_id')}, rank int, score double, base double, graph double, intent double, source string")


def triple_hits(triples: DataFrame, context: DataFrame, rels: DataFrame | None = None) -> DataFrame:
    """Per question: shares of gold triples (qid, subject, predicate, object, evidence_doc, evidence_section, cues) whose document, section, subject, object and relation the context (qid, doc_id, section_id, text) has, and the first layer that lacks one.

    With rels (qid, subject, predicate, object, evidence) also the share that a relation states. Triples without subject, predicate or object don't count.
    """
    t = triples.where("trim(subject) <> '' and trim(predicate) <> '' and trim(object) <> ''").withColumn("sn", name_form(F.col("subject"))).withColumn("pn", F.replace(name_form(F.col("predicate")), F.lit(" "), F.lit("_"))).withColumn("on", name_form(F.col("object")))
    known = F.when(F.size("cues") > 0, F.transform("cues", name_form)).otherwise(F.split(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CUES.items() for x in kv]), F.col("pn")), name_form(F.col("predicate"))), r"\|"))
    t = t.withColumn("cs", known).withColumn("tid", F.monotonically_increasing_id())
    text = context.groupBy("qid").agg(name_form(F.array_join(F.array_sort(F.collect_list("text")), " ")).alias("x"), F.collect_set("doc_id").alias("docs"), F.collect_set(F.concat_ws("\x01", "doc_id", "section_id")).alias("secs"), F.collect_set("section_id").alias("ids"))
    d = t.join(text, "qid", "left").na.fill("", ["x"])
    d = d.withColumn("doc_hit", F.when(F.coalesce("evidence_doc", F.lit("")) != "", F.coalesce(F.array_contains("docs", F.col("evidence_doc")), F.lit(False))))
    sec = F.when(F.coalesce("evidence_doc", F.lit("")) == "", F.array_contains("ids", F.col("evidence_section"))).otherwise(F.array_contains("secs", F.concat_ws("\x01", "evidence_doc", "evidence_section")))
    d = d.withColumn("section_hit", F.when(F.coalesce("evidence_section", F.lit("")) != "", F.coalesce(sec, F.lit(False))))
    d = d.withColumn("subject_hit", contains(F.col("x"), F.col("sn"))).withColumn("object_hit", contains(F.col("x"), F.col("on")))
    d = d.withColumn("relation_hit", F.col("subject_hit") & F.col("object_hit") & F.forall("cs", lambda c: contains(F.col("x"), c)))
    if rels is not None:
        r = rels.select("qid", F.replace(name_form(F.col("predicate")), F.lit(" "), F.lit("_")).alias("rp"), name_form(F.concat_ws(" ", "subject", "evidence")).alias("rs"), name_form(F.concat_ws(" ", "object", "evidence")).alias("ro"), name_form(F.col("evidence")).alias("re"))
        may = F.split(_lookup(ALIASES, F.col("pn"), ""), " ")
        ok = contains(F.col("rs"), F.col("sn")) & contains(F.col("ro"), F.col("on")) & (F.array_contains(may, F.col("rp")) | (F.col("rp") == F.col("pn")) | contains(F.col("re"), F.replace(F.col("pn"), F.lit("_"), F.lit(" "))))
        stated = d.select("tid", "qid", "sn", "pn", "on").join(r, "qid").groupBy("tid").agg(F.max(ok).alias("stated"))
        d = d.join(stated, "tid", "left").withColumn("stated", F.coalesce("stated", F.lit(False)))
    else:
        d = d.withColumn("stated", F.lit(None).cast("boolean"))
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    none = lambda c: F.coalesce(F.max(~F.col(c)), F.lit(False))
    reason = F.when(none("doc_hit"), "missing_doc").when(none("section_hit"), "missing_section").when(none("subject_hit") & none("object_hit"), "entities_missing").when(none("subject_hit"), "subject_missing").when(none("object_hit"), "object_missing").when(none("relation_hit"), "entities_found_relation_missing").otherwise("ok")
    return d.groupBy("qid").agg(
        F.count("*").alias("n_triples"), rate("doc_hit").alias("doc_recall"), rate("section_hit").alias("section_recall"), rate("subject_hit").alias("subject_recall"), rate("object_hit").alias("object_recall"), rate("relation_hit").alias("relation_evidence_recall"), rate("stated").alias("relation_recall"), reason.alias("error"),
    )


def expansion_gain(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid, before, after, gain, is_new): what the expansion adds to the relation evidence of each question, from two results of triple_hits."""
    b = before.select("qid", F.col("relation_evidence_recall").alias("before"))
    return after.select("qid", F.col("relation_evidence_recall").alias("after")).join(b, "qid", "full").select("qid", "before", "after", F.round(F.col("after") - F.col("before"), 6).alias("gain"), (F.col("after") > F.col("before")).cast("int").alias("is_new"))


def weak_type(value: Column, is_object: bool) -> Column:
    """Type of the subject or object of a gold triple, by words in it."""
    v = name_form(value)
    return (
        F.when(v.rlike(r"\b(?:master|bachelor)\s+of\s+(?:arts|science)\b|\b(?:m\.a\.|b\.a\.|m\.sc\.)"), "Degree").when(v.rlike("englisch|deutsch"), F.when(F.lit(is_object) & ~v.contains("b2"), "Language").otherwise("Requirement"))
        .when(v.rlike(r"(?U)\b(?:ects|lp|leistungspunkt|b2|dsh|note|\d+\s*monate?)\b"), "Requirement").when(v.rlike(r"(?U)\b(?:semester|monat|jahr)\b"), "Semester").when(v.rlike(r"(?U)\b(?:einmal|zweimal|wiederholt|wiederholungsversuch|prüfungsanspruch)\b"), "RepeatLimit").otherwise("Requirement" if is_object else "Concept")
    )


def supervision_terms(triples: DataFrame) -> DataFrame:
    """(entity_type, term): subjects and objects of gold triples of three letters and more, each once by normal form; optional, as it shows the gold answers to the graph."""
    s = triples.select(F.trim("subject").alias("term"), weak_type(F.col("subject"), False).alias("entity_type"))
    o = triples.select(F.trim("object").alias("term"), weak_type(F.col("object"), True).alias("entity_type"))
    return s.unionByName(o).where("length(term) >= 3").groupBy("entity_type", name_form(F.col("term")).alias("norm")).agg(F.min("term").alias("term")).select("entity_type", "term")


def path_grounding(claims: DataFrame, paths: DataFrame) -> DataFrame:
    """(qid, path_support, grounded, unsupported_without_path): shares of claims (qid, chunk_id, in_context) whose supporting chunk holds a relation (qid, chunk_id) that the graph went along."""
    p = paths.select("qid", "chunk_id").distinct().withColumn("has", F.lit(True))
    d = claims.join(p, ["qid", "chunk_id"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    return d.groupBy("qid").agg(
        F.round(F.avg(F.col("has").cast("int")), 6).alias("path_support"), F.round(F.avg((F.col("has") & F.col("in_context")).cast("int")), 6).alias("grounded"), F.round(F.avg(F.when(~F.col("in_context"), (~F.col("has")).cast("int"))), 6).alias("unsupported_without_path"),
    )


def added_noise(found: DataFrame, chunks: DataFrame, questions: DataFrame, triples: DataFrame) -> DataFrame:
    """(qid, n_added, n_noise, precision) of the chunks that only the graph led to: noise are preambles, chunks of low quality for the question, and those without a subject or object of its gold triples (where it has any)."""
    t = triples.where("trim(subject) <> '' and trim(object) <> ''").groupBy("qid").agg(F.collect_set(name_form(F.col("subject"))).alias("ss"), F.collect_set(name_form(F.col("object"))).alias("os"))
    new = Scratch(found.sparkSession).cut(found.where("source = 'graph'").select("qid", "chunk_id"))  # few chunks, often the same: only their texts are brought into normal form
    c = chunks.join(new.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "section_id", F.concat_ws(" ", F.col("doc_id").cast("string"), "title", "section_id").alias("place"), name_form(F.concat_ws(" ", "doc_id", "section_id", "title", "text")).alias("x"))
    d = new.join(c, "chunk_id").join(questions.select("qid", "question"), "qid").join(t, "qid", "left")
    none = F.col("ss").isNotNull() & ~F.exists("ss", lambda s: contains(F.col("x"), s)) & ~F.exists("os", lambda o: contains(F.col("x"), o))
    noise = (F.lower("section_id") == "preamble") | (chunk_quality(F.col("question"), F.col("place"), F.col("section_id")) < 0.5) | none
    d = d.withColumn("noise", F.coalesce(noise, F.lit(False)))
    return d.groupBy("qid").agg(F.count("*").alias("n_added"), F.count_if("noise").alias("n_noise"), F.round(F.avg((~F.col("noise")).cast("int")), 6).alias("precision"))
