"""Readers of questions, document files, spreadsheets, search services and artifacts of earlier runs."""

from __future__ import annotations

import io
import json
import re
import time
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rillway.functions.cpv import prefix8
from rillway.functions.matching import parse_number, slug

TRIPLE = "STRUCT<subject STRING, predicate STRING, object STRING, evidence_doc_id STRING, evidence_section_id STRING, relation_cues ARRAY<STRING>>"
QUESTION = f"STRUCT<id STRING, question STRING, gold_answer STRING, expected_keywords ARRAY<STRING>, program_id STRING, program_name STRING, doc_id STRING, year INT, answerable BOOLEAN, question_type STRING, must_have_triples ARRAY<{TRIPLE}>, nice_to_have_triples ARRAY<{TRIPLE}>>"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from a JSON list or an object with a list under "questions": missing ids become q and the place, missing texts are empty, a missing question is an error."""
    raw = spark.read.text(path, wholetext=True)
    whole = F.coalesce(F.from_json("value", f"STRUCT<questions ARRAY<{QUESTION}>>").getField("questions"), F.from_json("value", f"ARRAY<{QUESTION}>"))
    q = raw.select(F.posexplode(whole).alias("i", "q")).select("i", "q.*")
    need = F.when(F.col("question").isNull(), F.raise_error(F.concat(F.lit("question item "), F.col("i").cast("string"), F.lit(" has no question")))).otherwise(F.col("question"))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return q.select(F.coalesce("id", F.concat(F.lit("q"), (F.col("i") + 1).cast("string"))).alias("id"), need.alias("question"), *map(text, ("gold_answer", "program_id", "program_name", "doc_id")), F.coalesce("expected_keywords", F.array().cast("array<string>")).alias("expected_keywords"), "year", "answerable", "question_type", "must_have_triples", "nice_to_have_triples")


def with_metadata(files: DataFrame, path: str, root: str = "") -> DataFrame:
    """files with doc_id (the path below root), program_name (its first folder, 'root' without one) and program_id."""
    rel = F.regexp_replace(F.regexp_replace(F.col(path), r"^file:/*", "/"), "^" + re.escape(root.rstrip("/")) + "/", "") if root else F.col(path)
    first = F.when(F.contains(rel, F.lit("/")), F.element_at(F.split(F.regexp_replace(rel, "^/", ""), "/"), 1)).otherwise(F.lit("root"))
    d = files.withColumn("doc_id", rel).withColumn("program_name", first)
    return d.withColumn("program_id", slug(F.col("program_name")))


def document_files(spark: SparkSession, patterns: str, root: str = "") -> DataFrame:
    """(path, content, doc_id, program_name, program_id) of files by comma-separated paths and patterns, each once; folders count with all below; nothing found is an error when read."""
    paths = [p.strip() for p in patterns.split(",") if p.strip()]
    if not paths:
        raise ValueError("no document path is given")
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content").dropDuplicates(["path"])
    return with_metadata(d, "path", root)


def document_text(files: DataFrame, extract: Callable[[bytes], list[tuple[str, list[list[list[str | None]]]]]] | None = None) -> DataFrame:
    """(doc_id, program_id, program_name, text) of document files, page by page with the tables after the text.

    extract gives of a file's bytes its pages as (text outside of tables, tables as rows of cells). Without one, files are plain
    text. A file that can't be read gives an empty text.
    """
    from rillway.operators.sections import table_text

    def pages(batches):
        for b in batches:
            rows = []
            for d, pid, pn, c in zip(b["doc_id"], b["program_id"], b["program_name"], b["content"]):
                try:
                    found = extract(bytes(c)) if extract else [(bytes(c).decode("utf-8", "replace"), [])]
                except Exception:
                    found = []
                rows += [(d, pid, pn, i, t, [[[None if x is None else str(x) for x in r] for r in tab] for tab in tabs]) for i, (t, tabs) in enumerate(found or [("", [])])]
            yield pd.DataFrame(rows, columns=["doc_id", "program_id", "program_name", "page", "text", "tables"])

    p = files.select("doc_id", "program_id", "program_name", "content").mapInPandas(pages, "doc_id string, program_id string, program_name string, page int, text string, tables array<array<array<string>>>")
    tabs = F.transform("tables", lambda t, i: table_text(t, i + 1))
    parts = F.filter(F.concat(F.array(F.trim("text")), tabs), lambda x: x != "")
    p = p.withColumn("t", F.array_join(parts, "\n\n"))
    return p.groupBy("doc_id", "program_id", "program_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n").alias("text"))


# spreadsheets


def sheet_rows(content: bytes) -> list[list[str]]:
    """Rows of the first worksheet (in order of name) of a spreadsheet; empty rows are left out, whole numbers lose their fraction."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        if not names:
            raise ValueError("no worksheet")
        shared = ["".join(t.text or "" for t in si.iter(ns + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(ns + "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        sheet = ET.fromstring(z.read(names[0]))
    out = []
    for row in sheet.iter(ns + "row"):
        cells: dict[int, str] = {}
        for c in row.iter(ns + "c"):
            letters = "".join(x for x in c.get("r", "A") if x.isalpha()).upper()
            at = 0
            for x in letters:
                at = at * 26 + ord(x) - 64
            v, kind = c.find(ns + "v"), c.get("t")
            text = v.text or "" if v is not None else ""
            if kind == "s":
                text = shared[int(text)] if text.isdigit() and int(text) < len(shared) else ""
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(ns + "t"))
            elif re.fullmatch(r"-?\d+\.0+", text):
                text = text.split(".")[0]
            cells[max(at - 1, 0)] = text
        if any(v.strip() for v in cells.values()):
            out.append([cells.get(i, "") for i in range(max(cells) + 1)])
    return out


def header_key(text: str) -> str:
    return "".join(c for c in text.casefold() if c.isalnum())


def load_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, cells MAP<header key, text>, raw MAP<header, text>) of the rows below the header of each spreadsheet."""

    def read(batches):
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                got = sheet_rows(bytes(c))
                heads = [h.strip() for h in got[0]] if got else []
                for i, r in enumerate(got[1:], 1):
                    name = lambda j: heads[j] if j < len(heads) and heads[j] else f"Column {j + 1}"  # noqa: B023, E731
                    rows.append((p, i, {header_key(name(j)): v for j, v in enumerate(r)}, {name(j): v for j, v in enumerate(r)}))
            yield pd.DataFrame(rows, columns=["path", "row_no", "cells", "raw"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, row_no int, cells map<string,string>, raw map<string,string>")


#: Headers that mean the same.
ALIASES = {
    "id": ["Record ID", "id", "query_id", "question_id", "banf_id"], "query": ["Query Text", "query", "question", "user_query", "query_banf", "banf", "Notice Description"], "answer": ["LLM Answer", "Answer", "Generated Answer", "Final Answer", "RAG Answer"],
    "prediction": ["Predicted CPV", "Predicted CPV Code", "Predicted answer", "Prediction", "Predicted", "Candidate", "Answer CPV", "Answer", "CPV", "Label", "Code"], "score": ["Predicted Vector Score", "Retrieved Vector Score", "Vector Score", "RRF Score", "Score", "Confidence", "Probability", "Retrieval Score", "Reranker Score", "Final Score"],
    "expected": ["Ground Truth CPV", "Expected CPV", "Gold CPV", "Reference CPV", "Expected Answer", "Expected", "Gold", "Reference", "Target", "Label"],
    "chunk_id": ["Chunk ID", "Chunk IDs", "Retrieved Chunk ID", "Retrieved Chunk IDs", "Candidate ID"], "chunk_text": ["Chunk Text", "Chunk", "Chunks", "Retrieved Chunk Text", "Retrieved Chunks", "Retrieved Context", "Context", "Contexts", "Candidate Text"],
}


def aliased(field: str, rank: int | None = None) -> Column:
    """The first cell of a sheet that isn't blank under a header that means field; with a rank also of the forms x1, 1x, xrank1 and rank1x."""
    keys = []
    for a in map(header_key, ALIASES[field]):
        keys += [a] if rank is None else [f"{a}{rank}", f"{rank}{a}", f"{a}rank{rank}", f"rank{rank}{a}"]
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at("cells", F.lit(k))), F.lit("")) for k in dict.fromkeys(keys)])


def prepared_results(sheet: DataFrame, depth: int = 10) -> DataFrame:
    """(id, query, expected, code, score, rank) from rows of prepared results, wide (columns per rank) or long (several rows an id); a cell of several codes gives each, a millionth less in score."""
    slot = lambda r: F.struct(F.lit(r or 1).alias("slot"), aliased("prediction", r).alias("p"), parse_number(aliased("score", r)).alias("s"))
    s = sheet.select("row_no", F.coalesce(aliased("id"), F.col("row_no").cast("string")).alias("id"), aliased("query").alias("query"), aliased("expected").alias("expected"), F.explode(F.array(slot(None), *[slot(r) for r in range(1, depth + 1)])).alias("x")).where("x.p is not null")
    codes = F.regexp_extract_all("x.p", F.lit(r"\b(\d{8})\b"), F.lit(1))
    s = s.select("row_no", "id", "query", "expected", "x.slot", "x.s", F.posexplode(F.when(F.size(codes) > 0, codes).otherwise(F.array(F.trim("x.p")))).alias("at", "code"))
    from pyspark.sql.window import Window

    s = s.withColumn("score", F.coalesce("s", F.lit(0.0)) - F.col("at") * 1e-6).groupBy("id", "code").agg(F.min("query").alias("query"), F.min("expected").alias("expected"), F.max("score").alias("score"), F.min(F.struct("slot", "row_no", "at")).alias("o"))
    w = Window.partitionBy("id").orderBy(F.asc("o.slot"), F.desc("score"), F.asc("o.row_no"), F.asc("o.at"))
    return s.select("id", "query", "expected", "code", "score", F.row_number().over(w).alias("rank"))


# search services


def fetch_pages(post: Callable[[dict], dict], query: str, fields: list[str], limit: int = 250, most: int = 20_000, pause: float = 0.35, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Notices of a search service that hands out a token for the next batch, at most 250 a call and most in all; a call that fails is tried again after 1, 2, 4 … 30 seconds."""
    token, n = None, 0
    while n < most:
        body = {"query": query, "fields": fields, "limit": min(limit, 250), "paginationMode": "ITERATION", **({"iterationNextToken": token} if token else {})}
        for k in range(tries):
            try:
                answer = post(body)
                break
            except Exception:
                if k + 1 == tries:
                    raise
                sleep(min(2**k, 30))
        batch = answer.get("notices") or []
        yield from batch[: most - n]
        n += len(batch)
        token = str(answer.get("iterationNextToken") or "").strip()
        if not batch or not token:
            return
        sleep(pause)


class SearchService(DataSource):
    """Batch source 'notice_search' over fetch_pages: options query, fields (comma separated), most, and post, the name module:function of the call. One partition, as each token comes with the batch before."""

    @classmethod
    def name(cls) -> str:
        return "notice_search"

    def schema(self) -> str:
        return "publication_number string, raw_notice_json string"

    def reader(self, schema):
        return _SearchReader(self.options)


class _SearchReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        import importlib

        module, function = self.options["post"].split(":")
        post = getattr(importlib.import_module(module), function)
        for n in fetch_pages(post, self.options.get("query", "*"), self.options.get("fields", "").split(","), most=int(self.options.get("most", 20_000)), pause=0.0):
            yield str(n.get("publication-number", "")), json.dumps(n, ensure_ascii=False)


def classify_remote(queries: DataFrame, post: Callable[[dict], dict], top_k: int = 10, pause: float = 0.0) -> DataFrame:
    """(id, rank, code, score, explanation, status) from a classifier service, one call a query; predictions stand under several names, and a failed call gives a row with its error as status."""
    labels, scores = ("label", "cpv_code", "answer", "id", "code"), ("score", "confidence", "probability")

    def call(batches):
        for b in batches:
            rows = []
            for i, q in zip(b["id"], b["query"]):
                try:
                    a = post({"id": i, "query": q, "top_k": top_k})
                    found = a.get("predictions") or a.get("top_k_answers") or []
                    for r, p in enumerate(found[:top_k], 1):
                        p = p if isinstance(p, dict) else {"label": p}
                        s = next((p[k] for k in scores if p.get(k) is not None), None)
                        rows.append((i, r, str(next((p[k] for k in labels if p.get(k)), "")), None if s is None else float(s), a.get("explanation"), "success"))
                    if not found:
                        rows.append((i, None, None, None, a.get("explanation"), "empty"))
                except Exception as e:
                    rows.append((i, None, None, None, None, f"error: {e}"))
                if pause:
                    time.sleep(pause)
            out = pd.DataFrame(rows, columns=["id", "rank", "code", "score", "explanation", "status"])
            yield out.astype({"rank": "Int32"})

    return queries.select(F.col("id").cast("string").alias("id"), "query").mapInPandas(call, "id string, rank int, code string, score double, explanation string, status string")


# artifacts of earlier runs


def preview(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The first rows of a CSV artifact."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"').limit(limit)


def tail(spark: SparkSession, path: str, chars: int = 24_000) -> str:
    """The end of a text artifact."""
    r = spark.read.text(path, wholetext=True).select(F.right("value", F.lit(chars)).alias("t")).first()
    return r.t if r else ""


def read_object(spark: SparkSession, path: str) -> dict:
    """A JSON artifact; unreadable or other than an object gives an empty one."""
    r = spark.read.text(path, wholetext=True).first()
    try:
        x = json.loads(r.value) if r else {}
    except ValueError:
        x = {}
    return x if isinstance(x, dict) else {}


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modified, bytes) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, n_files, bytes, last) of the folders with artifacts below a folder, the newest first."""
    f = list_files(spark, folder).withColumn("run", F.regexp_extract("path", re.escape(folder.rstrip("/")) + "/([^/]+)/", 1)).where("run <> ''")
    return f.groupBy("run").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("last")).orderBy(F.desc("last"), "run")


def catalogue_from_profiles(profiles: DataFrame, fingerprint: str | None = None) -> DataFrame:
    """(code, label, description, parent_code, examples) from stored profiles, of one catalogue if its fingerprint is given; of repeated codes the smallest label counts."""
    p = profiles if fingerprint is None else profiles.where(F.col("source_fingerprint") == fingerprint)
    p = p.select(prefix8(F.col("code")).alias("code"), "label", F.col("description_en").alias("description"), prefix8(F.col("parent_code")).alias("parent_code"), F.from_json("examples_json", "array<string>").alias("examples")).where("code is not null")
    return p.groupBy("code").agg(F.min_by(F.struct("label", "description", "parent_code", "examples"), F.coalesce("label", F.lit(""))).alias("x")).select("code", "x.*")
