"""Writers: tables and summaries, upserts by bucket, index with manifest, graph exports, reports and charts."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from rillway.functions import cpv

INDEX_VERSION = 2
BUCKETS = 64


def write_table(df: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = ()) -> None:
    """A relation as Parquet, CSV or JSON lines, in folders by the columns by. CSV holds nested columns as JSON text."""
    if form == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    w = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    w.option("header", "true").option("escape", '"').format(form).save(path)


def write_object(spark: SparkSession, value: dict, path: str) -> None:
    """One nested object as a JSON text."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def shaped(df: DataFrame, first: Sequence[str] = (), drop: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    """Columns in a chosen order: first ones first, dropped ones and those with a dropped prefix left out; names that aren't there are passed over."""
    keep = [c for c in df.columns if c not in drop and not any(c.startswith(p) for p in prefixes)]
    return df.select(*[c for c in first if c in keep], *[c for c in keep if c not in first])


# upserts


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def upsert(spark: SparkSession, new: DataFrame, key: str, order: Sequence[str], path: str) -> int:
    """Put rows into the table at path: per key the last by order counts, old rows included, and of equals the new one. Only the buckets of keys that new rows have are written again; returns how many.

    The table is kept in folders of key buckets; a bucket is first written aside, so a lost executor leaves the old one.
    """
    new = new.withColumn("_b", _bucket(key))
    touched = [r[0] for r in new.select("_b").distinct().collect()]  # at most BUCKETS numbers
    try:
        old = spark.read.parquet(path).where(F.col("_b").isin(touched)) if touched else None
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        old = None
    new = new.withColumn("_n", F.lit(1))
    every = new if old is None else old.withColumn("_n", F.lit(0)).unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order], F.desc("_n"))
    last = every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_n")
    aside = path.rstrip("/") + "__new"
    last.write.mode("overwrite").partitionBy("_b").parquet(aside)
    spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_b").parquet(path)
    return len(touched)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_b")


def upsert_notices(spark: SparkSession, notices: DataFrame, examples: DataFrame, path: str) -> None:
    """Notices by publication number, and their examples: those of an upserted notice are replaced as a whole."""
    upsert(spark, notices, "publication_number", ["ingested_at", "notice_row_id"], path + "/notices")
    e = examples.groupBy("publication_number").agg(F.collect_list(F.struct(*[c for c in examples.columns if c != "publication_number"])).alias("examples"))
    n = notices.groupBy("publication_number").agg(F.max("ingested_at").alias("ingested_at")).join(e, "publication_number", "left")
    upsert(spark, n, "publication_number", ["ingested_at"], path + "/examples")


def upsert_profiles(spark: SparkSession, profiles: DataFrame, path: str) -> None:
    """Profiles by catalogue and code."""
    upsert(spark, profiles.withColumn("key", F.concat_ws("/", "source_fingerprint", "code")), "key", ["profile_row_id"], path)


# index


def fingerprint(df: DataFrame, columns: Sequence[str]) -> str:
    """Fingerprint of a relation that doesn't depend on the order of its rows: count and sums of two hashes of each."""
    h = F.xxhash64(*columns)
    r = df.agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(2**31 - 1))).alias("a"), F.sum(F.pmod(F.hash(*columns).cast("long"), F.lit(2**31 - 1))).alias("b")).select(F.sha1(F.concat_ws("|", "n", "a", "b")).alias("f")).first()
    return r.f


def ensure_index(spark: SparkSession, docs: DataFrame, key: str, text: str, path: str, model: str = "") -> bool:
    """Documents and their postings as tables at path, with a manifest; nothing is built where the manifest has the same fingerprint, count, model and version. True if it was built."""
    from rillway.operators.retrieval import postings
    from rillway.sources.documents import read_object

    mine = {"fingerprint": fingerprint(docs, [key, text]), "count": docs.count(), "model": model, "version": INDEX_VERSION}
    try:
        if read_object(spark, path + "/manifest") == mine:
            return False
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    docs.write.mode("overwrite").parquet(path + "/docs")
    postings(docs, key, F.col(text)).repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path + "/postings")
    write_object(spark, mine, path + "/manifest")
    return True


# graphs


def code_edges(codes: DataFrame) -> DataFrame:
    """(start, end, type): child and parent both ways, and neighbouring siblings once each pair of next ones in code order, so that siblings form a chain rather than all pairs."""
    c = codes.select("code", cpv.inferred_parent(F.col("code")).alias("parent"))
    up = c.join(codes.select(F.col("code").alias("parent")), "parent", "left_semi")
    nxt = F.lead("code").over(Window.partitionBy("parent").orderBy("code"))
    sib = up.withColumn("n", nxt).where("n is not null").select(F.col("code").alias("start"), F.col("n").alias("end"), F.lit("SIBLING_OF").alias("type"))
    return up.select(F.col("code").alias("start"), F.col("parent").alias("end"), F.lit("CHILD_OF").alias("type")).unionByName(up.select(F.col("parent").alias("start"), F.col("code").alias("end"), F.lit("PARENT_OF").alias("type"))).unionByName(sib)


def export_code_graph(spark: SparkSession, catalogue: DataFrame, path: str) -> None:
    """Nodes and edges of codes as CSV for a graph database, with the statement that loads them."""
    n = catalogue.select("code", "label", cpv.inferred_parent(F.col("code")).alias("parent_code"), cpv.code_level(F.col("code")).alias("code_level"), F.array_join(F.reverse(cpv.ancestors(F.col("code"))), " | ").alias("path_codes"))
    write_table(n, path + "/nodes", "csv")
    write_table(code_edges(catalogue), path + "/edges", "csv")
    load = "LOAD CSV WITH HEADERS FROM 'file:///nodes.csv' AS r MERGE (n:Code {code: r.code}) SET n.label = r.label;\nLOAD CSV WITH HEADERS FROM 'file:///edges.csv' AS r MATCH (a:Code {code: r.start}), (b:Code {code: r.end}) MERGE (a)-[:LINK {type: r.type}]->(b);"
    spark.createDataFrame([(load,)], "value string").coalesce(1).write.mode("overwrite").text(path + "/import")


def run_evidence(results: DataFrame, ranked: DataFrame, examples: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a run for a graph database: run, queries, predictions, codes and example notices, with what each was asked, predicted, retrieved and expected."""
    q = F.concat(F.lit(run + "/"), F.col("qid").cast("string"))
    nodes = results.select(q.alias("id"), F.lit("Query").alias("kind"), F.col("query").alias("name")).unionByName(ranked.select(F.col("code").alias("id"), F.lit("Code").alias("kind"), F.col("code").alias("name")).distinct()).unionByName(examples.select(F.col("publication_number").alias("id"), F.lit("NoticeExample").alias("kind"), F.col("publication_number").alias("name")).distinct())
    e = lambda d, a, t, b: d.select(a.alias("start"), F.lit(t).alias("type"), b.alias("end"))
    edges = e(results, F.lit(run), "HAS_QUERY", q).unionByName(e(results, q, "GOLD_CODE", F.col("gold"))).unionByName(e(ranked.where("rank = 1"), q, "PREDICTED_CODE", F.col("code"))).unionByName(e(ranked, q, "RETRIEVED", F.col("code"))).unionByName(e(examples, F.col("cpv_code"), "HAS_NOTICE_EXAMPLE", F.col("publication_number")))
    return nodes, edges.where("start is not null and end is not null").distinct()


def send_batches(df: DataFrame, connect: Callable[[], Callable[[list[dict]], None]], size: int = 500) -> None:
    """Rows to an external service in batches, from every partition with a connection of its own."""

    def send(rows):
        put, batch = connect(), []
        for r in rows:
            batch.append(r.asDict(recursive=True))
            if len(batch) == size:
                put(batch)
                batch = []
        if batch:
            put(batch)

    df.foreachPartition(send)


# reports and charts, of small aggregated tables


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """A table in Markdown, of at most so many rows."""
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    rows = df.limit(most).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def report(title: str, parts: dict[str, DataFrame], most: int = 50) -> str:
    """Markdown with a heading and a table for each part."""
    return "\n\n".join([f"# {title}", *(f"## {k}\n\n{markdown_table(d, most)}" for k, d in parts.items())]) + "\n"


def _esc(s: object) -> str:
    return str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def bar_chart(df: DataFrame, label: str, value: str, title: str, width: int = 640, most: int = 40) -> str:
    """Bars in SVG of at most so many rows; missing and negative values have no bar."""
    rows = [(r[label], float(r[value]) if r[value] is not None and not math.isnan(float(r[value])) else 0.0) for r in df.select(label, value).limit(most).collect()]
    top = max([v for _, v in rows] + [1e-9])
    bars = "".join(f'<text x="4" y="{40 + 22 * i}" font-size="12">{_esc(k)}</text><rect x="200" y="{28 + 22 * i}" width="{max(v, 0) / top * (width - 280):.1f}" height="15" fill="#4477aa"/><text x="{206 + max(v, 0) / top * (width - 280):.1f}" y="{40 + 22 * i}" font-size="11">{v:.4g}</text>' for i, (k, v) in enumerate(rows))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{40 + 22 * len(rows)}"><text x="4" y="16" font-size="14">{_esc(title)}</text>{bars}</svg>'


def scatter_chart(df: DataFrame, x: str, y: str, title: str, size: int = 360, most: int = 500) -> str:
    """Points in SVG within the range of both columns."""
    pts = [(float(r[x]), float(r[y])) for r in df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y).limit(most).collect()]
    lo, hi = [min((p[i] for p in pts), default=0.0) for i in (0, 1)], [max((p[i] for p in pts), default=1.0) for i in (0, 1)]
    at = lambda v, i: 30 + (v - lo[i]) / ((hi[i] - lo[i]) or 1.0) * (size - 60)
    dots = "".join(f'<circle cx="{at(a, 0):.1f}" cy="{size - at(b, 1):.1f}" r="3" fill="#aa4466"/>' for a, b in pts)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}"><text x="4" y="16" font-size="14">{_esc(title)}</text>{dots}</svg>'
