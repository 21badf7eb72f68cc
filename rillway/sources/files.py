"""Readers of question files, notice exports and code catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from rillway.functions.cpv import prefix8


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """(id, query, gold_cpv_code, notes) from a JSON list or an object with a list under "queries".

    A missing id becomes q and the place in the file; rows without query or gold code are an error.
    """
    item = "STRUCT<id STRING, query STRING, gold_cpv_code STRING, notes STRING>"
    raw = spark.read.text(path, wholetext=True)
    whole = F.coalesce(F.from_json("value", f"STRUCT<queries ARRAY<{item}>>").getField("queries"), F.from_json("value", f"ARRAY<{item}>"))
    rows = raw.select(F.posexplode(whole).alias("i", "q")).select((F.col("i") + 1).alias("i"), "q.*")
    need = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.raise_error(F.concat(F.lit(f"no {c} in row "), F.col("i").cast("string")))).otherwise(F.col(c))
    return rows.select(F.coalesce("id", F.concat(F.lit("q"), "i")).alias("id"), need("query").alias("query"), need("gold_cpv_code").alias("gold_cpv_code"), "notes")


def load_notice_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV export that have a number, a code of eight digits and a title or text."""
    t = spark.read.csv(path, header=True, multiLine=True, escape='"')
    t = t.toDF(*[c.lstrip("﻿") for c in t.columns]).withColumn("MAIN_CPV", prefix8(F.col("MAIN_CPV")))
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return t.where(filled("PUB_NUMBER") & F.col("MAIN_CPV").isNotNull() & (filled("TITLE") | filled("TEXT")))


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(code, label, parent_code, examples) from either layout: code and label, or CODE, EN and further languages."""
    t = spark.read.csv(path, header=True, multiLine=True, escape='"')
    t = t.toDF(*[c.lstrip("﻿") for c in t.columns])
    if "CODE" in t.columns:
        langs = [c for c in ["EN", *sorted(set(t.columns) - {"CODE", "EN"})] if c in t.columns]
        out = t.select(prefix8(F.col("CODE")).alias("code"), F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in langs]).alias("label"), F.lit(None).cast("string").alias("parent_code"), F.array().cast("array<string>").alias("examples"))
    else:
        have = lambda c: F.col(c) if c in t.columns else F.lit(None).cast("string")
        out = t.select(prefix8(F.col("code")).alias("code"), F.col("label"), prefix8(have("parent_code")).alias("parent_code"), F.filter(F.split(F.coalesce(have("examples"), F.lit("")), r" \|\| "), lambda x: x != "").alias("examples"))
    first = F.row_number().over(Window.partitionBy("code").orderBy("label"))
    return out.where("code is not null and label is not null").withColumn("r", first).where("r = 1").drop("r")
