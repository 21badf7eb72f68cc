"""Documents to sections, paragraphs, tables as text, chunks and sentences with their places; all by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rillway.functions.text import clean_text

#: Form of a section heading, the name of what stands before the first, and an empty cell.
HEADING = r"^§\s*(\d+[a-zA-Z]?)\s+(.+)$"
PREAMBLE, EMPTY_CELL = ("PREAMBLE", "Preamble"), "[EMPTY]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_toc_line(line: Column) -> Column:
    """Lines of a table of contents: dot leaders, short lines numbered in roman numerals, numbered annexes."""
    short = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != "")) <= 6
    return line.rlike(r"\.{5,}\s*\d*\s*$") | (line.rlike(r"^[IVX]+\.\s+\S") & short) | (line.rlike(r"^Anlage(?:\(n\))?:") & line.rlike(r"\b\d+\b"))


def sections(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, section_position, section_id, title, text): documents cut at headings '§ n title'.

    The first heading must be § 1 and have '(1)' in its line or the next three that aren't empty. Before it, other headings and
    lines of a table of contents are dropped; after it, headings that aren't valid stay in the text. Parts without text give no section.
    """
    lines = docs.select(doc, F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")).alias("pos", "raw")).withColumn("line", strip(F.col("raw")))
    number, title = F.regexp_extract("line", HEADING, 1), strip(F.regexp_extract("line", HEADING, 2))
    lines = lines.withColumn("is_head", F.col("line").rlike(HEADING)).withColumn("number", number).withColumn("title", title).withColumn("toc", is_toc_line(F.col("line")))
    fits = F.col("is_head") & ~F.col("toc") & ~F.col("title").rlike(r"^(?:Abs\.|Absatz|Satz)(?:\s|$)") & ~F.col("title").rlike(r"^\p{Ll}")
    by = Window.partitionBy(doc).orderBy("pos")
    solid = lines.where("line <> ''")
    ahead = F.concat_ws(" ", "line", *[F.lead("line", i).over(by) for i in (1, 2, 3)])
    solid = solid.withColumn("fits", fits).withColumn("opens", F.col("fits") & (F.col("number") == "1") & F.contains(ahead, F.lit("(1)")))
    flagged = solid.withColumn("first", F.min(F.when(F.col("opens"), F.col("pos"))).over(Window.partitionBy(doc)))
    before = F.col("first").isNull() | (F.col("pos") < F.col("first"))
    heads = flagged.select(doc, "pos", (F.col("fits") & ~before).alias("head"), (before & (F.col("is_head") | F.col("toc"))).alias("dropped"))
    every = lines.select(doc, "pos", "line", "number", "title").join(heads, [doc, "pos"], "left").na.fill(False, ["head", "dropped"]).where("not dropped")
    every = every.withColumn("n", F.sum(F.col("head").cast("int")).over(by))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    g = every.groupBy(doc, "n").agg(F.max(F.when(F.col("head"), F.concat(F.lit("§ "), "number"))).alias("id"), F.max(F.when(F.col("head"), F.col("title"))).alias("title"), strip(body).alias("text")).where("text <> ''")
    place = F.row_number().over(Window.partitionBy(doc).orderBy("n")) - 1
    return g.select(doc, place.alias("section_position"), F.coalesce("id", F.lit(PREAMBLE[0])).alias("section_id"), F.coalesce("title", F.lit(PREAMBLE[1])).alias("title"), "text")


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, stripped; where there is none, the lines."""
    solid = lambda x: F.filter(F.transform(x, strip), lambda p: p != "")
    parts = solid(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"))
    return F.when(F.size(parts) > 0, parts).otherwise(solid(F.split(F.coalesce(text, F.lit("")), "\n")))


def table_text(rows: Column, index: Column) -> Column:
    """Rows ARRAY<ARRAY<STRING>> as lines of cells between bars under '[TABLE n]'; empty rows are left out, short ones filled up, empty cells marked; no rows give an empty text."""
    full = F.filter(rows, lambda r: F.exists(r, lambda c: F.coalesce(strip(c) != "", F.lit(False))))
    wide = F.array_max(F.transform(full, F.size))
    cell = lambda c: F.coalesce(F.nullif(strip(F.replace(clean_text(c), F.lit("\n"), F.lit(" / "))), F.lit("")), F.lit(EMPTY_CELL))
    line = lambda r: F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(None).cast("string"), wide - F.size(r))), cell), " | ")
    return F.when(F.size(full) > 0, F.concat_ws("\n", F.concat(F.lit("[TABLE "), index.cast("string"), F.lit("]")), F.array_join(F.transform(full, line), "\n"))).otherwise("")


def sentences(text: Column) -> Column:
    """ARRAY<STRUCT<text, start, end>>: stretches between line ends, and between sentence ends and a capital, paragraph sign or number in brackets; places count code points."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"((?<=[.!?])\s+(?=[A-ZÄÖÜ§]|\(\d+\))|\n+)", "\x01$1\x01")
    pieces = F.split(marked, "\x01")
    runs = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.when(strip(p) == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(strip(p).alias("text"), (acc["at"] + F.length(p) - F.length(F.regexp_replace(p, r"(?U)^\s+", ""))).alias("start"), (acc["at"] + F.length(p)).alias("end"))))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return runs


def chunk_text(title: Column, text: Column, index: Column) -> Column:
    """What is searched of a chunk: the title with the first chunk only, then the text."""
    return F.concat_ws("\n", F.when((index == 0) & (strip(title) != ""), title), F.when(strip(text) != "", text))


def chunks_of(units: DataFrame, key: str, text: str, size: int, step: int) -> DataFrame:
    """(key, chunk_index, start_word, end_word, n_words, text): windows of size words, step words apart, of each unit; one window with size 0."""
    w = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    d = units.withColumn("w", w).where("size(w) > 0").withColumn("n", F.size("w"))
    if size == 0:
        return d.select(key, F.lit(0).alias("chunk_index"), F.lit(0).alias("start_word"), F.col("n").alias("end_word"), F.col("n").alias("n_words"), F.array_join("w", " ").alias("text"))
    count = 1 + F.ceil(F.greatest(F.col("n") - size, F.lit(0)) / F.lit(step)).cast("int")
    d = d.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("chunk_index") * step
    part = F.slice("w", start + 1, size)
    return d.select(key, "chunk_index", start.alias("start_word"), F.least(start + size, F.col("n")).alias("end_word"), F.size(part).alias("n_words"), F.array_join(part, " ").alias("text"))
