"""Splitting oversized items at natural boundaries, by one bounded-quantifier regular expression.

The alternatives are ordered by the strength of the boundary and consume up to the limit; the last one falls back
to characters. Offsets of the matches come from their lengths, and looking back from them gives the overlap.
Everything is built-in SQL, so it stays within the JVM; sizes count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Marks that end sentences, and marks that may follow them, in the scripts of the corpus.
ENDS = ".!?…。！？؟।"
CLOSERS = "\"'”“’»›)\\]」』）"


def _pattern(size: Column) -> Column:
    """Pattern for pieces of at most `size` new characters; weaker boundaries count only in a piece at least half full."""
    k = size.cast("string")
    half = F.greatest(F.lit(1), F.floor(size / 2)).cast("string")
    bounds = (
        r"(?<=\n)[ \t\r]*(?=\n)|",  # not consumed: a blank line, before its last line feed
        rf"(?<=[{ENDS}][{CLOSERS}]{{0,3}})(?=\s)|(?<=[。！？।][{CLOSERS}]{{0,3}})|",
        r"(?=\n)|",
        r"(?=\s)|(?<=\s)|",
    )
    parts: list[Column] = [F.lit("(?sU)(?:")]
    short = [F.lit(".{"), half, F.lit(","), k, F.lit("}")]
    parts += [F.lit(".{1,"), k, F.lit("}\\z|")]
    for b in bounds:
        parts += [*short, F.lit("(?:" + b.rstrip("|") + ")|")]
    parts += [F.lit(".{1,"), k, F.lit("})")]
    return F.concat(*parts)


def split_items(df: DataFrame, text: str, max_chars: Column, overlap_chars: Column) -> DataFrame:
    """df with a column pieces ARRAY<STRUCT<piece_no, start_char, end_char, text, cut>>.

    An item of at most max_chars code points is one piece. A longer one is cut so that no piece is longer than
    max_chars and each piece after the first begins with the last overlap_chars characters of the one before
    (the overlap is at most max_chars - 1, and less than nothing counts as nothing). cut says what the piece ends
    at: 'end', 'paragraph', 'sentence', 'line', 'space' or 'char'. Without the overlaps the pieces are exactly the
    text. Null text or limit, or a limit below 1, gives null pieces; an empty text gives no piece.
    """
    limit = F.when(max_chars >= 1, max_chars)
    overlap = F.least(F.greatest(F.coalesce(overlap_chars, F.lit(0)), F.lit(0)), limit - 1)
    t = F.col(text)
    steps = F.zip_with("_raw", F.slice("_raw", 2, F.greatest(F.size("_raw"), F.lit(1))), lambda x, nxt: F.struct(x.alias("x"), F.substring(F.coalesce(nxt, F.lit("")), 1, 1).alias("ahead")))
    none = F.array().cast("array<struct<piece_no:int,start_char:int,end_char:int,text:string,cut:string>>")
    pieces = F.aggregate(steps, F.struct(F.lit("").alias("tail"), F.lit(0).alias("end"), none.alias("out")), _step, lambda acc: acc["out"])
    return (
        df.withColumn("_limit", limit)
        .withColumn("_overlap", overlap)
        .withColumn("_raw", F.when(F.length(t) <= F.col("_limit"), F.filter(F.array(t), lambda x: x != "")).otherwise(F.regexp_extract_all(t, _pattern(F.col("_limit") - F.col("_overlap")), F.lit(0))))
        .withColumn("pieces", pieces)
        .drop("_raw", "_limit", "_overlap")
    )


def _step(acc: Column, s: Column) -> Column:
    """One piece more: what it adds, before it the tail of the text so far. Only the tail is carried along, so a piece costs its own length."""
    x, ahead = s["x"], s["ahead"]
    text = F.concat(acc["tail"], x)
    end = acc["end"] + F.length(x)
    tail = F.substring(x, -1, 1)
    last = F.substring(F.regexp_replace(F.right(x, F.lit(4)), rf"[{CLOSERS}]{{1,3}}$", ""), -1, 1)
    cut = (
        F.when(ahead == "", "end")
        .when(((tail == "\n") | x.rlike(r"\n[ \t\r]*\z")) & (ahead == "\n"), "paragraph")
        .when(F.instr(F.lit(ENDS), last) > 0, "sentence")
        .when(ahead == "\n", "line")
        .when(ahead.rlike(r"(?U)^\s") | tail.rlike(r"(?U)^\s"), "space")
        .otherwise("char")
    )
    piece = F.struct(F.size(acc["out"]).alias("piece_no"), (end - F.length(text)).alias("start_char"), end.alias("end_char"), text.alias("text"), cut.alias("cut"))
    return F.struct(F.when(F.col("_overlap") > 0, F.right(text, F.col("_overlap"))).otherwise("").alias("tail"), end.alias("end"), F.concat(acc["out"], F.array(piece)).alias("out"))
