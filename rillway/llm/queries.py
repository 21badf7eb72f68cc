"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from rillway.llm import canon, langid, mix, names, pack, scans, sentences, split, tokens
from rillway.session import Scratch, spread, table

P6_FIELDS = ["notice_title", "description_proc", "buyer_name"]


def _p6(spark: SparkSession, d: str) -> DataFrame:
    return canon.canonical_text(spread(table(spark, d, "ted_notices").select("notice_row_id", *P6_FIELDS)), P6_FIELDS, ["notice_row_id"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cases = F.filter(F.array(*[F.when(F.col(c + "_differs"), F.lit(c)) for c in P6_FIELDS]), lambda x: x.isNotNull())
    return _p6(spark, d).select("notice_row_id", F.explode(cases).alias("field_name"))


def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).select("notice_row_id", *P6_FIELDS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    who = names.link_names(table(spark, d, "ted_notices"), "buyer_name")
    a = who.select(F.col("name").alias("name_a"), "entity")
    return a.join(who.select(F.col("name").alias("name_b"), "entity"), "entity").where("name_a < name_b").select("name_a", "name_b")


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each different buyer name with its class and the number of other spellings linked to it."""
    who = names.link_names(table(spark, d, "ted_notices"), "buyer_name")
    size = who.groupBy("entity").agg(F.count("*").alias("n"), F.min("name").alias("class_name"))
    return who.join(size, "entity").select("name", "class_name", (F.col("n") - 1).alias("n_links"))


def _p7(spark: SparkSession, d: str) -> DataFrame:
    """Sections and paragraphs with their pieces; the limits are a table of two rows."""
    limits = F.broadcast(table(spark, d, "split_limits"))
    both = None
    for name, key in (("doc_sections", "section_row_id"), ("doc_paragraphs", "paragraph_row_id")):
        t = spread(table(spark, d, name).select(key, "text")).select(F.lit(name).alias("item_table"), F.col(key).alias("row_id"), "text")
        both = t if both is None else both.unionByName(t)
    return split.split_items(both.join(limits, "item_table"), "text", F.col("max_chars"), F.col("overlap_chars"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that were cut, and whether a stretch without white space exceeds the limit."""
    stretch = F.array_max(F.transform(F.split("text", r"(?U)\s+"), lambda w: F.length(w)))
    return _p7(spark, d).where("size(pieces) > 1").select("item_table", "row_id", F.when(stretch > F.col("max_chars"), 1).otherwise(0).alias("unbroken"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).select("item_table", "row_id", F.inline("pieces")).withColumn("n", F.length("text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def _p2_model(spark: SparkSession, d: str) -> langid.Model:
    more = table(spark, d, "documents").select("doc_id", "text", "lang")
    return langid.fit_language_model(table(spark, d, "cpv_notice_examples"), "example_id", "example_text", "language", table(spark, d, "cpv_catalog"), more)


def _p2_examples(spark: SparkSession, d: str, model: langid.Model) -> DataFrame:
    return langid.label_texts(spread(table(spark, d, "cpv_notice_examples").select("example_id", "example_text", "language")), "example_id", "example_text", "language", model)


def _p2_segments(spark: SparkSession, d: str, model: langid.Model) -> DataFrame:
    return langid.label_segments(spread(table(spark, d, "ted_notices").select("notice_row_id", "description_proc", "official_languages_json")), "notice_row_id", "description_proc", "official_languages_json", model)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    model = _p2_model(spark, d)
    ex = _p2_examples(spark, d, model).where("wrong").select(F.lit("cpv_notice_examples").alias("table_name"), F.col("example_id").alias("row_id"), "lang")
    seg = _p2_segments(spark, d, model).where("not is_named and lang <> 'und'").select(F.lit("ted_notices").alias("table_name"), F.col("notice_row_id").alias("row_id"), "lang")
    return ex.unionByName(seg.distinct())


def p2_examples(spark: SparkSession, d: str) -> DataFrame:
    return _p2_examples(spark, d, _p2_model(spark, d)).withColumn("confidence", F.round("confidence", 3))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    return _p2_segments(spark, d, _p2_model(spark, d)).withColumn("confidence", F.round("confidence", 3))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    lines, words = scans.findings(spread(table(spark, d, "doc_sections").select("section_row_id", "text", "doc_id", "program_name")), "section_row_id", "text", "doc_id", "program_name")
    frame = lines.select(F.col("key").alias("section_row_id"), F.lit("line").alias("kind"), F.explode(F.col("frame").cast("array<string>")).alias("found"))
    return frame.unionByName(words.select(F.col("key").alias("section_row_id"), F.lit("word").alias("kind"), F.col("right").alias("found")).distinct())


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Repaired paragraphs of all doc_sections and doc_paragraphs, numbered from 0 within the row they begin in.

    The rows of doc_paragraphs are put together to their sections again first, so a torn paragraph becomes one; n_rows
    is the number of rows it runs over, and a row that only goes on with a paragraph of an earlier one has none of its own.
    Repeated rows each have their paragraphs.
    """
    lines, _ = scans.repair(spread(table(spark, d, "doc_sections").select("section_row_id", "text", "doc_id", "program_name")), "section_row_id", "text", "doc_id", "program_name")
    whole = lines.select(F.lit("doc_sections").alias("item_table"), F.col("key").alias("row_id"), F.posexplode("paras").alias("paragraph_no", "text"), F.lit(1).alias("n_rows"))
    p = table(spark, d, "doc_paragraphs").where("text is not null")
    one = p.groupBy("doc_id", "section_id", "paragraph_index", "text").agg(F.collect_list("paragraph_row_id").alias("ids"), F.min("paragraph_row_id").alias("id"), F.min("program_name").alias("program_name"))
    sections = one.groupBy("doc_id", "section_id").agg(
        F.min("id").alias("key"), F.min("program_name").alias("program_name"), F.array_sort(F.collect_list(F.struct("paragraph_index", "id", "text", "ids"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda x: x["text"]), "\n\n")
    torn, _ = scans.repair(sections.select("key", text.alias("text"), "doc_id", "program_name"), "key", "text", "doc_id", "program_name")
    # the line each part starts at; between two parts is one blank line
    by_section = Window.partitionBy("key")
    n_lines = F.size(F.split("part.text", "\n")) + 1
    parts = sections.select("key", F.posexplode("parts").alias("at", "part")).select(
        "key", "at", "part.ids", F.coalesce(F.sum(n_lines).over(by_section.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("start")
    )
    starts = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("starts"))
    begun = lambda line: F.size(F.filter("starts", lambda x: x["start"] <= line))
    pieces = torn.select("key", "first", F.posexplode(F.arrays_zip(F.col("paras").alias("text"), F.col("first").alias("a"), F.col("last").alias("z"))).alias("no", "para")).join(starts.hint("merge"), "key")
    pieces = pieces.withColumn("row", begun(F.col("para.a"))).withColumn("part", F.element_at("starts", F.col("row")))
    before = F.size(F.filter("first", lambda x: x < F.col("part.start")))
    again = pieces.select(F.lit("doc_paragraphs").alias("item_table"), F.explode("part.ids").alias("row_id"), (F.col("no") - before).alias("paragraph_no"), F.col("para.text").alias("text"), (begun(F.col("para.z")) - F.col("row") + 1).alias("n_rows"))
    return whole.unionByName(again)


def _sized(spark: SparkSession, d: str) -> DataFrame:
    t = tokens.with_token_counts(spread(table(spark, d, "documents").select(F.col("doc_id").alias("item"), "source", "text")), "text")
    return t.select("item", "source", F.col("n_tokens").alias("n"))


def _p8(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(_sized(spark, d), table(spark, d, "pack_sizes").select("container_name", F.col("capacity_tokens").alias("capacity")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d).select("container_name", "container_id", F.col("item").alias("doc_id"), "part_no", F.col("n").alias("n_tokens"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each kind of container: how many were used, how many are needed at least by the dual-feasible bound over all documents, and the share of room used."""
    sizes = table(spark, d, "pack_sizes").select("container_name", F.col("capacity_tokens").alias("capacity"))
    items = Scratch(spark).cut(_sized(spark, d))
    p = pack.pack(items, sizes)
    used = p.groupBy("container_name", "capacity").agg(F.countDistinct("container_id").alias("containers"), F.sum("n").alias("tokens"), F.countDistinct("item").alias("documents"))
    return used.join(pack.least_containers(items, sizes), "container_name").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4))


def _p9(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix.mix(_sized(spark, d), table(spark, d, "mix_targets"))


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[0].select(F.col("item").alias("doc_id"), "source", F.col("n").alias("n_tokens"), "copies")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p9(spark, d)[1].withColumn("actual_share", F.round("actual_share", 5))


QUERIES = {f.__name__: f for f in (p8_containers, p8_report, p9_copies, p9_shares, p3_found, p3_paragraphs, p2_found, p2_examples, p2_segments, p10_found, p7_found, p7_pieces, p5_found, p5_entities, p6_found, p6_canonical)}
_P6 = canon.inner_sql("ted_notices", P6_FIELDS, ["notice_row_id"])
_P7 = """(select 'doc_sections' item_table, section_row_id row_id, text from doc_sections union all select 'doc_paragraphs', paragraph_row_id, text from doc_paragraphs)"""
ORACLE = {
    "p7_found": rf"""select item_table, row_id, (list_max(list_transform(regexp_split_to_array(text, '[\s\p{{Z}}\x{{85}}]+'), lambda w: length(w))) > max_chars)::int unbroken
        from {_P7} join split_limits using (item_table) where length(text) > max_chars""",
    "p6_found": f"select notice_row_id, field_name from (select notice_row_id, unnest([{', '.join(f'{{f: {chr(39)}{c}{chr(39)}, d: {c}_differs}}' for c in P6_FIELDS)}], recursive := true) from ({_P6})) t(notice_row_id, field_name, d) where d",
    "p6_canonical": f"select notice_row_id, {', '.join(P6_FIELDS)} from ({_P6})",
}
