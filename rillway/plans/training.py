"""Queries of the general training-data problems: nested records (p1) and hierarchies (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillway.operators.hierarchy import ancestor_paths, descendants, hierarchy
from rillway.operators.records import notice_entities
from rillway.session import spread, table


def _raw(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    return notice_entities(spread(table(spark, d, "ted_notices").select("notice_row_id", "raw_notice_json")), "notice_row_id", "raw_notice_json", kinds=kinds)


def p1_codes(spark: SparkSession, d: str) -> DataFrame:
    """Each code with the node it stands at and the item, lot, group or notice that holds it; a code of the list (origin 'codes') has the notice row itself as parent, and parent_id null."""
    t = table(spark, d, "ted_notices")
    raw = _raw(spark, d, "code").withColumn("origin", F.lit("raw"))
    listed = notice_entities(t, "notice_row_id", "all_cpv_codes_json", code_list=True).withColumn("origin", F.lit("codes"))
    return raw.unionByName(listed).select(F.col("row_id").alias("notice_row_id"), "origin", "node_id", "parent_id", "lot_ref", F.col("value").alias("cpv_code"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_codes(spark, d).select("notice_row_id", "origin", "lot_ref", "cpv_code").distinct()


def p1_notices(spark: SparkSession, d: str) -> DataFrame:
    """Each notice row with the node of its raw notice, the parent of what stands at the top; null where the raw notice is unusable."""
    t = table(spark, d, "ted_notices").select("notice_row_id", "publication_number")
    return t.join(_raw(spark, d, "notice").select(F.col("row_id").alias("notice_row_id"), "node_id").hint("merge"), "notice_row_id", "left")


def p1_criteria(spark: SparkSession, d: str) -> DataFrame:
    """Award criteria with the node of the lot, group, item or notice that holds them."""
    return _raw(spark, d, "criterion").select(F.col("row_id").alias("notice_row_id"), "node_id", "parent_id", "lot_ref", F.col("ref").alias("criterion_type"), F.col("value").alias("weight"))


def p1_fields(spark: SparkSession, d: str) -> DataFrame:
    """All values of the raw notices that no other table holds, such as titles and official languages, with the node of what they belong to."""
    return _raw(spark, d, "field").select(F.col("row_id").alias("notice_row_id"), "node_id", "parent_id", "lot_ref", F.col("ref").alias("field"), "value")


def p1_lots(spark: SparkSession, d: str) -> DataFrame:
    """Lots with the node of the lot, lot group or notice that holds them."""
    return _raw(spark, d, "lot", "group").select(F.col("row_id").alias("notice_row_id"), "entity", "node_id", "parent_id", "ref")


def p1_items(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d, "item").select(
        F.col("row_id").alias("notice_row_id"), "node_id", "parent_id", "lot_ref", F.col("ref").cast("int").alias("item_no"), F.col("value").cast("int").alias("quantity")
    )


def _eight(col: str):
    digits = F.regexp_replace(F.col(col), "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.substring(digits, 1, 8))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "cpv_profiles").select("source_fingerprint", _eight("code").alias("code"), _eight("parent_code").alias("parent_code"))
    return hierarchy(p, "source_fingerprint", "code", "parent_code")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select(
        F.col("scope").alias("source_fingerprint"), F.col("node").alias("code"), F.coalesce("root", F.lit("")).alias("root_code"), "depth"
    )


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    paths = ancestor_paths(tree)
    return tree.where("not in_cycle").join(paths, ["scope", "node"]).select(
        F.col("scope").alias("source_fingerprint"), F.col("node").alias("code"), F.array_join("path", "/").alias("path"), "depth", "n_descendants"
    )


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each code with each of its descendants, one row per pair, so no list of descendants has to fit one row."""
    return descendants(_tree(spark, d)).select(F.col("scope").alias("source_fingerprint"), F.col("node").alias("code"), F.col("descendant").alias("descendant_code"))


QUERIES = {f.__name__: f for f in (p1_found, p1_notices, p1_lots, p1_items, p1_criteria, p1_codes, p1_fields, p4_found, p4_paths, p4_descendants)}

_TREE = """with recursive src as (
  select coalesce(source_fingerprint, '') f, regexp_replace(code, '[^0-9]', '', 'g') c, regexp_replace(parent_code, '[^0-9]', '', 'g') p from cpv_profiles),
 n as (select distinct f, substr(c, 1, 8) c from src where length(c) >= 8),
 l as (select f, substr(c, 1, 8) c, min(substr(p, 1, 8)) p from src where length(c) >= 8 and length(p) >= 8
       and (f, substr(p, 1, 8)) in (select (f, c) from n) group by all),
 t as (select n.f, n.c, n.c root, 0 depth, n.c path from n left join l on n.f = l.f and n.c = l.c where l.c is null
       union all select l.f, l.c, t.root, t.depth + 1, t.path || '/' || l.c from t join l on l.f = t.f and l.p = t.c)
"""
_NESTED = r"""with v as (select notice_row_id id, raw_notice_json::json j from ted_notices where json_valid(raw_notice_json)),
 t1 as (select v.id, x.fullkey fk, x.path pa, x.key k, x.type ty, x.atom ->> '$' a from v, json_tree(v.j) x),
 en as (select id, fk, a::json j from t1 where ty = 'VARCHAR' and regexp_matches(a, '^\s*[\[{]') and contains(a, '{') and json_valid(a)),
 t2 as (select en.id, en.fk || substr(x.fullkey, 2) fk, en.fk || substr(x.path, 2) pa, x.key k, x.type ty, x.atom ->> '$' a from en, json_tree(en.j) x),
 tr as (select * from t1 union all select * from t2),
 named as (select id, pa fk, a lot from tr where k = 'lot-id' and ty not in ('OBJECT', 'ARRAY', 'NULL')),
 lots as (select * from named union all select o.id, o.fk, o.k from tr o where o.ty = 'OBJECT' and regexp_matches(o.pa, '\."?lots"?$') and o.k is not null and regexp_matches(o.fk, '\."?lots"?\.[^\[\]]*$') and not exists (select 1 from named n where n.id = o.id and (n.fk = o.pa or n.fk = o.fk))),
 sch as (select id, pa, lower(trim(a)) s from tr where k = 'scheme' and ty = 'VARCHAR'),
 lf as (select tr.id, fk, case when ty in ('UBIGINT', 'BIGINT') and length(a) = 7 then '0' || a else a end a, s from tr left join sch on tr.k = 'code' and sch.id = tr.id and sch.pa = tr.pa where ty not in ('OBJECT', 'ARRAY', 'NULL') and regexp_matches(fk, '\."?(classification|main-classification-proc|additional-classification-proc)"?(\[\d+\]|\."?(code|main|additional)"?)*$')),
 cd as (select id, fk, regexp_extract(a, '^\s*(\d{8})(?:-\d)?\s*$', 1) code from lf where coalesce(s, 'cpv') = 'cpv'),
 wl as (select cd.id, cd.fk, code, arg_max(lot, length(lots.fk)) lot from cd left join lots on lots.id = cd.id and starts_with(cd.fk, lots.fk || '.') where code <> '' group by all),
 c0 as (select notice_row_id id, all_cpv_codes_json::json j from ted_notices where json_valid(all_cpv_codes_json)),
 c1 as (select c0.id, x.fullkey fk, x.path pa, x.key k, x.type ty, x.atom ->> '$' a from c0, json_tree(c0.j) x),
 cs as (select id, pa, lower(trim(a)) s from c1 where k = 'scheme' and ty = 'VARCHAR'),
 c2 as (select c1.id, regexp_extract(case when ty in ('UBIGINT', 'BIGINT') and length(a) = 7 then '0' || a else a end, '^\s*(\d{8})(?:-\d)?\s*$', 1) code, s from c1 left join cs on c1.k = 'code' and cs.id = c1.id and cs.pa = c1.pa where ty not in ('OBJECT', 'ARRAY', 'NULL') and regexp_matches(fk, '^\$(\[\d+\]|\."?(code|main|additional)"?)*$'))
select distinct id notice_row_id, 'raw' origin, coalesce(lot, '') lot_ref, code cpv_code from wl union select id, 'codes', '', code from c2 where code <> '' and coalesce(s, 'cpv') = 'cpv'"""
ORACLE = {
    "p1_found": _NESTED,
    "p4_found": _TREE + "select n.f source_fingerprint, n.c code, coalesce(t.root, '') root_code, coalesce(t.depth, -1)::int depth from n left join t on n.f = t.f and n.c = t.c",
    "p4_paths": _TREE + "select f source_fingerprint, c code, path, depth::int depth, (select count(*) from t d where d.f = t.f and starts_with(d.path, t.path || '/')) n_descendants from t",
    "p4_descendants": _TREE + "select a.f source_fingerprint, a.c code, b.c descendant_code from t a join t b on a.f = b.f and starts_with(b.path, a.path || '/')",
}
