"""Flat, linked tables from nested notice records, over the structural index of nested.py."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rillway.operators.nested import LBRACE, LBRACK, SCALAR, STRING, JsonIndex, blocks, indexed, key_texts

CODE = re.compile(r"\s*([0-9]{8})(?:-[0-9])?\s*\Z")
#: Names of the record format, fixed values.
CLASS_KEYS = ("classification", "main-classification-proc", "additional-classification-proc")
LOT_LISTS, GROUP_LISTS, ITEM_LISTS = ("lots",), ("lot-groups",), ("items",)
LOT_ID, GROUP_ID, ITEM_ID = "lot-id", "group-id", "item-no"
CRITERION_LISTS, CRITERION_TYPE, CRITERION_WEIGHT, QUANTITY = ("award-criteria",), "type", "weight", "quantity"
KINDS = ("notice", "lot", "group", "item", "criterion", "code", "field")
SCHEMA = "row_id BIGINT, entity STRING, node_id INT, parent_id INT, ref STRING, lot_ref STRING, value STRING"
ARROW = pa.schema(
    [("row_id", pa.int64()), ("entity", pa.string()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("ref", pa.string()), ("lot_ref", pa.string()), ("value", pa.string())]
)


def cpv8(text: str | None, number: bool = False) -> str | None:
    """First eight digits of a CPV code with or without check digit; a number may have lost one leading zero."""
    if text is None:
        return None
    if number and len(text) == 7:
        text = "0" + text
    m = CODE.match(text)
    return m[1] if m else None


def _down(ix: JsonIndex, own: np.ndarray) -> np.ndarray:
    """For each token the nearest value >= 0 of own on the way up, itself included; -1 for none. By depth, not by record."""
    got = own.copy()
    if not len(got):
        return got
    for d in range(1, int(ix.level.max(initial=0)) + 1):
        at = np.nonzero((ix.level == d) & (got < 0) & (ix.parent >= 0))[0]
        got[at] = got[ix.parent[at]]
    return got


def _paths(ix: JsonIndex, key: np.ndarray, names: list[str], stop: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Number of each token's path of keys since the last token of stop, in a list of the different paths."""
    paths, known = [""], {(0, -1): 0}
    out = np.zeros(len(ix.kind), np.int64)
    for d in range(0, int(ix.level.max(initial=0)) + 1):
        at = np.nonzero((ix.level == d) & ~stop)[0]
        above = np.where(ix.parent[at] >= 0, out[np.maximum(ix.parent[at], 0)], 0)
        pairs, back = np.unique(np.stack([above, key[at]]), axis=1, return_inverse=True)
        number = np.zeros(pairs.shape[1], np.int64)
        for j, (up, k) in enumerate(pairs.T.tolist()):
            if k < 0:
                number[j] = up
            else:
                if (up, k) not in known:
                    known[up, k] = len(paths)
                    paths.append(f"{paths[up]}.{names[k]}" if paths[up] else names[k])
                number[j] = known[up, k]
        out[at] = number[back.reshape(-1)]
    return out, paths


def _entities(ix: JsonIndex, ids_of: np.ndarray, all_codes: bool, kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The linked rows of the valid records of a block, a batch for each kind; ids_of has the row id of each record."""
    m = len(ix.kind)
    key, names = key_texts(ix)
    number = {x: i for i, x in enumerate(names)}

    def having(wanted) -> np.ndarray:
        return np.isin(key, [number[x] for x in wanted if x in number])

    good = ix.valid[ix.doc] & ix.value
    obj = good & (ix.kind == LBRACE)
    parent = np.maximum(ix.parent, 0)
    ids = {}
    for name in (LOT_ID, GROUP_ID, ITEM_ID, "scheme", QUANTITY, CRITERION_TYPE, CRITERION_WEIGHT):
        at = np.full(m, -1, np.int64)
        leaf = np.nonzero(good & having((name,)) & (ix.kind >= STRING))[0]
        at[ix.parent[leaf]] = leaf
        ids[name] = at

    def members(lists, id_name) -> tuple[np.ndarray, np.ndarray]:
        """Which objects are members of the lists (as sole object, in an array, or under their id as key), and where their id stands."""
        held = having(lists)
        in_array = obj & (ix.parent >= 0) & (ix.kind[parent] == LBRACK) & held[parent]
        sole = obj & held & (ids[id_name] >= 0)
        keyed = obj & (ix.parent >= 0) & (ix.kind[parent] == LBRACE) & held[parent] & (ids[id_name][parent] < 0)
        which = in_array | sole | keyed | (obj & (ids[id_name] >= 0))
        return which, np.where(ids[id_name] >= 0, ids[id_name], np.where(keyed, ix.key, -1))

    is_lot, lot_at = members(LOT_LISTS, LOT_ID)
    is_group, group_at = members(GROUP_LISTS, GROUP_ID)
    held = having(ITEM_LISTS)
    is_item = obj & (((ix.parent >= 0) & (ix.kind[parent] == LBRACK) & held[parent]) | (held & (ids[ITEM_ID] >= 0)))
    number_of = np.arange(m)
    held = having(CRITERION_LISTS)
    is_criterion = obj & ~is_lot & ~is_group & ~is_item & (held | ((ix.parent >= 0) & (ix.kind[parent] == LBRACK) & held[parent]))
    holds_object = np.zeros(m, bool)
    holds_object[ix.parent[obj & (ix.parent >= 0)]] = True
    is_notice = good & (ix.parent < 0) & ((ix.kind == LBRACE) | ((ix.kind == LBRACK) & holds_object)) & ~is_lot & ~is_group & ~is_item & (not all_codes)
    lot = _down(ix, np.where(is_lot & (lot_at >= 0), number_of, -1))
    is_entity = is_notice | is_lot | is_group | is_item | is_criterion
    entity = _down(ix, np.where(is_entity, number_of, -1))
    up = np.where(ix.parent >= 0, entity[parent], -1)
    base = np.searchsorted(ix.doc, np.arange(len(ix.valid)))
    local = number_of - base[ix.doc]
    told = np.zeros(m, bool)  # leaves that an entity's row holds; the others are fields
    told[lot_at[is_lot & (lot_at >= 0)]] = True
    told[group_at[is_group & ~is_lot & (group_at >= 0)]] = True
    for which, names_of in ((is_item & ~is_lot & ~is_group, (ITEM_ID, QUANTITY)), (is_criterion, (CRITERION_TYPE, CRITERION_WEIGHT))):
        for name in names_of:
            at = ids[name][which]
            told[at[at >= 0]] = True

    def batch(name: str, at: np.ndarray, ref: pa.Array, value: pa.Array, above: np.ndarray) -> pa.RecordBatch:
        lots = np.where(lot[at] >= 0, lot_at[np.maximum(lot[at], 0)], -1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids_of[ix.doc[at]], pa.int64()), pa.repeat(name, len(at)), pa.array(local[at], pa.int32()), pa.array(local[np.maximum(above, 0)].astype(np.int32), mask=above < 0),
                ref, pc.fill_null(ix.texts(lots), ""), value,
            ],
            schema=ARROW,
        )

    nothing = lambda at: pa.nulls(len(at), pa.string())
    if not all_codes:
        tables = (
            ("notice", is_notice, None, None), ("lot", is_lot, lot_at, None), ("group", is_group & ~is_lot, group_at, None),
            ("item", is_item & ~is_lot & ~is_group, ids[ITEM_ID], ids[QUANTITY]), ("criterion", is_criterion, ids[CRITERION_TYPE], ids[CRITERION_WEIGHT]),
        )
        for name, which, ref, value in tables:
            if name in kinds:
                at = np.nonzero(which)[0]
                yield batch(name, at, nothing(at) if ref is None else ix.texts(ref[at]), nothing(at) if value is None else ix.texts(value[at]), up[at])

    inside = good.copy() if all_codes else _down(ix, np.where(having(CLASS_KEYS), number_of, -1)) >= 0
    named = (key >= 0) & ~having(("code", "main", "additional", *CLASS_KEYS))
    wrong = _down(ix, np.where(named & inside, number_of, -1)) >= 0 if inside.any() else inside
    leaves = np.nonzero(good & inside & ~wrong & (ix.kind >= STRING))[0]
    schemes = np.where(having(("code",))[leaves] & (ix.parent[leaves] >= 0), ids["scheme"][parent[leaves]], -1)
    scheme = pc.utf8_lower(pc.utf8_trim_whitespace(pc.fill_null(ix.texts(schemes), "cpv")))
    leaves = leaves[pc.equal(scheme, "cpv").to_numpy(zero_copy_only=False)] if len(leaves) else leaves
    forms = ix.texts(leaves).dictionary_encode()
    as_text, as_number = (np.array([cpv8(x, n) for x in forms.dictionary.to_pylist()] + [None], object) for n in (False, True))
    at = pc.fill_null(forms.indices, len(forms.dictionary)).to_numpy()
    code = np.where(ix.kind[leaves] == SCALAR, as_number[at], as_text[at])
    have = np.array([c is not None for c in code], bool)
    told[leaves[have]] = True
    if "code" in kinds:
        yield batch("code", leaves[have], nothing(leaves[have]), pa.array(code[have], pa.string()), entity[leaves[have]])
    if all_codes or "field" not in kinds:
        return
    at = np.nonzero(good & (ix.kind >= STRING) & ~told & (ix.parent >= 0))[0]
    path, paths = _paths(ix, key, names, is_entity)
    yield batch("field", at, pa.array(paths, pa.string()).take(pa.array(path[at])), ix.texts(at), entity[at])


def notice_entities(df: DataFrame, id_col: str, json_col: str, code_list: bool = False, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Notices, lots, lot groups, items, award criteria, codes and fields of nested records as linked rows.

    One row per entity: row_id, entity (one of kinds), node_id (unique within the record), parent_id (node_id of the
    enclosing entity; null for the notice), ref (lot-id, group-id, item number, a criterion's type, or a field's keys
    from its entity down, joined by dots), lot_ref (id of the innermost lot around, the entity included; '' outside of
    lots), value (the code's eight digits, an item's quantity, a criterion's weight, or a field's text). Fields are all
    strings, numbers and literals that no other row holds, so a code of another scheme is one, too.
    With code_list the whole record is a list of codes, which have no parent in it. Null, empty and invalid records give
    no rows; a lot without an id takes the id of the lot around it. A string that holds encoded objects counts as those objects.
    """

    def run(batches):
        for b in batches:
            rows = [(i, x.encode()) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if x is not None]
            for part in blocks(rows):
                for numbers, ix in indexed(part, code_list):
                    yield from _entities(ix, numbers, code_list, kinds)

    src = df.selectExpr(f"cast(`{id_col}` as bigint) as row_id", f"cast(`{json_col}` as string) as body")
    return src.mapInArrow(run, SCHEMA)
