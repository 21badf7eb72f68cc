import json

from hypothesis import given, settings, strategies as st

from rillway.operators.nested import LBRACE, LBRACK, structural_index
from rillway.operators.records import cpv8, notice_entities
from rillway.plans import training

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4),
    max_leaves=12,
)


def strict(raw: str) -> bool:
    def bad(_):
        raise ValueError

    try:
        json.loads(raw, parse_constant=bad)
        return True
    except ValueError:
        return False


@settings(max_examples=200, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=4), st.integers(0, 60), st.sampled_from(['"', "{", "]", ",", ":", "\\", "1", " ", ""]))
def test_validity_equals_a_parser(docs, at, char):
    raws = [json.dumps(d, ensure_ascii=False) for d in docs]
    spoiled = [r[: at % (len(r) + 1)] + char + r[at % (len(r) + 1) + 1 :] for r in raws]
    both = raws + [s for s in spoiled if "\n" not in s]
    ix = structural_index([r.encode() for r in both])
    assert ix.valid.tolist() == [strict(r) for r in both]


@settings(max_examples=100, deadline=None)
@given(VALUES)
def test_number_of_values_and_keys(doc):
    ix = structural_index([json.dumps(doc).encode()])

    def count(x):
        return 1 + (sum(map(count, x.values())) if isinstance(x, dict) else sum(map(count, x)) if isinstance(x, list) else 0)

    assert int(ix.value.sum()) == count(doc)
    for i in range(len(ix.kind)):
        if ix.value[i] and ix.parent[i] >= 0:
            assert ix.kind[ix.parent[i]] in (LBRACE, LBRACK)


def test_entities_link_to_their_parents(spark):
    doc = {
        "internal-reference": "20248714",
        "main-classification-proc": ["45000000-7", None],
        "lots": [{"lot-id": "L1", "classification": {"main": {"scheme": "CPV", "code": " 33000000 "}}, "lots": {"L2": {"items": [{"item-no": 1, "quantity": 3, "classification": 44000000}]}}}, {"classification": [{"scheme": "nuts", "code": "12345678"}]}],
        "lot-groups": [{"group-id": "G", "lots": {"lot-id": "L3", "classification": "55000000"}}],
    }
    df = spark.createDataFrame([(1, json.dumps(doc), "x"), (2, None, "x"), (3, "", "x"), (4, '{"lots": [', "x"), (5, "[]", "x")], "id long, j string, row_id string")
    rows = notice_entities(df, "id", "j").collect()
    assert {r.row_id for r in rows} == {1}
    codes = {(r.lot_ref, r.value) for r in rows if r.entity == "code"}
    assert codes == {("", "45000000"), ("L1", "33000000"), ("L2", "44000000"), ("L3", "55000000")}
    by = {r.node_id: r for r in rows}
    l2 = next(r for r in rows if r.ref == "L2")
    assert by[l2.parent_id].ref == "L1"
    item = next(r for r in rows if r.entity == "item")
    assert by[item.parent_id].ref == "L2" and item.value == "3"
    l3 = next(r for r in rows if r.ref == "L3")
    assert by[l3.parent_id].entity == "group"


def test_every_value_is_in_a_linked_row(spark):
    doc = {
        "official-language": ["DE", None],
        "notice-title": {"deu": "Titel"},
        "main-classification-proc": "45000000-7",
        "lots": [{"lot-id": "L1", "title": "Los", "award-criteria": [{"type": "price", "weight": 60}, {"type": "quality", "weight": 40}], "classification": {"scheme": "nuts", "code": "DE229"}, "items": [{"item-no": 1, "quantity": 3, "classification": {"code": "44000000"}}]}],
    }
    rows = notice_entities(spark.createDataFrame([(1, json.dumps(doc)), (2, "[]")], "id long, j string"), "id", "j").collect()
    by = {r.node_id: r for r in rows}
    assert len(by) == len(rows) and {r.row_id for r in rows} == {1}
    above = lambda r: (by[r.parent_id].entity, by[r.parent_id].ref)
    assert [r.entity for r in rows if r.parent_id is None] == ["notice"]
    assert {(r.value, *above(r)) for r in rows if r.entity == "code"} == {("45000000", "notice", None), ("44000000", "item", "1")}
    assert {(r.ref, r.value, *above(r)) for r in rows if r.entity == "criterion"} == {("price", "60", "lot", "L1"), ("quality", "40", "lot", "L1")}
    assert sorted((r.ref, str(r.value), above(r)[0]) for r in rows if r.entity == "field") == [
        ("classification.code", "DE229", "lot"), ("classification.scheme", "nuts", "lot"), ("notice-title.deu", "Titel", "notice"), ("official-language", "DE", "notice"), ("official-language", "None", "notice"), ("title", "Los", "lot")
    ]


def test_p1_tables_are_linked(spark, tables):
    notices = {(r.notice_row_id, r.node_id) for r in training.p1_notices(spark, tables).collect()}
    assert len(notices) == spark.read.parquet(f"{tables}/ted_notices.parquet").count()
    lots = {(r.notice_row_id, r.node_id): r.parent_id for r in training.p1_lots(spark, tables).collect()}
    items = {(r.notice_row_id, r.node_id): r.parent_id for r in training.p1_items(spark, tables).collect()}
    criteria = {(r.notice_row_id, r.node_id): r.parent_id for r in training.p1_criteria(spark, tables).collect()}
    codes = {(r.notice_row_id, r.node_id): r.parent_id for r in training.p1_codes(spark, tables).where("origin = 'raw'").collect()}
    known = notices | lots.keys() | items.keys() | criteria.keys()
    for child in (lots, items, criteria, codes):
        assert child and all((n, p) in known for (n, _), p in child.items())
    fields = training.p1_fields(spark, tables).collect()
    assert {"official-language", "title"} <= {r.field for r in fields} and all((r.notice_row_id, r.parent_id) in known for r in fields)


def test_code_lists(spark):
    df = spark.createDataFrame([(1, '["45000000-7", ["33000000"], []]'), (2, '[{"code": "55000000", "main": true}]'), (3, '"  66000000 "'), (4, "null"), (5, "nope")], "id long, j string")
    got = {(r.row_id, r.value) for r in notice_entities(df, "id", "j", code_list=True).collect()}
    assert got == {(1, "45000000"), (1, "33000000"), (2, "55000000"), (3, "66000000")}


def test_cpv8():
    assert [cpv8(x) for x in ("45000000", "45000000-1", "4500000", "450000001", "a45000000", None)] == ["45000000", "45000000", None, None, None, None]
    assert cpv8("9000000", True) == "09000000"


def test_encoded_objects_are_decoded(spark):
    inner = json.dumps([{"lot-id": "L1", "classification": "45000000", "items": json.dumps([{"item-no": 1, "quantity": 2, "classification": "33000000-1"}])}, {"lot-id": "L2", "title": "ä\t[x]"}])
    df = spark.createDataFrame([(1, json.dumps({"title": "[1] is no list", "lots": inner})), (2, json.dumps(json.dumps({"main-classification-proc": "44000000"}))), (3, json.dumps({"lots": "[{broken"}))], "id long, j string")
    rows = notice_entities(df, "id", "j").collect()
    by = {(r.row_id, r.node_id): r for r in rows}
    assert len(by) == len(rows)
    assert {(r.row_id, r.lot_ref, r.value) for r in rows if r.entity == "code"} == {(1, "L1", "45000000"), (1, "L1", "33000000"), (2, "", "44000000")}
    assert {(r.row_id, r.ref, r.value) for r in rows if r.entity == "field"} == {(1, "title", "[1] is no list"), (1, "title", "ä\t[x]"), (3, "lots", "[{broken")}
    item = next(r for r in rows if r.entity == "item")
    assert by[1, item.parent_id].ref == "L1" and by[1, by[1, item.parent_id].parent_id].entity == "notice"
