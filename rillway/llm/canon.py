"""One consistent form for text that looks the same, by SQL in DuckDB inside Arrow partitions.

Compatibility forms, decomposed accents, invisible signs, kinds of space and look-alike letters are mapped by
nfc_normalize, translate and regular expressions; signs that look different (superscripts, dashes, typographic
quotes) and words properly written in another script stay.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

#: Letters of other scripts and the Latin letters that look the same.
CYRILLIC = "аеорсухіѕјһԁԛԝАВЕЅІЈКМНОРСТУХ"
CYRILLIC_AS_LATIN = "aeopcyxisjhdqwABESIJKMHOPCTYX"
GREEK = "ονιαρυκχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_AS_LATIN = "oviapukxABEZHIKMNOPTYX"
#: The way back, for a Latin letter within a word of the other script.
LATIN_IN_CYRILLIC, AS_CYRILLIC = "aeopcyxABEKMHOPCTYX", "аеорсухАВЕКМНОРСТУХ"
LATIN_IN_GREEK, AS_GREEK = "oviapukxABEZHIKMNOPTYX", "ονιαρυκχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
#: Compatibility letters of more than one character.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj", "ǳ": "dz"}
WIDE = "".join(chr(0xFF01 + i) for i in range(94))
WIDE_AS = "".join(chr(0x21 + i) for i in range(94))
INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"
SPACES = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
HYPHENS = r"[\x{2010}\x{2011}]"
OTHER = r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}]"
ALIKE = f"[{CYRILLIC}{GREEK}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _plain(x: str) -> str:
    """SQL: all but the look-alike letters."""
    sql = f"translate(nfc_normalize({x}), {_q(WIDE)}, {_q(WIDE_AS)})"
    sql = f"regexp_replace({sql}, {_q(INVISIBLE)}, '', 'g')"
    sql = f"regexp_replace({sql}, {_q(SPACES)}, ' ', 'g')"
    sql = f"regexp_replace({sql}, {_q(HYPHENS)}, '-', 'g')"
    for a, b in LIGATURES.items():
        sql = f"replace({sql}, {_q(a)}, {_q(b)})"
    return f"nfc_normalize({sql})"


_MIXED = rf"\p{{Latin}}\p{{M}}*{OTHER}|{OTHER}\p{{M}}*\p{{Latin}}"
_LONE = rf"(?:^|\p{{Latin}}[^\p{{L}}]+)(?:{ALIKE}+[^\p{{L}}]+)+\p{{Latin}}|^[^\p{{L}}]*{ALIKE}+[^\p{{L}}]+\p{{Latin}}|\p{{Latin}}(?:[^\p{{L}}]+{ALIKE}+)+[^\p{{L}}]*$"


def differs_sql(x: str, plain: str) -> str:
    """SQL: text x holds a character in place of, or besides, the usual one. plain is its _plain form."""
    return f"({x} <> {plain} or regexp_matches({plain}, {_q(_MIXED)}) or regexp_matches({plain}, {_q(_LONE)}))"


def _word(tokens: str, i: str) -> str:
    """SQL: token i of tokens (words and what stands between them) with the look-alike letters of its own script."""
    w = f"{tokens}[{i}]"
    latin = f"translate(translate({w}, {_q(CYRILLIC)}, {_q(CYRILLIC_AS_LATIN)}), {_q(GREEK)}, {_q(GREEK_AS_LATIN)})"
    only = f"regexp_full_match({w}, {_q(ALIKE + '+')})"
    beside = rf"coalesce(regexp_matches({tokens}[{i} - 2], '\p{{Latin}}$'), true) and coalesce(regexp_matches({tokens}[{i} + 2], '^\p{{Latin}}'), true) and len({tokens}) > 2"
    return (
        f"case when {only} and {beside} then {latin}"
        f" when not regexp_matches({w}, {_q(_MIXED)}) then {w}"
        rf" when regexp_matches(translate({w}, {_q(CYRILLIC)}, ''), '\p{{Cyrillic}}') then translate({w}, {_q(LATIN_IN_CYRILLIC)}, {_q(AS_CYRILLIC)})"
        rf" when regexp_matches(translate({w}, {_q(GREEK)}, ''), '\p{{Greek}}') then translate({w}, {_q(LATIN_IN_GREEK)}, {_q(AS_GREEK)})"
        f" else {latin} end"
    )


def canonical_sql(plain: str) -> str:
    """SQL: the consistent form of a text whose _plain form is given."""
    rough = f"(regexp_matches({plain}, {_q(_MIXED)}) or regexp_matches({plain}, {_q(ALIKE)}))"
    tokens = rf"regexp_extract_all(' ' || {plain}, '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}]+')"
    return f"case when {rough} then (select substr(array_to_string(list_transform(range(1, len(tk) + 1), lambda i: {_word('tk', 'i')}), ''), 2) from (select {tokens} tk)) else {plain} end"


def inner_sql(source: str, columns: list[str], keep: list[str]) -> str:
    """SQL over a table of texts: keep, and of each column c its consistent form c and whether the text differs from it, c_differs."""
    plains = ", ".join(f"{c} as x_{c}, {_plain(c)} as p_{c}" for c in columns)
    outs = ", ".join(f"{canonical_sql('p_' + c)} as {c}, {differs_sql('x_' + c, 'p_' + c)} as {c}_differs" for c in columns)
    head = ", ".join(keep)
    return f"select {head}{', ' if head else ''}{outs} from (select {head}{', ' if head else ''}{plains} from {source})"


def canonical_text(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """keep, and for each of columns its consistent form under the same name and a BOOLEAN <name>_differs.

    Null stays null in both; empty and very long texts are treated like any other. No rows are added or lost, and
    other columns of df are left out.
    """
    src = df.select(*keep, *columns)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keep] + [f"`{c}` string, `{c}_differs` boolean" for c in columns])
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    names = {k: f"k{i}" for i, k in enumerate(keep)} | {c: f"c{i}" for i, c in enumerate(columns)}
    sql = inner_sql("batch", [names[c] for c in columns], [names[k] for k in keep])
    final = [x for k in keep for x in [k]] + [x for c in columns for x in (c, c + "_differs")]

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        for b in batches:
            con.register("batch", pa.Table.from_batches([b.rename_columns([names[n] for n in b.schema.names])]))
            for part in con.sql(sql).to_arrow_table().to_batches():
                yield part.rename_columns(final)

    assert set(kinds) == set(keep) | set(columns)
    return src.mapInArrow(run, schema)
