"""Deeply nested JSON records to flat, linked tables, by vectorised structural indexing.

A block of records is laid end to end in one byte array. Bitmaps of quotes (with escapes resolved by the parity
of backslash runs), brackets and delimiters are built for the whole block, in-string state and nesting depth are
prefix sums over them, and the enclosing container of every token is a forward fill in (record, depth, place)
order. The same arrays decide validity, so no second parser is needed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LBRACE, RBRACE, LBRACK, RBRACK, COLON, COMMA, STRING, SCALAR, START = range(9)
BLOCK_BYTES = 4 << 20
_SCALAR = re.compile(rb"(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)\Z")


@dataclass
class JsonIndex:
    """Tokens of a block of records. All arrays are by token; parent and key are token numbers or -1."""

    data: bytes
    valid: np.ndarray
    doc: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    level: np.ndarray
    parent: np.ndarray
    key: np.ndarray
    value: np.ndarray

    def texts(self, at: np.ndarray) -> pa.Array:
        """The strings and scalars at tokens as text; null for null, brackets and -1. Only those with escapes are parsed one by one."""
        at = np.asarray(at, np.int64)
        ok = at >= 0
        ok[ok] = self.kind[at[ok]] >= STRING
        which, back = np.unique(at[ok], return_inverse=True)
        a = np.frombuffer(self.data, np.uint8)
        quoted = self.kind[which] == STRING
        start, end = self.start[which] + quoted, self.end[which] - quoted
        out = spans(a, start, end).cast(pa.string())
        slashes = np.concatenate([[0], np.cumsum(a == 92)])
        escaped = quoted & (slashes[end] > slashes[start])
        if escaped.any():
            parsed = [json.loads(self.data[self.start[t] : self.end[t]]).encode("utf-8", "replace").decode() for t in which[escaped]]
            out = pc.replace_with_mask(out, pa.array(escaped), pa.array(parsed, pa.string()))
        if not quoted.all():
            out = pc.if_else(pc.and_(pa.array(~quoted), pc.equal(out, "null")), pa.scalar(None, pa.string()), out)
        place = np.zeros(len(at), np.int64)
        place[ok] = back
        return out.take(pa.array(place, mask=~ok)) if len(out) else pa.nulls(len(at), pa.string())


def spans(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes between start and end of each span, gathered at once."""
    n = (end - start).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(start - off[:-1], n) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(a[at])])


def structural_index(records: list[bytes]) -> JsonIndex:
    """Index a block of JSON records. Invalid records have valid False; their tokens are meaningless."""
    n = len(records)
    data = b"\n".join(records) + b"\n"
    a = np.frombuffer(data, np.uint8)
    at = np.arange(len(a), dtype=np.int64)
    ends = np.cumsum([len(r) + 1 for r in records]).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    doc_of = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
    valid = np.ones(n, bool)

    slash = a == 92
    last_other = np.maximum.accumulate(np.where(slash, -1, at))
    last_other = np.maximum(last_other, starts[doc_of] - 1)
    run = at - last_other  # length of the backslash run that ends here
    prev_run = np.concatenate([[0], np.where(slash, run, 0)[:-1]])
    quote = (a == 34) & (prev_run % 2 == 0)
    count = np.cumsum(quote)
    base = np.concatenate([[0], count[ends[:-1] - 1]]) if n else count[:0]
    inside = ((count - base[doc_of]) & 1).astype(bool)  # from an opening quote to before its closing quote
    valid[doc_of[inside & (a < 32)]] = False
    starter = np.nonzero(slash & (run % 2 == 1) & inside)[0]
    if len(starter):
        follow = a[np.minimum(starter + 1, len(a) - 1)]
        valid[doc_of[starter[~np.isin(follow, np.frombuffer(b'"\\/bfnrtu', np.uint8))]]] = False
        esc_u = starter[follow == 117]
        for k in range(2, 6):
            c = a[np.minimum(esc_u + k, len(a) - 1)]
            hexa = ((c >= 48) & (c <= 57)) | ((c >= 65) & (c <= 70)) | ((c >= 97) & (c <= 102))
            valid[doc_of[esc_u[~hexa]]] = False

    out = ~inside & ~quote
    kind_of = np.full(256, -1, np.int8)
    for c, k in zip(b"{}[]:,", range(6)):
        kind_of[c] = k
    struct = out & (kind_of[a] >= 0)
    blank = (a == 32) | (a == 9) | (a == 10) | (a == 13)
    word = out & ~struct & ~blank
    word_start = word & ~np.concatenate([[False], word[:-1]])
    word_end = word & ~np.concatenate([word[1:], [False]])
    opening = quote & inside
    tok = np.nonzero(struct | opening | word_start)[0]
    kind = np.where(opening[tok], STRING, np.where(word_start[tok], SCALAR, kind_of[a[tok]])).astype(np.int8)
    doc = doc_of[tok]
    end = tok + 1
    quotes = np.nonzero(quote)[0]
    closing = np.searchsorted(quotes, tok[kind == STRING]) + 1
    end[kind == STRING] = np.where(closing < len(quotes), quotes[np.minimum(closing, max(len(quotes) - 1, 0))] + 1, len(a)) if len(quotes) else 0
    end[kind == SCALAR] = np.nonzero(word_end)[0] + 1
    odd = (count[ends - 1] - base) % 2 == 1 if n else valid
    valid[odd] = False

    opens, closes = (kind == LBRACE) | (kind == LBRACK), (kind == RBRACE) | (kind == RBRACK)
    first_tok = np.searchsorted(doc, np.arange(n))
    total = np.concatenate([[0], np.cumsum(opens.astype(np.int64) - closes)])
    depth = total[1:] - total[first_tok[doc]]  # after the token
    level = depth - opens + closes  # of the container the token stands in
    level = np.where(closes, depth + 1, level)
    valid[doc[depth < 0]] = False
    tokens_in = np.bincount(doc, minlength=n)
    valid[tokens_in == 0] = False
    last_tok = first_tok + tokens_in - 1
    has = tokens_in > 0
    valid[np.nonzero(has)[0][depth[last_tok[has]] != 0]] = False

    # enclosing opener: forward fill over openers (at their own depth) and tokens (at their level)
    m = len(tok)
    which = np.concatenate([np.nonzero(opens)[0], np.arange(m)])
    lev = np.concatenate([depth[opens], level])
    is_open = np.concatenate([np.ones(opens.sum(), bool), np.zeros(m, bool)])
    deep = max(int(lev.max()) + 2, 2) if m else 2
    group = doc[which].astype(np.int64) * deep + np.maximum(lev, 0)
    order = np.lexsort((is_open, which, group))
    mark = np.where(is_open[order], np.arange(len(order)), -1)
    fill = np.maximum.accumulate(mark) if len(mark) else mark
    g = group[order]
    ok = (fill >= 0) & (g[np.maximum(fill, 0)] == g) if len(g) else np.zeros(0, bool)
    holder = np.where(ok, which[order][np.maximum(fill, 0)], -1)
    parent = np.full(m, -1, np.int64)
    child = ~is_open[order]
    parent[which[order][child]] = holder[child]
    parent[level <= 0] = -1

    # grammar on neighbouring tokens
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]]) if m else np.zeros(0, bool)
    prev = np.where(new_doc, START, np.concatenate([[START], kind[:-1]]))
    prev2 = np.where(new_doc | np.concatenate([[True], new_doc[:-1]]), START, np.concatenate([[START, START], kind[:-2]])[:m]) if m else prev
    box = np.where(parent >= 0, kind[np.maximum(parent, 0)], START)  # LBRACE, LBRACK or START
    starts_value = opens | (kind >= STRING)
    is_key = (kind == STRING) & (box == LBRACE) & ((prev == LBRACE) | (prev == COMMA))
    value_ok = np.where(box == START, prev == START, np.where(box == LBRACK, (prev == LBRACK) | (prev == COMMA), prev == COLON))
    prev_key = np.concatenate([[False], is_key[:-1]]) & ~new_doc if m else is_key
    prev_value = np.isin(prev, (RBRACE, RBRACK, SCALAR)) | ((prev == STRING) & ~prev_key)
    good = np.select(
        [is_key, starts_value, kind == COLON, kind == COMMA, kind == RBRACE, kind == RBRACK],
        [True, value_ok, (box == LBRACE) & prev_key, (box != START) & prev_value, (box == LBRACE) & (prev_value | (prev == LBRACE)), (box == LBRACK) & (prev_value | (prev == LBRACK))],
        False,
    )
    valid[doc[~good]] = False
    scalars = np.nonzero(kind == SCALAR)[0]
    if len(scalars):
        forms = spans(a, tok[scalars], end[scalars]).dictionary_encode()
        sound = np.array([bool(_SCALAR.match(x)) for x in forms.dictionary.to_pylist()])
        valid[doc[scalars[~sound[forms.indices.to_numpy()]]]] = False
    key = np.where(starts_value & ~is_key & (box == LBRACE), np.arange(m) - 2, -1)
    return JsonIndex(data, valid, doc, kind, tok, end, level, parent, key, starts_value & ~is_key)


def blocks(rows: list[tuple[int, bytes]], limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Cut (number, record) rows into blocks of about limit bytes; a longer record is a block of its own."""
    part, size = [], 0
    for r in rows:
        if part and size + len(r[1]) > limit:
            yield part
            part, size = [], 0
        part.append(r)
        size += len(r[1]) + 1
    if part:
        yield part


def key_texts(ix: JsonIndex) -> tuple[np.ndarray, list[str]]:
    """Number of each token's key in a list of the distinct keys; -1 for none."""
    out = np.full(len(ix.kind), -1, np.int64)
    at = np.nonzero(ix.key >= 0)[0]
    if not len(at):
        return out, []
    names = ix.texts(ix.key[at]).dictionary_encode()
    out[at] = names.indices.to_numpy()
    return out, names.dictionary.to_pylist()


def indexed(rows: list[tuple[int, bytes]], plain: bool = False) -> Iterator[tuple[np.ndarray, JsonIndex]]:
    """(row numbers, index) of a block of (number, record), in which no string holds an encoded container any more.

    A string that is itself JSON of an object, or of an array with objects in it (with plain, of any array), is put into its record
    as that object or array, and the records changed so are indexed as a block of their own, until none is left; in
    the index of the block they came from they count as invalid.
    """
    while rows:
        ix = structural_index([r for _, r in rows])
        numbers = np.array([i for i, _ in rows])
        a = np.frombuffer(ix.data, np.uint8)
        at = np.nonzero(ix.value & (ix.kind == STRING) & ix.valid[ix.doc])[0]
        at = at[np.isin(a[np.minimum(ix.start[at] + 1, len(a) - 1)], np.frombuffer(b"[{ \\", np.uint8))]
        inner = [(t, x.strip().encode()) for t, x in zip(at.tolist(), ix.texts(at).to_pylist()) if x.strip()[:1] in ("{", "[") and (plain or "{" in x)] if len(at) else []
        if inner:
            good = structural_index([x for _, x in inner]).valid
            inner = [x for x, ok in zip(inner, good) if ok]
        changed: dict[int, list[tuple[int, bytes]]] = {}
        for t, x in inner:
            changed.setdefault(int(ix.doc[t]), []).append((t, x))
        again = []
        for d, parts in changed.items():
            begin = int(ix.start[np.searchsorted(ix.doc, d)])
            out = []
            for t, x in parts:
                out += [ix.data[begin : ix.start[t]], x]
                begin = int(ix.end[t])
            last = int(ix.end[np.searchsorted(ix.doc, d, "right") - 1])
            again.append((rows[d][0], b"".join([*out, ix.data[begin:last]])))
        ix.valid[list(changed)] = False
        yield numbers, ix
        rows = again
