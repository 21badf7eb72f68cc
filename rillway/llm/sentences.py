"""Sentence boundaries across languages and scripts, by semi-Markov dynamic programming over whole spans.

A text is cut into blocks at breaks that are certain (blank lines, line feeds that don't wrap a paragraph). Within
a block every place that could end a sentence is a candidate; the best sequence of whole spans between candidates
is chosen, where a span is scored by its length, the word that opens it, the word that closes it and whether
quotations are balanced in it.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame

#: Abbreviations that end in a full stop and seldom end a sentence, lower case, by language.
ABBREVIATIONS = set(
    "abs art nr z b d h ca bzw usw co dipl ing dr prof hr fr str vgl ggf inkl zzgl bzgl evtl kap anl lit tel st max min allg sog u a o i s f ff bd hrsg jh mio mrd "  # German
    "no sect approx sen rep gov gen capt lt col sgt rev hon st e.g i.e ltd inc mr mrs ms vs fig vol pp jr sr dept est cf al messrs "  # English
    "p ex env m mm mme mlle c.-à-d c.-à art chap av boul éd hab ann réf tél "  # French
    "núm aprox sra dña ej cía admón págs pág avda c/ "  # Spanish
    "lda exmo av n.º cf "  # Portuguese
    "es dott dott.ssa sig ing avv geom n cfr s.p.a s.r.l ca pag "  # Italian
    "bijv d.w.z dhr mevr enz blz incl excl m.b.t t.a.v b.v n.v o.a "  # Dutch
    "np ul tzn ok inż sp z.o.o o.o mgr poz pkt ust lp godz woj pow itd itp im tj wg "  # Polish
    "t.ex dvs kap tel ing f.d bl.a m.m o.s.v resp civ "  # Swedish
    "άρθ αρ π.χ δηλ κ κα κος τηλ σελ παρ περ "  # Greek
    "чл напр ул т.е т.н г гр инж арх д-р проф ал бул бр лв "  # Bulgarian
    "د م أ ص ت डॉ श्री रु सं".split()  # Arabic, Hindi
)
#: Abbreviations that also stand at the end of sentences.
MAY_END = set("etc usw enz itd itp ltd inc s.a s.p.a s.r.l b.v n.v lda o.o m.m o.s.v т.н".split())
#: Words before an ordinal, and months that follow one.
BEFORE_ORDINAL = set("der die das dem den des am im vom zum zur beim ab bis ein eine einen einem den d le la el".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember januari februari maart mei augustus".split())
PAIRS = {"„": "“”", "«": "»", "“": "”", "「": "」", "『": "』", "‹": "›", "»": "«"}
QUOTES = re.compile("[\"„«“”「」『』‹›»]")
THAI_LETTER = re.compile("[฀-๿]")
CLOSING = "\"'”“’»›)]」』）】"
#: Marks that end sentences in scripts that put no blank after them or have a mark of their own.
WIDE_ENDS = "。！？｡।॥؟۔։．"
END = re.compile(rf"(?:[.!?…]+|．(?!\d)|[{WIDE_ENDS[:-1]}]+|(?<=[\u0370-\u03ff\u1f00-\u1fff]);|\u037e)[\"'”“’»›)\]」』）】]*(?:[   ][»”](?=[\s.,;]|$))?")
WORD_BEFORE = re.compile(r"[^\s(\[\"'„“«»]+$")
OPENER_NUMBER = re.compile(r"[(\[]?\d{1,3}(?:\.\d{1,3})*[.)\]]{1,2}$")
DOTTED = re.compile(r"(?:[^\W\d_][^\W\d_\u0900-\u097f]?[\u0900-\u097f]{0,2}\.)+[^\W\d_]?[\u0900-\u097f]{0,3}")
THAI = re.compile(r"(?<=[฀-๿0-9])[  ](?=[฀-๿])")
WIDTHS = (30, 130)


def _soft_feeds(lines: list[str]) -> list[bool]:
    """For each line but the last: is the line feed after it only the wrap of a paragraph?

    A feed wraps if the next word would not have fitted into the width of the text. A text counts as wrapped if such
    feeds outnumber the others by far, and some of them stand in mid-sentence or there are several.
    """
    width = max(map(len, lines))
    if not WIDTHS[0] <= width <= WIDTHS[1]:
        return [False] * (len(lines) - 1)
    full, loose, inner = [], 0, 0
    for a, b in zip(lines, lines[1:]):
        a, nxt = a.rstrip(), b.split(None, 1)
        if not a or not nxt:
            full.append(False)
            continue
        tight = len(a) + (1 if nxt[0][0] > "⺀" else 1 + len(nxt[0])) > width
        full.append(tight)
        loose += not tight
        inner += tight and a[-1] not in ".!?…:;" + WIDE_ENDS and (nxt[0][0].islower() or nxt[0][0].isdigit())
    hits = sum(full)
    wrapped = hits and loose <= 0.25 * (hits + loose) and (inner or hits >= 3)
    return full if wrapped else [False] * len(full)


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of text between certain breaks, without white space at their ends."""
    lines = text.split("\n")
    soft = _soft_feeds(lines) if len(lines) > 1 else []
    out, begin, at = [], 0, 0
    for i, line in enumerate(lines):
        at += len(line)
        if i == len(lines) - 1 or not soft[i]:
            out.append((begin, at))
            begin = at + 1
        at += 1
    return [(s, e) for s, e in (_trim(text, s, e) for s, e in out) if s < e]


def _trim(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s].isspace():
        s += 1
    while e > s and text[e - 1].isspace():
        e -= 1
    return s, e


def _depths(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """(place, number of open quotations from there on), in order."""
    out, stack = [], []
    for m in QUOTES.finditer(text, s, e):
        i, c = m.start(), m[0]
        if c == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            else:
                stack.append('"')
        elif stack and c in stack[-1]:
            stack.pop()
        elif c == "”":
            if stack or (i > s and not text[i - 1].isspace()):
                continue
            stack.append("”")
        elif c in PAIRS and not (c == "»" and not stack and i + 1 < e and text[i + 1].isspace()):
            stack.append(PAIRS[c])
        else:
            continue
        out.append((i, len(stack)))
    return out


def _abbreviated(low: str) -> bool:
    return low.rstrip(".").rsplit("-", 1)[-1] in ABBREVIATIONS


def closing_score(word: str, mark: str, before: str) -> float:
    """How well a sentence closes with the word before its mark; before is the text ahead of the word."""
    if mark[0] in WIDE_ENDS:
        return 4.0
    if mark[0] in "!?…;\u037e" or mark.startswith("..."):
        return 3.0
    low = word.lower().rstrip(".")
    last = before.rstrip()
    prior = WORD_BEFORE.search(last)
    if OPENER_NUMBER.match(word + ".") and (not last or (last[-1] in ".!?…:;" + WIDE_ENDS and not _abbreviated(prior[0].lower() if prior else ""))):
        return -9.0
    if low.isdigit() and len(low) < 3:
        return -4.0 if prior and prior[0].lower() in BEFORE_ORDINAL else 1.5
    piece = low.rsplit("-", 1)[-1]
    if low in ABBREVIATIONS or piece in ABBREVIATIONS or low.replace(" ", "") in ABBREVIATIONS:
        return -1.0 if low in MAY_END or piece in MAY_END else -6.0
    if len(low) == 1 and low.isalpha():
        return -6.0
    if low in MAY_END:
        return -1.0
    if DOTTED.fullmatch(low):
        return -3.0
    return 2.0


def opening_score(text: str, at: int, e: int, spaced: bool, quoted_end: bool) -> float:
    """How well a sentence opens at a place."""
    c = text[at]
    if c in "¿¡":
        return 3.0
    if c in "([{":
        return 0.5 if re.match(r"[(\[]\d{1,3}[)\]]\s", text[at : at + 8]) else -1.5
    i = at
    while i < e and text[i] in "\"'„“«‘「『‹":
        i += 1
    if i >= e:
        return -5.0
    c = text[i]
    if c in ",;:)]}»”。、，":
        return -9.0
    if c.isdigit():
        return 1.0 if re.match(r"\d{1,3}[.)]\s+\S", text[i : i + 12]) else -1.0
    if c.islower():
        return 0.3 if re.match(r"[a-z][A-Z]", text[i : i + 2]) else -6.0
    if c.isupper():
        word = re.match(r"[^\W\d_]+", text[i:e])
        return -8.0 if word and text[:at].rstrip().endswith(".") and word[0].lower() in MONTHS and re.search(r"\d\.$", text[:at].rstrip()) else 1.5
    if c.isalpha() or unicodedata.category(c)[0] in "LM":
        return -6.0 if quoted_end else 1.0 if spaced or c > "⺀" else 0.5
    return -2.0


def length_score(chars: int) -> float:
    return -6.0 if chars < 4 else -1.5 if chars < 9 else 0.0 if chars < 480 else -0.002 * (chars - 480)


def _candidates(text: str, s: int, e: int) -> list[tuple[int, int, float]]:
    """(end, start of the next, score of closing and opening there) of the places that could end a sentence."""
    out = []
    for m in END.finditer(text, s, e):
        j = m.end()
        if j >= e:
            break
        k = j
        while k < e and text[k].isspace():
            k += 1
        spaced, mark = k > j, m[0]
        head = text[max(s, m.start() - 60) : m.start()]
        w = WORD_BEFORE.search(head)
        word, before = (w[0], head[: w.start()]) if w else ("", head)
        if not spaced and mark[0] in ".!?…":
            tail = text[k : k + 2]
            new = (tail[:1].isupper() and tail[1:].islower()) or "֐" <= tail[:1] <= "๿" or tail[:1] in "¿¡„«"
            if not new or (mark[0] == "." and (len(word) < (2 if tail[:1].isupper() else 4) or not (word[-1].islower() or word[-1].isdigit() or word[-1] in ")%" or "֐" <= word[-1] <= "๿"))):
                continue
        quoted = len(mark) > 1 and mark[-1] in "\"”“»」』’" and text[k : k + 1].isalpha() and not (text[k].isupper() or text[k].islower())
        out.append((j, k, closing_score(word, mark, before) + opening_score(text, k, e, spaced, quoted)))
    if THAI_LETTER.search(text, s, e):
        out += [(m.start(), m.end(), 2.0) for m in THAI.finditer(text, s, e)]
        out.sort()
    return [x for x in out if x[2] > -8]


def block_sentences(text: str, s: int, e: int) -> list[tuple[int, int]]:
    cand = _candidates(text, s, e)
    if not cand:
        return [(s, e)]
    quotes = _depths(text, s, e)
    starts, ends, gain = [s] + [c[1] for c in cand], [c[0] for c in cand] + [e], [c[2] for c in cand] + [0.0]
    depth, q, now = [0], 0, 0
    for end in ends:
        while q < len(quotes) and quotes[q][0] < end:
            now = quotes[q][1]
            q += 1
        depth.append(now)
    n = len(ends)
    wide = 3 if text[s] > "⺀" else 1  # a sign of these scripts says as much as some letters
    length = [0]
    for i in range(n):
        length.append(length[-1] + wide * (ends[i] - starts[i]))
    best, back = [0.0] + [-1e18] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(j - 1, -1, -1):
            score = best[i] + length_score(length[j] - length[i]) + gain[j - 1] - (12.0 if depth[j] != depth[i] else 0.0)
            if score > best[j]:
                best[j], back[j] = score, i
            if length[j] - length[i] > 6000 and i < j - 1:
                break  # longer spans lose more by their length than any boundary can
    spans, j = [], n
    while j:
        i = back[j]
        spans.append((starts[i], ends[j - 1]))
        j = i
    return spans[::-1]


def sentences(text: str) -> list[tuple[int, int]]:
    """Offsets (start, end) of the sentences of a text, in code points, without white space at their ends."""
    return [span for s, e in blocks(text) for span in block_sentences(text, s, e)]


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_char, end_char): one row per sentence.

    Null, empty and blank texts have no sentence; every other character that isn't white space lies in exactly one.
    Rows are treated one by one, so repeated rows give repeated sentences.
    """

    def run(batches):
        for b in batches:
            rows = [(k, s, e) for k, t in zip(b["k"], b["t"]) if t for s, e in sentences(t)]
            yield pd.DataFrame(rows, columns=["k", "s", "e"]).astype({"s": "int32", "e": "int32"})

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.selectExpr(f"`{key}` as k", f"cast(`{text}` as string) as t").mapInPandas(run, f"k {kind}, s int, e int").toDF(key, "start_char", "end_char")
