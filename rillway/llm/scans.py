"""Repair of text from scanned pages: lines of the page frame, broken words and misread letters.

Lines are labelled body, frame or break by a hidden Markov model over layout features, whose parameters are trained
by expectation maximisation over all sections; the executors send back only expected counts. Without the frame, body lines are put
together to paragraphs; words broken at line ends are joined. Misread words are found against the vocabulary of
all sections: a rare word that becomes a much more frequent one by undoing a misreading of letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from rillway.llm.names import slips
from rillway.session import Scratch, spread

BODY, FRAME, BREAK = range(3)
STATES, ROUNDS, STRENGTH = 3, 3, 60.0
#: Bits of the filter that keeps guesses which are no word at all from the join, and its hashes; the join itself is exact.
FILTER_BITS, HASHES, FILTER_BLOCK = 1 << 26, 2, 1 << 15
#: Forms of page numbers; # stands for an arabic or roman number.
PAGE_FORMS = ("seite # von #", "page # of #", "page # sur #", "página # de #", "pagina # di #", "pagina # van #", "strona # z #", "sida # av #", "σελίδα # από #", "стр. # от #", "seite #", "page #", "s. #", "p. #", "- # -", "– # –", "[#]", "#/#", "# / #")
_N = r"(?:\d{1,4}|[ivxlcm]{1,7}|[IVXLCM]{1,7})"
_FORMS = "|".join(re.escape(p).replace(r"\#", _N).replace(r"\ ", r"\s*") for p in PAGE_FORMS)
PAGE = re.compile(rf"\s*(?:{_FORMS})\s*\Z", re.IGNORECASE)
TAIL = re.compile(rf"\s{{2,}}(?:{_FORMS}|{_N})\s*\Z", re.IGNORECASE)
TABLE = re.compile(r"\[[^\]]*\D \d+\]\Z")
NUMBER = re.compile(r"\s*\d{1,4}\s*\Z")
#: Letters and the letters they are misread as.
MISREAD = (
    ("i", "l"), ("l", "1"), ("l", "I"), ("i", "1"), ("I", "l"), ("I", "1"), ("o", "0"), ("O", "0"), ("e", "c"), ("c", "e"), ("h", "b"), ("b", "h"), ("ß", "B"), ("g", "q"), ("u", "n"), ("n", "u"),
    ("rn", "m"), ("m", "rn"), ("w", "vv"), ("d", "cl"), ("nn", "m"), ("ri", "n"), ("li", "h"), ("S", "5"), ("s", "5"), ("B", "8"), ("t", "f"), ("f", "t"), ("a", "o"), ("o", "a"), ("v", "y"), ("ü", "ii"), ("G", "C"), ("Z", "2"), ("z", "2"), ("q", "g"), ("D", "0"), ("E", "F"), ("l", "i"), ("t", "l"), ("1", "l"), ("0", "o"), ("cl", "d"),
    ("ä", "a"), ("ö", "o"), ("ü", "u"), ("å", "a"), ("é", "e"), ("è", "e"), ("ê", "e"), ("á", "a"), ("à", "a"), ("ã", "a"), ("ó", "o"), ("ò", "o"), ("ô", "o"), ("í", "i"), ("ú", "u"), ("ç", "c"), ("ñ", "n"), ("ł", "l"), ("ą", "a"), ("ę", "e"), ("ś", "s"), ("ć", "c"), ("ż", "z"),
)
#: Words that follow a hyphen which stands for a part left out.
AFTER_HANGING = set("und oder bzw sowie and or et ou y e o i lub oraz ed en of och eller και ή и или".split())
JOINT = "\x01"
HYPHENS = "-‐‑¬\xad"
CLEAN, DIGIT_PRIOR, ODDS = 0.1, 12.0, 2.0
#: Candidates of up to 4, up to 7 and more letters that count as misreadings before any is seen.
PSEUDO = (1.0, 20.0, 100.0)
WORD = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
#: Probabilities of each feature's values, in body, frame and break, before training.
PRIOR = {
    "shape": ((0.97, 0.001, 0.002, 0.007, 0.02), (0.62, 0.28, 0.098, 0.001, 0.001), (0.996, 0.001, 0.001, 0.001, 0.001)),
    "repeat": ((0.9, 0.07, 0.03), (0.25, 0.15, 0.6), (0.998, 0.001, 0.001)),
    "names": ((0.998, 0.002), (0.45, 0.55), (0.999, 0.001)),
    "loose": ((0.97, 0.03), (0.15, 0.85), (0.999, 0.001)),
    "ends": ((0.75, 0.25), (0.99, 0.01), (0.999, 0.001)),
    "tail": ((0.999, 0.001), (0.75, 0.25), (0.999, 0.001)),
    "blank": ((0.9999, 0.0001), (0.9999, 0.0001), (0.0001, 0.9999)),
}
MOVE = ((0.8, 0.03, 0.17), (0.45, 0.1, 0.45), (0.85, 0.12, 0.03))
FIRST = (0.9, 0.08, 0.02)


def line_key(line: str) -> str:
    """A line without the page number at its end, its digits and its case: the same for each copy of a running header."""
    return re.sub(r"\d+", "0", re.sub(r"\s+", " ", TAIL.sub("", line)).strip().casefold())


def may_head(line: str) -> bool:
    s = line.strip()
    return bool(s) and len(s) <= 120 and s[-1] not in ".,;!?" and not s[0].islower() and not s.startswith("(") and "[TABLE" not in s and not re.match(r"\d+ \|", s)


def features(lines: list[str], keys: dict[str, int], program: str) -> np.ndarray:
    """(lines x features) values; keys are the repeated line keys of the document with their counts."""
    n = len(lines)
    out = np.zeros((n, len(PRIOR)), np.uint8)
    out[:, 6] = [not x.strip() for x in lines]
    number = [bool(NUMBER.match(x)) for x in lines]
    prog = re.sub(r"\s+", " ", program or "").strip().casefold()
    heads = [k for k in keys if len(k) >= 6]
    known: dict[str, tuple[int, int]] = {}
    solid = [i for i, x in enumerate(lines) if x.strip()]
    lengths = sorted(len(lines[i].rstrip()) for i in solid if not TAIL.search(lines[i]) and not number[i])
    width = lengths[int(0.9 * (len(lengths) - 1))] if lengths else 0
    where = {i: p for p, i in enumerate(solid)}
    for i in solid:
        s = lines[i].strip()
        beside = any(number[max(0, i - 2) : i]) or any(number[i + 1 : i + 3])
        out[i, 0] = 3 if number[i] and beside else 2 if number[i] else 1 if PAGE.match(s) else 0
        tail = TAIL.search(lines[i])
        if out[i, 0] == 0 and may_head(lines[i]):
            k = line_key(lines[i])
            if k not in known:
                c = keys.get(k, 1)
                if c < 2 and len(k) >= 8:
                    c += sum(keys[h] for h in heads if abs(len(h) - len(k)) <= 2 and slips(h, k, 2) <= 2)
                has = 0
                if len(prog) >= 6:
                    flat = re.split(r"\s*[|–,]\s*|\s{3,}", k)
                    has = int(any(abs(len(f) - len(prog)) <= 3 and slips(f, prog, 3) <= 3 for f in flat))
                known[k] = (c, has)
            c, has = known[k]
            out[i, 1], out[i, 2] = min(c - 1, 2) if c > 1 else 0, has
        elif out[i, 0] in (1, 2):
            out[i, 1] = min(max(keys.get(line_key(lines[i]), 1) - 1, 0), 2)
        p = where[i]
        after = max((len(lines[j].split(None, 1)[0]) for j in solid[p + 1 : p + 3]), default=99)  # the next line may itself be of the frame
        full = len(lines[i].rstrip()) + 1 + after > width - 2
        if out[i, 0] == 0 and (s.count(" | ") >= 2 or TABLE.match(s)):
            out[i, 0] = 4
        out[i, 3] = int(not full and s[-1] not in ".,;:!?)" + HYPHENS and out[i, 0] < 3)
        out[i, 4] = int(s[-1] in ".,;!?)")
        out[i, 5] = int(bool(tail) and len(s) <= 120)
    return out


def padded(sections: list[np.ndarray], most: int = 256):
    """(numbers, features (sections x lines x features), lengths) of sections of like length, so that little is padding."""
    order = sorted(range(len(sections)), key=lambda i: len(sections[i]))
    for k in range(0, len(order), most):
        at = [i for i in order[k : k + most] if len(sections[i])]
        if at:
            n = np.array([len(sections[i]) for i in at])
            f = np.zeros((len(at), n.max(), len(PRIOR)), np.uint8)
            for j, i in enumerate(at):
                f[j, : n[j]] = sections[i]
            yield at, f, n


class LineModel:
    """Hidden Markov model of the lines of sections with the states BODY, FRAME and BREAK; sections are worked off many at a time."""

    def __init__(self):
        self.emit = [np.array(v) for v in PRIOR.values()]
        self.move, self.first = np.array(MOVE), np.array(FIRST)

    def scores(self, f: np.ndarray) -> np.ndarray:
        b = np.ones((*f.shape[:2], STATES))
        for k, e in enumerate(self.emit):
            b *= e.T[f[:, :, k]]
        return b

    def expected(self, sections: list[np.ndarray]) -> np.ndarray:
        """Expected counts of first states, moves and feature values over the sections, as one row of numbers."""
        first, moves, counts = np.zeros(STATES), np.zeros((STATES, STATES)), [np.zeros(e.shape) for e in self.emit]
        for _, f, n in padded(sections):
            b = self.scores(f)
            rows, t = len(n), f.shape[1]
            fwd = np.zeros((rows, t, STATES))
            now = self.first * b[:, 0]
            fwd[:, 0] = now / now.sum(1, keepdims=True)
            for i in range(1, t):
                now = (fwd[:, i - 1] @ self.move) * b[:, i]
                fwd[:, i] = now / now.sum(1, keepdims=True)
            bwd = np.ones((rows, STATES))
            post = np.zeros((rows, t, STATES))
            for i in range(t - 1, -1, -1):
                live = i < n
                g = fwd[:, i] * bwd
                post[live, i] = (g / g.sum(1, keepdims=True))[live]
                if i:
                    ahead = b[:, i] * bwd
                    pair = fwd[:, i - 1][:, :, None] * self.move * ahead[:, None, :]
                    moves += (pair / pair.sum((1, 2), keepdims=True))[live].sum(0)
                    back = ahead @ self.move.T
                    bwd = np.where(live[:, None], back / back.sum(1, keepdims=True), 1.0)
            first += post[:, 0].sum(0)
            for k, c in enumerate(counts):
                for v in range(c.shape[1]):
                    c[:, v] += post[f[:, :, k] == v].sum(0)
        return np.concatenate([first, moves.ravel(), *[c.ravel() for c in counts]])

    def update(self, counts: np.ndarray) -> None:
        """New parameters from expected counts; the starting values count like STRENGTH lines of their own, which keeps the states' meaning."""
        share = lambda c: c / c.sum(-1, keepdims=True)
        self.first = share(counts[:STATES] + STRENGTH * np.array(FIRST))
        at = STATES + STATES * STATES
        self.move = share(counts[STATES:at].reshape(STATES, STATES) + STRENGTH * np.array(MOVE))
        for k, v in enumerate(PRIOR.values()):
            v = np.array(v)
            self.emit[k] = share(counts[at : at + v.size].reshape(v.shape) + STRENGTH * v)
            at += v.size

    def labels(self, sections: list[np.ndarray]) -> list[np.ndarray]:
        """BODY, FRAME or BREAK of each line of each section, by the Viterbi path."""
        out = [np.zeros(0, np.int64) for _ in sections]
        move = np.log(self.move)
        for at, f, n in padded(sections):
            b = np.log(self.scores(f))
            rows, t = len(n), f.shape[1]
            v, back = np.log(self.first) + b[:, 0], np.zeros((t, rows, STATES), np.int8)
            best = v.copy()
            for i in range(1, t):
                m = v[:, :, None] + move
                back[i] = m.argmax(1)
                v = m.max(1) + b[:, i]
                best = np.where((i < n)[:, None], v, best)
            state = best.argmax(1)
            path = np.zeros((t, rows), np.int64)
            for i in range(t - 1, -1, -1):
                path[i] = np.where(i < n, state, 0)
                state = np.where((i < n) & (i > 0), back[i][np.arange(rows), state], state)
            for j, k in enumerate(at):
                out[k] = path[: n[j], j]
        return out

    def label(self, lines: list[str], f: np.ndarray) -> np.ndarray:
        """The labels of one section."""
        return self.labels([f])[0] if lines else np.zeros(0, np.int64)


def bare(token: str) -> str:
    m = WORD.search(token)
    return m[0] if m else ""


def paragraphs(lines: list[str], labels: np.ndarray) -> tuple[list[str], list[int]]:
    """Paragraphs, and the numbers of the frame lines, as in flow."""
    return flow(lines, labels)[:2]


def flow(lines: list[str], labels: np.ndarray) -> tuple[list[str], list[int], list[int], list[int]]:
    """Paragraphs, the numbers of the frame lines, and of each paragraph its first and its last line.

    In a word put together from two lines JOINT stands for the hyphen between its halves. A hyphen at a
    line end joins unless the next word shows that a part was left out on purpose; what the hyphen becomes is
    decided later, against the vocabulary.
    """
    paras, now, frame, gap, torn = [], [], [], False, False
    first, last_line, at = [], [], 0
    for i, line in enumerate(lines):
        if labels[i] == FRAME:
            frame.append(i)
            torn = True
            continue
        if labels[i] == BREAK:
            gap = True
            continue
        tokens = line.split()
        if gap and now:  # a page frame with blank lines around it, or a broken word, doesn't end a paragraph
            last, low = now[-1], line.lstrip()[:1].islower()
            if not (low and (last[-1] in HYPHENS or (torn and last[-1] not in ".!?…:;"))):
                paras.append(" ".join(now))
                last_line.append(at)
                now = []
        gap = torn = False
        if now and tokens and len(now[-1]) > 1 and now[-1][-1] in HYPHENS and now[-1][-2].isalpha() and tokens[0][:1].isalpha() and bare(tokens[0]).casefold() not in AFTER_HANGING:
            now[-1] = now[-1][:-1] + JOINT + tokens.pop(0)
        if not now:
            first.append(i)
        now += tokens
        at = i
    if now:
        paras.append(" ".join(now))
        last_line.append(at)
    return paras, frame, first, last_line


def core(token: str) -> tuple[int, int]:
    """Where the word within a token starts and ends: from its first to its last letter or number."""
    at = [i for i, c in enumerate(token) if unicodedata.category(c)[0] in "LN"]
    return (at[0], at[-1] + 1) if at else (0, 0)


def put_back(para: str, right: dict[tuple[str, str], str]) -> str:
    """A paragraph with its words as they should read; right has them by (word, form with hyphen or '')."""
    out = []
    for t in para.split(" "):
        if right or JOINT in t:
            a, b = core(t)
            word = t[a:b].replace(JOINT, "")
            t = t[:a].replace(JOINT, "") + right.get((word, t[a:b].replace(JOINT, "-") if JOINT in t else ""), word) + t[b:].replace(JOINT, "")
        out.append(t)
    return " ".join(out)


def undo(word: str) -> set[str]:
    """Words that could have been misread as word: one misreading undone, at one place or at all places where it can have been."""
    return set(undone(word))


def undone(word: str) -> dict[str, tuple[int, int]]:
    """The words of undo, each with its misreading (number in MISREAD) and at how many places; the fewest places count."""
    out: dict[str, tuple[int, int]] = {}
    for kind, (good, bad) in enumerate(MISREAD):
        i, places = word.find(bad), word.count(bad)
        while i >= 0:
            out.setdefault(word[:i] + good + word[i + len(bad) :], (kind, 1))
            i = word.find(bad, i + 1)
        if places > 1:
            out.setdefault(word.replace(bad, good), (kind, places))
    out.pop(word, None)
    return out


def _with_keys(df: DataFrame, text: str, doc: str) -> DataFrame:
    """df with the repeated line keys of its document as a column heads MAP<key, count>."""
    def keys(batches):
        for b in batches:
            rows = Counter()
            for d, t in zip(b["d"], b["t"]):
                if d is not None and t:
                    for x in t.split("\n"):
                        if may_head(x) or NUMBER.match(x) or PAGE.match(x):
                            rows[d, line_key(x)] += 1
            yield pd.DataFrame([(d, k, n) for (d, k), n in rows.items()], columns=["d", "k", "n"])

    found = df.select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInPandas(keys, "d string, k string, n long")
    often = found.groupBy("d", "k").agg(F.sum("n").alias("n")).where("n > 1 and k <> ''")
    heads = often.groupBy("d").agg(F.collect_list(F.struct("k", "n")).alias("heads"))
    return df.join(heads.hint("merge"), df[doc] == heads["d"], "left").drop("d")


def _slices(batches, size: int = 500):
    """Record batches in slices, so that only few long texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)


def read_lines(df: DataFrame, key: str, text: str, doc: str, program: str, scratch: Scratch) -> DataFrame:
    """(key, doc, frame, paras ARRAY<STRING>, first, last) of every text, by a model trained on all of them; frame, first and last are line numbers ARRAY<INT>."""
    src = _with_keys(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(doc).alias("doc"), F.coalesce(program, F.element_at(F.split(doc, "/"), 1)).alias("program")), "text", "doc")
    wide = len(PRIOR)

    def look(batches):
        for b in _slices(batches):
            rows = []
            for t, heads, prog in zip(*(b.column(c).to_pylist() for c in ("text", "heads", "program"))):
                known = {h["k"]: h["n"] for h in heads} if heads is not None else {}
                rows.append(features(t.split("\n"), known, prog).tobytes() if t else b"")
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc"), b.column("text"), pa.array(rows, pa.binary())], names=["key", "doc", "text", "layout"])

    kind = df.select(key).schema[0].dataType.simpleString()
    seen = scratch.cut(src.mapInArrow(look, f"key {kind}, doc string, text string, layout binary"))
    model = LineModel()
    unpack = lambda col: [np.frombuffer(x, np.uint8).reshape(-1, wide) for x in col]
    for _ in range(ROUNDS):

        def count(batches):
            total = sum((model.expected(unpack(b["layout"])) for b in batches if len(b)), np.zeros(1))
            if len(total) > 1:
                yield pd.DataFrame({"counts": [total]})

        got = [r.counts for r in seen.select("layout").mapInPandas(count, "counts array<double>").collect()]  # one short row a task
        if got:
            model.update(np.sum(got, axis=0))

    def run(batches):
        for b in _slices(batches):
            labels = model.labels(unpack(b.column("layout").to_pylist()))
            out = [flow(t.split("\n"), lab) if t else ([], [], [], []) for t, lab in zip(b.column("text").to_pylist(), labels)]
            paras, frame, first, last = zip(*out) if out else ((), (), (), ())
            numbers = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("doc"), pa.array(frame, numbers), pa.array(paras, pa.list_(pa.string())), pa.array(first, numbers), pa.array(last, numbers)],
                names=["key", "doc", "frame", "paras", "first", "last"],
            )

    return seen.mapInArrow(run, f"key {kind}, doc string, frame array<int>, paras array<string>, first array<int>, last array<int>")


def findings(df: DataFrame, key: str, text: str, doc: str, program: str) -> tuple[DataFrame, DataFrame]:
    """(lines, words) of texts from scanned pages.

    lines: as in read_lines, paras still as they stand. words: (key, word, hyphened, right, why): every token that was
    broken or misread, as it stands (halves joined without hyphen, and with it; '' where nothing was joined) and as it
    should read; why is 'broken', 'misread' or both with a plus. Null and empty texts have neither.
    """
    scratch = Scratch(df.sparkSession)
    lines = scratch.cut(read_lines(df, key, text, doc, program, scratch))
    # signs of scanning: a line of the frame, a broken word, or a digit between small letters
    sign = (F.size("frame") > 0) | F.exists("paras", lambda p: F.contains(p, F.lit(JOINT)) | p.rlike(r"\p{Ll}[0-9]\p{Ll}"))
    scanned = lines.where(sign).select("doc").distinct().withColumn("scanned", F.lit(1))
    flat = lines.join(scanned, "doc", "left").select("key", F.coalesce("scanned", F.lit(0)).alias("scanned"), F.explode(F.flatten(F.transform("paras", lambda p: F.split(p, " ")))).alias("token"))
    strip = lambda c: F.regexp_replace(c, r"(?U)^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    tokens = scratch.cut(
        flat.select("key", "scanned", strip(F.replace("token", F.lit(JOINT), F.lit(""))).alias("word"), F.when(F.contains("token", F.lit(JOINT)), strip(F.replace("token", F.lit(JOINT), F.lit("-")))).otherwise("").alias("hyphened"))
        .where("word <> ''")
        .groupBy("key", "scanned", "word", "hyphened").agg(F.count("*").alias("k"))
    )
    vocab = tokens.groupBy("word", F.col("hyphened").alias("h")).agg(F.sum("k").alias("n"), F.sum(F.col("k") * (1 - F.col("scanned"))).alias("clean"))
    plain = scratch.cut(vocab.where("h = ''").select("word", "n", "clean"))
    # what the hyphen of a broken word becomes: kept where that form is the more frequent one of whole words
    cut = tokens.where("hyphened <> ''").select("word", "hyphened").distinct()
    as_one = plain.select("word", F.col("n").alias("n1"))
    as_two = plain.select(F.col("word").alias("hyphened"), F.col("n").alias("n2"))
    resolved = scratch.cut(
        cut.join(as_one, "word", "left").join(as_two, "hyphened", "left")
        .select("word", "hyphened", F.when(F.coalesce("n2", F.lit(0)) > F.coalesce("n1", F.lit(0)), F.col("hyphened")).otherwise(F.col("word")).alias("whole"))
    )
    counted = plain.unionByName(resolved.select(F.col("whole").alias("word"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("clean"))).groupBy("word").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))
    fixes = scratch.cut(misread_words(counted))
    broken = tokens.where("hyphened <> ''").join(resolved, ["word", "hyphened"]).join(fixes.select(F.col("word").alias("whole"), "right"), "whole", "left").select(
        "key", "word", "hyphened", F.coalesce("right", "whole").alias("right"), F.when(F.col("right").isNull(), "broken").otherwise("broken+misread").alias("why")
    )
    wrong = tokens.where("hyphened = ''").join(fixes, "word").select("key", "word", "hyphened", "right", F.lit("misread").alias("why"))
    return lines, broken.unionByName(wrong)


def repair(df: DataFrame, key: str, text: str, doc: str, program: str) -> tuple[DataFrame, DataFrame]:
    """(lines, words) as in findings, but with every paragraph of lines as it should read: words put back, no joint left.

    A text without noise gives its own paragraphs.
    """
    lines, words = findings(df, key, text, doc, program)
    columns = lines.columns
    right = words.groupBy("key").agg(F.collect_list(F.struct("word", "hyphened", "right")).alias("rights"))

    def run(batches):
        for b in _slices(batches):
            rights = [{(x["word"], x["hyphened"]): x["right"] for x in r or []} for r in b.column("rights").to_pylist()]
            paras = [[put_back(p, r) for p in ps] for ps, r in zip(b.column("paras").to_pylist(), rights)]
            yield pa.RecordBatch.from_arrays([pa.array(paras, pa.list_(pa.string())) if c == "paras" else b.column(c) for c in columns], names=columns)

    return lines.join(right.hint("merge"), "key", "left").mapInArrow(run, lines.schema), words


def _places(words: list[str]) -> np.ndarray:
    """(words x HASHES) places of words in the filter."""
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    return np.stack([(h >> np.uint64(32 * k)) % np.uint64(FILTER_BITS) for k in range(HASHES)], 1).astype(np.int64)


def word_filter(words: DataFrame) -> np.ndarray:
    """Bits that are set for every word: a fixed FILTER_BITS / 8 bytes, whatever the number of words."""

    def places(batches):
        for b in batches:
            at = np.unique(_places(list(b["word"])))
            yield pd.DataFrame({"block": at // FILTER_BLOCK, "bit": (at % FILTER_BLOCK).astype(np.int32)})

    def pack(batches):
        for b in batches:
            yield pd.DataFrame({"block": b["block"], "bytes": [np.packbits(np.isin(np.arange(FILTER_BLOCK), x)).tobytes() for x in b["bits"]]})

    bits = words.select("word").mapInPandas(places, "block long, bit int").distinct().groupBy("block").agg(F.collect_list("bit").alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    size = FILTER_BLOCK // 8
    for r in bits.mapInPandas(pack, "block long, bytes binary").toLocalIterator():
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bytes, np.uint8)
    return out


def misread_words(vocab: DataFrame) -> DataFrame:
    """(word, right) from a vocabulary (word, n, clean) of all texts: words that a misreading made out of more frequent ones.

    clean counts the uses in documents without any sign of scanning; a word with more than the share CLEAN of its uses there
    is at home there and no misreading, however many uses it has. The others are judged by the log odds of two models: a
    misreading of right, whose expected number is right's uses times the measured rate of that misreading, to the power
    of the places; or a word of its own, of which there are many with few uses. Words with a digit within are hardly
    ever their own; for words of letters the prior is measured by length, from candidates that are at home in clean
    documents and such as never occur there.
    """

    def guess(batches):
        for b in batches:
            for i in range(0, len(b), 1000):  # in slices, as a word has many candidates
                part = b.iloc[i : i + 1000]
                rows = [(w, n, c, g, k, p) for w, n, c in zip(part["word"], part["n"], part["clean"]) if len(w) >= 3 and sum(map(str.isalpha, w)) >= 2 for g, (k, p) in undone(w).items()]
                out = pd.DataFrame(rows, columns=["word", "n", "clean", "right", "kind", "places"])
                if len(out):
                    at = _places(list(out["right"]))
                    out = out[((bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)]
                yield out

    scratch = Scratch(vocab.sparkSession)
    vocab = scratch.cut(spread(vocab))
    bits = vocab.sparkSession.sparkContext.broadcast(word_filter(vocab))
    often = vocab.select(F.col("word").alias("right"), F.col("n").alias("m"))
    # Spark takes the size of guesses for that of the words, so the join must not be left to its estimate
    pairs = scratch.cut(
        vocab.mapInPandas(guess, "word string, n long, clean long, right string, kind int, places int").join(often.hint("merge"), "right").where("m > n")
        .withColumn("own", F.col("clean") > CLEAN * F.col("n")).withColumn("digit", F.col("word").rlike(r"\d"))
        .withColumn("size", F.when(F.length("word") < 5, 0).when(F.length("word") < 8, 1).otherwise(2))
        .withColumn("nth", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("m"), "right")))
    )
    # small tables: a row for each misreading and for each class of length
    rates = pairs.where("not own and places = 1 and nth = 1").groupBy("kind").agg(((F.sum("n") + 0.1) / (F.sum(F.col("m") + F.col("n")) + 10)).alias("rate"))
    priors = pairs.where("not digit").groupBy("size").agg((F.log(F.count_if(~F.col("own")) + F.element_at(F.array(*map(F.lit, PSEUDO)), F.col("size") + 1)) - F.log(F.count_if("own") + 1.0)).alias("prior"))
    scored = pairs.where("not own").join(F.broadcast(rates), "kind", "left").join(F.broadcast(priors), "size", "left")
    mean = F.pow(F.coalesce("rate", F.lit(0.01)), F.col("places")) * (F.col("m") + F.col("n"))
    n = F.col("n")
    misread = n * (F.log(mean) - F.log1p(mean)) - F.log1p(mean)
    own = -F.log(n * (n + 1.0))
    prior = F.when(F.col("digit"), DIGIT_PRIOR).otherwise(F.coalesce("prior", F.lit(0.0)))
    scored = scratch.cut(scored.withColumn("score", F.round(misread - own + prior, 6)).withColumn("mean", mean).where(f"score > {ODDS}").select("word", "right", "m", "mean"))
    # what is misread itself is no word to go back to; of several others the one that gives the most misreadings is it
    sound = scored.join(scored.select(F.col("word").alias("right")).distinct().hint("merge"), "right", "left_anti")
    w = Window.partitionBy("word").orderBy(F.desc(F.round("mean", 6)), F.desc("m"), "right")
    return sound.withColumn("r", F.row_number().over(w)).where("r = 1").select("word", "right")
