"""Language of texts and of the segments of mixed texts, by averaged hashed subword embeddings and a linear softmax.

The model is trained here, in numpy, by stochastic gradient descent on a bounded sample of labelled rows (at most
SAMPLE_ROWS of them, whatever the size of the table) and on the labels of the catalogue. A first
model, of the catalogue alone, and those after it decide which labels of the sample are confirmed; the rest is left out. Temperature and the least confidence that is not rejected
come from rows held out of training.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rillway.llm.canon import AS_CYRILLIC, AS_GREEK, CYRILLIC, CYRILLIC_AS_LATIN, GREEK, GREEK_AS_LATIN, LATIN_IN_CYRILLIC, LATIN_IN_GREEK
from rillway.llm.sentences import sentences

LANGS = ("eng", "deu", "fra", "spa", "por", "ita", "nld", "pol", "swe", "ell", "bul")
#: Codes of ISO 639-1, 639-2/T and 639-2/B of the languages.
CODES = {
    "en": "eng", "eng": "eng", "de": "deu", "deu": "deu", "ger": "deu", "fr": "fra", "fra": "fra", "fre": "fra", "es": "spa", "spa": "spa", "pt": "por", "por": "por",
    "it": "ita", "ita": "ita", "nl": "nld", "nld": "nld", "dut": "nld", "pl": "pol", "pol": "pol", "sv": "swe", "swe": "swe", "el": "ell", "ell": "ell", "gre": "ell", "bg": "bul", "bul": "bul",
}
SAMPLE_ROWS = 5000
BUCKETS, DIM, SIZES = 1 << 14, 16, (2, 3, 4)
FIRST_EPOCHS, EPOCHS, BATCH, RATE, SEED = 3, 6, 32, 1.5, 7
#: Least probability that a sampled label must have to stay, round by round.
CONFIRM = (0.12, 0.25, 0.4)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
ENOUGH = 12
CUT = re.compile(r"\s+[/|]\s+|\n+")
#: Log odds that a stored label must be beaten by, and the cost of a change of language between sentences.
LABEL_TRUST, SWITCH = 2.0, 2.5
_LAT = str.maketrans(CYRILLIC + GREEK, CYRILLIC_AS_LATIN + GREEK_AS_LATIN)
_CYR = str.maketrans(LATIN_IN_CYRILLIC, AS_CYRILLIC)
_GRK = str.maketrans(LATIN_IN_GREEK, AS_GREEK)


def plain(text: str) -> str:
    return INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


def plain_word(w: str) -> str:
    """A word with look-alike letters of another script put right, in lower case."""
    has = {unicodedata.name(c, "")[:5] for c in w}
    if "LATIN" in has and ("CYRIL" in has or "GREEK" in has):
        rest = [unicodedata.name(c, "")[:5] for c in w if c not in CYRILLIC and c not in GREEK]
        w = w.translate(_CYR) if "CYRIL" in rest else w.translate(_GRK) if "GREEK" in rest else w.translate(_LAT)
    return w.lower()


def content_words(text: str) -> list[str]:
    """The words that show a language: names of places and firms don't, so capitalised words count only where little else stands."""
    words = WORD.findall(text)
    low = [w for i, w in enumerate(words) if i == 0 or w[0].islower() or len(w) < 4]
    return low if sum(map(len, low)) >= ENOUGH else words


def buckets(word: str) -> list[int]:
    s = f"<{word}>"
    out = [zlib.crc32(s.encode()) % BUCKETS]
    for n in SIZES:
        out += [zlib.crc32(s[i : i + n].encode()) % BUCKETS for i in range(len(s) - n + 1)]
    return out


@dataclass
class Model:
    """per_bucket is embeddings times softmax weights, so a text is scored by a mean over its subwords."""

    per_bucket: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


class Scorer:
    """Scores texts; keeps the sums of the words it has seen."""

    def __init__(self, model: Model, most: int = 200_000):
        self.m, self.most = model, most
        self.number: dict[str, int] = {}
        self.sums = np.zeros((1024, len(LANGS)), np.float32)
        self.counts = np.zeros(1024, np.float32)

    def word(self, w: str) -> int:
        i = self.number.get(w)
        if i is None:
            if len(self.number) >= self.most:
                self.number.clear()
            i = self.number[w] = len(self.number)
            if i >= len(self.counts):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            b = buckets(plain_word(w))
            self.sums[i], self.counts[i] = self.m.per_bucket[b].sum(0), len(b)
        return i

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities (texts x languages) and the number of letters of each text; without words it is even."""
        if len(self.number) > self.most // 2:
            self.number.clear()
        words = [content_words(t) for t in texts]
        n = np.array([len(w) for w in words])
        ids = np.fromiter((self.word(w) for ws in words for w in ws), np.int64, n.sum())
        at = np.concatenate([[0], np.cumsum(n)])[:-1]
        z = np.zeros((len(texts), len(LANGS)), np.float32)
        some = n > 0
        if some.any():
            total = np.add.reduceat(self.sums[ids], at[some])
            z[some] = total / np.add.reduceat(self.counts[ids], at[some])[:, None] + self.m.bias
        z /= self.m.temperature
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        return z, np.array([sum(map(len, w)) for w in words])


def _fit(texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    emb = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(LANGS)), np.float32), np.zeros(len(LANGS), np.float32)
    weight = 1 / np.sqrt(np.maximum(np.bincount(labels, minlength=len(LANGS)), 1))
    weight = (weight / weight[labels].mean()).astype(np.float32)
    steps, done = epochs * (len(texts) // BATCH + 1), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            part = order[s : s + BATCH]
            n = np.array([len(texts[i]) for i in part])
            used, place = np.unique(np.concatenate([texts[i] for i in part]), return_inverse=True)
            share = np.bincount(np.repeat(np.arange(len(part)), n) * len(used) + place, minlength=len(part) * len(used)).reshape(len(part), -1).astype(np.float32)
            share /= n[:, None]
            h = share @ emb[used]
            z = h @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[part]
            p[np.arange(len(part)), y] -= 1
            p *= weight[y][:, None]
            rate = RATE * (1 - done / steps)
            back = share.T @ (p @ w.T)
            w -= rate * (h.T @ p) / len(part) * 4
            bias -= rate * p.mean(0)
            emb[used] -= rate * 4 * back
            done += 1
    return emb @ w, bias


def train(rows: list[tuple[str, str]], sure: list[tuple[str, str]]) -> Model:
    """Model from (text, language) rows whose labels may be wrong and rows whose labels are sure. Deterministic."""
    rng = np.random.default_rng(SEED)
    seen: dict[str, list[int]] = {}

    def ids(t: str) -> list[int]:
        out = []
        for w in content_words(plain(t)):
            if w not in seen:
                seen[w] = buckets(plain_word(w))
            out += seen[w]
        return out

    data = [(ids(t), LANGS.index(y), ok) for part, ok in ((rows, False), (sure, True)) for t, y in part]
    data = [x for x in data if x[0]]
    if not data:
        return Model(np.zeros((BUCKETS, len(LANGS)), np.float32), np.zeros(len(LANGS), np.float32), 1.0, 1.0)
    texts, labels, safe = [np.array(x[0]) for x in data], np.array([x[1] for x in data]), np.array([x[2] for x in data])

    def score(per: np.ndarray, bias: np.ndarray, which: np.ndarray) -> np.ndarray:
        z = np.stack([per[texts[i]].mean(0) for i in which]) + bias
        return z - z.max(1, keepdims=True)

    every = np.arange(len(texts))
    keep = safe if safe.any() else np.ones(len(texts), bool)
    for least in CONFIRM:  # rows whose label the model of the rows kept so far doesn't rule out
        per, bias = _fit([texts[i] for i in every[keep]], labels[keep], rng, FIRST_EPOCHS)
        z = np.exp(score(per, bias, every))
        keep = safe | (z[every, labels] / z.sum(1) >= least)
    every = every[keep]
    held = every[rng.random(len(every)) < 0.1]
    fit = np.setdiff1d(every, held)
    per, bias = _fit([texts[i] for i in fit], labels[fit], rng, EPOCHS)
    if not len(held):
        return Model(per, bias, 1.0, 0.5)
    z = score(per, bias, held)
    best = (np.inf, 1.0)
    for t in np.geomspace(0.3, 3, 24):
        q = z / t
        best = min(best, (float((np.log(np.exp(q).sum(1)) - q[np.arange(len(held)), labels[held]]).mean()), float(t)))
    q = np.exp(z / best[1])
    q /= q.sum(1, keepdims=True)
    conf, right = q.max(1), q.argmax(1) == labels[held]
    wrong = np.sort(conf[~right])
    least = float(np.clip(np.median(wrong) if len(wrong) else 0.4, 0.3, 0.6))
    return Model(per.astype(np.float32), bias.astype(np.float32), best[1], least)


def drawn(rows: DataFrame, n: int) -> DataFrame:
    """The n rows with the smallest hash h. Only those below a bound that about 2n rows pass are sorted, so no task sends n rows of its own."""
    total = rows.count()
    if total > 2 * n:
        rows = rows.where(F.col("h") < int(-(2**63) + 2**64 * (2 * n / total)))
    return rows.orderBy("h", "k").limit(n)


def fit_language_model(labelled: DataFrame, key: str, text: str, label: str, catalogue: DataFrame | None = None, more: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most sample_rows labelled rows, drawn by a hash of their key, and on a small catalogue with a column per language.

    more holds further labelled texts as (key, text, label), of which at most sample_rows / 4 are drawn and cut into
    sentences. Of texts that differ in names and numbers only the most frequent label counts.
    """
    codes = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    lang = codes[F.lower(F.trim(F.col(label)))]
    picked = labelled.select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.col(text).alias("t"), lang.alias("y")).where("y is not null and t is not null")
    votes: dict[str, Counter] = {}
    for r in drawn(picked, sample_rows).collect():
        votes.setdefault(" ".join(content_words(plain(r.t))), Counter())[r.y] += 1
    if more is not None:
        m = more.toDF("k", "t", "y").withColumn("h", F.xxhash64("k")).withColumn("y", codes[F.lower(F.trim(F.col("y")))]).where("y is not null and t is not null")
        for r in drawn(m, sample_rows // 4).collect():
            for s, e in sentences(r.t):
                votes.setdefault(" ".join(content_words(plain(r.t[s:e]))), Counter())[r.y] += 1
    major = [(t, max(sorted(c), key=c.get), c) for t, c in sorted(votes.items())]
    agreed = {t for t, y, c in major if c[y] >= 3 and c[y] >= 0.6 * c.total()}
    rows = [(t, y) for t, y, _ in major if t not in agreed]
    sure = [(t, y) for t, y, _ in major if t in agreed]
    if catalogue is not None:
        have = [c for c in catalogue.columns if c in CODES]
        sure += [(r[c], CODES[c]) for r in catalogue.select(*have).orderBy(*have).limit(sample_rows).collect() for c in have if r[c]]
    return train(rows, sorted(sure))


def named(languages: str | None) -> set[str]:
    """Languages that a JSON string, list or null names, whatever the code system; unusable values name none."""
    try:
        x = json.loads(languages) if languages else None
    except ValueError:
        return set()
    found: set[str] = set()
    for v in x if isinstance(x, list) else [x]:
        if isinstance(v, str) and v.strip().lower() in CODES:
            found.add(CODES[v.strip().lower()])
    return found


def segments(texts: list[str], scorer: Scorer) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, language, confidence) of the stretches of one language in each text.

    Sentences are scored one by one; the best sequence of languages pays for every change, so a sentence that says
    little keeps the language around it.
    """
    units, owner = [], []
    for i, t in enumerate(texts):
        at = 0
        for part in [*CUT.finditer(t), None]:
            s, e = at, part.start() if part else len(t)
            for a, b in sentences(t[s:e]):
                units.append((s + a, s + b))
                owner.append(i)
            at = part.end() if part else e
    logp, letters = scorer.logits([plain(texts[o][a:b]) for o, (a, b) in zip(owner, units)]) if units else (np.zeros((0, len(LANGS))), np.zeros(0))
    weigh = np.minimum(1.0, letters / 25.0)[:, None] * np.maximum(logp, -9.0)
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    u = 0
    while u < len(units):
        v = u
        while v < len(units) and owner[v] == owner[u]:
            v += 1
        score, back = weigh[u].copy(), []
        for k in range(u + 1, v):
            move = score.max() - SWITCH
            back.append(np.where(score >= move, np.arange(len(LANGS)), score.argmax()))
            score = np.maximum(score, move) + weigh[k]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        k = u
        while k < v:
            j = k
            while j < v and path[j - u] == path[k - u]:
                j += 1
            lang = path[k - u]
            mass = float(np.exp(np.average(logp[k:j, lang], weights=np.maximum(letters[k:j], 1))))
            name = LANGS[lang] if letters[k:j].sum() and mass >= scorer.m.least else "und"
            out[owner[u]].append((units[k][0], units[j - 1][1], name, mass))
            k = j
        u = v
    return out


def label_texts(df: DataFrame, key: str, text: str, label: str, model: Model) -> DataFrame:
    """(key, lang, confidence, label_lang, wrong): language of each whole text, next to what its label names.

    lang is 'und' where the text has no words or the confidence is below the calibrated bound. wrong is true where
    the label names no language and the text has one, or where the text is in another language by a clear margin.
    Null and empty texts give 'und', confidence 0 and wrong false.
    """

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            texts = [plain(t) if t else "" for t in b["t"]]
            z, letters = scorer.logits(texts)
            best = z.argmax(1)
            conf = np.where(letters > 0, np.exp(z.max(1)), 0.0)
            ok = (letters > 0) & (conf >= model.least)
            given = [CODES.get((x or "").strip().lower()) for x in b["y"]]
            own = np.array([z[i, LANGS.index(g)] if g in LANGS else -np.inf for i, g in enumerate(given)])
            wrong = ok & (z.max(1) - own > LABEL_TRUST)
            yield pd.DataFrame({"k": b["k"], "lang": np.where(ok, np.array(LANGS)[best], "und"), "confidence": conf.astype(float), "label_lang": given, "wrong": wrong})

    kind = df.select(key).schema[0].dataType.simpleString()
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("y"))
    return src.mapInPandas(run, f"k {kind}, lang string, confidence double, label_lang string, wrong boolean").withColumnRenamed("k", key)


def label_segments(df: DataFrame, key: str, text: str, languages: str, model: Model) -> DataFrame:
    """(key, segment_no, start_char, end_char, lang, confidence, is_named): the stretches of one language of each text.

    is_named says whether the JSON value in languages names the language. Null and blank texts have no segment.
    """

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            texts = [t or "" for t in b["t"]]
            rows = []
            for k, js, segs in zip(b["k"], b["y"], segments(texts, scorer)):
                names = named(js)
                rows += [(k, i, s, e, lang, c, lang in names) for i, (s, e, lang, c) in enumerate(segs)]
            yield pd.DataFrame(rows, columns=["k", "segment_no", "start_char", "end_char", "lang", "confidence", "is_named"]).astype({"segment_no": "int32", "start_char": "int32", "end_char": "int32", "confidence": float, "is_named": bool})

    kind = df.select(key).schema[0].dataType.simpleString()
    src = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(languages).cast("string").alias("y"))
    return src.mapInPandas(run, f"k {kind}, segment_no int, start_char int, end_char int, lang string, confidence double, is_named boolean").withColumnRenamed("k", key)
