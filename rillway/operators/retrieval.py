"""Lexical and vector retrieval of many queries at once, fusion of rankings and reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rillway.functions.text import min_max, tokens
from rillway.session import Scratch, read_shared, shared_object

DIGITS = 6
#: Share of the pairs of a block from which a term's part is multiplied as matrices.
OFTEN = 0.01


def chunks(df: DataFrame, key: str, text: Column, size: int, overlap: int) -> DataFrame:
    """Sliding windows of words (key, chunk_index, start_word, end_word, text); texts without words give none."""
    step = max(size - overlap, 1)
    w = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    d = df.select(key, w.alias("w")).where("size(w) > 0").withColumn("n", F.size("w"))
    count = 1 + F.ceil(F.greatest(F.col("n") - size, F.lit(0)) / F.lit(step)).cast("int")
    d = d.select(key, "w", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return d.select(key, "chunk_index", start.alias("start_word"), F.least(start + size, F.col("n")).alias("end_word"), F.array_join(F.slice("w", start + 1, size), " ").alias("text"))


def tokenised(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, t): the tokens of each document, laid out by key.

    All that a lexical model needs is derived from this one exchange, which Spark reuses: texts are read and cut once, and counting
    and scoring by document need no other exchange of postings.
    """
    return docs.select(key, tokens(text).alias("t")).repartition(F.col(key))


def _counted(cut: DataFrame, key: str, terms: Column) -> DataFrame:
    # explode would be given a filter on the size of the tokens, for which texts are cut a second time below the exchange
    return cut.select(key, F.size("t").alias("n_terms"), F.explode_outer(terms).alias("term")).where("term is not null").groupBy(key, "n_terms", "term").agg(F.count("*").alias("tf"))


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, n_terms) of a corpus; the unit of both lexical models."""
    return _counted(tokenised(docs, key, text), key, F.col("t"))


def grams(t: Column) -> Column:
    """The words of two letters and more, and their pairs of neighbours."""
    w = F.filter(t, lambda x: F.length(x) > 1)
    return F.concat(w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x, y: F.when(y.isNotNull(), F.concat(x, F.lit(" "), y))))


def query_terms(queries: DataFrame, qid: str, text: Column) -> DataFrame:
    return queries.select(qid, F.explode(tokens(text)).alias("term")).groupBy(qid, "term").agg(F.count("*").alias("qtf"))


def top_k(scored: DataFrame, qid: str | list[str], key: str, k: int, score: str = "score") -> DataFrame:
    """The k best of each query with rank; scores are rounded, ties go to the smaller key. Null scores are left out."""
    s = scored.where(F.col(score).isNotNull()).withColumn(score, F.round(score, DIGITS))
    w = Window.partitionBy(qid).orderBy(F.desc(score), key)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, key: str, text: Column, queries: DataFrame, qid: str, qtext: Column, k1: float = 1.5, b: float = 0.75, eps: float | None = 0.25, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, key, score) for all pairs with a common term; repeated query terms count each time.

    Negative weights become eps times the mean weight; with eps None they become a millionth and query terms count once, as full-text
    engines do. allowed (key) narrows the documents that are scored; the statistics are those of all documents.
    """
    p, q, _ = _bm25_parts(docs, key, text, queries, qid, qtext, eps)
    if allowed is not None:
        p = p.join(allowed.select(key).distinct(), key, "left_semi")
    tf = F.col("tf")
    gain = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n_terms") / F.col("avgdl")))
    return p.join(q, "term").groupBy(qid, key).agg(F.sum(gain).alias("score"))


def _bm25_parts(docs: DataFrame, key: str, text: Column, queries: DataFrame, qid: str, qtext: Column, eps: float | None):
    """Postings of the documents, terms of the queries with their weight, and size of the corpus."""
    cut = tokenised(docs, key, text)
    p = _counted(cut, key, F.col("t"))
    size = cut.agg(F.count("*").alias("N"), F.avg(F.size("t")).alias("avgdl"))
    idf = p.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(size), F.lit(True)).withColumn("idf", F.log(F.col("N") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    if eps is None:
        idf = idf.select("term", "avgdl", F.greatest("idf", F.lit(1e-6)).alias("idf"))
    else:
        mean = idf.agg(F.avg("idf").alias("mean"))
        idf = idf.join(F.broadcast(mean), F.lit(True)).select("term", "avgdl", F.when(F.col("idf") < 0, eps * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    q = query_terms(queries, qid, qtext)
    return p, (q if eps is not None else q.withColumn("qtf", F.lit(1))).join(idf, "term"), size


def tfidf(docs: DataFrame, key: str, text: Column, queries: DataFrame, qid: str, qtext: Column, features: int = 50_000) -> DataFrame:
    """(qid, key, score): cosine of smoothed TF-IDF vectors of words of two letters and more and their pairs; only the most frequent features of the corpus count."""
    d, norm, q, qnorm = _tfidf_parts(docs, key, text, queries, qid, qtext, features)
    dot = d.join(q, "term").groupBy(qid, key).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return dot.join(norm, key).join(qnorm, qid).select(qid, key, (F.col("dot") / F.col("norm") / F.col("qnorm")).alias("score"))


def _tfidf_parts(docs: DataFrame, key: str, text: Column, queries: DataFrame, qid: str, qtext: Column, features: int):
    """Weighted terms of documents and queries, and the lengths of both vectors."""
    cut = tokenised(docs, key, text)
    p = _counted(cut, key, grams(F.col("t"))).where("term is not null")
    total = cut.agg(F.count("*").alias("N"))
    df = p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).orderBy(F.desc("cf"), "term").limit(features)
    idf = df.join(F.broadcast(total), F.lit(True)).select("term", (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1).alias("idf"))
    d = p.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = d.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = queries.select(qid, F.explode(grams(tokens(qtext))).alias("term")).where("term is not null").groupBy(qid, "term").agg(F.count("*").alias("qtf"))
    q = q.join(idf, "term").select(qid, "term", (F.col("qtf") * F.col("idf")).alias("qw"))
    qnorm = q.groupBy(qid).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    return d, norm, q, qnorm


class _Terms:
    """Weighted terms of queries (qid, term, w), by term."""

    def __init__(self, path: str):
        t = read_shared(path)
        qi, self.qids = pd.factorize(t["qid"], sort=True)
        ti, self.vocabulary = pd.factorize(t["term"])
        order = np.lexsort((qi, ti))
        self.q, self.w = qi[order], t["w"].to_numpy()[order]
        self.at = np.searchsorted(ti[order], np.arange(len(self.vocabulary) + 1))


def _best(ix: _Terms, n: int, di, ti, dw, k: int, many: int):
    """Rows (query, document, score) of a block of n documents that may be among the k best of a query; di, ti, dw: document, term and weight."""
    order = np.argsort(ti, kind="stable")
    di, ti, dw = di[order], ti[order], dw[order]
    ts, at = np.unique(ti, return_index=True)
    ends = np.append(at[1:], len(ti))
    positive = len(dw) == 0 or (dw.min() > 0 and ix.w.min() > 0)  # then what has a common term is what has a score
    for low in range(0, len(ix.qids), many):
        nq = min(many, len(ix.qids) - low)
        s, met, often = np.zeros((nq, n)), None if positive else np.zeros((nq, n), dtype=bool), []
        for t, i, j in zip(ts, at, ends):
            own = ix.q[ix.at[t] : ix.at[t + 1]]
            x, y = np.searchsorted(own, (low, low + nq)) + ix.at[t]
            if positive and (y - x) * (j - i) > OFTEN * nq * n:
                often.append((x, y, i, j))
            elif x < y:
                pairs = np.ix_(ix.q[x:y] - low, di[i:j])
                s[pairs] += np.outer(ix.w[x:y], dw[i:j])
                if not positive:
                    met[pairs] = True
        # terms of many pairs by a product of matrices
        for few in range(0, len(often), 256):
            some = often[few : few + 256]
            a, b = np.zeros((nq, len(some))), np.zeros((len(some), n))
            for f, (x, y, i, j) in enumerate(some):
                a[ix.q[x:y] - low, f], b[f, di[i:j]] = ix.w[x:y], dw[i:j]
            s += a @ b
        if positive:
            met = s > 0
        s[~met] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k] if n > k else np.full(nq, -np.inf)
        # a hair less, as scores are rounded before they are compared
        qs, ds = np.nonzero(met & (s >= least[:, None] - 2 * 10.0**-DIGITS))
        yield qs + low, ds, s[qs, ds]


def sparse_top_k(docs: DataFrame, key: str, queries: DataFrame, qid: str, k: int, block: int = 2048, many: int = 4096) -> DataFrame:
    """(qid, key, score, rank): the k largest sums of products of documents (key, term, w) and queries (qid, term, w) with a common term.

    Where queries are as many as documents and share frequent words, the pairs with a common term are too many to be rows. So
    documents are taken in blocks against all queries, whose terms each Python worker reads from the shared folder; only what may
    be among the k best of a query leaves its block.
    """
    scratch = Scratch(docs.sparkSession)
    q = scratch.cut(queries.select(F.col(qid).alias("qid"), "term", F.col("w").cast("double").alias("w")))
    path = scratch.path(q)
    d = docs.join(q.select("term").distinct(), "term", "left_semi").groupBy(key).agg(F.collect_list(F.struct("term", F.col("w").cast("double").alias("w"))).alias("t"))
    d = d.select(F.col(key).alias("key"), F.col("t.term").alias("terms"), F.col("t.w").alias("ws")).repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)

    def score(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        ix = shared_object(_Terms, path)
        vocabulary = pa.array(ix.vocabulary, pa.string())
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                b = whole.slice(start, block)
                terms = b.column("terms")
                di = np.repeat(np.arange(b.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
                ti = pc.index_in(terms.flatten(), value_set=vocabulary).to_numpy(zero_copy_only=False).astype(int)
                for qs, ds, found in _best(ix, b.num_rows, di, ti, b.column("ws").flatten().to_numpy(zero_copy_only=False), k, many):
                    yield pa.RecordBatch.from_arrays([pa.array(ix.qids[qs]).cast(kind_q), b.column("key").take(pa.array(ds)), pa.array(found)], names=[qid, key, "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind_q = to_arrow_type(queries.schema[qid].dataType)
    show = lambda t, c: f"`{c}` {t.schema[c].dataType.simpleString()}"
    return top_k(d.mapInArrow(score, f"{show(queries, qid)}, {show(docs, key)}, score double"), qid, key, k)


def _by_key(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, t): tokens, the rows of a key one after another; texts are moved, as their tokens take several times the room."""
    return docs.select(F.col(key).alias("key"), text.alias("t")).repartition("key").sortWithinPartitions("key").select("key", tokens(F.col("t")).alias("t"))


def _whole(batches):
    """Batches in which no key is cut off from its other rows."""
    import pyarrow as pa

    rest = None
    for b in batches:
        if rest is not None:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        at = np.flatnonzero(np.diff(_codes(b.column("key"))))
        last = at[-1] + 1 if len(at) else 0
        if last:
            yield b.slice(0, last)
        rest = b.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def _codes(a) -> np.ndarray:
    return a.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)


class _Counted:
    """Terms of a batch of tokens: words, or with pairs words of two letters and more and pairs of neighbours; (doc, term, tf) by document."""

    def __init__(self, b, pairs: bool):
        import pyarrow as pa
        import pyarrow.compute as pc

        codes = _codes(b.column("key"))
        of = np.append(0, np.cumsum(codes[1:] != codes[:-1]))
        self.first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        self.keys, self.n = b.column("key").take(pa.array(self.first)), len(self.first)
        self.length = pc.list_value_length(b.column("t")).to_numpy(zero_copy_only=False)
        d = b.column("t").flatten().dictionary_encode()
        words, code, row = d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(of)), self.length)
        v = len(words)
        if pairs:
            keep = pc.greater(pc.utf8_length(words), 1).to_numpy(zero_copy_only=False)[code] if v else np.zeros(0, dtype=bool)
            code, row = code[keep], row[keep]
            near = np.flatnonzero(row[1:] == row[:-1])
            code, row = np.append(code, (code[near] + 1) * v + code[near + 1]), np.append(row, row[near])
        term, seen = pd.factorize(code)
        u = max(len(seen), 1)
        both = np.sort(of[row] * u + term)
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, dtype=int)
        self.doc, self.term, self.tf = both[at] // u, both[at] % u, np.diff(np.append(at, len(both)))
        two = seen >= v
        texts = words.take(pa.array(seen % max(v, 1)))
        if two.any():
            left = words.take(pa.array(np.where(two, seen // max(v, 1) - 1, 0)))
            texts = pc.if_else(pa.array(two), pc.binary_join_element_wise(left, texts, " "), texts)
        self.terms = texts


def term_counts(docs: DataFrame, key: str, text: Column, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, term, df, cf) of a corpus, words for 'bm25' and grams() for 'tfidf': in how many documents a term is, and how often; the row without a term has the rows and the words of all.

    Terms are counted as numbers within batches, so that no row is made for a term of a document.
    """

    def count(batches):
        import pyarrow as pa

        for b in _whole(batches):
            for kind in kinds:
                c = _Counted(b, kind == "tfidf")
                df, cf = np.bincount(c.term, minlength=len(c.terms)), np.bincount(c.term, c.tf, len(c.terms)).astype(np.int64)
                terms = pa.concat_arrays([c.terms, pa.array([None], pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(terms)), terms, pa.array(np.append(df, b.num_rows)), pa.array(np.append(cf, c.length.sum()))], names=["kind", "term", "df", "cf"])

    return _by_key(docs, key, text).mapInArrow(count, "kind string, term string, df long, cf long").groupBy("kind", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


class _Weights(_Terms):
    """Terms of the queries, and those of the corpus (term, idf) that count in a document's length."""

    def __init__(self, path: str, features: str | None):
        import pyarrow as pa

        super().__init__(path)
        self.values = pa.array(self.vocabulary, pa.string())
        if features:
            t = read_shared(features)
            self.features, self.idf = pa.array(t["term"], pa.string()), t["idf"].to_numpy()


def _weights(*paths) -> list[_Weights]:
    return [_Weights(*p) for p in paths]


def _tfidf_weights(scratch: Scratch, counts: DataFrame, docs: DataFrame, queries: DataFrame, qid: str, qtext: Column, features: int):
    """Terms of the queries by weight and of the corpus by idf."""
    total = docs.agg(F.count("*").alias("N"))
    idf = counts.where("term is not null").orderBy(F.desc("cf"), "term").limit(features).join(F.broadcast(total), F.lit(True))
    idf = scratch.cut(idf.select("term", (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1).alias("idf")))
    q = queries.select(qid, F.explode(grams(tokens(qtext))).alias("term")).where("term is not null").groupBy(qid, "term").agg(F.count("*").alias("qtf"))
    q = q.join(idf, "term").select(qid, "term", (F.col("qtf") * F.col("idf")).alias("qw"))
    norm = q.groupBy(qid).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    return q.join(norm, qid).select(qid, "term", (F.col("qw") / F.col("qnorm")).alias("w")), idf


def _bm25_weights(counts: DataFrame, queries: DataFrame, qid: str, qtext: Column):
    """Terms of the queries by weight, and the mean length of documents."""
    n, words = (counts.where("term is null").select("df", "cf").first() or (1, 1))[:2]
    idf = counts.where("term is not null").select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    idf = idf.join(F.broadcast(idf.agg(F.avg("idf").alias("mean"))), F.lit(True)).select("term", F.when(F.col("idf") < 0, 0.25 * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    return query_terms(queries, qid, qtext).join(idf, "term").select(qid, "term", (F.col("qtf") * F.col("idf")).alias("w")), words / n


def lexical_top_k(kinds: tuple[str, ...], docs: DataFrame, key: str, text: Column, queries: DataFrame, qid: str, qtext: Column, k: int, features: int = 50_000, block: int = 2048, many: int = 4096) -> DataFrame:
    """top_k of tfidf(), bm25() or both as kinds (kind, qid, key, score, rank), kind being the place among kinds, with neither rows for the terms of documents nor for pairs with a common term.

    Two passes over the texts: one counts the terms of the corpus, the other weighs and scores documents in blocks against all queries.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    scratch, avgdl, paths = Scratch(docs.sparkSession), 0.0, []
    counts = term_counts(docs, key, text, kinds)
    counts = counts if kinds == ("tfidf",) else scratch.cut(counts)
    for kind in kinds:
        own, idf = counts.where(F.col("kind") == kind), None
        if kind == "tfidf":
            q, idf = _tfidf_weights(scratch, own, docs, queries, qid, qtext, features)
        else:
            q, avgdl = _bm25_weights(own, queries, qid, qtext)
        q = scratch.cut(q.select(F.col(qid).alias("qid"), "term", "w"))
        paths.append((scratch.path(q), None if idf is None else scratch.path(idf)))

    def score(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        place = lambda a, values: pc.index_in(a, value_set=values).fill_null(-1).to_numpy(zero_copy_only=False)
        for b in _whole(batches):
            for at, (kind, ix) in enumerate(zip(kinds, shared_object(_weights, *paths))):
                c = _Counted(b, kind == "tfidf")
                ti = place(c.terms, ix.values)[c.term]
                # documents without a key count, but aren't found
                own = np.flatnonzero((ti >= 0) & c.keys.is_valid().to_numpy(zero_copy_only=False)[c.doc])
                di, ti = c.doc[own], ti[own]
                if kind == "tfidf":
                    w = c.tf * np.append(ix.idf, 0.0)[place(c.terms, ix.features)[c.term]]
                    w = w[own] / np.sqrt(np.bincount(c.doc, w * w, c.n))[di]
                else:
                    # rows of the same key have one count of a term, but each its length
                    rows = np.diff(np.append(c.first, len(c.length)))[di]
                    i = np.repeat(np.arange(len(own)), rows)
                    r = np.arange(len(i)) - np.repeat(np.cumsum(rows) - rows, rows) + c.first[di][i]
                    tf = c.tf[own][i]
                    w = np.bincount(i, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * c.length[r] / avgdl)), len(own))
                for start in range(0, c.n, block):
                    x, y = np.searchsorted(di, (start, start + block))
                    for qs, ds, found in _best(ix, min(block, c.n - start), di[x:y] - start, ti[x:y], w[x:y], k, many):
                        yield pa.RecordBatch.from_arrays([pa.array([at] * len(qs), pa.int32()), pa.array(ix.qids[qs]).cast(kind_q), c.keys.take(pa.array(ds + start)), pa.array(found)], names=["kind", qid, key, "score"])

    kind_q = to_arrow_type(queries.schema[qid].dataType)
    show = lambda t, c: f"`{c}` {t.schema[c].dataType.simpleString()}"
    return top_k(_by_key(docs, key, text).mapInArrow(score, f"kind int, {show(queries, qid)}, {show(docs, key)}, score double"), ["kind", qid], key, k)


def retrieve(kind: str, docs: DataFrame, key: str, text: Column, queries: DataFrame, qid: str, qtext: Column, k: int, alpha: float = 0.6, depth: int = 100, allowed: DataFrame | None = None) -> DataFrame:
    """The k best documents of each query by 'bm25', 'tfidf', 'fulltext', 'hybrid' (both scaled, alpha for TF-IDF) or 'rrf'; allowed narrows the documents."""
    few = lambda s: s if allowed is None else s.join(allowed.select(key).distinct(), key, "left_semi")
    args = (docs, key, text, queries, qid, qtext)
    if kind in ("bm25", "tfidf") and allowed is None:
        return lexical_top_k((kind,), *args, k).drop("kind")
    if kind == "bm25":
        scored = bm25(*args, allowed=allowed)
    elif kind == "fulltext":
        scored = bm25(*args, k1=1.2, eps=None, allowed=allowed)
    elif kind == "tfidf":
        scored = few(tfidf(*args))
    elif kind == "hybrid":
        scored = fuse_alpha(top_k(few(tfidf(*args)), qid, key, max(k, depth)), top_k(bm25(*args, allowed=allowed), qid, key, max(k, depth)), qid, key, alpha)
    elif kind == "rrf":
        scored = fuse_rrf([("tfidf", 1.0, few(tfidf(*args))), ("bm25", 0.8, bm25(*args, allowed=allowed))], qid, key, max(k, depth))
    else:
        raise ValueError(f"no retriever {kind}")
    return top_k(scored, qid, key, k)


def evidence_rerank(ranked: DataFrame, qid: str, key: str, question: Column, title: Column, text: Column) -> DataFrame:
    """.50 scaled score, .30 words of the question in title and text, .15 its numbers in the text (1 without numbers), .05 its words in the title."""
    w = Window.partitionBy(qid)
    words = F.array_distinct(F.filter(tokens(question), lambda x: F.length(x) > 2))
    numbers = F.array_distinct(F.regexp_extract_all(question, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)))
    has = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)
    known = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)))
    base = min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w))
    s = 0.50 * base + 0.30 * has(words, tokens(F.concat_ws(" ", title, text))) + 0.15 * F.when(F.size(numbers) > 0, has(numbers, known)).otherwise(1.0) + 0.05 * has(words, tokens(title))
    return ranked.withColumn("final", F.round(s, DIGITS)).withColumn("new_rank", F.row_number().over(w.orderBy(F.desc("final"), key)))


def context(ranked: DataFrame, qid: str, doc: str, section: str, text: str, mode: str = "ranked", most: int = 8, budget: int | None = None) -> DataFrame:
    """Rows of each query in the order a mode gives – 'ranked', 'kg_first' (rows that only the graph found come first), 'group_by_doc' (documents by their best rank) or 'dedupe_section' (the best of each section) –, at most so many and within a budget of characters; the first row always stays. Adds place."""
    w = Window.partitionBy(qid)
    d = ranked
    if mode == "dedupe_section":
        d = d.withColumn("_s", F.row_number().over(Window.partitionBy(qid, doc, section).orderBy("rank"))).where("_s = 1").drop("_s")
    if mode == "group_by_doc":
        d = d.withColumn("_b", F.min("rank").over(Window.partitionBy(qid, doc)))
        order = [F.col("_b"), F.col(doc), F.col("rank")]
    elif mode == "kg_first":
        order = [F.when(F.col("source") == "graph", 0).otherwise(1), F.col("rank")]
    elif mode in ("ranked", "dedupe_section"):
        order = [F.col("rank")]
    else:
        raise ValueError(f"no context mode {mode}")
    d = d.withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= most).drop("_b")
    if budget is not None:
        upto = F.sum(F.length(text)).over(w.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        d = d.withColumn("_u", upto).where((F.col("_u") <= budget) | (F.col("place") == 1)).drop("_u")
    return d


def dense_top_k(vectors: DataFrame, key: str, vector: str, is_query: Column, k: int, block: int = 2048) -> DataFrame:
    """(qid, key, score, rank): exact inner products of the query rows with all rows, block by block.

    Queries and rows are gathered into blocks of bounded size; every pair of blocks is one matrix product that
    returns only its k best per query. A query doesn't find itself. Rows without a vector are left out.
    """
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("i"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))

    def blocks(d: DataFrame, size: int) -> DataFrame:
        def gather(batches):
            for b in batches:
                for s in range(0, len(b), size):
                    p = b.iloc[s : s + size]
                    yield pd.DataFrame({"ids": [p["i"].to_numpy()], "flat": [np.concatenate(list(p["v"]))]})

        return d.select("i", "v").mapInPandas(gather, "ids array<long>, flat array<double>")

    left = blocks(v.where("q"), 256).toDF("qids", "qflat")

    def multiply(batches):
        for b in batches:
            for qi, qf, di, dfl in zip(b["qids"], b["qflat"], b["ids"], b["flat"]):
                s = np.round(np.asarray(qf).reshape(len(qi), -1) @ np.asarray(dfl).reshape(len(di), -1).T, DIGITS)
                di = np.asarray(di)
                s[np.asarray(qi)[:, None] == di[None, :]] = -np.inf
                n = min(k, s.shape[1])
                rows = []
                for q, row in zip(qi, s):
                    best = np.lexsort((di, -row))[:n]
                    rows += [(q, di[j], row[j]) for j in best if np.isfinite(row[j])]
                yield pd.DataFrame(rows, columns=["qid", "key", "score"])

    pairs = left.join(blocks(v, block), F.lit(True)).mapInPandas(multiply, "qid long, key long, score double")
    return top_k(pairs, "qid", "key", k)


def fuse_alpha(dense: DataFrame, lexical: DataFrame, qid: str, key: str, alpha: float) -> DataFrame:
    """alpha times the scaled dense plus (1 - alpha) times the scaled lexical score; a missing side counts 0."""
    w = Window.partitionBy(qid)

    def scaled(d: DataFrame, name: str) -> DataFrame:
        return d.select(qid, key, min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w)).alias(name))

    both = scaled(dense, "a").join(scaled(lexical, "b"), [qid, key], "full")
    return both.select(qid, key, (alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0))).alias("score"))


def fuse_rrf(channels: list[tuple[str, float, DataFrame]], qid: str, key: str, depth: int, constant: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion of channels (name, weight, scored); adds the number of channels that found a row."""
    ranked = None
    for name, weight, d in channels:
        r = top_k(d, qid, key, depth).select(qid, key, (F.lit(weight) / (constant + F.col("rank"))).alias("part"), F.lit(name).alias("channel"))
        ranked = r if ranked is None else ranked.unionByName(r)
    return ranked.groupBy(qid, key).agg(F.sum("part").alias("score"), F.count("*").cast("int").alias("n_channels"))


def rerank_head(ranked: DataFrame, qid: str, key: str, signal: Column, weight: float, head: int) -> DataFrame:
    """The head of each ranking reordered by (1 - weight) scaled score + weight signal; the tail stays below it."""
    w = Window.partitionBy(qid)
    r = ranked.withColumn("is_tail", F.col("rank") > head).withColumn("low", F.min("score").over(w)).withColumn("high", F.max("score").over(w))
    r = r.withColumn("final", F.when(F.col("is_tail"), F.col("score")).otherwise(F.round((1 - weight) * min_max(F.col("score"), F.col("low"), F.col("high")) + weight * signal, DIGITS)))
    order = Window.partitionBy(qid).orderBy("is_tail", F.desc("final"), key)
    return r.withColumn("new_rank", F.row_number().over(order)).drop("low", "high", "is_tail")


def context_budget(ranked: DataFrame, qid: str, text: str, budget: int) -> DataFrame:
    """Rows of each query in rank order while their texts fit a budget of characters; the first always stays."""
    upto = F.sum(F.length(text)).over(Window.partitionBy(qid).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("chars_upto", upto).where((F.col("chars_upto") <= budget) | (F.col("rank") == 1))
