"""Places where models plug in: encoders, pair scorers, language models and judges, each a plain function in Arrow batches.

None is needed: without one a deterministic stand-in works. A failure of a hook gives a status, never an error.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rillway.functions.text import min_max

DIM = 64


def hashed_encoder(texts: list[str]) -> np.ndarray:
    """Stand-in for an encoder: unit vectors of hashed words."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % DIM] += 1.0 if h & (1 << 30) else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def encode(df: DataFrame, text: str, out: str = "embedding", encoder: Callable[[list[str]], np.ndarray] = hashed_encoder, prefix: str = "") -> DataFrame:
    """df with unit vectors of a text column; prefix is for encoders that tell queries from passages. Null texts have null vectors."""

    def run(batches):
        for t in batches:
            v = encoder([prefix + (x or "") for x in t])
            yield pd.Series([None if x is None else r / max(float(np.linalg.norm(r)), 1e-9) for x, r in zip(t, np.asarray(v, np.float32))])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def word_share(a: list[str], b: list[str]) -> list[float]:
    """Stand-in for a cross-encoder: share of the words of a that b has."""
    return [len(set(x.lower().split()) & set(y.lower().split())) / max(1, len(set(x.lower().split()))) for x, y in zip(a, b)]


def cross_rerank(ranked: DataFrame, qid: str, key: str, query: str, text: str, score: Callable[[list[str], list[str]], list[float]] = word_share, weight: float = 0.65, head: int = 20) -> DataFrame:
    """The head of each ranking by weight times the model's scaled score and the rest the scaled score; what is below the head is cut off."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(score(list(a.fillna("")), list(b.fillna(""))), dtype="float64")

    w = Window.partitionBy(qid)
    d = ranked.where(F.col("rank") <= head).withColumn("_m", F.pandas_udf(run, "double")(F.col(query), F.col(text)))
    fused = weight * min_max(F.col("_m"), F.min("_m").over(w), F.max("_m").over(w)) + (1 - weight) * min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w))
    d = d.withColumn("score", F.round(fused, 6)).drop("_m")
    return d.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), key)))


def ask(df: DataFrame, prompt: Column, model: Callable[[str], str] | None, out: str = "answer") -> DataFrame:
    """df with a model's answer to a prompt and a status: 'success', 'disabled' without a model, else the error."""
    if model is None:
        return df.withColumn(out, F.lit(None).cast("string")).withColumn(out + "_status", F.lit("disabled"))

    def run(p: pd.Series) -> pd.DataFrame:
        rows = []
        for x in p:
            try:
                rows.append((model(x), "success"))
            except Exception as e:
                rows.append((None, f"error: {e}"))
        return pd.DataFrame(rows, columns=["a", "s"])

    return df.withColumn("_x", F.pandas_udf(run, "a string, s string")(prompt)).withColumn(out, F.col("_x.a")).withColumn(out + "_status", F.col("_x.s")).drop("_x")


#: What a model is asked at each step.
PROMPTS = {
    "augment": "Rewrite the question for retrieval, one line: {question}", "rewrite": "The evidence was weak. Ask the question in other words, one line: {question}", "translate": "Translate to English, one line: {question}",
    "answer": "Answer only from the context.\nContext:\n{context}\nQuestion: {question}", "critique": "Correct the answer so that every statement is in the context.\nContext:\n{context}\nAnswer: {answer}", "judge": "Give JSON with gold_claims and answer_claims, each with claim, context_nli, answer_nli or gold_nli and supporting_chunk_ids.\nContext:\n{context}\nGold: {gold}\nAnswer: {answer}",
    "rank": "Order the candidates by fit, numbers separated by commas.\nQuery: {question}\nCandidates:\n{candidates}",
}


def prompt(step: str) -> Column:
    """The prompt of a step with the columns it names filled in."""
    import re

    parts = re.split(r"\{(\w+)\}", PROMPTS[step])
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def model_order(ranked: DataFrame, qid: str, query: str, text: str, model: Callable[[str], str] | None, weight: float = 0.5, head: int = 10) -> DataFrame:
    """The head of each ranking mixed with a model's order of it, weight for the order; without a usable answer nothing changes."""
    top = ranked.where(F.col("rank") <= head)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring(text, 1, 300).alias("t")))), lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["t"])), "\n")
    asked = ask(top.groupBy(qid).agg(F.first(query).alias("question"), lines.alias("candidates")), prompt("rank"), model)
    order = asked.select(qid, F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))).alias("o"))
    w = Window.partitionBy(qid)
    n = F.count("*").over(w)
    d = top.join(order, qid, "left").withColumn("at", F.array_position(F.coalesce("o", F.array().cast("array<int>")), F.col("rank")))
    place = F.when(F.col("at") > 0, F.when(n > 1, (n - F.col("at")) / (n - 1)).otherwise(1.0)).otherwise(0.0)
    mixed = (1 - weight) * min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w)) + weight * place
    d = d.withColumn("score", F.when(F.size(F.coalesce("o", F.array().cast("array<int>"))) > 0, F.round(mixed, 6)).otherwise(F.col("score"))).drop("o", "at")
    return d.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "rank")))


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer, from the first to the last brace; null where that is none."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(F.call_function("try_parse_json", F.nullif(body, F.lit(""))).isNotNull(), body)


def verdict(label: Column) -> Column:
    """Labels of judges in their one form: supported, contradicted or not_enough_info."""
    v = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(v.isin("supported", "entailed", "entailment", "yes", "true"), "supported").when(v.isin("contradicted", "contradiction", "refuted"), "contradicted").otherwise("not_enough_info")


JUDGED = "STRUCT<claim STRING, context_nli STRING, answer_nli STRING, gold_nli STRING, supporting_chunk_ids ARRAY<STRING>>"


def judge_metrics(judged: DataFrame, qid: str, payload: str, valid: str) -> DataFrame:
    """Claim metrics from judges' JSON payloads; chunk ids that aren't among the valid ones of the row count as invalid and support nothing. A payload without claims gives nulls."""
    x = F.from_json(json_object(F.col(payload)), f"STRUCT<gold_claims ARRAY<{JUDGED}>, answer_claims ARRAY<{JUDGED}>>")
    d = judged.select(qid, F.col(valid).alias("valid"), x.alias("x"))
    none = F.array().cast(f"array<{JUDGED}>")
    rows = F.concat(F.transform(F.coalesce("x.gold_claims", none), lambda c: F.struct(F.lit("gold").alias("kind"), c.alias("c"))), F.transform(F.coalesce("x.answer_claims", none), lambda c: F.struct(F.lit("answer").alias("kind"), c.alias("c"))))
    e = d.select(qid, "valid", F.explode_outer(rows).alias("r")).select(qid, "valid", "r.kind", "r.c.*")
    ids = F.coalesce("supporting_chunk_ids", F.array().cast("array<string>"))
    e = e.withColumn("good", F.size(F.array_intersect(ids, "valid"))).withColumn("bad", F.size(F.array_except(ids, "valid"))).where(F.col("kind").isNull() | (F.trim(F.coalesce("claim", F.lit(""))) != ""))
    g, a = F.col("kind") == "gold", F.col("kind") == "answer"
    sup = lambda c: verdict(F.col(c)) == "supported"
    n = e.groupBy(qid).agg(
        F.count_if(g).alias("gold_claims"), F.count_if(a).alias("answer_claims"), F.count_if(g & sup("context_nli")).alias("gold_in_context"), F.count_if(g & sup("answer_nli")).alias("gold_in_answer"), F.count_if(a & sup("gold_nli")).alias("answer_in_gold"), F.count_if(a & sup("context_nli")).alias("answer_in_context"),
        F.count_if(a & (verdict(F.col("context_nli")) == "contradicted")).alias("contradicted_claims"), F.count_if(a & sup("context_nli") & (F.col("good") > 0)).alias("attributed"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_attributions"),
    )
    r = lambda x, y: F.round(F.when(F.col(y) > 0, F.col(x) / F.col(y)), 6)
    return n.select("*", r("gold_in_context", "gold_claims").alias("context_claim_recall"), r("gold_in_answer", "gold_claims").alias("answer_claim_recall"), r("answer_in_gold", "answer_claims").alias("answer_claim_precision"), r("answer_in_context", "answer_claims").alias("grounded_ratio"), r("attributed", "answer_claims").alias("attribution_precision"))


def retry_weak(questions: DataFrame, search: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame, DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], rounds: int = 1) -> DataFrame:
    """Chunks for questions (qid, question), where questions with weak evidence are asked again in other words, so many times at most; a new result counts only where its evidence is better.

    search gives (qid, chunk_id, rank, score, text), judge (qid, status, score) of questions and chunks, rewrite questions in other words.
    """
    from rillway.session import Scratch

    scratch = Scratch(questions.sparkSession)
    best = scratch.cut(search(questions))
    seen = scratch.cut(judge(questions, best))
    now = questions
    for _ in range(rounds):
        weak = seen.where("status <> 'good_evidence'").select("qid")
        now = scratch.cut(rewrite(now.join(weak, "qid", "left_semi")))
        if now.isEmpty():
            break
        found = scratch.cut(search(now))
        after = scratch.cut(judge(now, found))
        won = after.join(seen.select("qid", F.col("score").alias("old")), "qid").where("score > old").select("qid")
        best = scratch.cut(best.join(won, "qid", "left_anti").unionByName(found.join(won, "qid", "left_semi")))
        seen = scratch.cut(seen.join(won, "qid", "left_anti").unionByName(after.join(won, "qid", "left_semi")))
    return best
