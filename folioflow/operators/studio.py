"""Answers over several documents: chunks, citations, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CITATION = r"\[CITE:([A-Za-z0-9_]+)\]"


def best_chunks(hits: DataFrame, per_document: int = 5, overall: int = 8) -> DataFrame:
    """(qid, doc_id, score, ord): the best hits of each document, then of each query; ties in document order."""
    own = Window.partitionBy("qid", "doc_id").orderBy(F.desc("score"), "hit")
    all_ = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "hit")
    kept = hits.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= per_document)
    return kept.withColumn("ord", F.row_number().over(all_)).where(F.col("ord") <= overall).drop("_n")


def cited(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, cite): the distinct citation signs of each answer in order of appearance (ord)."""
    found = F.array_distinct(F.regexp_extract_all(F.col(answer), F.lit(CITATION), F.lit(1)))
    return answers.select(key, F.posexplode(found).alias("ord", "cite"))


def primary(uses: DataFrame, by: str, what: str, share: float = 0.6) -> DataFrame:
    """(by, primary, top_share): the most used value if it has at least ``share`` of the uses, else null; of equally used ones that with the first use (ord)."""
    n = uses.groupBy(by, what).agg(F.count("*").alias("n"), F.min("ord").alias("_first"))
    top = n.groupBy(by).agg(F.max_by(what, F.struct("n", -F.col("_first"))).alias("_top"), F.max("n").alias("_m"), F.sum("n").alias("_all"))
    ratio = F.col("_m") / F.col("_all")
    return top.select(by, F.when(ratio >= share, F.col("_top")).alias("primary"), F.round(ratio, 6).alias("top_share"))


def confidence(n: Column) -> Column:
    """low without citations, high from three on."""
    return F.when(n == 0, "low").when(n >= 3, "high").otherwise("medium")


def context(rows: DataFrame, by: list[str], order: str, piece: Column, separator: str = "\n\n") -> DataFrame:
    """(by..., context): pieces of text in order, joined."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))), lambda x: x["p"]), separator)
    return rows.groupBy(*by).agg(listed.alias("context"))


def error_class(message: Column) -> Column:
    """Kind of a failure by its message; the first that fits counts."""
    low = F.lower(message)
    has = lambda *xs: F.coalesce(*[F.nullif(low.contains(x), F.lit(False)) for x in xs], F.lit(False))
    return (
        F.when(has("timeout", "timed out"), "timeout")
        .when(has("rate limit", "quota", "429"), "rate_limit")
        .when(has("invalid", "400"), "invalid_request")
        .when(has("empty", "no response"), "empty_response")
        .otherwise("api_error")
    )
