"""Fusion of vector and keyword results and re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bm25 import tokens


def weights(vector: float, keyword: float) -> tuple[float, float]:
    """The two weights scaled to sum 1; 0.7 and 0.3 if there is nothing to scale."""
    total = vector + keyword
    return (vector / total, keyword / total) if total > 0 else (0.7, 0.3)


def min_max(scored: DataFrame, by: str, score: str = "score") -> DataFrame:
    """Scores between 0 and 1 within each ``by``; the range counts as 1 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    span = F.when(high == low, 1.0).otherwise(high - low)
    return scored.withColumn("norm", (F.col(score) - low) / span)


def fuse(vector: DataFrame, keyword: DataFrame, limit: int, wv: float = 0.7, wb: float = 0.3) -> DataFrame:
    """(qid, chunk_id, score, rank) of a full outer join of both legs (qid, chunk_id, score).

    Keyword scores are scaled per query. A missing leg counts 0; either leg may be
    empty. Of repeated rows of a leg the best counts.
    """
    wv, wb = weights(wv, wb)
    v = vector.groupBy("qid", "chunk_id").agg(F.max("score").alias("v"))
    b = min_max(keyword, "qid").groupBy("qid", "chunk_id").agg(F.max("norm").alias("b"))
    both = v.join(b, ["qid", "chunk_id"], "full_outer")
    score = F.round(wv * F.coalesce("v", F.lit(0.0)) + wb * F.coalesce("b", F.lit(0.0)), 6)
    ranked = both.select("qid", "chunk_id", score.alias("score")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))
    )
    return ranked.where(F.col("rank") <= limit)


def overlap(query: Column, text: Column) -> Column:
    """Default re-ranker: the share of the query's distinct tokens in the first 512 characters of the text."""
    asked = F.array_distinct(tokens(query))
    cut = F.when(F.length(text) > 512, F.concat(F.substring(text, 1, 512), F.lit("..."))).otherwise(text)
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, tokens(cut))) / F.size(asked))


def rerank(hits: DataFrame, k: int, scorer: Column) -> DataFrame:
    """The k best hits of each query by ``scorer``; the reported score mixes it with the score so far."""
    scored = hits.withColumn("rerank_score", F.round(scorer, 6)).withColumn("score", F.round(0.7 * F.col("rerank_score") + 0.3 * F.col("score"), 6))
    w = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
