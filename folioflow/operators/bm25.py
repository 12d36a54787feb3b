"""Okapi BM25 over a corpus: tokens, statistics, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import keep, spread
from .sizes import small

K1, B, EPSILON = 1.5, 0.75, 0.25
#: References that are tokens as a whole, in the order in which they are taken out.
SPECIAL = (r"section\s+\d+[a-z]?", r"chapter\s+\d+", r"part\s+\d+", r"article\s+\d+", r"clause\s+\([a-z0-9]+\)", r"\d+[a-z]?")


WORD = r"(?<![\p{L}\p{N}_])([a-z]++)(?![\p{L}\p{N}_])"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """References, then words of ASCII letters, of the lower-case text; single letters are dropped."""

    def rest(text: Column, n: int, found: list[Column]) -> Column:
        if n == len(SPECIAL):
            return F.concat(*found, F.regexp_extract_all(text, F.lit(WORD), F.lit(1)))
        own = F.regexp_extract_all(text, F.lit(f"({SPECIAL[n]})"), F.lit(1))
        return _let(F.regexp_replace(text, SPECIAL[n], " "), lambda left: rest(left, n + 1, [*found, own]))

    return F.filter(_let(F.lower(text), lambda t: rest(t, 0, [])), lambda t: (F.length(t) > 1) | t.rlike(r"^\d"))


def counted(text: Column) -> Column:
    """(term, tf) of the distinct tokens of a text, counted within the row: the tokens sorted, each run's length."""

    def runs(own: Column) -> Column:
        at = F.transform(own, lambda t, i: F.struct(t.alias("term"), i.alias("i")))
        first = F.filter(at, lambda e: (e["i"] == 0) | (e["term"] != F.get(own, e["i"] - 1)))
        return _let(first, lambda f: F.transform(f, lambda e, j: F.struct(e["term"].alias("term"), (F.coalesce(F.get(f, j + 1)["i"], F.size(own)) - e["i"]).alias("tf"))))

    return _let(F.array_sort(tokens(F.coalesce(text, F.lit("")))), runs)


def posted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dl, terms) as a written table: each document once with its length and counted terms, nulls as empty texts.

    Statistics and scores both read it, so that texts are tokenised once.
    """
    own = spread(docs.select(key, text)).select(key, counted(F.col(text)).alias("terms"))
    return keep(own.select(key, F.aggregate("terms", F.lit(0), lambda n, t: n + t["tf"]).alias("dl"), "terms"))


def statistics(docs: DataFrame, key: str, text: str, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(term, df, idf) and one row (n, avgdl). A negative idf becomes a share of the mean idf of all terms.

    A document holds a term once in its counted terms, so (term, 1) is summed before
    and after one shuffle of the vocabulary; tokens are never shuffled.
    """
    table = posted(docs, key, text) if table is None else table
    corpus = table.agg(F.count("*").alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) / F.count("*")).alias("avgdl"))
    df = table.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(corpus), F.lit(True)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(F.broadcast(mean), F.lit(True)).select("term", "df", idf.alias("idf")), corpus


def index_statistics(docs: DataFrame, by: str, text: str) -> DataFrame:
    """(by, documents, tokens, terms, avgdl) of the index of each collection ``by``; documents without a collection have none."""
    rows = keep(spread(docs.where(F.col(by).isNotNull()).select(by, text)).select(by, counted(F.col(text)).alias("terms")))
    sizes = rows.groupBy(by).agg(F.count("*").alias("documents"), F.sum(F.aggregate("terms", F.lit(0), lambda n, t: n + t["tf"])).cast("long").alias("tokens"))
    words = rows.select(by, F.explode("terms.term").alias("term")).distinct().groupBy(by).agg(F.count("*").alias("terms"))
    joined = sizes.join(words, by, "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    return joined.withColumn("avgdl", F.round(F.col("tokens") / F.col("documents"), 6))


def search(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int = 10, allowed: DataFrame | None = None) -> DataFrame:
    """(qid, key, score, rank): the k best documents of each query (qid, query).

    A term counts as often as the query has it. Documents without any term of the
    query have no row. Ties go to the smaller key. ``allowed`` (key) cuts the
    documents that are scored; statistics stay those of all ``docs``. Terms with
    their weights are broadcast if they pass the check of their size, so only
    postings of asked terms, and of those only one partial score a query and
    document, are shuffled; many queries at once take a shuffled join.
    """
    table = posted(docs, key, text)
    idf, corpus = statistics(docs, key, text, table)
    asked = queries.select("qid", F.explode(tokens(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    weights = small(keep(asked.join(idf, "term").select("qid", "term", (F.col("times") * F.col("idf")).alias("weight"))))
    rows = table if allowed is None else table.join(allowed.select(key).distinct(), key, "left_semi")
    hits = rows.select(key, "dl", F.inline("terms")).join(weights, "term").join(F.broadcast(corpus), F.lit(True))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("qid", key).agg(F.round(F.sum(part), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= k)
