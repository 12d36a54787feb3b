"""Queries of retrieval: keyword, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bm25, hybrid, vectors
from ..operators.sizes import small
from ..sources.tables import read
from . import register

SPECIAL_SQL = list(bm25.SPECIAL)


def tokens_sql(text: str) -> str:
    """The token list of an expression, by the same extraction with RE2."""
    parts, rest = [], f"lower({text})"
    for p in SPECIAL_SQL:
        parts.append(f"regexp_extract_all({rest}, '{p}')")
        rest = f"regexp_replace({rest}, '{p}', ' ', 'g')"
    words = f"list_filter(regexp_extract_all({rest}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))"
    return f"list_filter(list_concat({', '.join(parts)}, {words}), lambda t: length(t) > 1 or regexp_matches(t, '^[0-9]'))"


#: Tokens, postings, statistics and queries as common table expressions.
BM25_SQL = f"""
toks as (select doc_id, {tokens_sql("coalesce(text, '')")} as terms from documents),
corpus as (select count(*) as n, avg(len(terms)) as avgdl from toks),
post as (select doc_id, len(terms) as dl, term, count(*) as tf from (select doc_id, terms, unnest(terms) as term from toks) group by all),
dfs as (select term, count(*) as df from post group by term),
raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from dfs, corpus),
idfs as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
queries as (select substr(result_id, 7)::bigint as qid, query from query_results where substr(result_id, 7)::bigint % 50 = 0),
asked as (select qid, term, count(*) as times from (select qid, unnest({tokens_sql("query")}) as term from queries) group by all),
scored as (select qid, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from post join idfs using (term) join asked using (term), corpus group by all)"""


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every search whose number is divisible by 50."""
    q = read(spark, sf_dir, "query_results").select(F.substring("result_id", 7, 20).cast("long").alias("qid"), "query")
    return q.where("qid % 50 = 0")


@register("bm25_tokens", f"select doc_id, array_to_string({tokens_sql('text')}, '|') as tokens from documents where text is not null")
def bm25_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(bm25.tokens(F.col("text")), "|").alias("tokens"))


@register("bm25_idf_stats", f"with {BM25_SQL} select term, df, round(idf, 6) as idf from idfs")
def bm25_idf_stats(spark, sf_dir):
    idf, _ = bm25.statistics(read(spark, sf_dir, "documents"), "doc_id", "text")
    return idf.withColumn("idf", F.round("idf", 6))


@register(
    "bm25_topk",
    f"with {BM25_SQL} select qid, doc_id, score, rank from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from scored) where rank <= 10",
)
def bm25_topk(spark, sf_dir):
    hits = bm25.search(read(spark, sf_dir, "documents"), queries_of(spark, sf_dir), "doc_id", "text")
    return hits.select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@register(
    "bm25_filtered",
    f"""with {BM25_SQL} select qid, doc_id, score, rank from (select s.*, row_number() over (partition by qid order by score desc, doc_id) as rank
    from scored s join documents d using (doc_id) where d.lang = 'en' and d.source = 'gazette_weekly') where rank <= 10""",
)
def bm25_filtered(spark, sf_dir):
    """The payload filter applies after scoring: statistics are those of the whole corpus."""
    docs = read(spark, sf_dir, "documents")
    allowed = docs.where("lang = 'en' and source = 'gazette_weekly'")
    return bm25.search(docs, queries_of(spark, sf_dir), "doc_id", "text", allowed=allowed).withColumn("rank", F.col("rank").cast("long"))


@register(
    "bm25_index_stats",
    f"""with toks as (select source, {tokens_sql("coalesce(text, '')")} as terms from documents where source is not null),
    vocabulary as (select source, count(distinct term) as terms from (select source, unnest(terms) as term from toks) group by source)
    select source, count(*) as documents, sum(len(toks.terms))::bigint as tokens, coalesce(any_value(v.terms), 0) as terms, round(sum(len(toks.terms)) / count(*), 6) as avgdl
    from toks left join vocabulary v using (source) group by source""",
)
def bm25_index_stats(spark, sf_dir):
    """Size of the keyword index of each collection."""
    return bm25.index_statistics(read(spark, sf_dir, "documents"), "source", "text")


COSINE_SQL = """
unit as (select vec_id, label, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as size from embeddings),
pairs as (select q.vec_id as qid, q.label as qlabel, p.vec_id, p.label, round(list_dot_product(q.v, p.v) / (q.size * p.size), 6) as score
  from unit q, unit p where q.vec_id % 50 = 0 and q.vec_id <> p.vec_id and q.size > 0 and p.size > 0)"""


def vector_queries(points: DataFrame) -> DataFrame:
    return points.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), "label")


@register("vector_topk", f"with {COSINE_SQL} select qid, vec_id, score, rank from (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from pairs) where rank <= 10")
def vector_topk(spark, sf_dir):
    points = read(spark, sf_dir, "embeddings")
    return vectors.top_k(points, vector_queries(points), 10).withColumn("rank", F.col("rank").cast("long"))


@register(
    "vector_filtered_topk",
    f"with {COSINE_SQL} select qid, vec_id, score, rank from (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from pairs where label = qlabel) where rank <= 10",
)
def vector_filtered_topk(spark, sf_dir):
    points = read(spark, sf_dir, "embeddings")
    return vectors.top_k(points, vector_queries(points), 10, same="label").withColumn("rank", F.col("rank").cast("long"))


@register(
    "vector_multi_collection",
    f"""with {COSINE_SQL}, per as (select *, row_number() over (partition by qid, label order by score desc, vec_id) as r from pairs)
    select qid, label, vec_id, score, rank from (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from per where r <= 3) where rank <= 10""",
)
def vector_multi_collection(spark, sf_dir):
    """Three points of each collection (label), then the ten best of all.

    The points of a collection are ranked for a query among themselves: a query is asked once for each label.
    """
    points = read(spark, sf_dir, "embeddings")
    labels = points.where("label is not null").select("label").distinct()
    asked = vector_queries(points).drop("label")
    # (query, label) pairs get a number of their own, so that each is searched within its label.
    keyed = asked.join(small(labels), F.lit(True)).withColumn("code", F.col("qid") * 1_000_000 + F.col("label"))
    hits = vectors.top_k(points, keyed.select(F.col("code").alias("qid"), "vector", "label"), 4, same="label", exclude_self=False)
    hits = hits.select(F.floor(F.col("qid") / 1_000_000).cast("long").alias("qid"), (F.col("qid") % 1_000_000).cast("int").alias("label"), "vec_id", "score").where("qid <> vec_id")
    per = hits.withColumn("r", F.row_number().over(Window.partitionBy("qid", "label").orderBy(F.desc("score"), "vec_id"))).where("r <= 3")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return per.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10").select("qid", "label", "vec_id", "score", "rank")


@register("point_ids", "select vec_id, md5(concat_ws('_', label::varchar, vec_id::varchar))::uuid::varchar as point_id from embeddings where len(embedding) > 0")
def point_ids(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").where("size(embedding) > 0").select("vec_id", vectors.point_id(F.col("label"), F.col("vec_id")).alias("point_id"))


@register("collections", "select source as collection, count(*) as points from documents where source is not null group by source")
def collections(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("points"))


@register("vector_delete_document", "select vec_id, label from embeddings where vec_id not in (select doc_id from documents where source = 'gazette_weekly')")
def vector_delete_document(spark, sf_dir):
    """Points that stay when the documents of a source are deleted, in whatever collection."""
    gone = read(spark, sf_dir, "documents").where("source = 'gazette_weekly'").select(F.col("doc_id").alias("vec_id"))
    return read(spark, sf_dir, "embeddings").join(gone, "vec_id", "left_anti").select("vec_id", "label")


KEYWORD_SQL = "kw as (select qid, doc_id as chunk_id, score from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from scored) where rank <= 40)"
MINMAX_SQL = """scaled as (select qid, chunk_id, (score - min(score) over (partition by qid))
  / (case when max(score) over (partition by qid) = min(score) over (partition by qid) then 1.0 else max(score) over (partition by qid) - min(score) over (partition by qid) end) as norm from kw)"""
#: The vector of a query is that of the point with its number, within the number of points.
VECTOR_SQL = """
unit as (select vec_id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as size from embeddings),
qv as (select q.qid, u.v, u.size from queries q join unit u on u.vec_id = q.qid % (select count(*) from embeddings)),
vp as (select qid, p.vec_id as chunk_id, round(list_dot_product(qv.v, p.v) / (qv.size * p.size), 6) as score from qv, unit p where p.size > 0 and qv.size > 0),
vec as (select qid, chunk_id, score from (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from vp) where rank <= 40)"""
FUSED_SQL = f"""with {BM25_SQL}, {KEYWORD_SQL}, {MINMAX_SQL}, {VECTOR_SQL},
merged as (select coalesce(vec.qid, scaled.qid) as qid, coalesce(vec.chunk_id, scaled.chunk_id) as chunk_id,
  round(0.7 * coalesce(vec.score, 0) + 0.3 * coalesce(scaled.norm, 0), 6) as score from vec full outer join scaled on vec.qid = scaled.qid and vec.chunk_id = scaled.chunk_id),
fused as (select * from (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from merged) where rank <= 20)"""


def legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both legs of a hybrid search, 40 hits each: (qid, chunk_id, score)."""
    q = queries_of(spark, sf_dir)
    points = read(spark, sf_dir, "embeddings")
    n = points.agg(F.count("*").alias("n"))
    keyed = q.join(F.broadcast(n), F.lit(True)).withColumn("vec_id", F.col("qid") % F.col("n"))
    asked = keyed.join(points.select("vec_id", F.col("embedding").alias("vector")), "vec_id").select("qid", "vector")
    vector = vectors.top_k(points, asked, 40, exclude_self=False).select("qid", F.col("vec_id").alias("chunk_id"), "score")
    keyword = bm25.search(read(spark, sf_dir, "documents"), q, "doc_id", "text", 40).select("qid", F.col("doc_id").alias("chunk_id"), "score")
    return vector, keyword


@register("minmax_bm25", f"with {BM25_SQL}, {KEYWORD_SQL}, {MINMAX_SQL} select qid, chunk_id, round(norm, 6) as norm from scaled")
def minmax_bm25(spark, sf_dir):
    hits = bm25.search(read(spark, sf_dir, "documents"), queries_of(spark, sf_dir), "doc_id", "text", 40)
    return hybrid.min_max(hits, "qid").select("qid", F.col("doc_id").alias("chunk_id"), F.round("norm", 6).alias("norm"))


@register("hybrid_fusion", FUSED_SQL + " select qid, chunk_id, score, rank from fused")
def hybrid_fusion(spark, sf_dir):
    vector, keyword = legs(spark, sf_dir)
    return hybrid.fuse(vector, keyword, 20).withColumn("rank", F.col("rank").cast("long"))


@register(
    "hybrid_keyword_only",
    f"""with {BM25_SQL}, {KEYWORD_SQL}, {MINMAX_SQL} select qid, chunk_id, score, rank from
    (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from (select qid, chunk_id, round(0.3 * norm, 6) as score from scaled)) where rank <= 20""",
)
def hybrid_keyword_only(spark, sf_dir):
    """A vector leg that failed counts as empty."""
    keyword = bm25.search(read(spark, sf_dir, "documents"), queries_of(spark, sf_dir), "doc_id", "text", 40).select("qid", F.col("doc_id").alias("chunk_id"), "score")
    return hybrid.fuse(keyword.limit(0), keyword, 20).withColumn("rank", F.col("rank").cast("long"))


RERANK_SQL = FUSED_SQL + f""", scored2 as (select f.qid, f.chunk_id, f.rank as old, f.score,
  case when len(list_distinct({tokens_sql("q.query")})) = 0 then 0.0 else
  round(len(list_intersect(list_distinct({tokens_sql("q.query")}), {tokens_sql("case when length(d.text) > 512 then substr(d.text, 1, 512) || '...' else d.text end")}))::double / len(list_distinct({tokens_sql("q.query")})), 6) end as rerank_score
  from fused f join queries q on q.qid = f.qid join documents d on d.doc_id = f.chunk_id where d.text is not null)
select qid, chunk_id, rerank_score, round(0.7 * rerank_score + 0.3 * score, 6) as score, rank from
(select *, row_number() over (partition by qid order by rerank_score desc, old, chunk_id) as rank from scored2) where rank <= 5"""


@register("hybrid_retrieve_rerank", RERANK_SQL)
def hybrid_retrieve_rerank(spark, sf_dir):
    """The retrieval funnel: 40 + 40 hits, 20 fused, 5 after re-ranking."""
    vector, keyword = legs(spark, sf_dir)
    fused = hybrid.fuse(vector, keyword, 20)
    texts = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("chunk_id"), "text")
    hits = fused.join(texts, "chunk_id").join(queries_of(spark, sf_dir), "qid")
    best = hybrid.rerank(hits, 5, hybrid.overlap(F.col("query"), F.col("text")))
    return best.select("qid", "chunk_id", "rerank_score", "score", F.col("rank").cast("long").alias("rank"))
