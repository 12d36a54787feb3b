"""Composite pipelines: from words to texts, from texts to scored chunks, from questions to sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, chunks, hybrid, offsets, vectors, words


def parse_pages(ocr: DataFrame) -> DataFrame:
    """(document_id, page, markdown, words, x0, y0, x2, y2): clean words put together page by page."""
    clean = words.clean(ocr)
    lines = words.line_texts(clean, ["document_id", "page", "line"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    texts = lines.groupBy("document_id", "page").agg(body.alias("_t"))
    boxes = clean.groupBy("document_id", "page").agg(F.count("*").alias("words"), *(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x2", "y2")))
    return texts.join(boxes, ["document_id", "page"]).select("document_id", "page", offsets.page_markdown(F.col("page"), F.col("_t")).alias("markdown"), "words", "x0", "y0", "x2", "y2")


def to_markdown(ocr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document_id, markdown) and the places of the pages in it."""
    pages = parse_pages(ocr)
    return offsets.assemble(pages), offsets.page_spans(pages)


def chunk_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_index, chunk, completeness, coherence, quality): sections, sizes fitted, scored."""
    pieces = docs.where(F.col(text).isNotNull()).select(key, chunks.sections(F.col(text)).alias("pieces"))
    own = chunks.fit_sizes(pieces, key, "pieces")
    c = F.col("chunk")
    rich = T.richness(T.act_name(c), T.section_numbers(c), T.chapter_numbers(c), T.first_year(c))
    scored = own.withColumn("completeness", T.completeness(c)).withColumn("coherence", T.coherence(c)).withColumn("richness", rich)
    return scored.withColumn("quality", F.round(0.4 * F.col("completeness") + 0.3 * F.col("coherence") + 0.3 * F.col("richness") + 1e-9, 3))


def attach_metadata(chunked: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Chunks with their document's metadata and the sections that they name themselves."""
    c = F.col(text)
    meta = docs.select(key, T.act_name(c).alias("act_name"), T.first_year(c).alias("year"), T.section_numbers(c).alias("sections"), T.chapter_numbers(c).alias("chapters"))
    return chunked.join(meta, key).withColumn("sections_in_chunk", T.section_numbers(F.col("chunk")))


def hashed_vector(text: Column, size: int = 64) -> Column:
    """Default embedding: counts of the tokens by hash, so that equal texts have equal vectors. Stands for an external model."""
    at = F.transform(bm25.tokens(text), lambda t: F.pmod(F.hash(t), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(at, lambda a: a == i)).cast("float"))


def retrieve(docs: DataFrame, queries: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """(qid, chunk_id, score, rank): 40 + 40 hits by words and vectors, 20 fused, k after re-ranking."""
    points = docs.select(F.col(key).alias("vec_id"), hashed_vector(F.coalesce(F.col(text), F.lit(""))).alias("embedding"))
    asked = queries.select("qid", hashed_vector(F.col("query")).alias("vector"))
    vector = vectors.top_k(points, asked, 40, exclude_self=False).select("qid", F.col("vec_id").alias("chunk_id"), "score")
    keyword = bm25.search(docs, queries, key, text, 40).select("qid", F.col(key).alias("chunk_id"), "score")
    fused = hybrid.fuse(vector, keyword, 20)
    hits = fused.join(docs.where(F.col(text).isNotNull()).select(F.col(key).alias("chunk_id"), F.col(text).alias("text")), "chunk_id").join(queries, "qid")
    return hybrid.rerank(hits, k, hybrid.overlap(F.col("query"), F.col("text"))).select("qid", "chunk_id", "rerank_score", "score", "rank")


def _chunks(content: Column) -> Column:
    """How many windows of 1,000 characters with an overlap of 200 a text has."""
    n = F.length(content)
    return F.when(content.isNull() | (F.trim(content) == ""), 0).when(n <= 1000, 1).otherwise(F.ceil((n - 1000) / 800) + 1).cast("long")


def ingest(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, status, error, chunks): outcome of each document of a run; null contents weren't extracted, blank ones are empty."""
    c = F.col(content)
    error = F.when(c.isNull(), "No content extracted").when(F.trim(c) == "", "Empty markdown supplied")
    return docs.select(key, F.when(error.isNull(), "success").otherwise("failed").alias("status"), error.alias("error"), _chunks(c).alias("chunks"))


def totals(docs: DataFrame, by: Column, content: str, pages: str) -> DataFrame:
    """(collection, documents, failed, pages, characters, chunks) of a batch, by collection."""
    c = F.col(content)
    return docs.groupBy(by.alias("collection")).agg(
        F.count("*").alias("documents"),
        F.count(F.when(c.isNull() | (F.trim(c) == ""), 1)).alias("failed"),
        F.sum(F.coalesce(F.col(pages), F.lit(0))).cast("long").alias("pages"),
        F.sum(F.coalesce(F.length(c), F.lit(0))).cast("long").alias("characters"),
        F.sum(_chunks(c)).cast("long").alias("chunks"),
    )
