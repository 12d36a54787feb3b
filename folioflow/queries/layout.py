"""Queries of layout, regions and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import highlights, layout, upsert
from ..sources.tables import WORDS_SQL, read
from ..sources.tables import words as word_table
from . import register


@register(
    "words_wordify",
    f"""with e as (select *, case when coalesce(space_type, 0) >= 2 or text = ':' or coalesce(lead(text) over w = ':', false) then 1 else 0 end as e from {WORDS_SQL} where text is not null window w as (partition by document_id, page order by index_sort)),
    g as (select *, coalesce(sum(e) over (partition by document_id, page order by index_sort rows between unbounded preceding and 1 preceding), 0)::bigint as word from e)
    select document_id, page, word, string_agg(text, '' order by index_sort) as text, min(x0) as x0, max(x2) as x2, count(*) as fragments from g group by document_id, page, word""",
)
def words_wordify(spark, sf_dir):
    """Fragments joined up to the wide spaces (words stand for fragments, space types are lowered by one)."""
    w = word_table(spark, sf_dir).where("text is not null").withColumn("space_type", F.col("space_type") - 1)
    return layout.wordify(w, ["document_id", "page"]).select("document_id", "page", F.col("word").cast("long").alias("word"), "text", "x0", "x2", "fragments")


@register(
    "page_word_spans",
    f"""select document_id, page, index_sort, coalesce(sum(length(text) + 1) over (partition by document_id, page order by line, y0, x0, index_sort rows between unbounded preceding and 1 preceding), 0)::bigint as start,
    coalesce(sum(length(text) + 1) over (partition by document_id, page order by line, y0, x0, index_sort rows between unbounded preceding and 1 preceding), 0)::bigint + length(text) as "end" from {WORDS_SQL} where text is not null""",
)
def page_word_spans(spark, sf_dir):
    own = layout.word_spans(word_table(spark, sf_dir).where("text is not null"), ["document_id", "page"])
    return own.select("document_id", "page", "index_sort", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@register(
    "tree_regions",
    f"""with p as (select document_id, page, min(o) as s, max(o + length(t)) as e from (select document_id, page, w.char_offset as o, w.text as t from (select document_id, page, unnest(words) as w from (select distinct on (document_id, page) * from word_bboxes))) group by document_id, page),
    n as (select document_id, request_id as node, 1 + request_id % 2 as first_page, 1 + request_id % 2 as last_page from (select distinct document_id, request_id from parse_requests))
    select n.document_id, n.node, min(s) as region_start, max(e) as region_end from n left join p on p.document_id = n.document_id and p.page between first_page - 1 and last_page + 1 group by n.document_id, n.node""",
)
def tree_regions(spark, sf_dir):
    """Where a node's start is sought: requests stand for nodes on page 1 or 2."""
    from .pages import page_bbox_map

    page = (1 + F.col("request_id") % 2).alias("first_page")
    n = read(spark, sf_dir, "parse_requests").select("document_id", "request_id").distinct().select("document_id", F.col("request_id").alias("node"), page, page.alias("last_page"))
    return layout.search_regions(n, page_bbox_map(spark, sf_dir).select("document_id", "page", "start_char", "end_char"))


@register("image_paths", "select document_id, page, printf('%s/page_%04d.jpg', document_id, page) as path from (select distinct document_id, page from ocr_words)")
def image_paths(spark, sf_dir):
    p = read(spark, sf_dir, "ocr_words").select("document_id", "page").distinct()
    return p.select("document_id", "page", F.format_string("%s/page_%04d.jpg", "document_id", "page").alias("path"))


@register("users_insert", "select distinct user_id, 'new' as state from starred_responses where user_id not in (select user_id from query_results where user_id is not null)")
def users_insert(spark, sf_dir):
    """Users that can be added: those whose id isn't taken."""
    known = read(spark, sf_dir, "query_results").where("user_id is not null").select("user_id")
    new = read(spark, sf_dir, "starred_responses").select("user_id").distinct().join(known, "user_id", "left_anti")
    return new.select("user_id", F.lit("new").alias("state"))


@register("feedback_light", "select id, user_id, left(query, 100) as message, octet_length(encode(coalesce(answer, ''))) <= 3145728 as fits from (select distinct on (id) * from starred_responses)")
def feedback_light(spark, sf_dir):
    """Feedback without its heavy columns, and whether an attachment of that size would be taken."""
    s = read(spark, sf_dir, "starred_responses").dropDuplicates(["id"])
    return s.select("id", "user_id", F.substring("query", 1, 100).alias("message"), (F.octet_length(F.coalesce("answer", F.lit(""))) <= 3 * 1024 * 1024).alias("fits"))


@register("waitlist_upsert", "select user_id, max(starred_at) as last_at, min(starred_at) as created_at, count(distinct id) as n from starred_responses group by user_id")
def waitlist_upsert(spark, sf_dir):
    s = read(spark, sf_dir, "starred_responses").dropDuplicates(["id"]).select("user_id", "id", "starred_at")
    first = upsert.latest(s, ["user_id"], [F.asc("starred_at"), F.asc("id")]).select("user_id", F.col("starred_at").alias("created_at"))
    last = s.groupBy("user_id").agg(F.max("starred_at").alias("last_at"), F.count("*").alias("n"))
    return last.join(first, "user_id").select("user_id", "last_at", "created_at", "n")


@register("layout_lines")
def layout_lines(spark, sf_dir):
    """Lines of pages as rows of characters; tested by hand-made lines."""
    return layout.rendered_lines(word_table(spark, sf_dir).where("text is not null"), ["document_id", "page"])


@register("chunk_sentences")
def chunk_sentences(spark, sf_dir):
    """Whole sentences up to 200 words with an overlap; an ordered fold, tested on small texts."""
    return layout.sentence_chunks(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "n_words")


@register("tree_chunks")
def tree_chunks(spark, sf_dir):
    """Parts of the contents for building trees; tested on long texts."""
    d = read(spark, sf_dir, "parsed_documents").where("content is not null")
    return d.select("document_id", F.inline(layout.tree_parts(F.col("content"))))


def sections_of_pages(spark, sf_dir):
    """Boxed pages and a section of each: it begins with the page's words 10 to 14, ends with 40 to 44 and has words 10 and 11 as its title."""
    pages = highlights.page_words(read(spark, sf_dir, "word_bboxes"))
    text = lambda a, n: F.array_join(F.transform(F.slice("ws", a, n), lambda w: w["text"]), " ")
    nodes = pages.where(F.size("ws") > 44).select("document_id", F.col("page").alias("node"), text(11, 5).alias("start_text"), text(41, 5).alias("end_text"), text(11, 2).alias("title"), F.lit(None).cast("string").alias("next_title"), F.col("page").alias("first_page"), F.col("page").alias("last_page"))
    return nodes, pages


@register("highlight_anchored")
def highlight_anchored(spark, sf_dir):
    """Words from each section's start text to its end text; tested against a plain loop."""
    return highlights.anchored(*sections_of_pages(spark, sf_dir))


@register("highlight_titled")
def highlight_titled(spark, sf_dir):
    """Words under each section's title; tested against a plain loop."""
    return highlights.titled(*sections_of_pages(spark, sf_dir))


@register("highlight_cascade")
def highlight_cascade(spark, sf_dir):
    """Boxes of each section: by its anchors, else under its title."""
    nodes, pages = sections_of_pages(spark, sf_dir)
    return highlights.best_candidates([highlights.anchored(nodes, pages), highlights.titled(nodes, pages)])
