"""Queries over answers: citations, context, checks of responses, studio."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import studio
from ..operators.sizes import small
from ..sources.tables import pairs, read
from . import register

CITES_SQL = r"""cites as (select result_id, cite, min(i)::int as ord from (select result_id, unnest(regexp_extract_all(answer, '\[CITE:([A-Za-z0-9_]+)\]', 1)) as cite,
  generate_subscripts(regexp_extract_all(answer, '\[CITE:([A-Za-z0-9_]+)\]', 1), 1) as i from query_results where use_llm and answer is not null) group by result_id, cite)"""


def cites(spark, sf_dir):
    return studio.cited(pairs(spark, sf_dir).where("answer is not null"), "result_id", "answer")


CHUNKS_SQL = "chunks as (select 'c' || doc_id as cite, doc_id, source, left(text, 280) as quote, coalesce(nullif(category, ''), nullif(source, ''), 'unknown') as section from documents)"


def chunks(spark, sf_dir):
    """Every document as the chunk that its number cites."""
    section = F.coalesce(F.nullif("category", F.lit("")), F.nullif("source", F.lit("")), F.lit("unknown"))
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("cite"), "doc_id", "source", F.substring("text", 1, 280).alias("quote"), section.alias("section"))


@register("citations_resolve", f"with {CITES_SQL}, {CHUNKS_SQL} select result_id, cite, doc_id, quote, section from cites join chunks using (cite)")
def citations_resolve(spark, sf_dir):
    """Citations of the answers with the chunks that they cite: c1 is the document 1."""
    return cites(spark, sf_dir).join(chunks(spark, sf_dir), "cite").select("result_id", "cite", "doc_id", "quote", "section")


@register("citation_counts", f"with {CITES_SQL} select result_id, count(cite) as citations, case when count(cite) = 0 then 'low' when count(cite) >= 3 then 'high' else 'medium' end as confidence from (select result_id from query_results where use_llm) left join cites using (result_id) group by result_id")
def citation_counts(spark, sf_dir):
    n = cites(spark, sf_dir).groupBy("result_id").agg(F.count("*").alias("citations"))
    j = pairs(spark, sf_dir).select("result_id").join(n, "result_id", "left").fillna(0, ["citations"])
    return j.withColumn("confidence", studio.confidence(F.col("citations")))


@register(
    "primary_document",
    f"""with {CITES_SQL}, {CHUNKS_SQL}, n as (select result_id, source, count(*) as n, min(ord) as f from cites join chunks using (cite) where source is not null group by all),
    best as (select *, row_number() over (partition by result_id order by n desc, f) as r, sum(n) over (partition by result_id) as total from n)
    select result_id, round(n::double / total, 6) as top_share, case when n::double / total >= 0.6 then source end as "primary" from best where r = 1""",
)
def primary_document(spark, sf_dir):
    """The source that at least 0.6 of an answer's cited chunks belong to, if one does."""
    uses = cites(spark, sf_dir).join(chunks(spark, sf_dir).where("source is not null").select("cite", "source"), "cite")
    return studio.primary(uses, "result_id", "source")


HITS_SQL = """hits as (select user_id as qid, strategy as doc_id, result_id as hit, chunks_retrieved / 10.0 as score from query_results where user_id is not null and chunks_retrieved is not null)"""


def hits(spark, sf_dir):
    q = read(spark, sf_dir, "query_results").where("user_id is not null and chunks_retrieved is not null")
    return q.select(F.col("user_id").alias("qid"), F.col("strategy").alias("doc_id"), F.col("result_id").alias("hit"), (F.col("chunks_retrieved") / 10.0).alias("score"))


BEST_SQL = f"""{HITS_SQL}, per as (select *, row_number() over (partition by qid, doc_id order by score desc, hit) as r from hits),
  best as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id, hit) as ord from per where r <= 5) where ord <= 8)"""


@register("studio_topk", f"with {BEST_SQL} select qid, doc_id, hit, score::double as score, ord from best")
def studio_topk(spark, sf_dir):
    """Five hits of each document, eight of each query: users stand for queries, strategies for documents."""
    return studio.best_chunks(hits(spark, sf_dir)).select("qid", "doc_id", "hit", F.col("score").cast("double").alias("score"), F.col("ord").cast("long").alias("ord"))


@register("studio_topk_counts", f"with {BEST_SQL} select qid, doc_id, count(*) as n, min(ord) as first_seen from best group by qid, doc_id")
def studio_topk_counts(spark, sf_dir):
    return studio.best_chunks(hits(spark, sf_dir)).groupBy("qid", "doc_id").agg(F.count("*").alias("n"), F.min("ord").cast("long").alias("first_seen"))


@register("unique_documents", f"with {HITS_SQL} select qid, doc_id, min(hit) as first_hit from hits group by qid, doc_id")
def unique_documents(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("qid", "doc_id").agg(F.min("hit").alias("first_hit"))


@register(
    "context_assembly",
    f"with {BEST_SQL} select qid, md5(string_agg('[Section ' || ord || '] ' || doc_id || chr(10) || hit, chr(10) || chr(10) order by ord)) as digest, count(*) as pieces from best group by qid",
)
def context_assembly(spark, sf_dir):
    """Numbered sections of a prompt's context."""
    best = studio.best_chunks(hits(spark, sf_dir))
    piece = F.concat(F.lit("[Section "), F.col("ord").cast("string"), F.lit("] "), "doc_id", F.lit("\n"), "hit")
    n = best.groupBy("qid").agg(F.count("*").alias("pieces"))
    return studio.context(best, ["qid"], "ord", piece).join(n, "qid").select("qid", F.md5("context").alias("digest"), "pieces")


HISTORY_SQL = """turns as (select user_id, query, created_at, result_id, row_number() over (partition by user_id order by created_at desc, result_id desc) as back from query_results where user_id is not null)"""


@register(
    "history_prepend",
    f"with {HISTORY_SQL} select user_id, coalesce(string_agg('[User: ' || query || ']', chr(10) order by created_at, result_id) filter (back between 2 and 4) || chr(10), '') || 'Follow-up question: ' || max(query) filter (back = 1) as prompt from turns group by user_id",
)
def history_prepend(spark, sf_dir):
    """The three searches before a user's last one, then the last one as the question."""
    q = read(spark, sf_dir, "query_results").where("user_id is not null").select("user_id", "query", "created_at", "result_id")
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("result_id"))
    t = q.withColumn("back", F.row_number().over(w)).where("back <= 4").withColumn("o", F.struct("created_at", "result_id"))
    lines = studio.context(t.where("back > 1"), ["user_id"], "o", F.concat(F.lit("[User: "), "query", F.lit("]")), "\n")
    last = t.where("back = 1").select("user_id", "query")
    before = F.coalesce(F.concat("context", F.lit("\n")), F.lit(""))
    return last.join(lines, "user_id", "left").select("user_id", F.concat(before, F.lit("Follow-up question: "), "query").alias("prompt"))


@register(
    "studio_message",
    f"with {BEST_SQL} select qid, string_agg('[id=c' || ord || '] (' || doc_id || ') ' || hit || ' — p. ' || floor(score)::int, chr(10) order by ord) as message from best group by qid",
)
def studio_message(spark, sf_dir):
    best = studio.best_chunks(hits(spark, sf_dir))
    piece = F.concat(F.lit("[id=c"), F.col("ord").cast("string"), F.lit("] ("), "doc_id", F.lit(") "), "hit", F.lit(" — p. "), F.floor("score").cast("string"))
    return studio.context(best, ["qid"], "ord", piece, "\n").withColumnRenamed("context", "message")


@register("studio_scope", "select user_id, array_to_string(list_sort(list_distinct(list(strategy))), ',') as types_used, count(distinct strategy) > 1 as cross_domain from query_results where user_id is not null group by user_id")
def studio_scope(spark, sf_dir):
    q = read(spark, sf_dir, "query_results").where("user_id is not null").groupBy("user_id").agg(F.sort_array(F.collect_set("strategy")).alias("t"))
    return q.select("user_id", F.array_join("t", ",").alias("types_used"), (F.size("t") > 1).alias("cross_domain"))


@register(
    "studio_classify",
    "with n as (select category, count(*) as n from documents where category is not null group by category) select doc_id, category from documents where category in (select category from n where n >= (select avg(n) from n))",
)
def studio_classify(spark, sf_dir):
    """Catalogue entries that a selector chose: here the categories with at least the mean number of documents."""
    d = read(spark, sf_dir, "documents").where("category is not null")
    n = d.groupBy("category").agg(F.count("*").alias("n"))
    chosen = n.join(n.agg(F.avg("n").alias("mean")), F.col("n") >= F.col("mean")).select("category")
    return d.join(small(chosen), "category", "left_semi").select("doc_id", "category")


SAFE_SQL = f"trim(regexp_replace(regexp_replace(regexp_replace(answer, '{T.WHITE_SQL}+', ' ', 'g'), '\\.{{{{3,}}}}', '...', 'g'), '([.!?])([A-Z])', '\\1 \\2', 'g'), ' ')".replace("{{", "{").replace("}}", "}")
CHECK_SQL = f"checks as (select result_id, {SAFE_SQL} as a from query_results where use_llm and answer is not null)"
CHECKS_SQL = rf"""with {CHECK_SQL} select result_id, a as answer, case when a = '' then 0 else len(string_split(a, ' ')) end as word_count,
  regexp_matches(a, '(?i)(?:section|act|chapter|article) +\p{{Nd}}|\[.*?act.*?\]|\(.*?section.*?\)') as has_citations,
  a <> '' and (regexp_matches(a, '[.!?:)}}\]]\z') or length(a) < 50) as complete,
  regexp_matches(a, '^\p{{Nd}}+\. |^[-*] |^#{{1,6}} |\*\*.*?\*\*|_.*?_') as formatted from checks"""


@register("response_checks", CHECKS_SQL)
def response_checks(spark, sf_dir):
    """The sanitised answer, in one line, and what can be told from its form."""
    return checks(pairs(spark, sf_dir).where("answer is not null").select("result_id", safe(F.col("answer")).alias("answer")))


@register("response_checks_whole", CHECKS_SQL)
def response_checks_whole(spark, sf_dir):
    """The same as ``response_checks``, which once left rows out; tested against a plain loop."""
    return response_checks(spark, sf_dir)


def safe(answer):
    """White space squeezed, runs of dots as three, a blank between an end mark and a capital."""
    one = F.regexp_replace(F.regexp_replace(answer, f"[{T.WHITE}]+", " "), r"\.{3,}", "...")
    return F.trim(F.regexp_replace(one, r"([.!?])([A-Z])", "$1 $2"))


def checks(answers):
    a = F.col("answer")
    return answers.select(
        "result_id",
        "answer",
        F.when(a == "", 0).otherwise(F.size(F.split("answer", " "))).cast("long").alias("word_count"),
        a.rlike(r"(?i)(?:section|act|chapter|article) +\p{Nd}|\[.*?act.*?\]|\(.*?section.*?\)").alias("has_citations"),
        ((a != "") & (a.rlike(r"[.!?:)}\]]\z") | (F.length(a) < 50))).alias("complete"),
        a.rlike(r"^\p{Nd}+\. |^[-*] |^#{1,6} |\*\*.*?\*\*|_.*?_").alias("formatted"),
    )


ERROR_SQL = "case event_type when 'view' then 'HTTP 429: rate limit' when 'click' then 'Deadline timed out' when 'signup' then 'Invalid argument' when 'purchase' then 'Empty candidates' else 'boom ' || event_id end"


@register(
    "error_classify",
    f"""select event_id, case when contains(m, 'timeout') or contains(m, 'timed out') then 'timeout' when contains(m, 'rate limit') or contains(m, 'quota') or contains(m, '429') then 'rate_limit'
    when contains(m, 'invalid') or contains(m, '400') then 'invalid_request' when contains(m, 'empty') or contains(m, 'no response') then 'empty_response' else 'api_error' end as kind from (select event_id, lower({ERROR_SQL}) as m from events)""",
)
def error_classify(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    t = F.col("event_type")
    message = F.when(t == "view", "HTTP 429: rate limit").when(t == "click", "Deadline timed out").when(t == "signup", "Invalid argument").when(t == "purchase", "Empty candidates").otherwise(F.concat(F.lit("boom "), F.col("event_id").cast("string")))
    return e.select("event_id", studio.error_class(message).alias("kind"))


@register(
    "highlight_priority",
    """with cand as (select document_id, 1 as priority, 'words' as source from word_bboxes union all select document_id, 2, 'pages' from ocr_words union all select document_id, 3, 'none' from parsed_documents)
    select document_id, arg_min(source, priority) as source, min(priority) as priority from cand group by document_id""",
)
def highlight_priority(spark, sf_dir):
    """The best source of boxes that each document has."""
    names = (("word_bboxes", 1, "words"), ("ocr_words", 2, "pages"), ("parsed_documents", 3, "none"))
    out = None
    for table, priority, source in names:
        part = read(spark, sf_dir, table).select("document_id").distinct().select("document_id", F.lit(priority).alias("priority"), F.lit(source).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("document_id").agg(F.min_by("source", "priority").alias("source"), F.min("priority").alias("priority"))


@register(
    "next_marker",
    r"""with w as (select distinct on (document_id, page, index_sort) * from ocr_words), f as (select *, row_number() over (partition by document_id, page, line order by index_sort) as k from w where text is not null)
    select document_id, page, min(y0) as y from f where k = 1 and regexp_matches(text, '^[०-९0-9]+[.:]') and y0 > 0.12 group by document_id, page""",
)
def next_marker(spark, sf_dir):
    """Top of the first line on each page, below the head, that begins with a section number."""
    w = read(spark, sf_dir, "ocr_words").dropDuplicates(["document_id", "page", "index_sort"]).where("text is not null")
    first = F.row_number().over(Window.partitionBy("document_id", "page", "line").orderBy("index_sort"))
    return w.withColumn("k", first).where(F.col("text").rlike("^[०-९0-9]+[.:]") & (F.col("k") == 1) & (F.col("y0") > 0.12)).groupBy("document_id", "page").agg(F.min("y0").alias("y"))


@register("highlight_nodes", "select document_id, trim(n) as node from (select document_id, unnest(string_split(replace(collection_name, '_', ' , '), ',')) as n from parsed_documents where collection_name is not null) where trim(n) <> ''")
def highlight_nodes(spark, sf_dir):
    """Lists of node ids in one field, taken apart."""
    d = read(spark, sf_dir, "parsed_documents").where("collection_name is not null")
    node = F.explode(F.split(F.regexp_replace("collection_name", "_", " , "), ",")).alias("n")
    return d.select("document_id", node).select("document_id", F.trim("n").alias("node")).where("node <> ''")


@register("title_neighbours", """with w as (select distinct on (document_id, page, index_sort) document_id, page, index_sort, text, y0 from ocr_words)
  select document_id, page, index_sort, y0 from (select *, list(text) over (partition by document_id, page order by index_sort rows between 3 preceding and 5 following) as near from w) where lower(text) = 'act,' and list_contains(near, 'the')""")
def title_neighbours(spark, sf_dir):
    """Places of an anchor word with a certain word near it: from three before to five after."""
    w = read(spark, sf_dir, "ocr_words").dropDuplicates(["document_id", "page", "index_sort"]).select("document_id", "page", "index_sort", "text", "y0")
    near = F.collect_list("text").over(Window.partitionBy("document_id", "page").orderBy("index_sort").rowsBetween(-3, 5))
    return w.withColumn("near", near).where((F.lower("text") == "act,") & F.array_contains("near", "the")).select("document_id", "page", "index_sort", "y0")


@register("usage_totals_with_followups", "select user_id, count(*) as searches, sum(coalesce(chunks_retrieved, 0))::bigint as chunks, sum(coalesce(length(query), 0) + coalesce(length(answer), 0))::bigint as characters from query_results where user_id is not null group by user_id")
def usage_totals_with_followups(spark, sf_dir):
    q = read(spark, sf_dir, "query_results").where("user_id is not null").groupBy("user_id")
    n = F.coalesce(F.length("query"), F.lit(0)) + F.coalesce(F.length("answer"), F.lit(0))
    return q.agg(F.count("*").alias("searches"), F.sum(F.coalesce("chunks_retrieved", F.lit(0))).alias("chunks"), F.sum(n).cast("long").alias("characters"))


@register("approx_users", None)
def approx_users(spark, sf_dir):
    """Distinct users a day by a sketch (an extension of the daily totals); within 5 % of the exact number in tests."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.approx_count_distinct("user_id", 0.02).alias("users"))
