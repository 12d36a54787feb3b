"""Queries over words of pages, their layout and their places in texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import offsets, words
from ..sources.tables import WORDS_SQL, read
from ..sources.tables import words as word_table
from . import register

CLEAN_SQL = rf"""cleaned as (select document_id, page, index_sort, line, block, x0, y0, x2, y2, space_type, confidence, regexp_replace(trim(regexp_replace(text, '[\s\x{{A0}}]+', ' ', 'g')), '^[^\p{{L}}\p{{N}}\p{{M}}_]+$', '') as text
  from {WORDS_SQL} where text is not null and trim(text) <> '' and coalesce(confidence, 0) >= 0.5 and x2 > x0 and y2 > y0)"""


def exploded(spark, sf_dir):
    """Words of the boxes table with their place on the page; repeated rows once."""
    w = read(spark, sf_dir, "word_bboxes").dropDuplicates(["document_id", "page"])
    return w.select("document_id", "page", F.posexplode("words").alias("pos", "w")).select("document_id", "page", "pos", "w.*")


EXPLODED_SQL = "(select document_id, page, i - 1 as pos, w.text as text, w.x0 as x0, w.y0 as y0, w.x2 as x2, w.y2 as y2, w.block as block, w.line as line, w.char_offset as char_offset from (select document_id, page, unnest(words) as w, generate_subscripts(words, 1) as i from (select distinct on (document_id, page) * from word_bboxes)))"


@register("words_clean", f"with {CLEAN_SQL} select document_id, page, index_sort, text from cleaned")
def words_clean(spark, sf_dir):
    return words.clean(word_table(spark, sf_dir)).select("document_id", "page", "index_sort", "text")


@register("words_order", f"select document_id, page, index_sort, row_number() over (partition by document_id, page order by line, y0, x0, index_sort) - 1 as ord from {WORDS_SQL}")
def words_order(spark, sf_dir):
    return words.reading_order(word_table(spark, sf_dir)).select("document_id", "page", "index_sort", F.col("order").cast("long").alias("ord"))


@register("words_plain_spaces", r"select document_id, page, index_sort, replace(replace(replace(text, chr(160), ' '), chr(8239), ' '), chr(65279), '') as text from " + WORDS_SQL + " where text is not null")
def words_plain_spaces(spark, sf_dir):
    return word_table(spark, sf_dir).where("text is not null").select("document_id", "page", "index_sort", T.plain_spaces(F.col("text")).alias("text"))


@register(
    "words_space_type",
    f"""select document_id, page, index_sort, case when lead(index_sort) over w is null or lead(line) over w <> line or lead(block) over w <> block or coalesce(starts_with(lead(text) over w, ':'), false) then 2 else 1 end as gap
    from {WORDS_SQL} window w as (partition by document_id, page order by index_sort)""",
)
def words_space_type(spark, sf_dir):
    return words.space_types(word_table(spark, sf_dir)).select("document_id", "page", "index_sort", "gap")


@register(
    "words_combine",
    f"""with {CLEAN_SQL}, f as (select *, case when coalesce(space_type > 1 or ends_with(text, ':') or lead(line) over w <> line or lead(block) over w <> block
      or (lead(x0) over w - x2) > 0.75 * greatest(y2 - y0, lead(y2) over w - lead(y0) over w), true) then 1 else 0 end as ends from cleaned window w as (partition by document_id, page order by index_sort)),
    g as (select *, coalesce(sum(ends) over (partition by document_id, page order by index_sort rows between unbounded preceding and 1 preceding), 0)::bigint as phrase from f)
    select document_id, page, phrase, string_agg(text, ' ' order by index_sort) as text, min(x0) as x0, max(x2) as x2, round(case when sum(length(text)) > 0 then sum(confidence * length(text)) / sum(length(text)) end + 1e-9, 4) as confidence, count(*) as words from g group by document_id, page, phrase""",
)
def words_combine(spark, sf_dir):
    own = words.combine(words.clean(word_table(spark, sf_dir)))
    return own.select("document_id", "page", F.col("phrase").cast("long").alias("phrase"), "text", "x0", "x2", F.round(F.col("confidence") + 1e-9, 4).alias("confidence"), "words")


@register("simple_text", f"with {CLEAN_SQL} select document_id, page, line, string_agg(text, ' ' order by x0, index_sort) as text from cleaned group by document_id, page, line")
def simple_text(spark, sf_dir):
    return words.line_texts(words.clean(word_table(spark, sf_dir)), ["document_id", "page", "line"])


@register(
    "block_bbox",
    f"""with {CLEAN_SQL}, l as (select document_id, page, block, line, string_agg(text, ' ' order by x0, index_sort) as t from cleaned group by all),
    b as (select document_id, page, block, string_agg(t, chr(10) order by line) as text from l group by all)
    select document_id, page, block, min(x0) as x0, min(y0) as y0, max(x2) as x2, max(y2) as y2, count(*) as words, any_value(b.text) as text from cleaned c join b using (document_id, page, block) group by document_id, page, block""",
)
def block_bbox(spark, sf_dir):
    return words.block_boxes(words.clean(word_table(spark, sf_dir)))


@register(
    "page_bbox",
    f"""select document_id, page, coalesce(min(x0), 0) as x0, coalesce(min(y0), 0) as y0, coalesce(max(x2), 1) as x2, coalesce(max(y2), 1) as y2, count(text) as words from {WORDS_SQL} group by document_id, page""",
)
def page_bbox(spark, sf_dir):
    w = word_table(spark, sf_dir).groupBy("document_id", "page")
    return w.agg(F.coalesce(F.min("x0"), F.lit(0.0)).alias("x0"), F.coalesce(F.min("y0"), F.lit(0.0)).alias("y0"), F.coalesce(F.max("x2"), F.lit(1.0)).alias("x2"), F.coalesce(F.max("y2"), F.lit(1.0)).alias("y2"), F.count("text").alias("words"))


KV_SQL = rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null),
    f as (select doc_id, i, lower(regexp_replace(regexp_extract(t, '(?s)\A([^:\n]+?):{T.WHITE_SQL}*(.+)\z', 1), '\A{T.WHITE_SQL}+|{T.WHITE_SQL}+\z', '', 'g')) as field,
      regexp_replace(regexp_extract(t, '(?s)\A([^:\n]+?):{T.WHITE_SQL}*(.+)\z', 2), '\A{T.WHITE_SQL}+|{T.WHITE_SQL}+\z', '', 'g') as value from l where regexp_matches(t, '(?s)\A([^:\n]+?):{T.WHITE_SQL}*(.+)\z'))
    select doc_id, field, arg_max(value, i) as value from f group by doc_id, field"""


@register("kv_fields", KV_SQL)
def kv_fields(spark, sf_dir):
    """"Field: value" lines of the documents, lines with control characters and any white space too."""
    d = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    trim = lambda c: F.regexp_replace(c, rf"\A[{T.WHITE}]+|[{T.WHITE}]+\z", "")
    return words.key_values(d, ["doc_id"], "t", F.col("i"), rf"(?s)\A([^:\n]+?):[{T.WHITE}]*(.+)\z", trim)


@register("kv_fields_whole", KV_SQL)
def kv_fields_whole(spark, sf_dir):
    """The same as ``kv_fields``, which once left lines out; tested against a plain loop."""
    return kv_fields(spark, sf_dir)


SKEW_SQL = f"select document_id, page, x0 as x_left, y2 as y_left, x2 as x_right, y2 + (index_sort % 7 - 3) * 0.001 as y_right from {WORDS_SQL} where x2 > x0"


@register("skew_angle", f"select document_id, page, round(case when count(*) > 3 then quantile_cont(degrees(atan2(y_right - y_left, x_right - x_left)), 0.5) end, 5) as angle, count(*) as words from ({SKEW_SQL}) group by document_id, page")
def skew_angle(spark, sf_dir):
    """Median slope of the words of each page; the corners lean by the words' places."""
    w = word_table(spark, sf_dir).where("x2 > x0")
    lean = F.col("y2") + (F.col("index_sort") % 7 - 3) * 0.001
    points = w.select("document_id", "page", F.col("x0").alias("x_left"), F.col("y2").alias("y_left"), F.col("x2").alias("x_right"), lean.alias("y_right"))
    return words.skew_angle(points, ["document_id", "page"]).withColumn("angle", F.round("angle", 5))


@register(
    "words_orient",
    f"""select document_id, page, index_sort, round(case page % 4 when 1 then 1 - y2 when 2 then 1 - x2 when 3 then y0 else x0 end, 6) as x0, round(case page % 4 when 1 then x0 when 2 then 1 - y2 when 3 then 1 - x2 else y0 end, 6) as y0,
    round(case page % 4 when 1 then 1 - y0 when 2 then 1 - x0 when 3 then y2 else x2 end, 6) as x2, round(case page % 4 when 1 then x2 when 2 then 1 - y0 when 3 then 1 - x0 else y2 end, 6) as y2 from {WORDS_SQL}""",
)
def words_orient(spark, sf_dir):
    w = words.orient(word_table(spark, sf_dir), F.col("page") % 4 * 90)
    return w.select("document_id", "page", "index_sort", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x2", "y2")))


@register("words_to_unit", f"select document_id, page, pos, round(x0 / 612.0, 6) as x0, round(y0 / 792.0, 6) as y0, round(x2 / 612.0, 6) as x2, round(y2 / 792.0, 6) as y2 from {EXPLODED_SQL}")
def words_to_unit(spark, sf_dir):
    w = exploded(spark, sf_dir)
    return w.select("document_id", "page", F.col("pos").cast("long").alias("pos"), *(F.round(F.col(c) / (612.0 if c[0] == "x" else 792.0), 6).alias(c) for c in ("x0", "y0", "x2", "y2")))


@register("parse_totals", f"with {CLEAN_SQL} select count(distinct (document_id, page)) as pages, count(*) as words, count(distinct document_id) as documents from cleaned")
def parse_totals(spark, sf_dir):
    w = words.clean(word_table(spark, sf_dir))
    return w.agg(F.countDistinct(F.struct("document_id", "page")).alias("pages"), F.count("*").alias("words"), F.countDistinct("document_id").alias("documents"))


@register(
    "digital_detection",
    f"""with c as (select document_id, count(*) * 1.0 / count(distinct page) as per_page from {EXPLODED_SQL} group by document_id),
    r as (select document_id, arg_max_null(ocr_enabled, (requested_at, request_id)) as ocr_enabled, arg_max_null(lower(trim(language)), (requested_at, request_id)) as language from parse_requests group by document_id)
    select r.document_id, coalesce(per_page, 0) > 10 and not coalesce(ocr_enabled, false) and coalesce(language, 'en') <> 'ne' as digital from r left join c using (document_id)""",
)
def digital_detection(spark, sf_dir):
    """A document is digital if it has more than ten words a page, unless its request forces reading by OCR."""
    per = exploded(spark, sf_dir).groupBy("document_id").agg((F.count("*") / F.countDistinct("page")).alias("per_page"))
    r = read(spark, sf_dir, "parse_requests").where("requested_at is not null").groupBy("document_id")
    at = F.struct("requested_at", "request_id")
    last = r.agg(F.max_by("ocr_enabled", at).alias("ocr_enabled"), F.max_by(F.lower(F.trim("language")), at).alias("language"))
    digital = (F.coalesce("per_page", F.lit(0.0)) > 10) & ~F.coalesce("ocr_enabled", F.lit(False)) & (F.coalesce("language", F.lit("en")) != "ne")
    return last.join(per, "document_id", "left").select("document_id", digital.alias("digital"))


PAGES_SQL = rf"""pagetext as (select document_id, page, '## Page ' || page || chr(10) || trim(string_agg(t, chr(10) order by line)) as markdown from
  (select document_id, page, line, string_agg(text, ' ' order by x0, index_sort) as t from (select * from {WORDS_SQL} where text is not null) group by all) group by document_id, page)"""


def page_texts(spark, sf_dir, w=None):
    w = (word_table(spark, sf_dir) if w is None else w).where("text is not null")
    lines = words.line_texts(w, ["document_id", "page", "line"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return lines.groupBy("document_id", "page").agg(text.alias("t")).select("document_id", "page", offsets.page_markdown(F.col("page"), F.col("t")).alias("markdown"))


@register("page_markdown", f"with {PAGES_SQL} select document_id, page, md5(markdown) as digest, length(markdown) as n from pagetext")
def page_markdown(spark, sf_dir):
    return page_texts(spark, sf_dir).select("document_id", "page", F.md5("markdown").alias("digest"), F.length("markdown").cast("long").alias("n"))


@register(
    "page_offsets",
    f"with {PAGES_SQL}, s as (select document_id, page, length(markdown) as n, coalesce(sum(length(markdown) + 7) over (partition by document_id order by page rows between unbounded preceding and 1 preceding), 0)::bigint as start_char from pagetext) select document_id, page, start_char, start_char + n as end_char from s",
)
def page_offsets(spark, sf_dir):
    return offsets.page_spans(page_texts(spark, sf_dir))


PARTS_SQL = rf"""with {PAGES_SQL}, p as (select document_id, floor((page - 1) / 64) as block, min(page) as first_page, max(page) as last_page, string_agg(markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page) as t from pagetext group by 1, 2),
  placed as (select *, row_number() over (partition by document_id order by block) - 1 as part, coalesce(sum(length(t) + 7) over (partition by document_id order by block rows between unbounded preceding and 1 preceding), 0)::bigint as start_char from p)"""


@register("document_markdown", PARTS_SQL + " select document_id, part, md5(t) as digest from placed")
def document_markdown(spark, sf_dir):
    """Texts of all documents, the compendium too, in ordered parts of up to 64 pages."""
    return document_parts(spark, sf_dir).select("document_id", "part", "digest")


@register("document_parts", PARTS_SQL + " select document_id, part, first_page, last_page, start_char, start_char + length(t) as end_char, md5(t) as digest from placed")
def document_parts(spark, sf_dir):
    """Texts of all documents, the compendium too, in ordered parts of up to 64 pages; tested against a plain loop."""
    # One exchange by page serves the repeated words, the lines and the pages.
    w = read(spark, sf_dir, "ocr_words").repartition("document_id", "page").dropDuplicates(["document_id", "page", "index_sort"])
    return offsets.parts(page_texts(spark, sf_dir, w), F.md5).withColumnRenamed("kept", "digest")


@register("page_bbox_map", f"select document_id, page, min(char_offset) as start_char, max(char_offset + length(text)) as end_char, min(x0) as x0, min(y0) as y0, max(x2) as x2, max(y2) as y2 from {EXPLODED_SQL} group by document_id, page")
def page_bbox_map(spark, sf_dir):
    return offsets.page_boxes(exploded(spark, sf_dir))


@register("words_in_range", f"select document_id, page, pos, text from {EXPLODED_SQL} where char_offset >= 200 and char_offset < 600")
def words_in_range(spark, sf_dir):
    """Words that begin in a range of offsets; pages without any are skipped before their words are unpacked."""
    w = read(spark, sf_dir, "word_bboxes").dropDuplicates(["document_id", "page"])
    inside = lambda x: (x["char_offset"] >= 200) & (x["char_offset"] < 600)
    some = w.where(F.exists("words", lambda x: F.coalesce(inside(x), F.lit(False))))
    own = some.select("document_id", "page", F.posexplode("words").alias("pos", "w")).where(inside(F.col("w")))
    return own.select("document_id", "page", F.col("pos").cast("long").alias("pos"), "w.text")


@register("words_in_band", f"select document_id, page, index_sort, text from {WORDS_SQL} where page = 1 and y0 between 0.1 and 0.2")
def words_in_band(spark, sf_dir):
    return word_table(spark, sf_dir).where("page = 1 and y0 between 0.1 and 0.2").select("document_id", "page", "index_sort", "text")


@register(
    "page_words_map",
    f"select document_id, count(*) as pages, sum(n)::bigint as words, string_agg(page || ':' || n, ',' order by page) as by_page from (select document_id, page, count(*) as n from {EXPLODED_SQL} group by all) group by document_id",
)
def page_words_map(spark, sf_dir):
    per = exploded(spark, sf_dir).groupBy("document_id", "page").agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "n"))), lambda x: F.concat_ws(":", x["page"].cast("string"), x["n"].cast("string"))), ",")
    return per.groupBy("document_id").agg(F.count("*").alias("pages"), F.sum("n").alias("words"), listed.alias("by_page"))


@register("reset_lines")
def reset_lines(spark, sf_dir):
    """Lines by heights; a fold over each page, tested against a plain loop."""
    w = words.clean(word_table(spark, sf_dir))
    return words.reset_lines(w).select("document_id", "page", "index_sort", "line2", F.round("y", 6).alias("y"))


COLON_SQL = rf"""select document_id, page, index_sort, len(regexp_extract_all(array_to_string(list_transform(range(1, length(text) + 1), lambda i: case when substr(text, i, 1) = ':' and (i = 1 or not regexp_matches(substr(text, i - 1, 1), '\p{{Nd}}'))
    then chr(57344) else substr(text, i, 1) end), ''), chr(57344) || '|[^' || chr(57344) || ']+')) as pieces from {WORDS_SQL} where contains(text, ':')"""


@register("break_colons", COLON_SQL)
def break_colons(spark, sf_dir):
    """Pieces of every word with a colon, digits of all scripts."""
    w = word_table(spark, sf_dir).where("contains(text, ':')")
    return w.select("document_id", "page", "index_sort", F.size(words.break_colons(F.col("text"), r"\p{Nd}")).cast("long").alias("pieces"))


@register("break_colons_whole", COLON_SQL)
def break_colons_whole(spark, sf_dir):
    """The same as ``break_colons``, which once left words out; tested against a plain loop."""
    return break_colons(spark, sf_dir)


@register("word_offsets")
def word_offsets(spark, sf_dir):
    """Offsets of the words of all boxed pages in their documents' contents, each sought in its own page's text; tested against a plain loop."""
    w = read(spark, sf_dir, "word_bboxes").dropDuplicates(["document_id", "page"])
    own = w.join(offsets.page_starts(w), ["document_id", "page"]).join(read(spark, sf_dir, "parsed_documents").select("document_id", "content"), "document_id")
    texts = offsets.page_slices(own.select("document_id", "page", "content", "start_char", "next_char", F.transform("words", lambda x: x["text"]).alias("words")))
    return offsets.word_offsets(texts)


@register("char_to_word_asof", f"""with p as (select document_id, unnest(generate_series(100, 1100, 250)) as pos from (select distinct document_id from word_bboxes)), w as {EXPLODED_SQL}
  select p.document_id, p.pos, arg_max(w.text, (w.char_offset, w.pos)) as word, max(w.char_offset) as char_offset from p join w on w.document_id = p.document_id and w.char_offset <= p.pos group by p.document_id, p.pos""")
def char_to_word_asof(spark, sf_dir):
    """The word at or before each of five offsets of every document: a running maximum over words and offsets merged, no pairs."""
    w = exploded(spark, sf_dir).where("char_offset is not null").select("document_id", F.col("char_offset").alias("at"), F.struct("char_offset", "pos", "text").alias("w"), F.lit(None).cast("int").alias("asked"))
    docs = read(spark, sf_dir, "word_bboxes").select("document_id").distinct()
    p = docs.select("document_id", F.explode(F.sequence(F.lit(100), F.lit(1100), F.lit(250))).alias("asked")).select("document_id", F.col("asked").cast("long").alias("at"), F.lit(None).cast("struct<char_offset:bigint,pos:int,text:string>").alias("w"), "asked")
    seen = F.max("w").over(Window.partitionBy("document_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    both = w.unionByName(p).withColumn("best", seen)
    return both.where("asked is not null and best is not null").select("document_id", F.col("asked").cast("long").alias("pos"), F.col("best.text").alias("word"), F.col("best.char_offset").alias("char_offset"))


@register("colon_pieces")
def colon_pieces(spark, sf_dir):
    """Words cut at their colons, with boxes; tested against a plain loop."""
    w = word_table(spark, sf_dir).where("text is not null")
    return words.colon_pieces(w.select("document_id", "page", "index_sort", "text", "x0", "x2", "space_type"))
