"""Queries of metadata, quality, chunks, section trees and discovery."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks, trees, upsert
from ..plans import pipelines
from ..sources import files
from ..sources.tables import read, spread
from . import register
from .search import BM25_SQL, queries_of

#: Legal text: documents with a chapter and section heading of their own before the text.
LEGAL_SQL = """(select doc_id, 'Chapter ' || doc_id % 9 || chr(10) || 'Section ' || doc_id % 40 || case when doc_id % 3 = 0 then 'A' else '' end || ' of Income Tax Act ' || (2058 + doc_id % 25) || chr(10) || text as legal
  from documents where text is not null)"""


def legal(spark, sf_dir, *more):
    d = read(spark, sf_dir, "documents").where("text is not null")
    head = F.concat(
        F.lit("Chapter "), (F.col("doc_id") % 9).cast("string"), F.lit("\nSection "), (F.col("doc_id") % 40).cast("string"), F.when(F.col("doc_id") % 3 == 0, "A").otherwise(""),
        F.lit(" of Income Tax Act "), (2058 + F.col("doc_id") % 25).cast("string"), F.lit("\n"),
    )
    return d.select("doc_id", F.concat(head, "text").alias("legal"), *more)


YEAR_SQL = r"nullif(regexp_extract(legal, '\b(20[0-9][0-9])\b', 1), '')"
SECTIONS_SQL = r"list_sort(list_transform(list_distinct(regexp_extract_all(legal, '(?i)(?:Section|Sec\.?|§)\s*([0-9]+[A-Z]?)', 1)), lambda s: (length(s), s)))"
CHAPTERS_SQL = r"list_sort(list_distinct(regexp_extract_all(legal, '(?i)(?:Chapter|Part)\s+([0-9]+[A-Z]?)', 1)))"
ACT_SQL = r"nullif(regexp_extract(array_to_string(string_split(legal, chr(10))[1:50], chr(10)), '((?:[A-Z][a-z]+ ){1,6}Act)\b', 1), '')"


@register("meta_year", f"select doc_id, {YEAR_SQL} as year from {LEGAL_SQL}")
def meta_year(spark, sf_dir):
    return legal(spark, sf_dir).select("doc_id", T.first_year(F.col("legal")).alias("year"))


@register("meta_sections", f"select doc_id, array_to_string(list_transform({SECTIONS_SQL}, lambda p: p[2]), ',') as sections from {LEGAL_SQL}")
def meta_sections(spark, sf_dir):
    return legal(spark, sf_dir).select("doc_id", F.array_join(T.section_numbers(F.col("legal")), ",").alias("sections"))


@register("meta_chapters", f"select doc_id, array_to_string({CHAPTERS_SQL}, ',') as chapters from {LEGAL_SQL}")
def meta_chapters(spark, sf_dir):
    return legal(spark, sf_dir).select("doc_id", F.array_join(T.chapter_numbers(F.col("legal")), ",").alias("chapters"))


@register("meta_act_name", f"select doc_id, {ACT_SQL} as act_name from {LEGAL_SQL}")
def meta_act_name(spark, sf_dir):
    return legal(spark, sf_dir).select("doc_id", T.act_name(F.col("legal")).alias("act_name"))


@register("meta_all", f"select doc_id, {ACT_SQL} as act_name, {YEAR_SQL} as year, array_to_string(list_transform({SECTIONS_SQL}, lambda p: p[2]), ',') as sections, array_to_string({CHAPTERS_SQL}, ',') as chapters from {LEGAL_SQL}")
def meta_all(spark, sf_dir):
    c = F.col("legal")
    return legal(spark, sf_dir).select("doc_id", T.act_name(c).alias("act_name"), T.first_year(c).alias("year"), F.array_join(T.section_numbers(c), ",").alias("sections"), F.array_join(T.chapter_numbers(c), ",").alias("chapters"))


@register("collection_name", r"select doc_id, coalesce(nullif(regexp_replace(lower(trim(regexp_replace(coalesce(replace(source, '_', ' '), ''), '[^a-zA-Z0-9\s]', '', 'g'))), '\s+', '_', 'g'), ''), 'unknown_act') as name from documents")
def collection_name(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.collection_name(F.translate("source", "_", " ")).alias("name"))


@register("language_detect", "select document_id, case when regexp_matches(content, '[\\x{900}-\\x{97F}]') then 'ne' else 'en' end as language from parsed_documents where content is not null")
def language_detect(spark, sf_dir):
    return read(spark, sf_dir, "parsed_documents").where("content is not null").select("document_id", T.script_language(F.col("content")).alias("language"))


@register(
    "language_precedence",
    r"""with r as (select document_id, arg_max_null(language, (requested_at, request_id)) as form from parse_requests where requested_at is not null group by document_id)
    select document_id, coalesce(nullif(lower(trim(form)), ''), case when regexp_matches(content, '[\x{900}-\x{97F}]') then 'ne' end, 'en') as language from parsed_documents left join r using (document_id)""",
)
def language_precedence(spark, sf_dir):
    r = read(spark, sf_dir, "parse_requests").where("requested_at is not null").groupBy("document_id").agg(F.max_by("language", F.struct("requested_at", "request_id")).alias("form"))
    script = F.when(F.col("content").rlike("[\\u0900-\\u097F]"), "ne")
    return read(spark, sf_dir, "parsed_documents").join(r, "document_id", "left").select("document_id", F.coalesce(F.nullif(F.lower(F.trim("form")), F.lit("")), script, F.lit("en")).alias("language"))


@register("ocr_language_code", "select request_id, case when length(l) = 2 then l when l = 'nep' then 'ne' when l = 'eng' then 'en' when l = 'hin' then 'hi' else left(l, 2) end as code from (select distinct request_id, lower(trim(language)) as l from parse_requests where language is not null)")
def ocr_language_code(spark, sf_dir):
    return read(spark, sf_dir, "parse_requests").where("language is not null").select("request_id", "language").distinct().select("request_id", T.code_of_language(F.col("language")).alias("code"))


ANCHOR_SQL = rf"select document_id, trim(regexp_replace(regexp_replace(content, '<!--[^\n]*?-->', '', 'g'), '{T.WHITE_SQL}+', ' ', 'g'), ' ') as anchor from parsed_documents where content is not null"


@register("anchor_sanitise", ANCHOR_SQL)
def anchor_sanitise(spark, sf_dir):
    """All contents without comments, in one line."""
    d = read(spark, sf_dir, "parsed_documents").where("content is not null")
    return d.select("document_id", T.squeeze(F.regexp_replace("content", r"<!--[^\n]*?-->", ""), f"[{T.WHITE}]").alias("anchor"))


@register("anchor_sanitise_whole", ANCHOR_SQL)
def anchor_sanitise_whole(spark, sf_dir):
    """All contents without comments, white space of any kind squeezed; tested against a plain loop."""
    d = read(spark, sf_dir, "parsed_documents").where("content is not null")
    return d.select("document_id", T.squeeze(F.regexp_replace("content", "(?d)<!--.*?-->", ""), f"[{T.WHITE}]").alias("anchor"))


FORMS_SQL = r"""select document_id, lower(translate(content, '.,:;()[]{}"''`।॥', '               ')) as same_length, translate(content, '०१२३४५६७८९', '0123456789') as digits from parsed_documents where content is not null"""


@register("normal_forms", FORMS_SQL)
def normal_forms(spark, sf_dir):
    """Forms of whole contents in which every character keeps its place."""
    t = F.col("content")
    return read(spark, sf_dir, "parsed_documents").where("content is not null").select("document_id", T.same_length_form(t).alias("same_length"), T.plain_digits(t).alias("digits"))


@register("normal_forms_whole", FORMS_SQL)
def normal_forms_whole(spark, sf_dir):
    """Normal forms of whole contents; tested against a plain loop."""
    t = F.col("content")
    return read(spark, sf_dir, "parsed_documents").where("content is not null").select("document_id", T.same_length_form(t).alias("same_length"), T.plain_digits(t).alias("digits"))


COMPLETE_SQL = r"""case when rtext = '' then 0.0 else round(greatest(0.0, 1.0 - ((case when not regexp_matches(rtext, '[.!?;:]\z') then 0.3 else 0 end)
  + (case when length(text) - length(replace(text, '(', '')) > length(text) - length(replace(text, ')', '')) then 0.2 else 0 end)
  + (case when length(text) - length(replace(text, '[', '')) > length(text) - length(replace(text, ']', '')) then 0.1 else 0 end)
  + (case when length(text) - length(replace(text, '{', '')) > length(text) - length(replace(text, '}', '')) then 0.1 else 0 end)
  + (case when (length(text) - length(replace(text, '"', ''))) % 2 = 1 then 0.1 else 0 end)
  + (case when regexp_matches(rtext, '\n@W@*\p{Nd}+[.)]\z') then 0.2 else 0 end))), 6) end""".replace("@W@", T.WHITE_SQL)
COHERE_SQL = r"""case when length(text) < 50 or len(w) < 10 then 0.5 else round(greatest(0.0, least(1.0, 1.0 + (case when r > 0.9 then -0.2 when r < 0.6 then 0.1 else 0 end)
  + (case when len(m) > 1 then 0.1 else 0 end) + (case when len(list_distinct(m)) > 3 then -0.2 else 0 end))), 6) end"""
TOKENS_SQL = r"(select *, len(list_distinct(w))::double / greatest(len(w), 1) as r from (select doc_id, text, list_filter(regexp_split_to_array(lower(text), '@W@+'), lambda x: x <> '') as w, regexp_extract_all(text, '(?i)Section@W@+(\p{Nd}+)', 1) as m, regexp_replace(text, '@W@+\z', '') as rtext from documents where text is not null))".replace("@W@", T.WHITE_SQL)


@register("chunk_completeness", f"select doc_id, ({COMPLETE_SQL})::double as completeness from {TOKENS_SQL}")
def chunk_completeness(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.completeness(F.col("text")).alias("completeness"))


@register("chunk_coherence", f"select doc_id, ({COHERE_SQL})::double as coherence from {TOKENS_SQL}")
def chunk_coherence(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.coherence(F.col("text")).alias("coherence"))


@register("metadata_richness", f"select doc_id, round(least(1.0, (case when {ACT_SQL} is not null then 0.3 else 0 end) + (case when len({SECTIONS_SQL}) > 0 then 0.4 else 0 end) + (case when len({SECTIONS_SQL}) > 1 then 0.1 else 0 end) + (case when len({CHAPTERS_SQL}) > 0 then 0.1 else 0 end) + (case when {YEAR_SQL} is not null then 0.1 else 0 end)), 6)::double as richness from {LEGAL_SQL}")
def metadata_richness(spark, sf_dir):
    c = F.col("legal")
    return legal(spark, sf_dir).select("doc_id", T.richness(T.act_name(c), T.section_numbers(c), T.chapter_numbers(c), T.first_year(c)).alias("richness"))


@register(
    "chunk_quality",
    f"""with q as (select t.doc_id, ({COMPLETE_SQL}) as a, ({COHERE_SQL}) as b from {TOKENS_SQL} t), m as (select doc_id, least(1.0, (case when {ACT_SQL} is not null then 0.3 else 0 end) + (case when len({SECTIONS_SQL}) > 0 then 0.4 else 0 end)
      + (case when len({SECTIONS_SQL}) > 1 then 0.1 else 0 end) + (case when len({CHAPTERS_SQL}) > 0 then 0.1 else 0 end) + (case when {YEAR_SQL} is not null then 0.1 else 0 end)) as c from {LEGAL_SQL})
    select doc_id, round(0.4 * a::double + 0.3 * b::double + 0.3 * c::double + 1e-9, 3) as quality from q join m using (doc_id)""",
)
def chunk_quality(spark, sf_dir):
    """Weighted score of completeness, coherence and metadata of each text, in one pass."""
    head = spread(legal(spark, sf_dir, "text"))
    c = F.col("legal")
    rich = T.richness(T.act_name(c), T.section_numbers(c), T.chapter_numbers(c), T.first_year(c))
    return head.select("doc_id", F.round(0.4 * T.completeness(F.col("text")) + 0.3 * T.coherence(F.col("text")) + 0.3 * rich + 1e-9, 3).alias("quality"))


@register(
    "chunk_fixed_windows",
    """select doc_id, i as chunk_index, i * 800 as start_char, md5(substr(text, i * 800 + 1, 1000)) as digest from (select doc_id, text, unnest(generate_series(0, case when length(text) <= 1000 then 0 else ceil((length(text) - 1000) / 800.0)::int end)) as i from documents where length(text) > 0)""",
)
def chunk_fixed_windows(spark, sf_dir):
    w = chunks.windows(read(spark, sf_dir, "documents"), "doc_id", "text")
    return w.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start_char").cast("long").alias("start_char"), F.md5("chunk").alias("digest"))


SPLIT_SQL = (
    r"""with m as (select doc_id, regexp_replace(regexp_replace(regexp_replace(chr(10) || legal, '(\nChapter@W@+[0-9]+|\nPART@W@+[0-9]+)', chr(57344) || '\1', 'g'), '(\nSection@W@+[0-9]+|\nArt\. [0-9]+)', chr(57344) || '\1', 'g'), '(\n#{1,3}@W@+)', chr(57344) || '\1', 'g') as t from """
    + LEGAL_SQL
    + r""") select doc_id, len(p) as pieces, md5(array_to_string(p, '|')) as digest from (select doc_id, list_filter(list_transform(string_split(t, chr(57344)), lambda x: trim(regexp_replace(x, '^@W@+|@W@+\z', '', 'g'), ' ')), lambda x: x <> '') as p from m)"""
).replace("@W@", T.WHITE_SQL)


@register("section_split", SPLIT_SQL)
def section_split(spark, sf_dir):
    """Sections of all documents, white space of any kind."""
    p = legal(spark, sf_dir).select("doc_id", chunks.sections(F.col("legal"), f"[{T.WHITE}]").alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("pieces"), F.md5(F.array_join("p", "|")).alias("digest"))


@register("section_split_whole", SPLIT_SQL)
def section_split_whole(spark, sf_dir):
    """Sections of all documents, white space of any kind; tested against a plain loop."""
    p = legal(spark, sf_dir).select("doc_id", chunks.sections(F.col("legal"), f"[{T.WHITE}]").alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("pieces"), F.md5(F.array_join("p", "|")).alias("digest"))


@register("chunk_fit_sizes")
def chunk_fit_sizes(spark, sf_dir):
    """Sections brought to 100 to 2,000 characters; an ordered fold, tested on small texts."""
    d = legal(spark, sf_dir).select("doc_id", chunks.sections(F.col("legal")).alias("pieces"))
    return chunks.fit_sizes(d, "doc_id", "pieces").select("doc_id", "chunk_index", F.length("chunk").alias("n"))


@register("chunk_definitions")
def chunk_definitions(spark, sf_dir):
    """Sections with unfinished definitions joined with the next; an ordered fold, tested on small texts."""
    d = legal(spark, sf_dir).select("doc_id", chunks.sections(F.col("legal")).alias("pieces"))
    return chunks.merge_definitions(d, "doc_id", "pieces").select("doc_id", "chunk_index", F.length("chunk").alias("n"))


MARKED_SQL = "chr(1) || content"
for _mark in chunks.marks(T.WHITE_SQL[1:-1]):
    MARKED_SQL = f"regexp_replace({MARKED_SQL}, '({_mark})', chr(1) || '\\1', 'g')"


@register(
    "section_split_legal",
    f"""select document_id, len(p) as pieces, md5(array_to_string(p, '|')) as digest from (select document_id, list_filter(list_transform(string_split({MARKED_SQL}, chr(1)), lambda x: regexp_replace(x, '^{T.WHITE_SQL}+|{T.WHITE_SQL}+\\z', '', 'g')), lambda x: x <> '') as p from parsed_documents where content is not null)""",
)
def section_split_legal(spark, sf_dir):
    """Contents before each chapter, section, clause and heading, in English and Nepali."""
    p = read(spark, sf_dir, "parsed_documents").where("content is not null").select("document_id", chunks.legal_sections(F.col("content")).alias("p"))
    return p.select("document_id", F.size("p").cast("long").alias("pieces"), F.md5(F.array_join("p", "|")).alias("digest"))


@register("chunk_sentence_windows")
def chunk_sentence_windows(spark, sf_dir):
    """Windows that end with a sentence where one ends near; an ordered fold, tested against a plain loop."""
    return chunks.sentence_windows(read(spark, sf_dir, "documents").where("length(text) > 0"), "doc_id", "text")


def _found_sql(c: str, pattern: str) -> str:
    return f"nullif(regexp_replace(regexp_extract({c}, '{pattern}'), '^{T.WHITE_SQL}+|{T.WHITE_SQL}+\\z', '', 'g'), '')"


_W = T.WHITE_SQL[1:-1]
ACT_TITLE_SQL = "coalesce(" + ", ".join([
    *(_found_sql("stem", p) for p in T.act_patterns(_W)),
    f"case when contains(lower(stem), 'act') then array_to_string(list_transform(string_split(trim(regexp_replace(translate(stem, '_-', '  '), '{T.WHITE_SQL}+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') end",
    *(f"case when regexp_matches(content, '[\\x{{0900}}-\\x{{097F}}]') then {_found_sql('head', f'[\\x{{0900}}-\\x{{097F}}{_W}]+{x}')} end" for x in T.NEPALI_ACTS),
    *(_found_sql("head", p) for p in T.act_patterns(_W)),
    _found_sql("head", f"[A-Z][a-z]+(?:[{_W}]+[A-Z][a-z]+){{0,5}}[{_W}]+Act"),
    _found_sql("head", f"[A-Z][A-Za-z{_W}]{{3,30}}?[{_W}]+Act"),
]) + ")"


@register(
    "meta_act_title",
    f"""select document_id, {ACT_TITLE_SQL} as act_name from (select document_id, content, array_to_string(string_split(content, chr(10))[1:50], chr(10)) as head,
    regexp_replace(regexp_replace(file_path, '\\.[^.]*\\z', ''), '(?s)^.*[/\\\\]', '') as stem from parsed_documents)""",
)
def meta_act_title(spark, sf_dir):
    """Names of acts by file name, then by content."""
    return read(spark, sf_dir, "parsed_documents").select("document_id", T.act_title(F.col("content"), F.col("file_path")).alias("act_name"))


@register(
    "meta_nepali",
    f"""select document_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(content, '(?:{T.NEPALI_SECTION}){T.WHITE_SQL}*(\\p{{Nd}}+)', 1)), lambda x: (length(x), x))), lambda p: p[2]), ',') as sections,
    array_to_string(list_sort(list_distinct(regexp_extract_all(content, '(?:{T.NEPALI_CHAPTER}){T.WHITE_SQL}*(\\p{{Nd}}+)', 1))), ',') as chapters from parsed_documents where regexp_matches(content, '[\\x{{0900}}-\\x{{097F}}]')""",
)
def meta_nepali(spark, sf_dir):
    """Numbers of sections and chapters of contents in Devanagari."""
    c = F.col("content")
    d = read(spark, sf_dir, "parsed_documents").where(c.rlike("[\\u0900-\\u097F]"))
    return d.select("document_id", F.array_join(T.nepali_numbers(c, T.NEPALI_SECTION), ",").alias("sections"), F.array_join(T.nepali_numbers(c, T.NEPALI_CHAPTER), ",").alias("chapters"))


# --- trees ------------------------------------------------------------------

LINES_SQL = "(select document_id, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) - 1 as line_no from parsed_documents where content is not null)"
HEAD_SQL = rf"""heads as (select document_id, line_no, length(regexp_extract(text, '^(#{{1,6}})', 1)) as level, trim(regexp_replace(rtrim(text, chr(13)), '^#{{1,6}}\s+', '')) as title from {LINES_SQL} where regexp_matches(text, '^#{{1,6}}\s+\S'))"""


def heads(spark, sf_dir):
    d = read(spark, sf_dir, "parsed_documents").where("content is not null").select("document_id", F.posexplode(F.split("content", "\n")).alias("line_no", "text"))
    return trees.heading_stack(d.withColumn("text", F.regexp_replace("text", "\r$", "")))


def up(n: int) -> str:
    return f"case when level > {n} then last_value(case when level = {n} then line_no end ignore nulls) over w end"


@register(
    "tree_headings",
    f"with {HEAD_SQL} select document_id, line_no::int as line_no, level::int as level, title, greatest({', '.join(up(n) for n in range(1, 6))})::int as parent_line from heads window w as (partition by document_id order by line_no rows between unbounded preceding and 1 preceding)",
)
def tree_headings(spark, sf_dir):
    return heads(spark, sf_dir)


@register("tree_next_title", f"with {HEAD_SQL} select document_id, line_no::int as line_no, title, lead(title) over (partition by document_id order by line_no) as next_title from heads")
def tree_next_title(spark, sf_dir):
    w = Window.partitionBy("document_id").orderBy("line_no")
    return heads(spark, sf_dir).select("document_id", "line_no", "title", F.lead("title").over(w).alias("next_title"))


GEO_SQL = """nodes as (select [r_regionkey]::int[] as path, r_name as title from region union all select [n_regionkey, n_nationkey], n_name from nation union all
  select [n_regionkey, n_nationkey, s_suppkey], s_name from supplier join nation on s_nationkey = n_nationkey)"""


def geography(spark, sf_dir):
    """A tree of three levels: regions, nations, suppliers."""
    r, n, s = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    ints = lambda *cs: F.array(*(F.col(c).cast("int") for c in cs)).alias("path")
    low = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return r.select(ints("r_regionkey"), F.col("r_name").alias("title")).unionByName(n.select(ints("n_regionkey", "n_nationkey"), F.col("n_name").alias("title"))).unionByName(low.select(ints("n_regionkey", "n_nationkey", "s_suppkey"), F.col("s_name").alias("title")))


@register("tree_dfs", f"with {GEO_SQL} select array_to_string(path, '.') as path, title, row_number() over (order by path) - 1 as id, len(path)::int as depth from nodes")
def tree_dfs(spark, sf_dir):
    own = trees.depth_first_within(geography(spark, sf_dir), 2)
    return own.select(F.array_join("path", ".").alias("path"), "title", "id", F.size("path").alias("depth"))


@register("tree_counts", f"with {GEO_SQL} select len(path)::int as depth, count(*) as nodes, string_agg(title, ',' order by title) filter (len(path) < 3) as titles from nodes group by len(path)")
def tree_counts(spark, sf_dir):
    n = geography(spark, sf_dir).withColumn("depth", F.size("path"))
    titles = F.array_join(F.sort_array(F.collect_list(F.when(F.col("depth") < 3, F.col("title")))), ",")
    return n.groupBy("depth").agg(F.count("*").alias("nodes"), F.when(F.first("depth") < 3, titles).alias("titles"))


@register("tree_compact", f"with {GEO_SQL} select array_to_string(path, '.') as node, title, (select count(*) from nodes c where len(c.path) = len(n.path) + 1 and c.path[1:len(n.path)] = n.path) as children from nodes n")
def tree_compact(spark, sf_dir):
    n = geography(spark, sf_dir)
    parents = n.where(F.size("path") > 1).groupBy(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.count("*").alias("children"))
    return n.join(parents, "path", "left").select(F.array_join("path", ".").alias("node"), "title", F.coalesce("children", F.lit(0)).alias("children"))


STARTS_SQL = rf"""{HEAD_SQL}, n as (select h.document_id, line_no, title, strpos(content, title) - 1 as start_char, length(content) as total, content from heads h join parsed_documents using (document_id) where title <> '')"""


def starts(spark, sf_dir):
    """Headings with the first place of their title in the content."""
    d = read(spark, sf_dir, "parsed_documents").select("document_id", "content")
    return heads(spark, sf_dir).where("title <> ''").join(d, "document_id").select("document_id", "line_no", "title", (F.call_function("locate", F.col("title"), F.col("content")) - 1).alias("start_char"), F.length("content").alias("total"), "content")


@register("tree_end_char", f"with {STARTS_SQL} select document_id, line_no::int as line_no, start_char, coalesce((select min(m.start_char) from n m where m.document_id = n.document_id and m.start_char > n.start_char + length(n.title)), total) as end_char from n")
def tree_end_char(spark, sf_dir):
    own = trees.next_start(starts(spark, sf_dir).drop("content"), ["document_id"], "start_char", "title", F.col("total"))
    return own.select("document_id", "line_no", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


@register(
    "tree_slice",
    f"with {STARTS_SQL}, e as (select *, coalesce((select min(m.start_char) from n m where m.document_id = n.document_id and m.start_char > n.start_char + length(n.title)), total) as end_char from n) select document_id, line_no::int as line_no, end_char > start_char and start_char >= 0 as is_exact, md5(substr(content, start_char + 1, end_char - start_char)) as digest from e",
)
def tree_slice(spark, sf_dir):
    """Texts of the sections; ends are found without the contents, which join last."""
    own = trees.next_start(starts(spark, sf_dir).drop("content"), ["document_id"], "start_char", "title", F.col("total"))
    whole = own.join(read(spark, sf_dir, "parsed_documents").select("document_id", "content"), "document_id")
    text, exact = trees.slice_text(F.col("content"), F.col("start_char"), F.col("end_char"), F.col("title"))
    return whole.select("document_id", "line_no", exact.alias("is_exact"), F.md5(text).alias("digest"))


PAGE_MAP_SQL = "(select document_id, page, min(o) as ps, max(o + length(t)) as pe, min(x0) as x0, min(y0) as y0, max(x2) as x2, max(y2) as y2 from (select document_id, page, w.char_offset as o, w.text as t, w.x0 as x0, w.y0 as y0, w.x2 as x2, w.y2 as y2 from (select document_id, page, unnest(words) as w from (select distinct on (document_id, page) * from word_bboxes))) group by document_id, page)"


@register(
    "tree_page_bboxes",
    f"""with {STARTS_SQL}, e as (select document_id, line_no, start_char, coalesce((select min(m.start_char) from n m where m.document_id = n.document_id and m.start_char > n.start_char + length(n.title)), total) as end_char from n)
    select e.document_id, line_no::int as node, page, x0::double as x0, round(y0 + (y2 - y0) * (greatest(start_char, ps) - ps) / greatest(pe - ps, 1)::double, 6) as y0, x2::double as x2, round(y0 + (y2 - y0) * (least(end_char, pe) - ps) / greatest(pe - ps, 1)::double, 6) as y2
    from e join {PAGE_MAP_SQL} p on p.document_id = e.document_id and pe > start_char and ps < end_char""",
)
def tree_page_bboxes(spark, sf_dir):
    from .pages import page_bbox_map

    nodes = trees.next_start(starts(spark, sf_dir).drop("content"), ["document_id"], "start_char", "title", F.col("total")).select("document_id", F.col("line_no").alias("node"), "start_char", "end_char")
    own = trees.page_boxes(nodes, page_bbox_map(spark, sf_dir))
    return own.select("document_id", "node", "page", F.col("x0").cast("double").alias("x0"), "y0", F.col("x2").cast("double").alias("x2"), "y2")


@register("tree_unmatched", f"with {STARTS_SQL} select document_id, count(*) filter (strpos(content, upper(title)) = 0) as unmatched, count(*) as nodes from n group by document_id")
def tree_unmatched(spark, sf_dir):
    """How many titles are not found as they are asked for (in capitals)."""
    n = starts(spark, sf_dir)
    return n.groupBy("document_id").agg(F.count(F.when(F.call_function("locate", F.upper("title"), F.col("content")) == 0, 1)).alias("unmatched"), F.count("*").alias("nodes"))


@register("tree_anchors")
def tree_anchors(spark, sf_dir):
    """Starts of the headings sought with a damaged anchor in the whole content, as their pages aren't known; tested on small texts."""
    n = starts(spark, sf_dir).select("document_id", "line_no", F.concat(F.col("title"), F.lit("~")).alias("anchor"), F.lit("").alias("title"), F.col("content").alias("region"))
    return trees.anchor_places(n, "region", "title", "anchor").select("document_id", "line_no", "start_char", "leg")


NODE_SQL = BM25_SQL.replace("select doc_id, ", "select document_id || '#' || line_no as doc_id, ", 1).replace("coalesce(text, '')", "title").replace("from documents)", "from heads where title <> '')", 1)


@register(
    "section_retrieve",
    f"with {HEAD_SQL}, {NODE_SQL} select qid, doc_id as node, score, rank from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from scored) where rank <= 5",
)
def section_retrieve(spark, sf_dir):
    """The five sections that each question leads to, of all documents' trees of headings."""
    n = heads(spark, sf_dir).where("title <> ''").select(F.concat_ws("#", "document_id", F.col("line_no").cast("string")).alias("node"), "title", F.lit(None).cast("string").alias("summary"))
    return trees.navigate(n, queries_of(spark, sf_dir), "node").withColumn("rank", F.col("rank").cast("long"))


@register(
    "section_rank",
    f"""with {HEAD_SQL}, s as (select *, row_number() over (partition by document_id order by line_no) - 1 as idx from heads), r as (select document_id, line_no::int as line_no, round(1.0 - 0.1 * idx, 6)::double as score, idx from s where idx < 5)
    select document_id, line_no, score, rank from (select *, row_number() over (order by score desc, document_id, idx) as rank from r) where rank <= 50""",
)
def section_rank(spark, sf_dir):
    """Sections by place in their document, then over all documents: the first 50."""
    w = Window.partitionBy("document_id").orderBy("line_no")
    own = heads(spark, sf_dir).withColumn("idx", F.row_number().over(w) - 1).where("idx < 5").withColumn("score", F.round(1.0 - 0.1 * F.col("idx"), 6))
    best = own.orderBy(F.desc("score"), "document_id", "idx").limit(50)
    top = best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "document_id", "idx")).cast("long"))
    return top.select("document_id", "line_no", "score", "rank")


@register(
    "collection_scope_fallback",
    """with d as (select document_id, lower(replace(collection_name, '_', ' ')) as title from parsed_documents), q(name) as (values ('road_toll'), ('no_such_thing'))
    select name, document_id from q, d where coalesce(contains(title, replace(name, '_', ' ')), false) or not exists (select 1 from d e where contains(e.title, replace(q.name, '_', ' ')))""",
)
def collection_scope_fallback(spark, sf_dir):
    """Documents whose title holds the name asked for; if none does, all of them."""
    d = read(spark, sf_dir, "parsed_documents").select("document_id", F.lower(F.translate("collection_name", "_", " ")).alias("title"))
    names = spark.createDataFrame([("road_toll",), ("no_such_thing",)], "name string")
    asked = d.join(F.broadcast(names), F.lit(True)).withColumn("hit", F.coalesce(F.contains("title", F.translate("name", "_", " ")), F.lit(False)))
    some = asked.groupBy("name").agg(F.max("hit").alias("some"))
    return asked.join(F.broadcast(some), "name").where("hit or not some").select("name", "document_id")


# --- discovery and ledger ---------------------------------------------------


@register("url_source_id", "select distinct request_id, sha256(concat_ws('|', coalesce(file_type, ''), coalesce(file_url, ''), coalesce(document_id, ''), coalesce(language, ''))) as source_id from parse_requests")
def url_source_id(spark, sf_dir):
    r = read(spark, sf_dir, "parse_requests")
    parts = [F.coalesce(c, F.lit("")) for c in ("file_type", "file_url", "document_id", "language")]
    return r.select("request_id", F.sha2(F.concat_ws("|", *parts), 256).alias("source_id")).distinct()


@register("url_parts", r"select distinct request_id, lower(regexp_extract(regexp_replace(file_url, '[?#].*$', ''), '(\.[A-Za-z0-9]+)$', 1)) as suffix, regexp_extract(file_url, '^https?://([^/]+)', 1) as host, translate(regexp_extract(file_url, '([^/]+?)(?:\.[A-Za-z0-9]+)?$', 1), '-_', '  ') as title from parse_requests where file_url is not null")
def url_parts(spark, sf_dir):
    r = read(spark, sf_dir, "parse_requests").where("file_url is not null")
    u = F.col("file_url")
    return r.select("request_id", T.suffix(u).alias("suffix"), F.regexp_extract(u, r"^https?://([^/]+)", 1).alias("host"), T.file_stem(u).alias("title")).distinct()


@register("file_kinds", r"select document_id, case when s = '.pdf' then 'pdf' when s in ('.png', '.jpg', '.jpeg', '.gif', '.tiff', '.tif', '.bmp', '.webp') then 'image' else 'unsupported' end as kind from (select document_id, lower(regexp_extract(file_path, '(\.[A-Za-z0-9]+)$', 1)) as s from parsed_documents)")
def file_kinds(spark, sf_dir):
    s = F.lower(F.regexp_extract("file_path", r"(\.[A-Za-z0-9]+)$", 1))
    kind = F.when(s == ".pdf", "pdf").when(s.isin(".png", ".jpg", ".jpeg", ".gif", ".tiff", ".tif", ".bmp", ".webp"), "image").otherwise("unsupported")
    return read(spark, sf_dir, "parsed_documents").select("document_id", kind.alias("kind"))


WHITE_SQL = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LINK_SQL = rf"""'https?://[^{WHITE_SQL}"''<>)]+'"""


@register(
    "links_extract",
    f"""with l as (select doc_id, unnest(regexp_extract_all(text, {LINK_SQL})) as url, generate_subscripts(regexp_extract_all(text, {LINK_SQL}), 1) as i from documents where text is not null)
    select doc_id, url, min(i)::int as ord from l group by doc_id, url""",
)
def links_extract(spark, sf_dir):
    """Distinct links of all documents with their first place; white space of any kind ends one."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    found = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(rf"""(https?://[^{T.WHITE}"'<>)]+)"""), F.lit(1))).alias("i", "url"))
    return found.groupBy("doc_id", "url").agg((F.min("i") + 1).alias("ord"))


@register(
    "links_extract_whole",
    f"""with l as (select doc_id, unnest(regexp_extract_all(text, {LINK_SQL})) as url, generate_subscripts(regexp_extract_all(text, {LINK_SQL}), 1) as i from documents where text is not null)
    select doc_id, url, min(i)::int as ord from l group by doc_id, url""",
)
def links_extract_whole(spark, sf_dir):
    """The same as ``links_extract``, which once left rows out; tested against a plain loop."""
    return links_extract(spark, sf_dir)


YEAR_GUESS_SQL = r"with y as (select document_id, nullif(regexp_extract(translate(content, '०१२३४५६७८९', '0123456789'), '(20[0-9]{2})', 1), '')::int as year from parsed_documents) select document_id, year from y where year is not null and year >= 2050 and year <= 2075"


@register("year_guess_filter", YEAR_GUESS_SQL)
def year_guess_filter(spark, sf_dir):
    """Documents whose first year, wherever it stands, lies within bounds; without a year they are left out."""
    d = read(spark, sf_dir, "parsed_documents").select("document_id", T.title_year(F.col("content")).cast("int").alias("year"))
    return d.where("year is not null and year between 2050 and 2075")


@register("year_guess_filter_whole", YEAR_GUESS_SQL)
def year_guess_filter_whole(spark, sf_dir):
    """Documents whose first year in the whole content lies within bounds; tested against a plain loop."""
    d = read(spark, sf_dir, "parsed_documents").select("document_id", T.title_year(F.col("content")).cast("int").alias("year"))
    return d.where("year is not null and year between 2050 and 2075")


@register("keyword_filter", "select document_id from parsed_documents where contains(file_path, 'Act') or contains(lower(file_path), 'toll') or contains(lower(file_path), 'survey')")
def keyword_filter(spark, sf_dir):
    p = F.col("file_path")
    return read(spark, sf_dir, "parsed_documents").where(p.contains("Act") | F.exists(F.array(F.lit("toll"), F.lit("survey")), lambda k: F.contains(F.lower(p), k))).select("document_id")


@register("safe_names", r"""select document_id, left(regexp_replace(file_path, '[<>:"/\\|?*\n\r\t]', '_', 'g'), 60) as name from parsed_documents""")
def safe_names(spark, sf_dir):
    return read(spark, sf_dir, "parsed_documents").select("document_id", T.safe_name(F.col("file_path"), 60).alias("name"))


LEDGER_SQL = "ledger as (select document_id, case hash_ % 4 when 0 then 'success' when 1 then 'failed' when 2 then 'in_progress' end as status from (select document_id, ascii(right(left(document_id, 8), 1)) as hash_ from parsed_documents where page_count is not null))"


def ledger(spark, sf_dir):
    h = F.ascii(F.substring("document_id", 8, 1)) % 4
    status = F.when(h == 0, "success").when(h == 1, "failed").when(h == 2, "in_progress")
    return read(spark, sf_dir, "parsed_documents").where("page_count is not null").select("document_id", status.alias("status"))


@register("ledger_antijoin", f"with {LEDGER_SQL} select distinct document_id from parse_requests where document_id not in (select document_id from ledger where status = 'success')")
def ledger_antijoin(spark, sf_dir):
    """Documents asked for that aren't ingested yet."""
    done = ledger(spark, sf_dir).where("status = 'success'")
    return read(spark, sf_dir, "parse_requests").select("document_id").distinct().join(done, "document_id", "left_anti")


@register("ledger_stats", f"with {LEDGER_SQL} select coalesce(status, 'unknown') as status, count(*) as n, (select count(*) from ledger) as total from ledger group by coalesce(status, 'unknown')")
def ledger_stats(spark, sf_dir):
    own = ledger(spark, sf_dir).groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))
    return own.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))


@register("download_paths", r"select document_id, base || case when n = 1 then '' when n = 2 then '_' || left(md5(document_id), 8) else '_' || left(md5(document_id), 8) || '_' || n end || '.pdf' as path from (select document_id, coalesce(collection_name, 'none') as base, row_number() over (partition by coalesce(collection_name, 'none') order by document_id) as n from parsed_documents)")
def download_paths(spark, sf_dir):
    """Places of downloads: a second file of a name gets a hash, further ones also a number."""
    base = F.coalesce("collection_name", F.lit("none"))
    d = read(spark, sf_dir, "parsed_documents").select("document_id", base.alias("base"))
    # Numbered within the first six characters of the ids, whose order is that of the ids, and over the counts of these: no name is one group.
    d = d.withColumn("part", F.substring("document_id", 1, 6))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("base").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = d.groupBy("base", "part").count().withColumn("before", before).drop("count")
    n = F.row_number().over(Window.partitionBy("base", "part").orderBy("document_id")) + F.col("before")
    d = d.join(counts, ["base", "part"])
    h = F.concat(F.lit("_"), F.substring(F.md5("document_id"), 1, 8))
    d = d.withColumn("n", n)
    tail = F.when(F.col("n") == 1, "").when(F.col("n") == 2, h).otherwise(F.concat(h, F.lit("_"), F.col("n").cast("string")))
    return d.select("document_id", F.concat("base", tail, F.lit(".pdf")).alias("path"))


@register("document_structure", "select p.document_id, count(distinct r.request_id) as requests, count(distinct r.request_id) filter (r.file_type = 'url') as urls, count(distinct b.page) as pages from parsed_documents p left join parse_requests r using (document_id) left join word_bboxes b using (document_id) group by p.document_id")
def document_structure(spark, sf_dir):
    p = read(spark, sf_dir, "parsed_documents").select("document_id")
    r = read(spark, sf_dir, "parse_requests").groupBy("document_id").agg(F.countDistinct("request_id").alias("requests"), F.countDistinct(F.when(F.col("file_type") == "url", F.col("request_id"))).alias("urls"))
    b = read(spark, sf_dir, "word_bboxes").groupBy("document_id").agg(F.countDistinct("page").alias("pages"))
    return p.join(r, "document_id", "left").join(b, "document_id", "left").fillna(0, ["requests", "urls", "pages"])


@register("requests_latest", "select document_id, arg_max(request_id, (requested_at, request_id)) as request_id, max(requested_at) as requested_at from parse_requests where requested_at is not null group by document_id")
def requests_latest(spark, sf_dir):
    r = read(spark, sf_dir, "parse_requests").where("requested_at is not null").select("document_id", "request_id", "requested_at").distinct()
    return upsert.latest(r, ["document_id"], [F.desc("requested_at"), F.desc("request_id")])


LEDGER_EVENTS_SQL = """(select document_id as source_id, received_at as t, request_id as seq, case request_id % 3 when 0 then 'in_progress' when 1 then 'success' else 'failed' end as status, file_type as title,
  case when request_id % 3 = 1 then document_id end as document_id, case when request_id % 3 = 2 then file_url end as error from (select distinct document_id, received_at, request_id, file_type, file_url from parse_requests))"""


@register(
    "ledger_upserts",
    f"""select source_id, arg_max(document_id, row(t, seq)) filter (status = 'success') as document_id, arg_max_null(title, row(t, seq)) as title, arg_max(status, row(t, seq)) as status,
    arg_max_null(case when status = 'failed' then left(error, 8000) end, row(t, seq)) filter (status <> 'in_progress') as error, min(t) as created_at, max(t) as updated_at, max(t) filter (status = 'success') as ingested_at from {LEDGER_EVENTS_SQL} group by source_id""",
)
def ledger_upserts(spark, sf_dir):
    """The ledger after every request, taken as one event each, has been written to it."""
    r = read(spark, sf_dir, "parse_requests").select("document_id", "received_at", "request_id", "file_type", "file_url").distinct()
    kind = F.col("request_id") % 3
    e = r.select(
        F.col("document_id").alias("source_id"), F.col("received_at").alias("at"), F.col("request_id").alias("seq"), F.when(kind == 0, "in_progress").when(kind == 1, "success").otherwise("failed").alias("status"),
        F.col("file_type").alias("title"), F.when(kind == 1, F.col("document_id")).alias("document_id"), F.when(kind == 2, F.col("file_url")).alias("error"),
    )
    return upsert.ledger(e)


@register(
    "ingest_run",
    """select document_id, case when content is null or trim(content) = '' then 'failed' else 'success' end as status, case when content is null then 'No content extracted' when trim(content) = '' then 'Empty markdown supplied' end as error,
    case when content is null or trim(content) = '' then 0 when length(content) <= 1000 then 1 else ceil((length(content) - 1000) / 800.0)::bigint + 1 end as chunks from parsed_documents""",
)
def ingest_run(spark, sf_dir):
    """Outcome of each document of an ingest run; what can't be ingested is a row with its error."""
    return pipelines.ingest(read(spark, sf_dir, "parsed_documents"), "document_id", "content")


@register(
    "ingest_totals",
    """select coalesce(collection_name, 'none') as collection, count(*) as documents, count(*) filter (content is null or trim(content) = '') as failed, sum(coalesce(page_count, 0))::bigint as pages, sum(coalesce(length(content), 0))::bigint as characters,
    sum(case when content is null or trim(content) = '' then 0 when length(content) <= 1000 then 1 else ceil((length(content) - 1000) / 800.0)::bigint + 1 end)::bigint as chunks from parsed_documents group by 1""",
)
def ingest_totals(spark, sf_dir):
    """Totals of a batch by collection."""
    d = read(spark, sf_dir, "parsed_documents")
    return pipelines.totals(d, F.coalesce("collection_name", F.lit("none")), "content", "page_count")


@register("pdf_links", "select document_id, 0 as ord, 'https://docs.example' || file_path as url from parsed_documents where lower(file_path) like '/%.pdf'")
def pdf_links(spark, sf_dir):
    """Links to PDF files on a page made of each document's path."""
    d = read(spark, sf_dir, "parsed_documents").where("file_path like '/%'")
    html = F.concat(F.lit('<a href="#top">up</a> <a href="'), "file_path", F.lit('">file</a> <a href="'), "file_path", F.lit('">again</a> <a href="javascript:go()">x.pdf</a>'))
    return files.pdf_links(d.select("document_id", html.alias("html"), F.lit("https://docs.example/lib").alias("at")), "document_id", "html", "at")
