"""Assembly of pages into texts and the places of words in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SEPARATOR = "\n\n---\n\n"


def page_markdown(page: Column, text: Column) -> Column:
    """A page under its heading, without line markers."""
    return F.concat(F.lit("## Page "), page.cast("string"), F.lit("\n"), F.trim(T.strip_markers(text)))


def page_spans(pages: DataFrame, text: str = "markdown") -> DataFrame:
    """start_char and end_char of each page in the text of its document: a running sum over the pages before it.

    The window is one document's pages (sizes only, no texts).
    """
    w = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(text)
    spans = pages.select("document_id", "page", size.cast("long").alias("_n"))
    start = F.coalesce(F.sum(F.col("_n") + len(SEPARATOR)).over(w), F.lit(0).cast("long"))
    return spans.select("document_id", "page", start.alias("start_char"), (start + F.col("_n")).alias("end_char"))


def assemble(pages: DataFrame, text: str = "markdown") -> DataFrame:
    """One text a document: its pages in order, between separators."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", text))), lambda p: p[text]), SEPARATOR)
    return pages.groupBy("document_id").agg(joined.alias("markdown"))


def parts(pages: DataFrame, kept: Callable[[Column], Column], text: str = "markdown", pages_a_part: int = 64) -> DataFrame:
    """(document_id, part, first_page, last_page, start_char, end_char, kept): every document in ordered parts of at most ``pages_a_part`` pages.

    The parts in order, between separators, are the document's text; ``kept`` says
    what is returned of each part's text. A group holds the texts of one part, so
    that a long document is spread; start_char is a running sum over the sizes of
    the document's parts, without their texts.
    """
    block = F.floor((F.col("page") - 1) / pages_a_part).alias("_block")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", text))), lambda p: p[text]), SEPARATOR)
    blocks = pages.groupBy("document_id", block).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), joined.alias("_text"))
    own = blocks.withColumns({"kept": kept(F.col("_text")), "_n": F.length("_text").cast("long")}).drop("_text")
    order = Window.partitionBy("document_id").orderBy("_block")
    start = F.coalesce(F.sum(F.col("_n") + len(SEPARATOR)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = own.select("*", (F.row_number().over(order) - 1).cast("long").alias("part"), start.alias("start_char"))
    return placed.select("document_id", "part", "first_page", "last_page", "start_char", (F.col("start_char") + F.col("_n")).alias("end_char"), "kept")


def page_starts(boxes: DataFrame) -> DataFrame:
    """(document_id, page, start_char, next_char): where the text of each boxed page begins and the next page's, as far as its words' offsets tell.

    Page 1 begins with the text, others with their first word; if that has no place,
    where the page before ends, else with the first word that has one. The window is
    one document's pages, without words.
    """
    w = Window.partitionBy("document_id").orderBy("page")
    at = F.transform("words", lambda x: x["char_offset"])
    ends = F.transform("words", lambda x: x["char_offset"] + F.length(x["text"]))
    slim = boxes.select("document_id", "page", F.get(at, F.lit(0)).alias("_first"), F.array_min(at).alias("_low"), F.array_max(ends).alias("_high"))
    before = F.when(F.lag("page").over(w) == F.col("page") - 1, F.lag("_high").over(w))
    placed = slim.withColumn("start_char", F.when(F.col("page") == 1, 0).otherwise(F.coalesce("_first", before, "_low")))
    after = F.when(F.lead("page").over(w) == F.col("page") + 1, F.lead("start_char").over(w))
    return placed.select("document_id", "page", "start_char", after.alias("next_char"))


def page_slices(pages: DataFrame) -> DataFrame:
    """``pages`` (document_id, page, content, start_char, next_char, ...) with the page's own text as markdown and its place as start_char.

    A page mark in the content counts first, then the given places, else the page has the whole content.
    """
    mark = F.concat(F.lit(r"(?m)^##\s*Page\s+"), F.col("page").cast("string"), F.lit(r"\s*$"))
    at = F.nullif(F.regexp_instr("content", mark), F.lit(0))
    head = at - 1 + F.length(F.regexp_substr("content", mark))
    rest = F.nullif(F.regexp_instr(F.expr("substring(content, _head + 1)"), F.lit(r"(?m)^##\s*Page\s+\d+\s*$")), F.lit(0))
    marked = pages.withColumn("_head", head.cast("long")).withColumn("_tail", F.col("_head") + rest - 1)
    size = F.length("content").cast("long")
    start = F.coalesce("_head", "start_char", F.lit(0)).cast("long")
    end = F.when(F.col("_head").isNotNull(), F.coalesce("_tail", size)).when(F.col("next_char") > F.coalesce("start_char", F.lit(0)), F.col("next_char")).otherwise(size)
    cut = marked.withColumn("start_char", start).withColumn("markdown", F.substring(F.col("content"), (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int")))
    return cut.drop("_head", "_tail", "next_char", "content")


def word_offsets(pages: DataFrame) -> DataFrame:
    """(document_id, page, word_ord, text, char_offset) from (document_id, page, markdown, words).

    Each word is sought from the end of the one before, first as it is, then
    without case; one that isn't found stands where the search is. A fold over the
    words of a page. With start_char the offsets count from there.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        exact = F.call_function("locate", w, F.col("markdown"), acc["at"] + 1)
        loose = F.call_function("locate", F.lower(w), F.lower("markdown"), acc["at"] + 1)
        place = F.when((w == "") | w.isNull(), acc["at"]).when(exact > 0, exact - 1).when(loose > 0, loose - 1).otherwise(acc["at"])
        found = (exact > 0) | (loose > 0)
        after = F.when(found & (w != ""), place + F.length(w)).otherwise(acc["at"])
        return F.struct(after.alias("at"), F.concat(acc["out"], F.array(place)).alias("out"))

    first = F.col("start_char") if "start_char" in pages.columns else F.lit(0)
    folded = pages.withColumn("_o", F.transform(F.aggregate("words", start, step, lambda a: a["out"]), lambda o: (o + first).cast("int")))
    return folded.select("document_id", "page", F.posexplode(F.arrays_zip(F.col("words").alias("text"), F.col("_o").alias("char_offset"))).alias("word_ord", "_w")).select(
        "document_id", "page", "word_ord", "_w.text", "_w.char_offset"
    )


def page_boxes(words: DataFrame) -> DataFrame:
    """First and last offset and the union of the boxes of the words of each page."""
    return words.groupBy("document_id", "page").agg(
        F.min("char_offset").alias("start_char"),
        F.max(F.col("char_offset") + F.length("text")).alias("end_char"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x2").alias("x2"),
        F.max("y2").alias("y2"),
    )
