"""Boxes of the words that a cited section covers, found by its anchors, its title or its pages.

Every (section, page) is a row of its own: places are sought page by page and the
pages compared by keys, so that a section over a whole document is no single group.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .trees import fuzzy

#: Fixed value: signs that anchors are compared without.
PUNCTUATION = re.compile(r"[।॥:;,\.\(\)\[\]\-—–'\"`]")
#: Fixed value: how a numbered section begins.
MARKER = re.compile(r"^[०-९\d]+[\.:]")
BOX = ("x0", "y0", "x2", "y2")


def page_words(words: DataFrame) -> DataFrame:
    """(document_id, page, ws): the words of each page that aren't blank, by line, top and left edge, as structs of text and box.

    ``words`` has document_id, page and words, an array of structs with text, line and box.
    """
    fields = lambda w: F.struct(F.coalesce(w["line"], F.lit(0)).alias("line"), w["y0"].alias("y0"), w["x0"].alias("x0"), w["x2"].alias("x2"), w["y2"].alias("y2"), F.trim(w["text"]).alias("text"))
    own = F.array_sort(F.transform(F.filter("words", lambda w: F.coalesce(F.trim(w["text"]), F.lit("")) != ""), fields))
    return words.dropDuplicates(["document_id", "page"]).select("document_id", "page", own.alias("ws"))


def span(anchor: str | None, text: str, after: int = 0) -> tuple[int, int] | None:
    """Start and end of an anchor in a page's text from ``after`` on: as it is, with signs as blanks, then the likeness of its first 60 characters."""
    clean = " ".join(re.sub(r"<!--.*?-->", "", anchor or "").split())
    rest = text[after:]
    if not clean or not rest:
        return None
    if m := re.search(re.escape(clean), rest, re.I):
        return after + m.start(), after + m.end()
    plain, hay = (PUNCTUATION.sub(" ", t).lower() for t in (clean, rest))
    if (at := hay.find(plain)) >= 0:
        return after + at, after + at + len(plain)
    probe = plain[:60]
    at = fuzzy(probe, hay, 0.7)[0] if len(probe) >= 8 else -1
    return (after + at, after + at + len(probe)) if at >= 0 else None


def word_at(texts: list[str], place: int, back: bool) -> int:
    """The word that holds a place of the joined text; between two words the one before (``back``) or after."""
    at = 0
    for i, t in enumerate(texts):
        if place < at:
            return max(i - 1, 0) if back else i
        if place < at + len(t):
            return i
        at += len(t) + 1
    return len(texts) - 1


PLACE = StructType([StructField(c, IntegerType()) for c in ("start", "end", "first", "last")])


@F.pandas_udf(PLACE)
def anchor_place(anchors: pd.Series, texts: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Characters and words of an anchor among the words of a page; nulls if it isn't there."""
    out = []
    for a, ws, k in zip(anchors, texts, after):
        own = list(ws)
        found = span(a, " ".join(own), 0 if pd.isna(k) else int(k))
        out.append((*found, word_at(own, found[0], False), word_at(own, found[1] - 1, True)) if found else (None,) * 4)
    return pd.DataFrame(out, columns=["start", "end", "first", "last"]).astype("Int32")


@F.pandas_udf(IntegerType())
def marker_before(texts: pd.Series, after: pd.Series) -> pd.Series:
    """The last word before the next numbered section among the words from a place on; null if there is none, or it comes at once."""

    def one(ws: list[str], start: int) -> int | None:
        at, tail = 0, 0
        for i, t in enumerate(ws):
            if at >= start:
                if MARKER.match(t):
                    return i - 1 if tail else None
                tail += 1
            at += len(t) + 1
        return None

    return pd.Series([one(list(w), int(a)) for w, a in zip(texts, after)], dtype="Int32")


def anchored(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, node, page, ord, x0, y0, x2, y2, how): the words from a section's start text to its end.

    nodes: document_id, node, start_text, end_text, first_page, last_page; pages as
    of ``page_words``. The start is sought on the declared pages, then on one page
    either side. The end is the end text on the same page after the start (how:
    end_text) or on the first later page that has it (end_text:xpage), else before
    the next numbered section of the start's page (marker), else the last page
    (range_end). Sections without a start text, or whose isn't found, have no rows.
    """
    key = ["document_id", "node"]
    texts = F.transform("ws", lambda w: w["text"])
    last = F.coalesce("last_page", "first_page")
    asked = nodes.where("first_page is not null and trim(coalesce(start_text, '')) != ''").withColumn("page", F.explode(F.sequence(F.greatest(F.lit(1), F.col("first_page") - 1), last + 1)))
    near = asked.join(pages.where(F.size("ws") > 0), ["document_id", "page"]).withColumn("declared", F.col("page").between(F.col("first_page"), last))
    placed = near.withColumn("s", anchor_place("start_text", texts, F.lit(0))).where("s.start is not null")
    start = placed.groupBy(*key).agg(F.min_by(F.struct("page", "s"), F.struct(~F.col("declared"), F.col("page"))).alias("b")).select(*key, F.col("b.page").alias("s_page"), "b.s")
    later = near.join(start, key).where("page >= s_page").withColumn("same", F.col("page") == F.col("s_page"))
    ends = later.withColumn("e", anchor_place("end_text", texts, F.when(F.col("same"), F.col("s.end")).otherwise(0))).withColumn("m", F.when(F.col("same"), marker_before(texts, F.col("s.end"))))
    end = ends.groupBy(*key).agg(
        F.min_by(F.struct("page", F.col("e.last").alias("word"), "same"), F.when(F.col("e.start").isNotNull(), F.col("page"))).alias("text"),
        F.max(F.when(F.col("same"), F.struct("page", F.col("m").alias("word")))).alias("marker"),
        F.max("page").alias("range_end"),
    )
    by_text, by_marker = F.col("text.page").isNotNull(), F.col("marker.word").isNotNull()
    how = F.when(by_text & F.col("text.same"), "end_text").when(by_text, "end_text:xpage").when(by_marker, "marker").otherwise("range_end")
    chosen = end.select(*key, F.when(by_text, F.col("text.page")).when(by_marker, F.col("marker.page")).otherwise(F.col("range_end")).alias("e_page"), F.when(by_text, F.col("text.word")).when(by_marker, F.col("marker.word")).alias("e_word"), how.alias("how"))
    covered = near.join(start, key).join(chosen, key).where("page between s_page and e_page")
    words = covered.select(*key, "page", "how", F.posexplode("ws").alias("ord", "w"), "s_page", "s", "e_page", "e_word")
    inside = words.where(((F.col("page") > F.col("s_page")) | (F.col("ord") >= F.col("s.first"))) & ((F.col("page") < F.col("e_page")) | F.col("e_word").isNull() | (F.col("ord") <= F.col("e_word"))))
    return inside.select(*key, "page", "ord", *(F.col(f"w.{c}").alias(c) for c in BOX), "how")


@F.pandas_udf(DoubleType())
def title_top(titles: pd.Series, pages: pd.Series) -> pd.Series:
    """Top of the word where a title begins: one that holds one of its first four tokens, another of them within three words before or five after; null if none does."""

    def one(title: str | None, ws) -> float | None:
        tokens = re.sub(r"[:()]", " ", title or "").split()[:4]
        own = sorted(ws, key=lambda w: (w["y0"], w["x0"]))
        for t, token in enumerate(tokens):
            others = tokens[:t] + tokens[t + 1 :]
            for i, w in enumerate(own):
                if token in w["text"] and (not others or any(o in v["text"] for j, v in enumerate(own[max(0, i - 3) : i + 6], max(0, i - 3)) if j != i for o in others)):
                    return w["y0"]
        return None

    return pd.Series([one(t, p) for t, p in zip(titles, pages)], dtype=float)


def next_marker(ws: Column, top: Column) -> Column:
    """Top of the first numbered section more than 0.02 below ``top``, null if there is none."""
    return F.array_min(F.transform(F.filter(ws, lambda w: (w["y0"] > top + 0.02) & w["text"].rlike(MARKER.pattern)), lambda w: w["y0"]))


def titled(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, node, page, ord, x0, y0, x2, y2): the words under a section's title, down to the next numbered section, else on up to two more pages, there down to the next section's title.

    nodes: document_id, node, title, next_title, first_page, last_page.
    """
    key = ["document_id", "node"]
    first = nodes.where("trim(coalesce(title, '')) != '' and first_page is not null").withColumn("page", F.col("first_page")).join(pages, ["document_id", "page"])
    found = first.withColumn("top", title_top("title", "ws")).where("top is not null").withColumn("low", next_marker(F.col("ws"), F.col("top")))
    out = lambda df: df.select(*key, "page", F.posexplode("ws").alias("ord", "w"), "top", "low")
    here = out(found).where((F.col("w.y0") >= F.col("top") - 0.03) & (F.col("w.y0") < F.coalesce("low", F.lit(1.1))))
    last = F.least(F.coalesce("last_page", "first_page"), F.col("first_page") + 2)
    more = found.where(F.col("low").isNull() & (last > F.col("first_page"))).drop("page", "ws", "top", "low").withColumn("page", F.explode(F.sequence(F.col("first_page") + 1, last)))
    on = more.join(pages, ["document_id", "page"]).withColumn("top", F.lit(None).cast("double")).withColumn("low", title_top("next_title", "ws"))
    there = out(on).where(F.col("w.y0") < F.coalesce("low", F.lit(1.1)))
    return here.unionByName(there).select(*key, "page", "ord", *(F.col(f"w.{c}").alias(c) for c in BOX))


def best_candidates(candidates: list[DataFrame], sizes: DataFrame | None = None) -> DataFrame:
    """(document_id, node, page, x0, y0, x2, y2, source): of each node the boxes of the first list that has any, scaled by the page's width and height if ``sizes`` (document_id, page, width, height) has them."""
    cols = ["document_id", "node", "page", *BOX]
    all_ = None
    for n, c in enumerate(candidates, 1):
        own = c.select(*cols).withColumn("source", F.lit(n))
        all_ = own if all_ is None else all_.unionByName(own)
    first = all_.groupBy("document_id", "node").agg(F.min("source").alias("source"))
    kept = all_.join(first, ["document_id", "node", "source"])
    if sizes is None:
        return kept.select(*cols, "source")
    scaled = kept.join(sizes, ["document_id", "page"], "left")
    by = lambda c: F.col(c) * F.coalesce("width" if c[0] == "x" else "height", F.lit(1))
    return scaled.select("document_id", "node", "page", *(by(c).alias(c) for c in BOX), "source")
