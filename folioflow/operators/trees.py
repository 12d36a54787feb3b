"""Section trees as flat tables of nodes, their places in texts and on pages."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import bm25


def depth_first(nodes: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """id: number of each node in depth-first order, from 0; ``path`` is the array of sibling numbers from the root."""
    return nodes.withColumn("id", (F.row_number().over(Window.partitionBy(*by).orderBy(path)) - 1).cast("long"))


def depth_first_within(nodes: DataFrame, prefix: int, path: str = "path") -> DataFrame:
    """id of each node of one large tree in depth-first order, from 0.

    Nodes are numbered among those that share the first ``prefix`` numbers of their
    path, and then over the counts of these groups, so that no task sorts the tree.
    """
    own = nodes.withColumn("_top", F.slice(path, 1, prefix))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = own.groupBy("_top").count().withColumn("_before", before).drop("count")
    at = F.row_number().over(Window.partitionBy("_top").orderBy(path)) - 1
    return own.withColumn("id", at).join(counts, "_top").withColumn("id", (F.col("id") + F.col("_before")).cast("long")).drop("_top", "_before")


def heading_stack(lines: DataFrame) -> DataFrame:
    """(document_id, line_no, level, title, parent_line): nodes from Markdown headings, each under the last heading of a higher level.

    ``lines`` has document_id, line_no and text. One window over the headings of a
    document finds the last heading of each level.
    """
    h = lines.where(F.col("text").rlike(r"^#{1,6}\s+\S")).select(
        "document_id",
        "line_no",
        F.length(F.regexp_extract("text", r"^(#{1,6})", 1)).alias("level"),
        F.trim(F.regexp_replace("text", r"^#{1,6}\s+", "")).alias("title"),
    )
    w = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.last(F.when(F.col("level") == n, F.col("line_no")), ignorenulls=True).over(w) for n in range(1, 6)]
    marked = h.select("*", *(a.alias(f"l{n}") for n, a in enumerate(above, 1)))
    parent = F.greatest(*(F.when(F.col("level") > n, F.col(f"l{n}")) for n in range(1, 6)))
    return marked.select("document_id", "line_no", "level", "title", parent.alias("parent_line"))


def next_start(nodes: DataFrame, by: list[str], start: str, title: str, length: Column) -> DataFrame:
    """end_char: the first distinct start after the node's title, else the length of the text; -1 for a node without a start (below 0).

    Starts are sorted per document; the next one after start + title is found by a
    window over starts and asked places together, so no pairs are made.
    """
    asked = F.col(start) + F.length(title)
    places = nodes.where(F.col(start) >= 0).select(*by, F.col(start).alias("_at"), F.lit(1).alias("_is_start")).distinct()
    asks = nodes.withColumn("_at", asked).withColumn("_is_start", F.lit(0))
    both = asks.unionByName(places, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col("_at").desc(), F.col("_is_start").asc()).rowsBetween(Window.unboundedPreceding, -1)
    # Going down from the end, the last start seen strictly above a place is the next one after it.
    ahead = F.last(F.when(F.col("_is_start") == 1, F.col("_at")), ignorenulls=True).over(w)
    return both.withColumn("_next", ahead).where("_is_start = 0").withColumn("end_char", F.when(F.col(start) < 0, -1).otherwise(F.coalesce("_next", length))).drop("_at", "_is_start", "_next")


#: Characters of a bucket in which ranges of nodes and pages meet.
BUCKET = 4000


def page_boxes(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes of the nodes on the pages that their text range overlaps: the page's box cut in proportion to the characters.

    nodes: document_id, node, start_char, end_char and, if known, first_page and
    last_page, to which the pages are limited; pages: document_id, page, start_char,
    end_char, x0, y0, x2, y2. A node without a range (a place below 0) has the whole
    boxes of its first page and the next one, as far as its pages go. Ranges meet in
    buckets of characters, so that a long document is no single group.
    """
    if "first_page" not in nodes.columns:
        nodes = nodes.withColumn("first_page", F.lit(None).cast("int")).withColumn("last_page", F.lit(None).cast("int"))
    near = lambda a, b: F.explode(F.sequence(F.floor(a / BUCKET), F.floor(F.greatest(a, b) / BUCKET)))
    n = nodes.where("start_char >= 0 and end_char >= 0").withColumn("bucket", near(F.col("start_char"), F.col("end_char")))
    p = pages.select("document_id", "page", F.col("start_char").alias("ps"), F.col("end_char").alias("pe"), "x0", "y0", "x2", "y2").withColumn("bucket", near(F.col("ps"), F.col("pe")))
    first = F.floor(F.greatest(F.col("start_char"), F.col("ps")) / BUCKET)
    inside = F.col("first_page").isNull() | F.col("page").between(F.col("first_page"), F.coalesce("last_page", "first_page"))
    j = n.join(p, ["document_id", "bucket"]).where((F.col("pe") > F.col("start_char")) & (F.col("ps") < F.col("end_char")) & (F.col("bucket") == first) & inside)
    size, high = F.col("pe") - F.col("ps"), F.col("y2") - F.col("y0")
    share = lambda at, empty: F.when(size > 0, (at - F.col("ps")) / size).otherwise(empty)
    top = F.col("y0") + high * share(F.greatest(F.col("start_char"), F.col("ps")), 0.0)
    low = F.col("y0") + high * share(F.least(F.col("end_char"), F.col("pe")), 1.0)
    exact = j.select("document_id", "node", "page", "x0", F.round(top, 6).alias("y0"), "x2", F.round(low, 6).alias("y2"))
    last = F.least(F.coalesce("last_page", "first_page"), F.col("first_page") + 1)
    loose = nodes.where("(start_char < 0 or end_char < 0) and first_page is not null").where(last >= F.col("first_page")).select("document_id", "node", F.explode(F.sequence("first_page", last)).alias("page"))
    return exact.unionByName(loose.join(pages, ["document_id", "page"]).select("document_id", "node", "page", "x0", F.round("y0", 6).alias("y0"), "x2", F.round("y2", 6).alias("y2")))


def slice_text(text: Column, start: Column, end: Column, summary: Column) -> tuple[Column, Column]:
    """(text of the node, whether it is exact): the range if it is valid, else the summary."""
    ok = (start >= 0) & (end > start) & text.isNotNull()
    return F.when(ok, F.substring(text, start.cast("int") + 1, (end - start).cast("int"))).otherwise(summary), F.coalesce(ok, F.lit(False))


#: Fixed value: punctuation without which anchors are compared.
SIGNS = "ः।॥(){}[].,:;\"'`"
#: Fixed value: a number at the start of an anchor and up to four words after it.
NUMBERED = re.compile(r"^\s*((?:[०-९]+|\d+)(?:\.[०-९\d]+)*\.?)\s+(\S+(?:\s+\S+){0,3})")


def fuzzy(needle: str, text: str, threshold: float = 0.6) -> tuple[int, float]:
    """First place and ratio of the window most like the needle, without case; -1 below the threshold or for needles under three letters.

    Ratcliff-Obershelp ratio over windows a tenth of the needle apart, then over all
    places around the best. How often each letter occurs in a window bounds its
    ratio, so windows are tried from the highest bound down and few are compared.
    """
    if len(needle) < 3 or not text:
        return -1, 0.0
    n, t = needle.lower(), text.lower()
    size, step = len(n), max(1, len(n) // 10)
    m = SequenceMatcher(None, autojunk=False)
    codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    m.set_seq2(n)

    def best(starts: np.ndarray, least: float) -> tuple[int, float]:
        ends = np.minimum(starts + size, len(t))
        common = np.zeros(len(starts), np.int64)
        for c, k in Counter(n).items():
            upto = np.concatenate([[0], np.cumsum(codes == ord(c))])
            common += np.minimum(upto[ends] - upto[starts], k)
        bound = 2.0 * common / (size + ends - starts)
        at, top = -1, least
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < top or bound[i] == top and at < 0:
                break
            m.set_seq1(t[starts[i] : ends[i]])
            r = m.ratio()
            if r > top or r == top and at >= 0 and starts[i] < at:
                at, top = int(starts[i]), r
        return at, top

    at, top = best(np.arange(0, max(1, len(t) - size // 2), step), 0.0)
    if at >= 0 and top >= 0.9 * threshold:
        finer = best(np.arange(max(0, at - step), max(min(len(t) - size // 2, at + step + 1), max(0, at - step))), top)
        at, top = finer if finer[0] >= 0 else (at, top)
    return (at, top) if at >= 0 and top >= threshold else (-1, top)


def bare(text: str) -> tuple[str, list[int]]:
    """Text without punctuation and with single blanks, and the place of each of its characters in ``text``."""
    out, places = [], []
    for i, c in enumerate(text):
        if c in SIGNS:
            continue
        if c.isspace():
            if not out or out[-1] == " ":
                continue
            c = " "
        out.append(c)
        places.append(i)
    if out and out[-1] == " ":
        out.pop()
        places.pop()
    return "".join(out), places


def _seek(needle: str, text: str, stripped: tuple[str, list[int]]) -> int:
    """Place of the needle without case, then without punctuation; -1 if there is none."""
    if not needle:
        return -1
    if m := re.search(re.escape(needle), text, re.I):
        return m.start()
    plain = bare(needle)[0]
    m = re.search(re.escape(plain), stripped[0], re.I) if plain else None
    return stripped[1][m.start()] if m else -1


def anchor(start_text: str | None, title: str | None, text: str | None) -> tuple[int, str]:
    """Place of a node in a text and how it was found: its start text as it is, without punctuation, by its number and next words, by likeness; then its title; (-1, "none")."""
    if not text:
        return -1, "none"
    stripped = bare(text)
    clean, name = " ".join((start_text or "").split()), (title or "").strip()
    if clean:
        if (at := _seek(clean, text, stripped)) >= 0:
            return at, "start_text"
        m = NUMBERED.match(clean)
        if m and (at := _seek(f"{m[1]} {m[2]}", text, stripped)) >= 0:
            return at, "number"
        if (at := fuzzy(clean, text)[0]) >= 0:
            return at, "start_text_like"
    if name:
        if m := re.search(re.escape(name), text, re.I):
            return m.start(), "title"
        if (at := fuzzy(name, text)[0]) >= 0:
            return at, "title_like"
    return -1, "none"


def anchor_places(nodes: DataFrame, text: str, title: str, start_text: str) -> DataFrame:
    """``nodes`` with start_char in ``text`` and the leg that found it (see ``anchor``); -1 and "none" if nothing fits.

    Anchors that stand in the text as they are, are found by Spark; only the rest
    goes through the cascade. ``text`` may be the part of the document that the
    node's pages give (``layout.search_regions``).
    """
    usable = F.regexp_replace(F.trim(F.coalesce(F.col(start_text), F.lit(""))), r"\s+", " ")
    exact = F.nullif(F.call_function("locate", usable, F.col(text)), F.lit(0))
    known = nodes.withColumn("start_char", F.when(usable != "", exact - 1).cast("long"))
    # Without case an earlier place may fit: only texts that have the anchor once without case are settled.
    low = F.call_function("locate", F.lower(usable), F.lower(F.col(text))) - 1
    settled = F.col("start_char").isNotNull() & (low == F.col("start_char"))
    found = known.where(settled).withColumn("leg", F.lit("start_text"))
    rest = known.where(~F.coalesce(settled, F.lit(False))).drop("start_char")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [anchor(*x) for x in zip(b[start_text], b[title], b[text])]
            yield b.assign(start_char=[g[0] for g in got], leg=[g[1] for g in got])

    schema = StructType([*rest.schema.fields, StructField("start_char", LongType()), StructField("leg", StringType())])
    return found.unionByName(rest.mapInPandas(run, schema))


def end_places(nodes: DataFrame, text: str, start: str, end_text: str, end: str = "end_char") -> DataFrame:
    """``nodes`` with ``end`` moved to the end of their end text where it is found after their start: as it is, without punctuation, by likeness."""

    def place(at: int | None, wanted: str | None, content: str | None, now: int | None) -> int | None:
        clean = " ".join((wanted or "").split())
        if not clean or not content or at is None or at < 0:
            return now
        rest = content[int(at) :]
        found = _seek(clean, rest, bare(rest))
        if found < 0:
            found = fuzzy(clean, rest)[0]
        return int(at) + found + len(clean) if found >= 0 else now

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{end: pd.array([place(None if pd.isna(a) else int(a), w, c, None if pd.isna(e) else int(e)) for a, w, c, e in zip(b[start], b[end_text], b[text], b[end])], dtype="Int64")})

    schema = StructType([StructField(f.name, LongType()) if f.name == end else f for f in nodes.schema.fields])
    return nodes.mapInPandas(run, schema)


def flatten(trees: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, id, node_id, parent_id, depth, title): the nodes of nested JSON trees, numbered depth first from 0.

    A tree is {"nodes": [{"nodeId", "title", "children": [...]}]}; what can't be read has no nodes.
    """
    out = "id bigint, node_id string, parent_id string, depth int, title string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[tree]):
                try:
                    top = json.loads(t or "{}")
                except ValueError:
                    continue
                stack = [(n, None, 0) for n in reversed(top.get("nodes") or [])] if isinstance(top, dict) else []
                n = 0
                while stack:
                    node, parent, depth = stack.pop()
                    rows.append((k, n, node.get("nodeId"), parent, depth, node.get("title")))
                    n += 1
                    stack += [(c, node.get("nodeId"), depth + 1) for c in reversed(node.get("children") or [])]
            yield pd.DataFrame(rows, columns=[key, "id", "node_id", "parent_id", "depth", "title"])

    kind = trees.schema[key].dataType.simpleString()
    return trees.select(key, tree).mapInPandas(run, f"{key} {kind}, {out}")


def navigate(nodes: DataFrame, queries: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(qid, key, score, rank): the ``k`` nodes that a question (qid, query) leads to, by BM25 over their titles and summaries.

    Stands in for a model that reads the tree: every node is a document of its own.
    Nodes: ``key``, title, summary; a node without words in common with the question isn't found.
    """
    text = nodes.select(key, F.concat_ws(" ", "title", "summary").alias("text"))
    return bm25.search(text, queries, key, "text", k)
