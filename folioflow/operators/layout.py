"""Small folds over one line, page or answer that need the order of their parts."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType


def wordify(fragments: DataFrame, by: list[str], order: str = "index_sort") -> DataFrame:
    """Words from fragments: joined until a space type of 1 or more, or a colon on either side.

    The box is the union, the confidence the mean weighted by length.
    """
    w = Window.partitionBy(*by).orderBy(order)
    nxt = F.lead("text").over(w)
    ends = (F.coalesce("space_type", F.lit(0)) >= 1) | (F.col("text") == ":") | F.coalesce(nxt == ":", F.lit(False))
    flagged = fragments.withColumn("_e", ends.cast("int"))
    numbered = flagged.withColumn("word", F.coalesce(F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    size = F.length("text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "")
    return numbered.groupBy(*by, "word").agg(
        text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.when(F.sum(size) > 0, F.sum(F.col("confidence") * size) / F.sum(size)).alias("confidence"), F.count("*").alias("fragments"),
    )


def rendered_lines(words: DataFrame, by: list[str], scale: float = 0.15, width: int = 1000) -> DataFrame:
    """(by..., line, rendered): each word at its place in a line of characters, under a line marker.

    A word of the same block follows the word before it after a blank; one of
    another block starts where its left edge falls and covers what stands there.
    """

    @F.pandas_udf(StringType())
    def render(lines: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for own, n in zip(lines, numbers):
            row, last, at = [" "] * width, None, 0
            for w in own:
                t = w["text"]
                at = at + 1 if last is not None and w["block"] == last else round(w["x0"] * scale)
                if at + len(t) > len(row):
                    row += [" "] * (at + len(t) - len(row))
                row[at : at + len(t)] = t
                at, last = at + len(t), w["block"]
            out.append(f"->{n}<- ".rjust(10) + "".join(row).rstrip())
        return pd.Series(out)

    lists = words.groupBy(*by, "line").agg(F.sort_array(F.collect_list(F.struct("x0", "index_sort", "text", "block"))).alias("ws"))
    return lists.select(*by, "line", render("ws", "line").alias("rendered"))


@F.pandas_udf(ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))
def tree_parts(texts: pd.Series) -> pd.Series:
    """Parts of long texts: each ends at the first heading of level 1 or 2 at or after the limit; without headings at the limit."""
    import re

    limit = 350_000
    head = re.compile(r"^#{1,2}\s", re.M)

    def one(t: str | None) -> list[dict]:
        if not t:
            return []
        if len(t) <= limit:
            return [{"start": 0, "end": len(t)}]
        cuts, at = [m.start() for m in head.finditer(t)], 0
        out = []
        while at < len(t):
            end = next((c for c in cuts if c >= at + limit), len(t)) if cuts else min(len(t), at + limit)
            out.append({"start": at, "end": end})
            at = end
        return out

    return texts.map(one)


@F.pandas_udf(StringType())
def outer_json(texts: pd.Series) -> pd.Series:
    """The JSON object in a model's reply: without a code fence, else the outermost balanced braces; null if neither can be read."""

    def one(t: str | None) -> str | None:
        if not t:
            return None
        bare = t.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
        start = bare.find("{")
        depth, quoted, skip = 0, False, False
        candidates = [bare]
        for i, c in enumerate(bare[start:] if start >= 0 else ""):
            if skip:
                skip = False
            elif c == "\\" and quoted:
                skip = True
            elif c == '"':
                quoted = not quoted
            elif not quoted and c == "{":
                depth += 1
            elif not quoted and c == "}":
                depth -= 1
                if depth == 0:
                    candidates.append(bare[start : start + i + 1])
                    break
        for x in candidates:
            try:
                return json.dumps(json.loads(x), ensure_ascii=False)
            except ValueError:
                continue
        return None

    return texts.map(one)


class _Cells(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag == "td":
            self.inside = True
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")

    def handle_endtag(self, tag):
        if tag == "td":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.rows[-1][-1] += data


@F.pandas_udf(StringType())
def html_tables(texts: pd.Series) -> pd.Series:
    """HTML tables as Markdown: the first row is the heading, bars are escaped; without cells the bare text in a code fence."""
    import re

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        p = _Cells()
        p.feed(t)
        rows = [[" ".join(c.split()).replace("|", "\\|") for c in r] for r in p.rows if r]
        if not rows:
            return "```\n" + re.sub(r"<[^>]+>", " ", t).strip() + "\n```"
        n = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (n - len(r))) + " |" for r in rows]
        return "\n".join([lines[0], "|" + " --- |" * n, *lines[1:]])

    return texts.map(one)


def follow_ups(reply: Column, most: int = 3) -> Column:
    """At most ``most`` strings of a JSON list; an empty array if it can't be read."""
    return F.slice(F.coalesce(F.from_json(reply, "array<string>"), F.array().cast("array<string>")), 1, most)


def word_spans(words: DataFrame, by: list[str]) -> DataFrame:
    """start and end of each word in the text of its page, words in the order of line, top and left edge, a blank between."""
    w = Window.partitionBy(*by).orderBy("line", "y0", "x0", "index_sort")
    before = F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return words.withColumn("start", before).withColumn("end", before + F.length("text"))


def search_regions(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, node, region_start, region_end): the characters of a node's pages and one page either side.

    nodes: document_id, node, first_page, last_page; pages: document_id, page,
    start_char, end_char. Nodes whose pages aren't known get nulls.
    """
    # A row for each page that a node looks at: joined by document and page, so that a long document is no single group.
    asked = nodes.where("first_page is not null and last_page >= first_page").select("document_id", "node", F.explode(F.sequence(F.col("first_page") - 1, F.col("last_page") + 1)).alias("page"))
    found = asked.join(pages.select("document_id", "page", "start_char", "end_char"), ["document_id", "page"]).groupBy("document_id", "node").agg(F.min("start_char").alias("region_start"), F.max("end_char").alias("region_end"))
    return nodes.select("document_id", "node").join(found, ["document_id", "node"], "left")


def sentence_chunks(docs: DataFrame, key: str, text: str, size: int = 200, overlap: int = 40) -> DataFrame:
    """(key, chunk_index, n_words, chunk): whole sentences up to ``size`` words, the last ones up to ``overlap`` words repeated."""
    import re

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            own = [s for s in re.split(r"(?<=[.!?।。])\s+", t or "") if s.strip()]
            sizes = [len(s.split()) for s in own]
            out, i = [], 0
            while i < len(own):
                j, n = i, 0
                while j < len(own) and (j == i or n + sizes[j] <= size):
                    n += sizes[j]
                    j += 1
                out.append(" ".join(own[i:j]))
                if j == len(own):
                    break
                k, back = j, 0
                while k - 1 > i and back + sizes[k - 1] <= overlap:
                    k -= 1
                    back += sizes[k]
                i = k
            return out

        return texts.map(one)

    own = docs.select(key, F.posexplode(cut(F.col(text))).alias("chunk_index", "chunk"))
    return own.select(key, "chunk_index", F.size(F.split(F.trim("chunk"), r"\s+")).alias("n_words"), "chunk")
