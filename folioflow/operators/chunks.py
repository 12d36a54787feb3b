"""Cutting of texts into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What begins a chapter or a section.
CHAPTER = r"(?=\nChapter\s+\d+)|(?=\nPART\s+\d+)"
SECTION = r"(?=\nSection\s+\d+)|(?=\nArt\. \d+)"
HEADING = r"(?=\n#{1,3}\s+)"


def windows(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, chunk_index, start_char, chunk): fixed windows with an overlap; the last one ends with the text."""
    step = size - overlap
    n = F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int") * step, F.lit(step)))
    cut = docs.where(n > 0).select(key, text, F.posexplode(starts).alias("chunk_index", "start_char"))
    return cut.select(key, "chunk_index", "start_char", F.substring(F.col(text), F.col("start_char") + 1, F.lit(size)).alias("chunk"))


def sections(text: Column, white: str = r"\s") -> Column:
    """Pieces of a text before chapters, sections and headings; blank ones are dropped."""
    pieces = F.array(F.concat(F.lit("\n"), text))
    chapter, section, heading = (x.replace(r"\s", white) for x in (CHAPTER, SECTION, HEADING))
    for cut in (lambda p: F.split(p, chapter), lambda p: F.split(p, section), lambda p: F.split(p, heading)):
        pieces = F.flatten(F.transform(pieces, cut))
    return F.filter(F.transform(pieces, lambda p: F.trim(F.regexp_replace(p, rf"^{white}+|{white}+$", ""))), lambda p: p != "")


#: What begins a chapter, in this order, and then what begins a section.
CHAPTERS = (r"(?:Chapter|Ch\.?)\s+\d+", r"(?:Part|Pt\.?)\s+\d+", r"(?:Article|Art\.?)\s+\d+", r"(?:Schedule|Sch\.?)\s+\d+", r"परिच्छेद\s+\d+", r"भाग\s+\d+", r"अध्याय\s+\d+")
SECTIONS = (
    r"(?:Section|Sec\.?|§)\s+\d+[A-Z]?", r"(?:Sub-section|Subsection|Sub-sec\.?)\s+\d+", r"(?:Clause|Cl\.?)\s+\([a-z0-9]+\)", r"(?:Sub-clause|Subclause)\s+\([a-z0-9]+\)",
    r"(?:दफा|उपदफा)\s+\d+", r"अनुच्छेद\s+\d+", r"खण्ड\s+\([क-ह0-9]+\)",
)


def marks(white: str) -> list[str]:
    """All beginnings of lines that divide a legal text, with a class of white space and digits of any script."""
    return ["\n" + x.replace(r"\s", f"[{white}]").replace(r"\d", r"\p{Nd}") for x in (*CHAPTERS, *SECTIONS, r"#{1,3}\s+")]


def legal_sections(text: Column) -> Column:
    """Pieces of a text before each chapter, section, clause and heading of level 1 to 3 that begins a line; blank pieces are dropped, others trimmed."""
    cut = lambda mark: lambda p: F.split(p, f"(?={mark})")
    pieces = F.array(text)
    for mark in marks(T.WHITE):
        pieces = F.flatten(F.transform(pieces, cut(mark)))
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, rf"^[{T.WHITE}]+|[{T.WHITE}]+\z", "")), lambda p: p != "")


def sentence_windows(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, chunk_index, start_char, end_char): windows of at most ``size`` characters that end after the last end mark before a blank in their last 200 characters, if there is one.

    The next window begins ``overlap`` before the end of one; the last ends with the text.
    """
    import re

    mark = re.compile(r"[.!?](?=[ \n])")

    def cut(t: str) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(t):
            end = min(at + size, len(t))
            if end < len(t):
                low = max(at, end - min(200, end - at)) + 1
                last = None
                for m in mark.finditer(t, low, min(end + 2, len(t))):
                    last = m.end() if m.start() <= end else last
                end = last or end
            yield at, end
            if end == len(t):
                return
            at = end - overlap if end - overlap > at else end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, i, a, e) for k, t in zip(b[key], b[text]) for i, (a, e) in enumerate(cut(t or ""))], columns=[key, "chunk_index", "start_char", "end_char"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_index int, start_char bigint, end_char bigint")


def fit_sizes(docs: DataFrame, key: str, chunks: str, least: int = 100, most: int = 2000, keep_oversized: bool = False) -> DataFrame:
    """(key, chunk_index, chunk): short chunks joined with the next, long ones divided at paragraphs and sentences.

    ``chunks`` is an array of the document's chunks. With ``keep_oversized`` a
    divided chunk also stays as a whole.
    """
    import re

    def divide(chunk: str) -> list[str]:
        parts = [p for p in chunk.split("\n\n") if p]
        if len(parts) == 1:
            parts = [p for p in re.split(r"(?<=[.!?])\s+", chunk) if p]
        out: list[str] = []
        for p in parts:
            if out and len(out[-1]) + len(p) + 2 <= most:
                out[-1] += "\n\n" + p
            else:
                out.append(p)
        return out

    def fold(own: list[str]) -> list[str]:
        out: list[str] = []
        i = 0
        while i < len(own):
            c = own[i]
            while len(c) < least and i + 1 < len(own) and len(c) + len(own[i + 1]) + 2 <= most:
                i += 1
                c = c + "\n\n" + own[i]
            if len(c) > most:
                out += divide(c) + ([c] if keep_oversized else [])
            else:
                out.append(c)
            i += 1
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, i, c) for k, own in zip(b[key], b[chunks]) for i, c in enumerate(fold(list(own if own is not None else [])))], columns=[key, "chunk_index", "chunk"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, chunks).mapInPandas(run, f"{key} {kind}, chunk_index int, chunk string")


#: How a definition begins.
DEFINITIONS = (r'"[^"]+"\s+means\s+', r'"[^"]+"\s+shall\s+mean\s+', r'means\s+"[^"]+"', r'shall\s+mean\s+"[^"]+"')


def merge_definitions(docs: DataFrame, key: str, chunks: str, most: int = 2000) -> DataFrame:
    """(key, chunk_index, chunk): a chunk with an unfinished definition takes the following ones, with a blank between, until it is finished or ``most`` characters long.

    A definition is finished by a stop or semicolon before a line's end, a new
    section or, once chunks are joined, a clause. If the text ends before the
    definition does, the chunks stay as they were.
    """
    import re

    begins = re.compile("|".join(DEFINITIONS), re.I)
    ends = re.compile(r"[;.]\s*(?:\n|$)|[;.]\s*(?:Section|Chapter|Part|Article)", re.I)
    clause = re.compile(r"[;.]\s*(?:\([a-z]\)|\([0-9]\))", re.I)

    def fold(own: list[str]) -> list[str]:
        out, i = [], 0
        while i < len(own):
            c, j = own[i], i + 1
            if begins.search(c) and not ends.search(c):
                done = False
                while j < len(own) and len(c) < most and not done:
                    c, j = c + " " + own[j], j + 1
                    done = bool(ends.search(c) or clause.search(c))
                if not done and j == len(own) and len(c) < most or j == i + 1:
                    c, j = own[i], i + 1
            out.append(c)
            i = j
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, i, c) for k, own in zip(b[key], b[chunks]) for i, c in enumerate(fold(list(own if own is not None else [])))], columns=[key, "chunk_index", "chunk"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, chunks).mapInPandas(run, f"{key} {kind}, chunk_index int, chunk string")
