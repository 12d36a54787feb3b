"""Sources and sinks besides parquet: folders of files, OCR responses, uploads, stored files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of files by suffix.
IMAGES = ("png", "jpg", "jpeg", "gif", "tiff", "tif", "bmp", "webp")
#: Largest upload in bytes.
MOST_BYTES = 50 * 1024 * 1024


def file_kind(path: Column) -> Column:
    """pdf, image or null by the suffix, whatever its case."""
    s = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(s == "pdf", "pdf").when(s.isin(*IMAGES), "image")


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.pdf", years: tuple[int, int] | None = None) -> DataFrame:
    """(path, title, year, size, modified) of the files below a folder; contents aren't read.

    With ``years`` only files whose name has a year within them.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    stem = F.translate(F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1), "_", " ")
    year = F.nullif(F.regexp_extract(F.translate(stem, "०१२३४५६७८९", "0123456789"), r"(20\d{2})", 1), F.lit("")).cast("int")
    out = f.select("path", stem.alias("title"), year.alias("year"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.where(F.col("year").between(*years)) if years else out


def check_files(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """``files`` with problem: null, or why a file can't be taken."""
    problem = F.when(F.col("size") <= 0, "empty").when(F.col("size") > most, "too large").when(file_kind(F.col("path")).isNull(), "unsupported")
    return files.withColumn("problem", problem)


def dynamic_dpi(width: Column, dpi: Column) -> Column:
    """Resolution for a page of this width: wide pages are read at a lower one."""
    return F.when(width > 1000, F.floor(dpi / (width / 1000)).cast("int")).otherwise(dpi)


WORD_SCHEMA = "array<struct<text:string,x0:double,y0:double,x2:double,y2:double,confidence:double,block:int,line:int>>"


def words_of_responses(responses: DataFrame) -> DataFrame:
    """Words of OCR responses (document_id, page, response as JSON with a list "words"): one row a word in the order given.

    A response that can't be read gives no words.
    """
    parsed = responses.withColumn("_w", F.from_json("response", f"words {WORD_SCHEMA}")["words"])
    return parsed.select("document_id", "page", F.posexplode("_w").alias("index_sort", "w")).select("document_id", "page", "index_sort", "w.*")


def block_graph_words(blocks: DataFrame) -> DataFrame:
    """Words of a graph of blocks: pages point to lines, lines to words by lists of ids.

    blocks: document_id, id, kind (PAGE, LINE, WORD), text, children. The order of
    the lists is kept; ids that lead nowhere are dropped.
    """
    pages = blocks.where("kind = 'PAGE'").select("document_id", F.col("id").alias("page_id"), F.posexplode("children").alias("line", "line_id"))
    lines = blocks.where("kind = 'LINE'").select("document_id", F.col("id").alias("line_id"), F.posexplode("children").alias("word", "word_id"))
    words = blocks.where("kind = 'WORD'").select("document_id", F.col("id").alias("word_id"), "text")
    return pages.join(lines, ["document_id", "line_id"]).join(words, ["document_id", "word_id"]).select("document_id", "page_id", "line", "word", "text")


def split_file(files: DataFrame, size: int = 255 * 1024) -> DataFrame:
    """(file_id, n, data): contents in pieces of ``size`` bytes."""
    n = F.ceil(F.length("content") / size).cast("int")
    return files.where(F.length("content") > 0).select("file_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("n"), "content").select("file_id", "n", F.substring("content", F.col("n") * size + 1, F.lit(size)).alias("data"))


def join_file(pieces: DataFrame) -> DataFrame:
    """(file_id, content): pieces joined in the order of n."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "data"))), lambda x: F.hex(x["data"]))
    return pieces.groupBy("file_id").agg(F.unhex(F.array_join(ordered, "")).alias("content"))


def uploads(rows: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(good, bad) uploads of parsed documents: JSON with parsed.markdown that isn't blank."""
    schema = "parsed struct<markdown:string,language:string>, raw struct<page_count:int>"
    read = rows.withColumn("_u", F.from_json(column, schema))
    ok = F.coalesce(F.trim(F.col("_u.parsed.markdown")) != "", F.lit(False))
    good = read.where(ok).select(*rows.columns, F.col("_u.parsed.markdown").alias("markdown"), F.col("_u.parsed.language").alias("language"), F.col("_u.raw.page_count").alias("page_count"))
    return good, read.where(~ok).drop("_u")


def tree_problems(nodes: DataFrame) -> DataFrame:
    """Nodes of an uploaded tree with problem, null for good ones: ids and titles, page ranges of two pages from 1 on."""
    r = F.col("page_range")
    problem = (
        F.when(F.coalesce(F.trim("nodeId"), F.lit("")) == "", "no id")
        .when(F.coalesce(F.trim("title"), F.lit("")) == "", "no title")
        .when(r.isNotNull() & (F.size(r) != 2), "page range")
        .when(r.isNotNull() & ((F.try_element_at(r, F.lit(1)) < 1) | (F.try_element_at(r, F.lit(2)) < F.try_element_at(r, F.lit(1)))), "page range")
    )
    return nodes.withColumn("problem", problem)


def table_to_markdown(cells: DataFrame) -> DataFrame:
    """(table_id, markdown) from cells (table_id, row, col, text), rows and columns from 1; missing cells are blank.

    The first row is the heading; bars in texts are escaped.
    """
    size = cells.groupBy("table_id").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    grid = size.select("table_id", "cols", F.explode(F.sequence(F.lit(1), "rows")).alias("row")).select("table_id", "cols", "row", F.explode(F.sequence(F.lit(1), "cols")).alias("col"))
    safe = F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|"))
    full = grid.join(cells.select("table_id", "row", "col", "text"), ["table_id", "row", "col"], "left").withColumn("text", safe)
    row = F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), " | "), F.lit(" |"))
    lines = full.groupBy("table_id", "row").agg(row.alias("line"), F.first("cols").alias("cols"))
    rule = F.when(F.col("row") == 1, F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("cols")))).otherwise("")
    return lines.select("table_id", "row", F.concat("line", rule).alias("line")).groupBy("table_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("markdown")
    )


def ordered_files(files: DataFrame, document: str) -> DataFrame:
    """Files of a document by id or name that have a page number, in page order."""
    return files.where(((F.col("document_id") == document) | (F.col("document_name") == document)) & F.col("page_number").isNotNull()).orderBy("page_number")


def with_ordinal(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """ord: place within ``by``."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)


def pdf_links(pages: DataFrame, key: str, html: str, address: str) -> DataFrame:
    """(key, ord, url): absolute addresses of the links to PDF files of each page, each once, in order.

    Links within the page and scripts are skipped; the path decides, without its case, query or fragment.
    """
    from html.parser import HTMLParser
    from urllib.parse import urljoin, urlparse

    class Anchors(HTMLParser):
        def handle_starttag(self, tag, attrs):
            href = dict(attrs).get("href") if tag == "a" else None
            if href and href.strip():
                self.found.append(href.strip())

    @F.pandas_udf("array<string>")
    def links(texts: pd.Series, bases: pd.Series) -> pd.Series:
        out = []
        for text, base in zip(texts, bases):
            parser = Anchors()
            parser.found = []
            parser.feed(text or "")
            full = [urljoin((base or "").rstrip("/") + "/", h) for h in parser.found if not h.startswith(("#", "javascript:"))]
            out.append(list(dict.fromkeys(u for u in full if urlparse(u).path.lower().endswith(".pdf"))))
        return pd.Series(out, dtype=object)

    return pages.select(key, F.posexplode(links(html, address)).alias("ord", "url"))


def hosted_pdfs(html: Column, host: str) -> Column:
    """Addresses of PDF files on a host, bare or as the value of a script's variable pdf, each once, in order: uploads, other media, then embedded ones."""
    import re

    at = re.escape(f"https://{host}")
    bare = [F.regexp_extract_all(html, F.lit(rf"(?i)({at}/media/{part}/[^\s\"'<>]+\.pdf)"), F.lit(1)) for part in ("pdf_upload", "pdf")]
    embedded = F.regexp_extract_all(html, F.lit(rf"(?i)var\s+pdf\s*=\s*['\"]({at}/media/pdf/[^'\"]+\.pdf)['\"]"), F.lit(1))
    return F.array_distinct(F.concat(*bare, embedded))
