"""Operators over tables of words with boxes."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PAGE = ["document_id", "page"]


def clean(words: DataFrame, least: float = 0.5) -> DataFrame:
    """Words that can be used: not blank, sure enough (unknown confidence counts as 0), box not inverted; text cleaned.

    Punctuation alone stays, as an empty text: blanks are dropped before texts are cleaned.
    """
    kept = words.where((F.col("text").isNotNull()) & (F.trim("text") != "") & (F.coalesce("confidence", F.lit(0.0)) >= least) & (F.col("x2") > F.col("x0")) & (F.col("y2") > F.col("y0")))
    return kept.withColumn("text", T.clean_word(F.col("text"))).withColumn("page", F.coalesce("page", F.lit(1))).withColumn("line", F.coalesce("line", F.lit(0)))


def reset_lines(words: DataFrame, factor: float = 1.0) -> DataFrame:
    """line2 and y0 from the words' heights: from the top a new line begins 0.3 of the median height below the line's first word.

    The first line has the number 0; its anchor is 0 if its first word is within that of the top. The fold runs within each page by a higher-order
    function; the order of equal tops is that of index_sort.
    """
    height = F.percentile(F.col("y2") - F.col("y0"), F.lit(0.5))
    packed = words.groupBy(*PAGE).agg(height.alias("h"), F.sort_array(F.collect_list(F.struct("y0", "index_sort", "x0"))).alias("ws"))
    start = F.struct(F.lit(0.0).alias("key"), F.lit(-1).alias("n"), F.array().cast("array<struct<index_sort:int,line2:int,y:double,x0:double>>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        new = (w["y0"] - acc["key"]) >= 0.3 * F.col("h") * factor
        key = F.when(new, w["y0"]).otherwise(acc["key"])
        n = acc["n"] + F.when(new | (acc["n"] < 0), 1).otherwise(0)
        one = F.struct(w["index_sort"].alias("index_sort"), n.alias("line2"), key.alias("y"), w["x0"].alias("x0"))
        return F.struct(key.alias("key"), n.alias("n"), F.concat(acc["out"], F.array(one)).alias("out"))

    folded = packed.select(*PAGE, F.aggregate("ws", start, step, lambda a: a["out"]).alias("out"))
    return folded.select(*PAGE, F.inline("out"))


def reading_order(words: DataFrame) -> DataFrame:
    """order: place of a word on its page by line, top and left edge."""
    w = Window.partitionBy(*PAGE).orderBy("line", "y0", "x0", "index_sort")
    return words.withColumn("order", F.row_number().over(w) - 1)


def space_types(words: DataFrame) -> DataFrame:
    """gap: 2 before the end of a line, block or page or before a colon, else 1."""
    w = Window.partitionBy(*PAGE).orderBy("index_sort")
    after = lambda c: F.lead(c).over(w)
    last = after("index_sort").isNull() | (after("line") != F.col("line")) | (after("block") != F.col("block")) | F.coalesce(F.startswith(after("text"), F.lit(":")), F.lit(False))
    return words.withColumn("gap", F.when(last, 2).otherwise(1))


def combine(words: DataFrame) -> DataFrame:
    """Phrases: runs of words between breaks, with the union of their boxes and the confidence weighted by length.

    A break follows a wide space type, a colon at the end, another line or block,
    or a gap wider than three quarters of the words' height.
    """
    w = Window.partitionBy(*PAGE).orderBy("index_sort")
    nxt = lambda c: F.lead(c).over(w)
    high = F.greatest(F.col("y2") - F.col("y0"), nxt("y2") - nxt("y0"))
    ends = (
        (F.col("space_type") > 1)
        | F.endswith(F.col("text"), F.lit(":"))
        | (nxt("line") != F.col("line"))
        | (nxt("block") != F.col("block"))
        | ((nxt("x0") - F.col("x2")) > 0.75 * high)
    )
    flagged = words.withColumn("_ends", F.coalesce(ends, F.lit(True)).cast("int"))
    numbered = flagged.withColumn("phrase", F.coalesce(F.sum("_ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    size = F.length("text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index_sort", "text"))), lambda x: x["text"]), " ")
    return numbered.groupBy(*PAGE, "phrase").agg(
        joined.alias("text"),
        *(F.min(c).alias(c) for c in ("x0", "y0")),
        *(F.max(c).alias(c) for c in ("x2", "y2")),
        F.min("line").alias("line"),
        F.min("block").alias("block"),
        F.when(F.sum(size) > 0, F.sum(F.col("confidence") * size) / F.sum(size)).alias("confidence"),
        F.count("*").alias("words"),
    )


def line_texts(words: DataFrame, by: list[str]) -> DataFrame:
    """(by..., text): texts of the words of each line from left to right."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "index_sort", "text"))), lambda x: x["text"]), " ")
    return words.groupBy(*by).agg(joined.alias("text"))


def block_boxes(words: DataFrame) -> DataFrame:
    """Box, number of words and text (lines under one another) of each block."""
    lines = line_texts(words, [*PAGE, "block", "line"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    texts = lines.groupBy(*PAGE, "block").agg(text.alias("text"))
    boxes = words.groupBy(*PAGE, "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("words"))
    return boxes.join(texts, [*PAGE, "block"])


def skew_angle(points: DataFrame, by: list[str]) -> DataFrame:
    """Median angle in degrees of the lines through each word's lower corners, null for fewer than four words."""
    angle = F.degrees(F.atan2(F.col("y_right") - F.col("y_left"), F.col("x_right") - F.col("x_left")))
    return points.groupBy(*by).agg(F.when(F.count("*") > 3, F.percentile(angle, F.lit(0.5))).alias("angle"), F.count("*").alias("words"))


def orient(words: DataFrame, angle: Column) -> DataFrame:
    """Boxes in unit space after a turn of the page by 0, 90, 180 or 270 degrees."""
    x0, y0, x2, y2 = (F.col(c) for c in ("x0", "y0", "x2", "y2"))
    pick = lambda a, b, c, d: F.when(angle == 90, b).when(angle == 180, c).when(angle == 270, d).otherwise(a)
    return words.select(
        *(c for c in words.columns if c not in ("x0", "y0", "x2", "y2")),
        pick(x0, 1 - y2, 1 - x2, y0).alias("x0"),
        pick(y0, x0, 1 - y2, 1 - x2).alias("y0"),
        pick(x2, 1 - y0, 1 - x0, y2).alias("x2"),
        pick(y2, x2, 1 - y0, 1 - x0).alias("y2"),
    )


def rotate(words: DataFrame, angle: Column, width: Column, height: Column) -> DataFrame:
    """Boxes in whole pixels after a turn about the centre of the page by ``angle`` degrees."""
    cx, cy, a = width / 2, height / 2, F.radians(-angle)
    turn_x = lambda x, y: F.bround(cx + (x - cx) * F.cos(a) - (y - cy) * F.sin(a), 0)
    turn_y = lambda x, y: F.bround(cy + (x - cx) * F.sin(a) + (y - cy) * F.cos(a), 0)
    corners = [(F.col(x), F.col(y)) for x in ("x0", "x2") for y in ("y0", "y2")]
    xs, ys = [turn_x(x, y) for x, y in corners], [turn_y(x, y) for x, y in corners]
    return words.select(
        *(c for c in words.columns if c not in ("x0", "y0", "x2", "y2")), F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x2"), F.greatest(*ys).alias("y2")
    )


def key_values(lines: DataFrame, by: list[str], text: str, order: Column, pattern: str = r"^([^:\n]+?):\s*(.+)$", trim: Callable[[Column], Column] = F.trim) -> DataFrame:
    """(by..., field, value): "Field: value" lines, the last one of a field counts."""
    found = lines.where(F.col(text).rlike(pattern)).select(*by, F.lower(trim(F.regexp_extract(text, pattern, 1))).alias("field"), trim(F.regexp_extract(text, pattern, 2)).alias("value"), order.alias("_o"))
    return found.groupBy(*by, "field").agg(F.max_by("value", "_o").alias("value"))


def break_colons(text: Column, digit: str = r"\d") -> Column:
    """Pieces of a word cut before and after each colon that follows no digit."""
    return F.filter(F.split(F.regexp_replace(text, rf"(?<=[^{digit}]):|^:", "\u0001:\u0001"), "\u0001"), lambda p: p != "")


def colon_pieces(words: DataFrame) -> DataFrame:
    """``words`` with each word cut at its colons: text, x0, x2 and space_type of the pieces, and ``piece``, their number in the word.

    A colon counts if it follows no digit or begins the word. The box is divided in
    proportion to the characters; pieces before others get the space type 2. As
    surveyed: a single character after the last colon is lost, and text between two
    colons keeps the second one.
    """
    kind = "array<struct<text:string,x0:double,x2:double,space_type:int>>"

    @F.pandas_udf(kind)
    def cut(texts: pd.Series, lefts: pd.Series, rights: pd.Series, spaces: pd.Series) -> pd.Series:
        out = []
        for t, x0, x2, space in zip(texts, lefts, rights, spaces):
            at = [m.start() for m in re.finditer(r"(?<=\D):|^:", t or "")]
            space = None if pd.isna(space) else int(space)
            if not at:
                out.append([(t, x0, x2, space)])
                continue
            wide = (x2 - x0) / len(t)
            box = lambda a, b, kind, x0=x0, t=t, wide=wide: (t[a:b], x0 + wide * a, x0 + wide * b, kind)
            own = [box(0, at[0], 2)] if at[0] else []
            for i, a in enumerate(at):
                own.append(box(a, a + 1, 2))
                last = i + 1 == len(at)
                end = len(t) - 1 if last else at[i + 1]
                if a + 1 < end:
                    own.append(box(a + 1, end + 1, space if last else 2))
            out.append(own)
        return pd.Series(out, dtype=object)

    rest = [c for c in words.columns if c not in ("text", "x0", "x2", "space_type")]
    return words.select(*rest, F.posexplode(cut("text", "x0", "x2", "space_type")).alias("piece", "p")).select(*rest, "piece", "p.*")


def to_pixels(words: DataFrame, dpi: int = 72) -> DataFrame:
    """Boxes in points as whole pixels at ``dpi``."""
    return words.withColumns({c: F.bround(F.col(c) * dpi / 72).cast("int") for c in ("x0", "y0", "x2", "y2")})
