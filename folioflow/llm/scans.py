"""Repair of text from scanned pages (problem 3).

1. Furniture: lines that stand alone at the top or foot of a page are compared
   with the corpus: how often a line of the same form stands there, and how often
   inside pages. Counts are joined back to the lines; a misread line finds its form
   by keys with one word or one sign left out. Page numbers are known by form and value.
2. The body of a page, and the first word of the next one, are de-lined into one
   stream. Ways through a stretch of it are the arcs of a lattice: a word as it
   stands, one that it is a misread form of, two words for one that was run
   together, one for two that were torn apart, and a word divided over two lines
   with and without its sign. Candidates come from the corpus's lexicon by joins on
   skeletons, halves and pairs, so that no lexicon is sent out.
3. The cheapest way is chosen by dynamic programming (Viterbi), an arc costing the
   negative log of its words' frequency and of its kind's.
4. Paragraphs: boundaries between lines by dynamic programming; they run on over
   page ends.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Collection, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

from ..operators.sizes import small
from .confusables import spell
from .tables import keep, read

#: Words that label a page number.
PAGE_LABEL = r"(?:page|pages|pg|p|पृष्ठ|पेज|पाना|seite|página|pág|第)"
ROMAN = r"[ivxlcdm1!|]{1,8}"
NUMBER = re.compile(
    rf"^\W*(?:{PAGE_LABEL}\W*)?(?:(\d+|[०-९]+|[\dlIoOSb!|]{{1,4}})|({ROMAN}))(?:\s*(?:of|/|को|का|von|sur|de)\s*[\dlIoO०-९]+)?\W*(?:页|頁|ページ)?\W*$", re.I
)
DIGITS = str.maketrans("०१२३४५६७८९", "0123456789")
MARKS = ".!?।॥|。！？:;,"
SIGNS = "-‐¬\u00ad"
LETTER = r"[^\W\d_]"
#: A letter or a sign that belongs to one.
SIGN = r"(?:[^\W\d_]|[ऀ-ॿ])"


def value(text: str) -> int | None:
    """The number that a page mark gives, read leniently."""
    plain = text.translate(DIGITS)
    if m := re.search(r"\d+", plain):
        return int(m.group()) if len(m.group()) < 7 else None
    letters = re.sub(rf"^\W*{PAGE_LABEL}\b", "", plain, flags=re.I)
    letters = re.sub(r"[^a-z!|]", "", letters.lower()).replace("!", "i").replace("|", "i")
    if re.fullmatch(r"[ivxlc]{1,8}", letters):
        sizes = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
        own = [sizes[c] for c in letters]
        return sum(-a if a < b else a for a, b in zip(own, own[1:] + [0]))
    return None


def masked(text: str) -> str:
    """Form of a line: without case and figures, with the sign # for a number of its own at either end."""
    out = re.sub(r"[\d०-९]+", "0", " ".join(unicodedata.normalize("NFC", text).casefold().split()))
    return re.sub(r"(?<=0) 0$", " #", re.sub(r"^0 (?=\D)", "# ", out))


PARTS = ("index_sort", "line", "block", "text")


def pages(words: DataFrame) -> DataFrame:
    """One row a page: document_id, page and in reading order index_sort, line, block and text of its words; ``Lines`` takes repeated rows once."""
    return (
        words.where(F.col("text").isNotNull() & F.col("document_id").isNotNull() & F.col("page").isNotNull() & F.col("index_sort").isNotNull())
        .groupBy("document_id", "page")
        .agg(F.sort_array(F.collect_list(F.struct(*PARTS))).alias("words"))
        .select("document_id", "page", *(F.col(f"words.{c}").alias(c) for c in PARTS))
    )


class Lines:
    """Lines of a page from the top: their words, text and whether each stands alone in its block."""

    def __init__(self, index_sort, line, block, text) -> None:
        rows: dict[int, list] = {}
        blocks: dict[int, int] = {}
        own: list[tuple[int, str]] = []
        last = now = None
        for w, n, b, t in zip(index_sort, line, block, text):
            if w == last:
                continue
            last = w
            if n != now:
                now, own = n, rows.setdefault(n, [])
                blocks.setdefault(n, b)
            if t.strip():
                own.append((w, t))
        self.number = sorted(rows)
        self.words = [rows[n] for n in self.number]
        many = Counter(blocks.values())
        self.alone = [many[blocks[n]] == 1 for n in self.number]
        self.block = [blocks[n] for n in self.number]

    def text(self, i: int) -> str:
        return " ".join(t.strip() for _, t in self.words[i])

    def zones(self) -> dict[int, str]:
        """Lines that may be furniture: their place, "top" or "foot"."""
        out: dict[int, str] = {}
        last = len(self.number) - 1
        for i in (0, 1):
            if i <= last and all(self.alone[: i + 1]):
                out[i] = "top"
        for i in (last, last - 1):
            if i > 0 and all(self.alone[i:]) and i not in out:
                out[i] = "foot"
        return out


def is_number(text: str) -> bool:
    return len(text) < 24 and bool(NUMBER.match(text)) and not re.search(r"\d[.,]\d|%|प्रतिशत", text.translate(DIGITS))


def split_number(words: list[tuple[int, str]]) -> tuple[int | None, int | None, list]:
    """Index and value of a number at either end of a line, and the words between."""
    if len(words) > 1:
        for at, rest in ((0, words[1:]), (-1, words[:-1])):
            t = words[at][1].translate(DIGITS)
            if re.fullmatch(r"[\dlIoO]{1,4}", t) and re.search(r"\d|^l+$", t):
                other = rest[-1][1].translate(DIGITS) if at == -1 else ""
                if at == -1 and not re.search(r"\d\W*$|[^\W\d]$", other):
                    continue
                if at == -1 and not re.search(r"\d{3,}\W*$", other):
                    continue
                return words[at][0], value(t.replace("l", "1").replace("I", "1").replace("o", "0").replace("O", "0")), rest
    return None, None, words


#: Pages whose words are Python objects at one time.
AT_ONCE = 512


def few_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of ``AT_ONCE``, as a batch of Spark's may hold a million words."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def inner(column: pa.ListArray) -> tuple[pa.Array, list[int]]:
    """The values of a column without null lists, and where each list begins and the last one ends."""
    at = column.offsets.to_numpy()
    return column.values.slice(at[0], at[-1] - at[0]), (at - at[0]).tolist()


def flat(column: pa.ListArray) -> list[list]:
    """The lists of a column; null integers are -1. Values are converted all at once, not one by one."""
    values, at = inner(column)
    own = (values.fill_null(-1).to_numpy() if pa.types.is_integer(values.type) else values.to_numpy(zero_copy_only=False)).tolist()
    return [own[a:b] for a, b in zip(at, at[1:])]


def structs(column: pa.ListArray, fields: tuple[str, ...]) -> list[list[tuple]]:
    """The lists of a column as lists of tuples of the named fields."""
    values, at = inner(column)
    rows = list(zip(*(values.field(f).to_pylist() for f in fields)))
    return [rows[a:b] for a, b in zip(at, at[1:])]


def each_page(batch: pa.RecordBatch, first: tuple[str, ...]) -> Iterator[tuple]:
    """The named columns and the lines of each page of a batch."""
    for row in zip(*(batch.column(c).to_pylist() for c in first), *(flat(batch.column(c)) for c in PARTS)):
        yield (*row[: len(first)], Lines(*row[len(first) :]))


#: Lines of one form are furniture of the corpus from so many pages on, however large it is.
COMMON = 3
ZONE_COLS = ["document_id", "page", "lines", "i", "place", "form", "numbered", "right", "indexes", "texts"]
ZONE_SCHEMA = "document_id string, page int, lines int, i int, place string, form string, numbered boolean, right boolean, indexes array<int>, texts array<string>"


def lone_lines(paged: DataFrame) -> DataFrame:
    """Lines that stand alone in their block: place (top, foot, title on a first page, mid), form, and whether a number at an end is the page's.

    Only lines at the top or foot bring their words; lines that are numbers have no form.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_pages(batches):
            out: list[list] = [[] for _ in ZONE_COLS]
            for doc, page, lines in each_page(batch, ("document_id", "page")):
                zones = lines.zones()
                for i, alone in enumerate(lines.alone):
                    if not alone and i not in zones or not lines.words[i]:
                        continue
                    text, zone = lines.text(i), zones.get(i)
                    form, number = None, None
                    if not is_number(text) and re.search(LETTER, text):
                        form = masked(text)
                        number = split_number(lines.words[i])[1]
                    if zone is None and form is None:
                        continue
                    place = zone or "mid"
                    words = lines.words[i] if zone else None
                    row = (doc, page, len(lines.number), i, place, form, number is not None, number is not None and number == page, words and [w for w, _ in words], words and [t for _, t in words])
                    for col, v in zip(out, row):
                        col.append(v)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ZONE_COLS)

    return paged.mapInArrow(run, ZONE_SCHEMA)


def segments(form: str) -> list[str]:
    """Parts of a form between signs that stand alone; none if it has no such sign."""
    parts = [" ".join(x) for sign, g in groupby(form.split(), lambda t: not re.search(r"[^\W_]|#", t)) if not sign for x in [list(g)]]
    return [p for p in parts if len(p) > 2] if len(parts) > 1 else []


def near_keys(form: str) -> list[str]:
    """Keys that a form shares with one in which a word, or a sign, was read wrongly."""
    words = [skeletons(w)[0] for w in form.split()]
    flat = " ".join(words)
    bare = [w for w in words if re.search(r"[^\W0]", w)]
    less = {"w" + " ".join(words[:i] + ["*"] + words[i + 1 :]) for i in range(len(words))} if len(words) > 2 else set()
    for own in (words, bare):
        less |= {"d" + " ".join(own)} | ({"d" + " ".join(own[:i] + own[i + 1 :]) for i in range(len(own))} if len(own) > 2 else set())
    return sorted(less | {"c" + flat[:i] + flat[i + 1 :] for i in range(len(flat))} | {"=" + x for x in skeletons(form)})


SALTS = 16


def known_forms(lines: DataFrame) -> DataFrame:
    """(form, whole, zone, known, top, foot, mid, numbered, right): the corpus's evidence for the forms of lines in a zone.

    ``known`` is the furniture form that the line's own form is, or is a misread one
    of, with that form's counts; other forms that stand ``COMMON`` times at edges
    have their own counts and no ``known``. ``whole`` is false for parts of forms.
    Forms are counted over all lines, wherever their documents are, and the least
    count doesn't depend on the size of the corpus.
    """

    @F.pandas_udf(ArrayType(StringType()))
    def cut(forms: pd.Series) -> pd.Series:
        return forms.map(segments)

    @F.pandas_udf(ArrayType(StringType()))
    def keys(forms: pd.Series) -> pd.Series:
        return forms.map(near_keys)

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y) for x, y in zip(a, b)], dtype=float)

    named = lines.where("form is not null and form != ''").select("form", F.when((F.col("page") == 1) & (F.col("place") == "top"), "title").otherwise(F.col("place")).alias("place"), "place", "numbered", "right").toDF("form", "place", "zone", "numbered", "right")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    counts = (n(F.col("place") == "top")("top"), n(F.col("place") == "foot")("foot"), n(F.col("place") == "mid")("mid"), n(F.col("numbered"))("numbered"), n(F.col("right"))("right"))
    whole = named.groupBy("form", "zone").agg(*counts)
    part = whole.withColumn("form", F.explode(cut("form"))).groupBy("form", "zone")
    sums = [F.sum(c).alias(c) for c in COUNTS]
    by_zone = keep(whole.withColumn("whole", F.lit(True)).unionByName(part.agg(*sums).withColumn("whole", F.lit(False))))
    total = keep(by_zone.groupBy("form", "whole").agg(*sums).where(F.col("top") + F.col("foot") >= COMMON))
    good = total.where("top >= 3 and top > mid").withColumn("zone", F.lit("top")).unionByName(total.where("foot >= 3 and foot > 2 * mid").withColumn("zone", F.lit("foot")))
    asked = by_zone.where("zone != 'mid'").select("form", "zone", "whole")
    exact = asked.join(good, ["form", "zone", "whole"]).withColumn("known", F.col("form"))
    rest = asked.join(good.select("form", "zone", "whole"), ["form", "zone", "whole"], "left_anti")
    keyed = good.select(F.col("form").alias("known"), "zone", "whole", *COUNTS, F.explode(keys("form")).alias("key"))
    pairs = rest.withColumn("key", F.explode(keys("form"))).join(keyed, ["zone", "whole", "key"]).dropDuplicates(["form", "zone", "whole", "known"]).withColumn("ratio", ratio("form", "known")).where("ratio > 0.8")
    best = F.max_by(F.struct("known", *COUNTS), F.struct("ratio", F.col("top") + F.col("foot"), "known"))
    near = pairs.groupBy("form", "zone", "whole").agg(best.alias("b")).select("form", "zone", "whole", "b.*")
    own = rest.join(near, ["form", "zone", "whole"], "left_anti").join(total, ["form", "whole"]).withColumn("known", F.lit(None).cast("string"))
    return exact.unionByName(near).unionByName(own)


COUNTS = ("top", "foot", "mid", "numbered", "right")


def alike(a: str, b: str) -> float:
    """Share of equal signs, 0 for texts of very different lengths."""
    if abs(len(a) - len(b)) > max(3, len(a) // 6):
        return 0.0
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def furniture(lines: DataFrame) -> DataFrame:
    """document_id, page, marks (index_sort -> kind): the words of running heads, feet and page numbers of each page that has some.

    A foot that isn't common in the corpus is one if each of its parts is a known
    form, or if it stands at the foot of another page of its document. Evidence is
    joined to the lines by form and a salt, as one head may stand on a third of all pages.
    """

    @F.pandas_udf(ArrayType(StringType()))
    def cut(forms: pd.Series) -> pd.Series:
        return forms.map(lambda f: segments(f) if f else [])

    known = keep(known_forms(lines))
    edge = lines.where("place in ('top', 'foot')").withColumn("salt", F.pmod(F.xxhash64("document_id", "page"), F.lit(SALTS)).cast("int"))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("zone", "place")
    counts = F.array(*(F.col(c) for c in COUNTS)).alias("counts")
    of_whole = salted.where("whole").select("form", "place", "salt", "known", counts)
    of_part = known.where("known is not null").select("form").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("hit", F.lit(1))
    pieces = edge.where("place = 'foot'").select("document_id", "page", "i", "salt", F.explode(cut("form")).alias("form"))
    by_part = pieces.join(of_part, ["form", "salt"], "left").groupBy("document_id", "page", "i").agg((F.count("hit") == F.count("*")).alias("by_part"))
    edge = edge.withColumn("exact", F.lower(F.array_join("texts", " ")))
    again = edge.where("place = 'foot' and form != ''").groupBy("document_id", "exact").agg(F.count("*").alias("n")).where("n > 1")
    again = again.select("document_id", "exact", F.lit(True).alias("again"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit("foot").alias("place"))
    seen = edge.join(of_whole, ["form", "place", "salt"], "left").join(by_part, ["document_id", "page", "i"], "left").join(again, ["document_id", "exact", "place", "salt"], "left")
    paged = seen.groupBy("document_id", "page", "lines").agg(F.collect_list(F.struct(*EDGE)).alias("edge"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_pages(batches):
            out: list[tuple] = []
            for doc, page, size, edge in zip(*(batch.column(c).to_pylist() for c in ("document_id", "page", "lines")), structs(batch.column("edge"), EDGE)):
                if marks := page_furniture(page, size, [dict(zip(EDGE, e)) for e in edge]):
                    out.append((doc, page, sorted(marks.items())))
            marks_ = pa.array([[{"index_sort": w, "kind": k} for w, k in x[2]] for x in out], pa.list_(pa.struct([("index_sort", pa.int32()), ("kind", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), marks_], ["document_id", "page", "marks"])

    return paged.mapInArrow(decide, "document_id string, page int, marks array<struct<index_sort: int, kind: string>>")


EDGE = ("i", "place", "form", "indexes", "texts", "known", "counts", "by_part", "again")


def page_furniture(page: int, size: int, edge: list[dict]) -> dict[int, str]:
    """index_sort -> kind for the furniture of a page of ``size`` lines, from its edge lines with their evidence."""
    out: dict[int, str] = {}
    marked: set[int] = set()
    rows = {e["i"]: e for e in edge}
    for i in sorted(rows, key=lambda i: i if rows[i]["place"] == "top" else size - i):
        row = rows[i]
        zone, known, repeated = row["place"], row["known"], bool(row["by_part"] or row["again"])
        counts = None if row["counts"] is None else list(row["counts"])
        words = list(zip(row["indexes"], row["texts"]))
        text = " ".join(t.strip() for _, t in words)
        at_edge = i == 0 or i == size - 1
        before = {i - 1, i + 1} & marked
        if is_number(text):
            got = value(text)
            decorated = bool(re.search(rf"{PAGE_LABEL}|[/\[\]—–-]|of", text, re.I))
            if (at_edge or before) and (decorated or got == page or (at_edge and got is not None and got < 3000 and not text.rstrip().endswith("."))):
                out.update({w: "page_number" for w, _ in words})
                marked.add(i)
            continue
        if not at_edge and not before or not re.search(SIGN + "{3}", text):
            continue
        at, number, _ = split_number(words)
        ended = re.search(rf"[{re.escape('.!?।॥|。！？')}][\"'”’»)\]]*$", text) or text.rstrip()[-1:] in SIGNS
        if zone == "foot":
            head = known is not None or repeated and not ended
        elif ended and known is None:
            head = False
        else:
            inside = counts is not None and counts[2] > counts[0]
            amount = re.search(r"%|प्रतिशत|percent|रु\.|rs\.|npr|₹", text, re.I)
            head = not inside and not amount and (i == 0 or known is not None)
            if page == 1 and at is None and not text.isupper():
                head = False
        if not head:
            continue
        marked.add(i)
        out.update({w: "header" for w, _ in words})
        if at is not None:
            right = counts[4] >= 0.5 * counts[3] if counts and counts[3] else number == page
            if right and number == page or right and len(str(page)) == len(str(number)) and counts:
                out[at] = "page_number"
    return out


@lru_cache(maxsize=100_000)
def core(text: str) -> str:
    """A word without the punctuation around it, case folded."""
    return re.sub(r"^[^\w]+|[^\wऀ-ॿ]+$|[।॥]+$", "", unicodedata.normalize("NFC", text)).casefold().rstrip("।॥")


NOISE = str.maketrans("", "", "|~^*\\_`'’\u00ad¬")
#: Signs that scanners take for one another, each class under its first member.
CLASSES = ("oa0", "ec", "tf7", "hb6", "il1!", "s5", "gq9", "z2", "रग", "समभ", "िी", "ेै", "ोौ", "तन", "यथ", "पष", "ुू", "बव", "टठढ", "घध", "डङ", "कफ")
CLASS = {ord(c): own[0] for own in CLASSES for c in own}
#: Two signs for one, in terms of the classes.
PAIRS = (("rn", "m"), ("ri", "n"), ("ei", "d"), ("vv", "w"), ("ii", "u"), ("रब", "ख"))


def skeletons(word: str) -> list[str]:
    """What stays the same of a word under the usual confusions of scanners; the first has no pairs replaced."""
    base = word.translate(NOISE).translate(CLASS)
    out = [base]
    for order in (PAIRS, PAIRS[::-1], *((p,) for p in PAIRS)):
        own = base
        for two, one in order:
            own = own.replace(two, one)
        if own not in out:
            out.append(own)
    return out


def eligible(word: str) -> bool:
    """Words whose letters can be judged: no amounts, dates, labels of provisions, addresses."""
    return bool(re.search(LETTER, word)) and not re.search(r"[/.,@]|^\d+[a-z]?$|^[a-z]\d+$|^(?:rs|npr|रु)\d*$", word) and len(word) > 1


def broken(word: str) -> bool:
    """A figure or sign among the letters of a word."""
    return bool(re.search(rf"{LETTER}[|~^*\\!]+{LETTER}|{LETTER}\d+{LETTER}|^\d{LETTER}{{2,}}|{LETTER}{{2,}}\d$", word)) and not re.fullmatch(r"\d+(?:st|nd|rd|th|ème|er|re|a|b|c)", word)


def readings(first: str, second: str) -> tuple[str, str]:
    """A divided word joined without its sign, and with it."""
    a = re.sub(rf"[{SIGNS}]+$", "", first)
    b = re.match(r"[^\s]*", second).group()
    return core(a + b), core(a + "-" + b)


def divided(word: str) -> bool:
    return len(word) > 1 and word[-1] in SIGNS and bool(re.search(rf"[{LETTER[1:-1]}ऀ-ॿ]$|{LETTER}$|[ऀ-ॿ]$", word[:-1]))


def tokens(marked: DataFrame) -> DataFrame:
    """Words of the pages (with their furniture as marks): document_id, page, index_sort, kind (furniture) or null, type, place in the de-lined stream.

    ``pos`` counts the words of the page's body and ``next_type`` is the next one's
    type. place: "in", or "cut" for a piece before a line's end, "last" for one at a
    page's end, "rest" for the first word after a piece, "first" for the first word
    of a page. For a cut piece, ``without`` and ``hyphenated`` are its two readings
    with ``rest_index``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_pages(batches):
            docs, numbers, sizes, heads, indexes, kinds_, types = ([] for _ in range(7))
            # By row, for the few words that aren't just inside a line.
            placed: dict[int, int] = {}
            texts: dict[int, str] = {}
            cuts: dict[int, tuple[str, str, int]] = {}
            for doc, page, marks, lines in each_page(batch, ("document_id", "page", "marks")):
                kinds = {m["index_sort"]: m["kind"] for m in marks or ()}
                own = [line for x in lines.words if (line := [w for w in x if w[0] not in kinds] if kinds else x)]
                before = len(indexes)
                indexes.extend(kinds)
                kinds_.extend(kinds.values())
                types.extend([None] * len(kinds))
                rest: int | None = None
                for i, line in enumerate(own):
                    at = len(types)
                    indexes.extend([w for w, _ in line])
                    types.extend([core(text) for _, text in line])
                    if rest == line[0][0]:
                        placed[at] = PLACES.index("rest")
                    elif i == 0:
                        placed[at], texts[at] = PLACES.index("first"), line[0][1]
                    at, text = len(types) - 1, line[-1][1]
                    if text[-1] in SIGNS and divided(text):
                        if i + 1 < len(own):
                            rest, begun = own[i + 1][0]
                            placed[at], cuts[at] = PLACES.index("cut"), (*readings(text, begun), rest)
                            texts.pop(at, None)
                        else:
                            placed[at], texts[at] = PLACES.index("last"), text
                docs.append(doc)
                numbers.append(page)
                sizes.append(len(indexes) - before)
                heads.append(len(kinds))
            size, head, row = np.array(sizes, int), np.array(heads, int), np.arange(len(indexes))
            end = np.cumsum(size)
            pos = row - np.repeat(end - size + head, size)
            framed = pos < 0
            last = np.isin(row, end - 1)
            place = np.zeros(len(row), int)
            place[list(placed)] = list(placed.values())

            def some(rows: Collection[int], values: list, kind: pa.DataType) -> pa.Array:
                where = np.full(len(row), -1)
                where[list(rows)] = np.arange(len(rows))
                return pa.array(values, kind).take(pa.array(where, mask=where < 0))

            s, n = pa.string(), pa.int32()
            each = np.repeat(np.arange(len(size)), size)
            typed = pa.array(types, s)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, s).take(pa.array(each)),
                    pa.array(numbers, n).take(pa.array(each)),
                    pa.array(indexes, n),
                    some(np.flatnonzero(framed), kinds_, s),
                    pa.array(pos, n, mask=framed),
                    typed,
                    typed.take(pa.array(row + 1, mask=framed | last)),
                    pa.array(PLACES, s).take(pa.array(place, mask=framed)),
                    *(some(cuts, [x[i] for x in cuts.values()], k) for i, k in enumerate((s, s, n))),
                    some(texts, list(texts.values()), s),
                ],
                COLS,
            )

    return marked.mapInArrow(run, SCHEMA)


PLACES = ["in", "first", "rest", "cut", "last"]
COLS = ["document_id", "page", "index_sort", "kind", "pos", "type", "next_type", "place", "without", "hyphenated", "rest_index", "text"]
SCHEMA = "document_id string, page int, index_sort int, kind string, pos int, type string, next_type string, place string, without string, hyphenated string, rest_index int, text string"

#: A rarer type is a misread form of a frequent one from this ratio of their counts on: for types unknown to texts that weren't scanned, and for others.
RATIO_NEW, RATIO_KNOWN, RATIO_EDIT, LEAST_EDIT = 4, 60, 30, 30


def misread_types(types: DataFrame) -> DataFrame:
    """(type, n, clean) -> (type, best, m, ratio): types that are misread forms, the type they stand for, its count and by how much it must exceed theirs.

    Candidates are found for all types by joins on their skeletons and on the
    skeletons with one sign left out.
    """

    @F.pandas_udf(ArrayType(StringType()))
    def keys(words: pd.Series) -> pd.Series:
        def one(w: str) -> list[str]:
            own = skeletons(w)
            s = own[0]
            less = {"-" + s[:i] + s[i + 1 :] for i in range(len(s))} | {"-" + s} if len(s) > 4 else set()
            return ["=" + x for x in own] + sorted(less)

        return words.map(one)

    @F.pandas_udf(BooleanType())
    def odd(words: pd.Series) -> pd.Series:
        return words.map(broken)

    @F.pandas_udf(BooleanType())
    def fit(words: pd.Series) -> pd.Series:
        return words.map(lambda w: eligible(w) or broken(w))

    own = types.where(fit("type")).withColumn("odd", odd("type")).withColumn("total", F.col("n") + F.col("clean"))
    keyed = own.withColumn("key", F.explode(keys("type")))
    rare = keyed.where(F.col("clean") * RATIO_KNOWN <= F.col("n") + 2)
    good = keyed.where("not odd and total >= 5").select(F.col("type").alias("best"), F.col("total").alias("m"), F.col("clean").alias("mc"), "key")
    near = rare.join(good, "key").where(F.col("type") != F.col("best"))
    same = F.col("key").startswith("=")
    ratio = F.when(same & (F.col("clean") == 0), RATIO_NEW).when(same, RATIO_KNOWN).when((F.col("clean") == 0) & (F.col("m") >= LEAST_EDIT), RATIO_EDIT)
    enough = near.withColumn("ratio", ratio).where(F.col("m") >= F.col("ratio") * F.when(F.col("clean") == 0, F.col("n")).otherwise(F.col("total")))
    found = enough.groupBy("type").agg(F.max_by(F.struct("best", "m", "ratio"), F.struct(same.alias("same"), F.col("m"), "best")).alias("b")).select("type", "b.*")
    # A figure or sign among letters is wrong even if no known word is near.
    alone = own.where("odd and clean = 0").select("type")
    return found.join(alone, "type", "full").select("type", "best", "m", "ratio")


#: Costs (natural logs) of two words that were run together, of one torn apart, of a misread reading of a divided word, and of one that nobody wrote.
SPLIT_COST, MERGE_COST, READING_COST, UNSEEN = 3.0, 10.0, 4.0, 25.0
#: No word as it stands costs more beside a split or a merge, so that they need the same evidence in corpora of any size.
MOST = 12.0


def split_types(types: DataFrame, total: int) -> DataFrame:
    """(type, fixed, cost): unknown types that are two known ones run together, for all of the corpus's types.

    Each place in a type that texts without scans lack gives two halves, which are joined with the lexicon.
    """
    known = types.where("clean >= 2 or clean > 0 and n >= 2 and length(type) > 2").where("length(type) > 1").select("type", F.log((F.col("n") + F.col("clean")) / total).alias("lp"))
    asked = types.where("clean = 0 and n > 0 and length(type) > 4").where(F.col("type").rlike(r"^[\p{L}\p{M}]+$"))
    cut = asked.select("type", F.greatest(F.log(F.col("n") / total), F.lit(-MOST)).alias("own"), F.explode(F.sequence(F.lit(2), F.length("type") - 2)).alias("k"))
    halves = cut.select("type", "own", F.expr("left(type, k)").alias("a"), F.expr("substring(type, k + 1)").alias("b"))
    both = halves.join(known.toDF("a", "la"), "a").join(known.toDF("b", "lb"), "b").withColumn("cost", SPLIT_COST - F.col("la") - F.col("lb"))
    best = both.where(F.col("cost") < -F.col("own")).groupBy("type").agg(F.min_by(F.struct(F.concat_ws(" ", "a", "b").alias("fixed"), "cost"), F.struct("cost", "a")).alias("x"))
    return best.select("type", "x.fixed", "x.cost")


def arcs(inside: DataFrame, types: DataFrame, total: int) -> DataFrame:
    """document_id, page, start, end, cost, kind, fixed, index_sort, rest_page, rest_index, rest_type: ways through the streams of the pages other than their words as they stand, and what those cost (kind null).

    A word stands at ``pos``; an arc covers the words from start up to end. A word
    divided over two pages ends at the page's end and takes the first word of the next.
    """
    # A word divided over two pages: its rest is the first word of the next page.
    last = inside.where("place = 'last'").select("document_id", "page", "pos", "index_sort", "text")
    first = inside.where("place = 'first'").select("document_id", (F.col("page") - 1).alias("page"), F.col("text").alias("rest"), F.col("index_sort").alias("rest_index"), F.col("type").alias("rest_type"))

    @F.pandas_udf(ArrayType(StringType()))
    def both(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([list(readings(x, y or "")) for x, y in zip(a, b)], dtype=object)

    over = last.join(first, ["document_id", "page"], "left").withColumn("two", both("text", "rest"))
    over = over.select("document_id", "page", "pos", "index_sort", F.col("two")[0].alias("without"), F.col("two")[1].alias("hyphenated"), (F.col("page") + 1).alias("rest_page"), "rest_index", "rest_type", F.lit(1).alias("width"))
    cuts = inside.where("place = 'cut'").select(
        "document_id", "page", "pos", "index_sort", "without", "hyphenated", F.col("page").alias("rest_page"), "rest_index", F.col("next_type").alias("rest_type"), F.lit(2).alias("width")
    )
    cuts = keep(cuts.unionByName(over))
    known = types.select("type", (F.col("n") + F.col("clean")).alias("total"))
    # Readings that nobody wrote may be misread words themselves.
    asked = cuts.select(F.explode(F.array("without", "hyphenated")).alias("type")).where("type != ''").distinct()
    unread = asked.join(types, "type", "left_anti").select("type", F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("clean"))
    wrong = keep(misread_types(types.unionByName(unread)))
    lp = lambda c: F.log(c / total)
    # What a reading costs: its count, else that of the word that it is a misread form of.
    readings_ = asked.join(known, "type", "left").join(wrong, "type", "left")
    seen = F.coalesce(F.col("total"), F.lit(0)) > 0
    readings_ = keep(readings_.select("type", F.when(seen, -lp(F.col("total"))).when(F.col("best").isNotNull(), READING_COST - lp(F.col("m"))).alias("cost"), F.when(~seen, F.col("best")).alias("best")))
    one = lambda name, extra, sign: (
        cuts.join(readings_.withColumnRenamed("type", name), name, "left")
        .withColumn("fixed", F.coalesce("best", name))
        .withColumn("cost", F.when(F.lit(not sign) | F.col("best").isNull() | F.col("best").contains("-"), F.col("cost")))
        .select("document_id", "page", F.col("pos").alias("start"), (F.col("pos") + F.col("width")).alias("end"), F.coalesce(F.col("cost") + extra, F.lit(UNSEEN) + 100 * extra).alias("cost"), F.lit("kept" if sign else "hyphen").alias("kind"), "fixed", "index_sort", "rest_page", "rest_index", "rest_type", F.col("best").isNotNull().alias("guessed"))
    )
    divided_ = one("without", 0.0, False).unionByName(one("hyphenated", 0.01, True))
    # One word for one, and two for one. What was cut, and its rest, are no words.
    taken = cuts.where("rest_index is not null").select("document_id", F.col("rest_page").alias("page"), F.col("rest_index").alias("index_sort"))
    mine = types.select("type", "n", "clean")
    as_is = F.when(F.col("clean") == 0, F.col("n")).otherwise(F.col("n") + F.col("clean"))
    misread = wrong.join(mine, "type").select("type", (-lp(as_is)).alias("own"), F.lit("misread").alias("kind"), F.col("best").alias("fixed"), F.coalesce(F.log("ratio") - lp(F.col("m")) - 1e-6, -lp(as_is) - 1).alias("cost"))
    splits = split_types(types, total).join(mine, "type").select("type", F.least(-lp(as_is), F.lit(MOST)).alias("own"), F.lit("split").alias("kind"), "fixed", "cost")
    other = small(keep(misread.unionByName(splits).groupBy("type").agg(F.max("own").alias("own"), F.collect_list(F.struct("kind", "fixed", "cost")).alias("ways"))))
    # The few words with other ways are found first, so that the rest of the words meets no other join.
    words = inside.where("place in ('in', 'first')").join(other, "type")
    words = words.join(taken.where(F.col("index_sort").isNotNull()), ["document_id", "page", "index_sort"], "left_anti")
    single = words.select("document_id", "page", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.explode(F.concat("ways", F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.col("type").alias("fixed"), F.col("own").alias("cost"))))).alias("w"), "index_sort")
    single = single.select("document_id", "page", "start", "end", "w.cost", "w.kind", "w.fixed", "index_sort")
    # One for two, if texts without scans lack one of them and have the whole.
    odd = small(keep(types.where("clean = 0 and n > 0").where(F.col("type").rlike(r"^[\p{L}\p{M}]+$")).select("type")))
    near = inside.where("place in ('in', 'first') and next_type is not null and type != '' and next_type != ''").select("document_id", "page", "pos", "index_sort", "type", "next_type")
    beside = near.join(odd.withColumn("a", F.lit(True)), "type", "left").join(odd.toDF("next_type").withColumn("b", F.lit(True)), "next_type", "left").where("a or b").drop("a", "b")
    whole = types.where("clean > 0").select(F.col("type").alias("fixed"), (F.col("n") + F.col("clean")).alias("m"))
    torn = beside.withColumn("fixed", F.concat("type", "next_type")).join(whole, "fixed").join(mine.toDF("type", "na", "ca"), "type").join(mine.toDF("next_type", "nb", "cb"), "next_type")
    torn = torn.withColumn("ia", F.least(-lp(F.col("na") + F.col("ca")), F.lit(MOST))).withColumn("ib", F.least(-lp(F.col("nb") + F.col("cb")), F.lit(MOST))).withColumn("im", MERGE_COST - lp(F.col("m"))).where("im < ia + ib")
    merged = torn.select("document_id", "page", "index_sort", F.inline(F.array(
        F.struct(F.col("pos").alias("start"), (F.col("pos") + 2).alias("end"), F.col("im").alias("cost"), F.lit("merge").alias("kind"), F.col("fixed").alias("fixed")),
        F.struct(F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.col("ia").alias("cost"), F.lit(None).cast("string").alias("kind"), F.col("type").alias("fixed")),
        F.struct((F.col("pos") + 1).alias("start"), (F.col("pos") + 2).alias("end"), F.col("ib").alias("cost"), F.lit(None).cast("string").alias("kind"), F.col("next_type").alias("fixed")),
    )))
    return divided_.unionByName(single, allowMissingColumns=True).unionByName(merged, allowMissingColumns=True)


def cheapest(ways: list[tuple]) -> list[tuple]:
    """The arcs (start, end, cost, kind, ...) on the cheapest way through a page; places without arcs cost nothing.

    Viterbi from left to right over the places where arcs begin or end. Of equal
    costs the longer arc counts, then the one that changes something.
    """
    by_start: dict[int, list[tuple]] = {}
    for w in ways:
        by_start.setdefault(w[0], []).append(w)
    # Divided words have no reading as they stand.
    split_at = {w[0] for w in ways if w[3] in ("hyphen", "kept")}
    places = sorted({p for w in ways for p in (w[0], w[1])} | {w[0] + 1 for w in ways})
    best: dict[int, tuple[float, tuple | None, int | None]] = {}
    reach = 0.0
    before: int | None = None
    for p in places:
        if p not in best:
            best[p] = (reach, None, before)
        elif before is not None and p not in {w[1] for w in by_start.get(before, ())} and best[before][0] + 50.0 < best[p][0]:
            best[p] = (best[before][0] + 50.0, None, before)
        here = best[p][0]
        own = by_start.get(p, [])
        for w in own:
            cost = here + w[2]
            if w[1] not in best or (cost, w[0], w[3] is None) < (best[w[1]][0], best[w[1]][2] if best[w[1]][2] is not None else -1, best[w[1]][1] is None or best[w[1]][1][3] is None):
                best[w[1]] = (cost, w, p)
        if p + 1 not in best and not any(w[1] == p + 1 for w in own):
            # The word as it stands, where only longer arcs are given.
            best[p + 1] = (here + (UNSEEN * 2 if p in split_at else 0.0), None, p)
        reach, before = here, p
    out: list[tuple] = []
    at: int | None = places[-1] if places else None
    while at is not None:
        _, w, came = best[at]
        if w is not None:
            out.append(w)
        at = came
    return out[::-1]


def clean_types(docs: DataFrame) -> DataFrame:
    """(type, clean): word types of texts that weren't scanned, in their ordinary form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: Counter[str] = Counter()
            raw: Counter[str] = Counter()
            for text in batch["content"]:
                raw.update(text.split())
            for w, k in raw.items():
                n[core(spell(w))] += k
            yield pd.DataFrame({"type": list(n), "clean": list(n.values())})

    texts = docs.where(~F.col("ocr_used") & F.col("content").isNotNull()).select("content")
    return texts.mapInPandas(run, "type string, clean bigint").groupBy("type").agg(F.sum("clean").alias("clean"))


def noisy(words: DataFrame, docs: DataFrame) -> DataFrame:
    """document_id, page, index_sort, kind, fixed: the noisy words of scanned pages and what stands for them.

    kind: header, page_number, hyphen (fixed: the whole word), misread, and for
    words that were run together ``split``, for the first of two torn ones ``merge``.
    Null and blank words are left out; a page without lines has its words in one
    line. Repeated rows count once.
    """
    paged = keep(pages(words))
    lines = keep(lone_lines(paged))
    all_words = keep(tokens(paged.join(furniture(lines), ["document_id", "page"], "left")))
    framed = all_words.where("kind is not null").select("document_id", "page", "index_sort", "kind", F.lit(None).cast("string").alias("fixed"))
    inside = all_words.where("kind is null")
    plain = inside.where("place in ('in', 'first')").select("type")
    types = (
        plain.groupBy("type")
        .agg(F.count("*").alias("n"))
        .join(clean_types(docs), "type", "full")
        .select("type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("clean", F.lit(0)).alias("clean"))
        .where("type != ''")
    )
    types = keep(types)
    total = types.agg(F.sum(F.col("n") + F.col("clean"))).first()[0] or 1
    ways = arcs(inside, types, total)
    fields = ("start", "end", "cost", "kind", "fixed", "index_sort", "rest_page", "rest_index", "rest_type", "guessed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_pages(batches):
            out: list[tuple] = []
            for doc, page, own in zip(batch.column("document_id").to_pylist(), batch.column("page").to_pylist(), structs(batch.column("ways"), fields)):
                for w in cheapest(sorted(set(own), key=lambda w: (w[0], w[1], w[2], w[3] or ""))):
                    _, _, _, kind, fixed, index, rest_page, rest, rest_type, guessed = w
                    if kind not in (None, "kept"):
                        out.append((doc, page, index, kind, fixed))
                    # The rest of a divided word is misread if the word that it stands for ends otherwise.
                    if kind in ("hyphen", "kept") and guessed and rest is not None and rest_type and not fixed.endswith(rest_type):
                        out.append((doc, rest_page, rest, "misread", None))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["document_id", "page", "index_sort", "kind", "fixed"])

    listed = ways.groupBy("document_id", "page").agg(F.collect_list(F.struct(*fields)).alias("ways"))
    chosen = listed.mapInArrow(run, "document_id string, page int, index_sort int, kind string, fixed string")
    found = framed.unionByName(chosen)
    order = F.when(F.col("kind") == "misread", 1).otherwise(0)
    return found.groupBy("document_id", "page", "index_sort").agg(F.min_by(F.struct("kind", "fixed"), order).alias("x")).select("document_id", "page", "index_sort", "x.kind", "x.fixed")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy words of all scanned pages with their kind."""
    found = noisy(read(spark, sf_dir, "ocr_words"), read(spark, sf_dir, "parsed_documents"))
    return found.where("kind in ('header', 'page_number', 'hyphen', 'misread')").select("document_id", "page", "index_sort", "kind")


def boundaries(lines: list[tuple[str, int]]) -> list[bool]:
    """For each line (text, block), whether a paragraph begins there.

    Dynamic programming over two states of a line, first of a paragraph or not:
    costs say how unlikely the gap above it, the end of the line before and its
    own beginning are in that state, and how short a paragraph is.
    """
    if not lines:
        return []
    width = max(len(t) for t, _ in lines) or 1
    cost = [[0.0, 0.0] for _ in lines]
    for i, (text, block) in enumerate(lines):
        if i == 0:
            cost[i] = [9.0, 0.0]
            continue
        before, gap = lines[i - 1][0], block != lines[i - 1][1]
        ended = bool(re.search(r"[.!?।॥|。！？:][\"'”’»)\]]*$", before))
        short = len(before) < 0.7 * width
        lower = bool(re.match(r"[a-zß-öø-ÿ,;)]", text)) or before[-1:] in SIGNS
        cost[i][0] += 2.0 * gap + 1.0 * (ended and short) + 0.5 * (short and not lower)
        cost[i][1] += 1.5 * (not gap) + 1.5 * (not ended) + 3.0 * lower + 0.5 * (not short)
    best, back = list(cost[0]), [[0, 0]]
    for own in cost[1:]:
        step, came = [0.0, 0.0], [0, 0]
        for s in (0, 1):
            ways = [best[0], best[1] + (0.3 if s else 0.0)]
            came[s] = 0 if ways[0] <= ways[1] else 1
            step[s] = min(ways) + own[s]
        best = step
        back.append(came)
    state = 0 if best[0] < best[1] else 1
    out = []
    for i in range(len(lines) - 1, -1, -1):
        out.append(state == 1)
        state = back[i][state]
    return out[::-1]


#: Pages of one paragraph that make a row; a paragraph over more pages goes on in the next row.
PART_PAGES = 64


def page_paragraphs(lines: Lines, kinds: dict[int, tuple[str, str | None]], next_lead: str | None) -> list[tuple[str, bool]]:
    """Text of the paragraphs of a page and whether each goes on into the next page.

    ``next_lead`` is the text of the next page's first body line, null if there is none.
    """
    kept = []
    for i, line in enumerate(lines.words):
        left = [w for w in line if kinds.get(w[0], ("",))[0] not in ("header", "page_number")]
        if left:
            kept.append((left, lines.block[i]))
    if not kept:
        return []
    read_ = [(" ".join(t for _, t in x), b) for x, b in kept]
    starts = boundaries(read_)
    # The next page's first line counts as one of another block, as a page end is a gap for every line.
    goes_on = next_lead is not None and not boundaries([*read_, (next_lead, read_[-1][1])])[-1] and not re.search(r"[.!?।॥|。！？:][\"'”’»)\]]*$", read_[-1][0])
    out: list[list[str]] = []
    glue: str | bool = False
    for (line, _), begins in zip(kept, starts):
        if begins and not glue or not out:
            out.append([])
        for w, t in line:
            kind, fixed = kinds.get(w, ("", None))
            if glue == "whole":
                glue = False  # its word stands where it began; marks after it stay
                out[-1].append(re.sub(r"^[\wऀ-ॿ]+(?:['’-][\wऀ-ॿ]+)*", "", t))
                continue
            joined, glue = glue, False
            if kind in ("misread", "split", "merge", "hyphen") and fixed:
                lead = re.match(r"[^\wऀ-ॿ]*", t).group()
                tail = "" if kind in ("hyphen", "merge") else re.search(r"[^\wऀ-ॿ]*$", t).group()
                new = fixed.capitalize() if t[len(lead) : len(lead) + 1].isupper() else fixed
                t = lead + new + tail
                glue = "whole" if kind in ("hyphen", "merge") else False
            elif kind == "hyphen":
                t, glue = re.sub(rf"[{SIGNS}]+$", "", t), "join"
            elif t[-1:] in SIGNS and w == line[-1][0] and divided(t):
                glue = "join"  # the sign stays, the line break goes
            out[-1].append(("" if joined == "join" else " ") + t)
    texts = ["".join(x).strip() for x in out]
    return [(t, goes_on and i == len(texts) - 1) for i, t in enumerate(texts) if t]


def paragraphs(words: DataFrame, docs: DataFrame) -> DataFrame:
    """document_id, page, paragraph, part, text: the repaired text of scanned pages in paragraphs, each where it begins.

    Running heads, feet and page numbers are gone, divided, torn and run-together
    words are mended, misread words replaced where a known word is near. A word
    divided over two pages stands whole on the first. A paragraph goes on over a
    page's end if its last line has no end mark and the next page's first line
    doesn't begin one; every 64 pages of it make a row (part).
    """
    found = keep(noisy(words, docs))
    paged = pages(words)
    marks = found.groupBy("document_id", "page").agg(F.collect_list(F.struct("index_sort", "kind", "fixed")).alias("marks"))
    marked = keep(paged.join(marks, ["document_id", "page"], "left"))

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_pages(batches):
            out = []
            for doc, page, noted, lines in each_page(batch, ("document_id", "page", "marks")):
                gone = {m["index_sort"] for m in noted or [] if m["kind"] in ("header", "page_number")}
                body = next((own for x in lines.words if (own := [w for w in x if w[0] not in gone])), None)
                if body:
                    out.append((doc, page - 1, " ".join(t for _, t in body), body[0][0], body[0][1]))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["document_id", "page", "lead", "lead_index", "lead_word"])

    lead = keep(marked.mapInArrow(leads, "document_id string, page int, lead string, lead_index int, lead_word string"))
    both = marked.join(lead, ["document_id", "page"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_pages(batches):
            out = []
            for doc, page, noted, text, word, lines in each_page(batch, ("document_id", "page", "marks", "lead", "lead_word")):
                kinds = {m["index_sort"]: (m["kind"], m["fixed"]) for m in noted or []}
                own = page_paragraphs(lines, kinds, text)
                body = [w for x in lines.words for w in x if kinds.get(w[0], ("",))[0] not in ("header", "page_number")]
                open_ = bool(body) and word is not None and body[-1][1][-1:] in SIGNS and divided(body[-1][1])
                for n, (t, on) in enumerate(own):
                    last = n == len(own) - 1
                    whole = last and open_ and bool(kinds.get(body[-1][0], ("", None))[1]) and kinds[body[-1][0]][0] == "hyphen"
                    out.append((doc, page, n, t, (on or open_) and last, "whole" if whole else "join" if open_ and last else None))
            kinds_ = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds_)], ["document_id", "page", "paragraph", "text", "goes_on", "glue"])

    pieces = keep(both.mapInArrow(run, "document_id string, page int, paragraph int, text string, goes_on boolean, glue string"))
    # Where a paragraph goes on, the next page's first one belongs to it. Only the edges of pages meet in the window.
    edges = pieces.groupBy("document_id", "page").agg(F.max("paragraph").alias("last"), F.max("goes_on").alias("goes_on"), F.max("glue").alias("glue"))
    w = Window.partitionBy("document_id").orderBy("page")
    from_before = (F.lag("page").over(w) == F.col("page") - 1) & F.lag("goes_on").over(w)
    linked = edges.withColumn("from_before", F.coalesce(from_before, F.lit(False))).withColumn("before_glue", F.when(F.col("from_before"), F.lag("glue").over(w)))
    placed = pieces.join(linked.select("document_id", "page", "from_before", "before_glue", "last"), ["document_id", "page"])
    head = F.col("from_before") & (F.col("paragraph") == 0)
    # The page and paragraph where each piece's paragraph began: the last one before it that isn't a continuation.
    begun = F.last(F.when(~F.col("from_before") | (F.col("last") > 0), F.struct("page", "last")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    origin = linked.withColumn("origin", begun).select("document_id", "page", F.col("origin.page").alias("o_page"), F.col("origin.last").alias("o_last"))
    placed = placed.join(origin, ["document_id", "page"])
    own = placed.select(
        "document_id",
        F.when(head, F.col("o_page")).otherwise(F.col("page")).alias("page"),
        F.when(head, F.col("o_last")).otherwise(F.col("paragraph")).alias("paragraph"),
        F.col("page").alias("at"),
        "text",
        F.when(head, F.coalesce("before_glue", F.lit(""))).alias("glue"),
    )
    part = F.floor((F.col("at") - F.col("page")) / PART_PAGES).cast("int").alias("part")
    listed = own.groupBy("document_id", "page", "paragraph", part).agg(F.array_sort(F.collect_list(F.struct("at", "glue", "text"))).alias("x"))
    rest = lambda y: F.when(y["glue"] == "whole", F.regexp_replace(y["text"], r"^[\p{L}\p{M}\p{N}_]+(?:['’-][\p{L}\p{M}\p{N}_]+)*", "")).when(y["glue"] == "join", y["text"]).otherwise(F.concat(F.lit(" "), y["text"]))
    return listed.select("document_id", "page", "paragraph", "part", F.trim(F.aggregate("x", F.lit(""), lambda acc, y: F.concat(acc, F.when(y["glue"].isNull(), y["text"]).otherwise(rest(y))))).alias("text"))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all scanned pages."""
    return paragraphs(read(spark, sf_dir, "ocr_words"), read(spark, sf_dir, "parsed_documents"))
