"""Column functions over text: normal forms, metadata, quality, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEVANAGARI_DIGITS, ASCII_DIGITS = "०१२३४५६७८९", "0123456789"


#: Fixed value: the members of a class of all white space, separators of files and records included.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def squeeze(c: Column, white: str = r"(?U)\s") -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{white}+", " "))


def plain_digits(c: Column) -> Column:
    """Devanagari digits as ASCII ones."""
    return F.translate(c, DEVANAGARI_DIGITS, ASCII_DIGITS)


def plain_spaces(c: Column) -> Column:
    """No-break spaces as blanks, byte-order marks removed."""
    return F.regexp_replace(F.translate(c, "  ", "  "), "﻿", "")


def clean_word(c: Column) -> Column:
    """A word without outer and repeated white space; punctuation alone becomes empty."""
    return F.regexp_replace(squeeze(c), r"(?U)^\W+$", "")


def strip_markers(c: Column) -> Column:
    """Text without line markers of the form ->12<-."""
    return F.regexp_replace(c, r"->\s*\d+\s*<-\s*", "")


def first_year(c: Column) -> Column:
    """First year 20xx as a whole word, null if there is none."""
    return F.nullif(F.regexp_extract(c, r"\b(20\d\d)\b", 1), F.lit(""))


def title_year(c: Column, digits: bool = True) -> Column:
    """First 20xx anywhere in a title; with ``digits`` also in Devanagari digits."""
    return F.nullif(F.regexp_extract(plain_digits(c) if digits else c, r"(20[0-9]{2})", 1), F.lit(""))


def section_numbers(c: Column) -> Column:
    """Distinct numbers after Section, Sec. or §, shorter ones first."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)(?:Section|Sec\.?|§)\s*(\d+[A-Z]?)"), F.lit(1)))
    order = lambda a, b: F.when(F.length(a) < F.length(b), -1).when(F.length(a) > F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(found, order)


def chapter_numbers(c: Column) -> Column:
    """Distinct numbers after Chapter or Part in text order of strings."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)(?:Chapter|Part)\s+(\d+[A-Z]?)"), F.lit(1))))


def act_name(c: Column) -> Column:
    """The first run of up to six capitalised words before "Act" in the first 50 lines, null if none."""
    head = F.array_join(F.slice(F.split(c, "\n"), 1, 50), "\n")
    return F.nullif(F.regexp_extract(head, r"((?:[A-Z][a-z]+ ){1,6}Act)\b", 1), F.lit(""))


#: Names of acts, of which the first that a text has counts; blanks stand for any white space.
ACTS = (
    "Income Tax Act|Income Tax",
    "VAT Act|Value Added Tax Act|Value Added Tax",
    "Finance Act|Budget Act",
    "Company Act|Companies Act",
    "Customs Act|Customs",
    "Excise Duty Act|Excise",
    "Social Security Act|Social Security",
    "Banking Act|Banking",
    "Insurance Act|Insurance",
    "Securities Act|Securities",
    "Foreign Exchange Act|Foreign Exchange",
    "Money Laundering Act|Money Laundering",
    "Labor Act|Labour Act|Labor|Labour",
)
#: Last words of names of acts, and words before numbers of sections and of chapters, in Nepali.
NEPALI_ACTS = ("ऐन", "नियमावली", "विनियम", "अध्यादेश")
NEPALI_SECTION = "दफा|उपदफा|अनुच्छेद|खण्ड|परिच्छेद"
NEPALI_CHAPTER = "परिच्छेद|भाग|अध्याय"


def act_patterns(white: str) -> list[str]:
    return [f"(?i)(?:{a})".replace(" ", f"[{white}]+") for a in ACTS]


def act_title(content: Column, name: Column) -> Column:
    """Name of an act: a known one in the file's name, else the file's name if it holds "act", else from the first 50 lines: a Nepali name (in texts with Devanagari), a known one, capitalised words before "Act", any run from a capital on before it. Null if none of them is there."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*\z", ""), r"(?s)^.*[/\\]", "")
    found = lambda c, p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(c, p, 0), rf"^[{WHITE}]+|[{WHITE}]+\z", "")), F.lit(""))
    from_name = [found(stem, p) for p in act_patterns(WHITE)]
    whole = F.when(F.lower(stem).contains("act"), F.initcap(squeeze(F.translate(stem, "_-", "  "), f"[{WHITE}]")))
    head = F.array_join(F.slice(F.split(content, "\n"), 1, 50), "\n")
    nepali = [F.when(content.rlike("[\\u0900-\\u097F]"), found(head, rf"[\u0900-\u097F{WHITE}]+{x}")) for x in NEPALI_ACTS]
    known = [found(head, p) for p in act_patterns(WHITE)]
    loose = [found(head, rf"[A-Z][a-z]+(?:[{WHITE}]+[A-Z][a-z]+){{0,5}}[{WHITE}]+Act"), found(head, rf"[A-Z][A-Za-z{WHITE}]{{3,30}}?[{WHITE}]+Act")]
    return F.coalesce(*from_name, whole, *nepali, *known, *loose)


def nepali_numbers(c: Column, words: str) -> Column:
    """Distinct numbers after words for sections (shorter ones first) or chapters, in whatever digits."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?:{words})[{WHITE}]*(\p{{Nd}}+)"), F.lit(1)))
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), lambda s: s["x"]) if words == NEPALI_SECTION else F.sort_array(found)


def collection_name(c: Column) -> Column:
    """Identifier of a collection: letters, digits and underscores; unknown_act for nothing."""
    bare = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^a-zA-Z0-9\s]", "")))
    return F.coalesce(F.nullif(F.regexp_replace(bare, r"\s+", "_"), F.lit("")), F.lit("unknown_act"))


def script_language(c: Column) -> Column:
    """ne if the text has any Devanagari, else en."""
    return F.when(c.rlike("[\\u0900-\\u097F]"), "ne").otherwise("en")


def code_of_language(c: Column) -> Column:
    """Two-letter code: two letters are kept, known three-letter ones mapped, else the first two letters."""
    low = F.lower(F.trim(c))
    return F.when(F.length(low) == 2, low).when(low == "nep", "ne").when(low == "eng", "en").when(low == "hin", "hi").otherwise(F.substring(low, 1, 2))


def short_title(c: Column) -> Column:
    """Title of a conversation: white space squeezed, cut to 56 characters with an ellipsis."""
    t = squeeze(c)
    return F.when(F.length(t) <= 56, t).otherwise(F.concat(F.substring(t, 1, 53), F.lit("…")))


#: Fixed value: the same class in the SQL that states results.
WHITE_SQL = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def without_markup(c: Column) -> Column:
    """Text without tags, bold, italics, code marks and heading marks wherever they stand, white space squeezed."""
    out = F.regexp_replace(c, r"<[^>]+>", "")
    out = F.regexp_replace(out, r"\*\*([^\n]+?)\*\*", "$1")
    out = F.regexp_replace(out, r"\*([^\n]+?)\*", "$1")
    out = F.regexp_replace(out, r"`([^`]+)`", "$1")
    out = F.regexp_replace(out, rf"#{{1,6}}[{WHITE}]", "")
    return squeeze(out, f"[{WHITE}]")


def without_punctuation(c: Column) -> Column:
    """Text without the punctuation that anchors are compared without, white space squeezed."""
    return squeeze(F.translate(c, "ः।॥(){}[].,:;\"'`", ""))


def same_length_form(c: Column) -> Column:
    """Lower-case text with punctuation as blanks; every character keeps its place."""
    signs = ".,:;()[]{}\"'`।॥"
    return F.lower(F.translate(c, signs, " " * len(signs)))


def number_prefix(c: Column) -> Column:
    """A leading number with up to four words after it."""
    return F.regexp_extract(F.trim(c), r"^([0-9०-९]+[A-Za-z]?[.):]?(?:\s+\S+){0,4})", 1)


def safe_name(c: Column, most: int = 200) -> Column:
    """A file name without characters that file systems forbid."""
    return F.substring(F.regexp_replace(c, r'[<>:"/\\|?*\n\r\t]', "_"), 1, most)


def file_stem(c: Column) -> Column:
    """Title from a path or address: the file's name without suffix, - and _ as blanks."""
    return F.translate(F.regexp_extract(c, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1), "-_", "  ")


def suffix(c: Column) -> Column:
    """Lower-case suffix of the path of an address, without its query."""
    return F.lower(F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"(\.[A-Za-z0-9]+)$", 1))


# --- quality of chunks ------------------------------------------------------


def _count(c: Column, sign: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))


def _open(c: Column, left: str, right: str) -> Column:
    return _count(c, left) > _count(c, right)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def completeness(c: Column) -> Column:
    """1 less what is missing: an end mark, closing brackets, a closing quote, the text of a numbered item."""

    def of(t: Column) -> Column:
        lost = (
            F.when(~t.rlike(r"[.!?;:]\z"), 0.3).otherwise(0.0)
            + F.when(_open(c, "(", ")"), 0.2).otherwise(0.0)
            + F.when(_open(c, "[", "]"), 0.1).otherwise(0.0)
            + F.when(_open(c, "{", "}"), 0.1).otherwise(0.0)
            + F.when(_count(c, '"') % 2 == 1, 0.1).otherwise(0.0)
            + F.when(t.rlike(rf"\n[{WHITE}]*+\p{{Nd}}++[.)]\z"), 0.2).otherwise(0.0)
        )
        return F.when(t == "", 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1.0 - lost), 6))

    return _let(F.regexp_replace(c, rf"[{WHITE}]++\z", ""), of)


def coherence(c: Column) -> Column:
    """From 1: less for words that hardly repeat or more than three different sections, more for repetition and several mentions of sections; 0.5 for short texts."""

    def of(x: Column) -> Column:
        n = F.size(x["words"])
        ratio = x["kinds"] / F.greatest(n, F.lit(1))
        score = (
            F.lit(1.0)
            + F.when(ratio > 0.9, -0.2).when(ratio < 0.6, 0.1).otherwise(0.0)
            + F.when(F.size(x["mentions"]) > 1, 0.1).otherwise(0.0)
            + F.when(F.size(F.array_distinct(x["mentions"])) > 3, -0.2).otherwise(0.0)
        )
        return F.when((F.length(c) < 50) | (n < 10), 0.5).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))

    mentions = F.regexp_extract_all(c, F.lit(rf"(?i)Section[{WHITE}]+(\p{{Nd}}+)"), F.lit(1))
    counted = lambda w: F.struct(w.alias("words"), F.size(F.array_distinct(w)).alias("kinds"), mentions.alias("mentions"))
    words = F.filter(F.split(F.lower(c), rf"[{WHITE}]+"), lambda x: x != "")
    return _let(_let(words, counted), of)


def richness(act: Column, sections: Column, chapters: Column, year: Column) -> Column:
    """Share of the metadata that a chunk has."""
    score = lambda n: (
        F.when(act.isNotNull(), 0.3).otherwise(0.0)
        + F.when(n > 0, 0.4).otherwise(0.0)
        + F.when(n > 1, 0.1).otherwise(0.0)
        + F.when(F.size(chapters) > 0, 0.1).otherwise(0.0)
        + F.when(year.isNotNull(), 0.1).otherwise(0.0)
    )
    return _let(F.size(sections), lambda n: F.round(F.least(F.lit(1.0), score(n)), 6))
