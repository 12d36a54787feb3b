"""One form for text that looks alike but differs in its characters (problem 4).

Each token is brought to its ordinary form: invisible characters go, spaces
become plain, composed standard forms replace others, compatibility letters and
digits their plain ones. Then every run of letters is resolved to scripts: the
script sets of its letters are intersected. Where the intersection is empty
(mixed scripts) or holds only a script in which no language of the corpus is
written, the script is taken in which the whole run can be spelled with letters
that look the same, with the fewest changes; a run that can't be spelled so is a
genuine word and stays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .tables import read, spread

#: Letters of other scripts with the Latin letters that they look like.
LOOKS = {
    "Cyrillic": ("аеорсухіјѕһԁԛԝӏѵАВЕКМНОРСТХІЈЅԌԚԜҮЗ", "aeopcyxijshdqwlvABEKMHOPCTXIJSGQWY3"),
    "Greek": ("οναιρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "ovaipukABEZHIKMNOPTYXcj"),
    "Armenian": ("օոսհցԼՕՍ", "onuhgLOU"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᎢᎳᏃ", "ABCDEHJKLMPRTWZ"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
}
#: Further letters of the Latin script that look like plain ones.
LATIN_LOOKS = {"ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ǀ": "l", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s"}
#: Devanagari sequences that look like one vowel letter or sign.
VOWELS = {"अा": "आ", "अो": "ओ", "अौ": "औ", "अॉ": "ऑ", "अॅ": "ॲ", "आे": "ओ", "आै": "औ", "एे": "ऐ", "एॅ": "ऍ", "ाे": "ो", "ाै": "ौ", "ाॅ": "ॉ"}
#: Thai sequences that look like one sign.
THAI = {"เเ": "แ", "ํา": "ำ"}
#: Characters without any look of their own.
INVISIBLE = re.compile("[\u00ad͏\u061cᅟᅠ឴឵᠋-\u180e\u200b\u200e\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f︀-️\ufeff\ufff9-\ufffb]")
JOINER = re.compile("[\u200c\u200d]")
SPACE = re.compile("[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
FRENCH = re.compile("(?<=«)[\u00a0\u202f]|[\u00a0\u202f](?=[»;:!?%])")
SCRIPT_OF = {c: name for name, (own, _) in LOOKS.items() for c in own}
TO_LATIN = {c: x for own, latin in LOOKS.values() for c, x in zip(own, latin)} | LATIN_LOOKS
FROM_LATIN = {name: {x: c for c, x in reversed(list(zip(own, latin)))} for name, (own, latin) in LOOKS.items()}
SEQUENCES = re.compile("|".join(map(re.escape, (VOWELS | THAI))))
LETTERS = re.compile(r"[^\W\d_]+")
#: Any character because of which a token has to be looked at.
ODD = re.compile(
    "[\u00a0\u00adıǀɐ-ʯ̀-ԯԱ-֏\u061cᅟᅠᎠ-᏿\u1680឴឵᠋-\u180eᴀ-ᶿ"
    "\u2000-\u200f\u2028-\u202f\u205f-\u206fⅠ-ⅿ⺀-⿟\u3000゙゚ꓐ-꓿豈-﫿ﬀ-ﬆ︀-️\ufeff"
    "０-９Ａ-Ｚａ-ｚｦ-ﾟ\ufff9-\ufffbक़-य़ऱऴ\U0001d400-\U0001d7ff\U0002f800-\U0002fa1f]|"
    + SEQUENCES.pattern
)
ODD_LETTER = re.compile("[ıǀɐ-ʯͰ-ԯԱ-֏Ꭰ-᏿ᴀ-ᶿꓐ-꓿]")


def script(c: str) -> str:
    """Script of a letter; Han and kana are one, as Japanese mixes them."""
    if c in SCRIPT_OF:
        return SCRIPT_OF[c]
    name = unicodedata.name(c, "").split(" ")[0]
    if name in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HALFWIDTH", "IDEOGRAPHIC"):
        return "Han"
    return {"LATIN": "Latin", "CYRILLIC": "Cyrillic", "GREEK": "Greek", "ARMENIAN": "Armenian", "CHEROKEE": "Cherokee", "LISU": "Lisu"}.get(name, name.title())


def in_script(c: str, target: str) -> str | None:
    """The letter of ``target`` that looks like ``c``, ``c`` itself if it belongs there."""
    own = script(c)
    if own == target:
        return LATIN_LOOKS.get(c, c) if target == "Latin" else c
    latin = c if own == "Latin" else TO_LATIN.get(c)
    if target == "Latin" or latin is None:
        return latin
    return FROM_LATIN.get(target, {}).get(latin)


def _resolve(run: str, used: frozenset[str]) -> str:
    """Spelling of a run of letters in one script."""
    if not ODD_LETTER.search(run):
        return run
    sets = [{script(c)} for c in run]
    common = set.intersection(*sets)
    if common & used and not any(c in LATIN_LOOKS for c in run):
        return run
    if "Han" in set.union(*sets):
        # Words of another script stand in such text without blanks: each stretch is its own word.
        return "".join(m.group() if script(m.group()[0]) == "Han" else _resolve(m.group(), used) for m in _stretches(run))
    best: tuple[int, str] | None = None
    for target in sorted(set.union(*sets) | {"Latin"}, key=lambda s: (s != "Latin", s)):
        if target not in used and len(set.union(*sets)) == 1:
            continue
        spelled = [in_script(c, target) for c in run]
        if None in spelled:
            continue
        changes = sum(a != b for a, b in zip(run, spelled))
        if best is None or changes < best[0] and target in used:
            best = (changes, "".join(spelled))  # type: ignore[arg-type]
    return best[1] if best else run


def _stretches(run: str) -> Iterator[re.Match]:
    return re.finditer("[⺀-鿿豈-﫿ｦ-ﾟ]+|[^⺀-鿿豈-﫿ｦ-ﾟ]+", run)


def _plain(c: str) -> str:
    """Plain form of a compatibility letter or digit."""
    kind = unicodedata.decomposition(c).split(" ")[0]
    if kind in ("<wide>", "<font>", "<narrow>") and unicodedata.category(c)[0] in "LN":
        return unicodedata.normalize("NFKC", c)
    if kind == "<narrow>" and c in "\uff9e\uff9f":
        return unicodedata.normalize("NFKC", c)
    if kind == "<compat>" and ("ﬀ" <= c <= "ﬆ" or "Ⅰ" <= c <= "ⅿ" or "⺀" <= c <= "⿟"):
        return unicodedata.normalize("NFKC", c)
    return c


def _east(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "！" <= c <= "ﾟ"


#: Scripts in which the languages of ``lang_codes`` are written.
USED = frozenset({"Latin", "Devanagari", "Han", "Thai"})


@lru_cache(maxsize=20_000)
def spell(token: str, used: frozenset[str] = USED) -> str:
    """The ordinary form of ``token``; the token itself if it is ordinary."""
    if not ODD.search(token):
        return token
    out = INVISIBLE.sub("", token)
    # A joiner keeps its place only where it shapes letters: after a virama, before a letter.
    out = JOINER.sub(lambda m: m.group() if _shapes(out, m.start()) else "", out)
    kept = {m.start() for m in FRENCH.finditer(out)}
    out = SPACE.sub(
        lambda m: m.group()
        if m.start() in kept or m.group() == "\u3000" and (_east(out[m.start() - 1 : m.start()] or "x") or _east(out[m.end() : m.end() + 1] or "x"))
        else " ",
        out,
    )
    out = "".join(_plain(c) if ord(c) > 0x2000 else c for c in out)
    out = unicodedata.normalize("NFC", out)
    out = SEQUENCES.sub(lambda m: (VOWELS | THAI)[m.group()], out)
    return LETTERS.sub(lambda m: _resolve(m.group(), used), out)


def _shapes(text: str, i: int) -> bool:
    before = text[i - 1 : i]
    after = text[i + 1 : i + 2]
    return bool(before) and unicodedata.combining(before) == 9 and bool(after) and unicodedata.category(after)[0] == "L"


RUN = re.compile(r"[^ \t\r\n]+")
EDGE = re.compile(r"[ \t\r\n]")


def odd_runs(text: str) -> Iterator[tuple[int, str, str]]:
    """Offset, run and ordinary form of each run of ``text`` that isn't ordinary."""
    done = 0
    for m in ODD.finditer(text):
        if m.start() < done:
            continue
        start = max(text.rfind(c, 0, m.start()) for c in " \t\r\n") + 1
        after = EDGE.search(text, m.start())
        done = after.start() if after else len(text)
        run = text[start:done]
        plain = spell(run) if len(run) < 200 else spell.__wrapped__(run)
        if plain != run:
            yield start, run, plain


def scan(docs: DataFrame, key: str = "document_id", text: str = "content") -> DataFrame:
    """Runs of ``text`` that aren't ordinary: key, pos (offset in code points), run, plain.

    Null and empty texts have none. Other columns are left out.
    """
    rows = spread(docs.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for pos, was, plain in odd_runs(t):
                    for col, v in zip(out, (k, pos, was, plain)):
                        col.append(v)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["key", "pos", "run", "plain"])

    return rows.mapInArrow(run, "key string, pos bigint, run string, plain string").withColumnRenamed("key", key)


@F.pandas_udf(StringType())
def plain(words: pd.Series) -> pd.Series:
    """Ordinary form of each word, null for null."""
    return words.map(lambda w: w if w is None else spell(w))


#: What follows a sign at the end of a line.
LINE_END = re.compile(r"[ \t]*(?:[\r\n]|\Z)")


def one_form(text: str | None, scanned: bool = False) -> str | None:
    """A text with every run in its ordinary form; the soft hyphens that end lines of a scanned one are what its page shows, and stay."""
    if not text:
        return text
    out, at = [], 0
    for start, run, form in odd_runs(text):
        out += [text[at:start], form]
        at = start + len(run)
        if scanned and run.endswith("\u00ad") and LINE_END.match(text, at):
            out.append("\u00ad")
    return "".join(out) + text[at:]


@F.pandas_udf(StringType())
def plain_text(texts: pd.Series) -> pd.Series:
    """Texts with every run in its ordinary form, null for null."""
    return texts.map(one_form)


@F.pandas_udf(StringType())
def plain_content(texts: pd.Series, scanned: pd.Series) -> pd.Series:
    """Contents of documents with every run in its ordinary form, null for null."""
    return pd.Series([one_form(t, s) for t, s in zip(texts, scanned)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def plain_words(pages: pd.Series) -> pd.Series:
    """Lists of words with each in its ordinary form, null for null."""
    return pages.map(lambda words: words if words is None else [w if w is None else spell(w) for w in words])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``word_bboxes`` and runs of unscanned contents that aren't written in their ordinary form."""
    words = (
        read(spark, sf_dir, "word_bboxes")
        .select("document_id", F.coalesce("page", F.lit(-1)).alias("page"), F.posexplode("words.text").alias("pos", "word"))
        .where(F.col("word").rlike(r"[^\x00-\x7f]"))
        .dropDuplicates(["document_id", "page", "pos", "word"])
        .where(plain("word") != F.col("word"))
        .select("document_id", "page", F.col("pos").cast("bigint").alias("pos"))
    )
    docs = read(spark, sf_dir, "parsed_documents").where(~F.col("ocr_used"))
    runs = scan(docs).select("document_id", F.lit(0).alias("page"), "pos")
    return words.unionByName(runs).dropDuplicates(["document_id", "page", "pos"])


def p4_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of all documents in one form; one that isn't known to be unscanned keeps the soft hyphens that end its lines."""
    docs = read(spark, sf_dir, "parsed_documents").select("document_id", "content", F.coalesce("ocr_used", F.lit(True)).alias("scanned"))
    return spread(docs).select("document_id", plain_content("content", "scanned").alias("content"))


def p4_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``word_bboxes`` with the texts of their words in one form and all else as it is."""
    pages = spread(read(spark, sf_dir, "word_bboxes").select("document_id", "page", "words")).withColumn("forms", plain_words("words.text"))
    return pages.select("document_id", "page", F.transform(F.arrays_zip("words", "forms"), lambda x: x["words"].withField("text", x["forms"])).alias("words"))
