"""Sentence units of documents in several languages and scripts (problem 2).

A text is first cut into blocks: heading lines, paragraphs, list lines. A line
break divides blocks unless the line was wrapped, that is, unless the next word
would not have fitted into the width of the document's lines. Within a block,
places after an end mark (in Thai, after a space) are candidates; each is decided
by the first rule that matches it in a cascade of tables: the table common to
all, then that of the script before the place, for Latin script that of the
language of the unit up to the place, as its function words tell it. Where they
don't tell, the abbreviations of all these languages hold. A rule is a pair of
regular expressions for the text before and after the place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read, spread

BLANKS = " \t\u00a0\u2007\u202f\u2000-\u2006\u2008-\u200a\u3000"
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f\u202a-\u202e\u2061-\u2064"
CLOSERS = "\"'”’»›）)】」』\\]}"
OPENERS = "\"'“‘„«‹（(【「『\\[{¿¡"
MARKS = ".!?…。！？｡．।॥|¦‖｜।"


@dataclass(frozen=True)
class Rule:
    """Break or don't break where ``before`` ends and ``after`` begins."""

    breaks: bool
    before: re.Pattern
    after: re.Pattern
    whole: bool  # looks at the unit from its beginning, not only at its last characters


#: Characters before a place that rules without a beginning look at; no abbreviation is as long.
TAIL = 28


def _rule(breaks: bool, before: str, after: str = "") -> Rule:
    return Rule(breaks, re.compile(f"(?:{before})\\Z"), re.compile(after), before.startswith("^"))


def _words(words: str) -> str:
    """Any of the blank-separated abbreviations, whole, with its stop; stops inside may be spaced."""
    each = (r"\.\s?".join(re.escape(p) for p in w.split(".")) for w in sorted(words.split(), key=len, reverse=True))
    return rf"(?:^|[^\w])(?:{'|'.join(each)})[{INVISIBLE}]*\.[{INVISIBLE}]*"


#: Abbreviations that never end a sentence, by language.
NEVER = {
    "en": "S e.g i.e cf vs viz Dr Prof Mr Mrs Ms Messrs Hon Rev St Pvt para paras Rs NRs ed eds est approx fig figs sec secs subsec "
    "Sec Secs Art Arts art arts ch Ch vol Vol pp cl Cl reg Reg sched Sched dept Dept Govt Gen Col Capt Lt Maj Sgt Jr ref Ref tel Tel",
    "fr": "M MM Mme Mlle Me al art Art p pp cf Cf n nº vol ex env av bd chap dir Dr Pr tél Tél",
    "de": "d.h z.B u.a i.V i.A Abs Nr S Hr Hrn Fr Dr Prof Art vgl Vgl bzw ca gem lt Ziff Bd Hrsg Str Tel inkl zzgl ggf sog evtl z.T o.g",
    "es": "Sr Sra Srta Sres Dr Dra D Dña art arts Art pág págs núm Núm cap Cap Ud Uds p.ej vol tel Tel",
    "deva": "रु रू नं डा डॉ प्रा श्री सं क्र वि.सं ई.सं ई.पू बि.सं आ.व कि.मि कि.ग्रा मि.मि से.मि कि मि ग्रा वि पृ ले नि मा.वि गा.वि.स न.पा कृ.पृ.उ "
    "ई आ अ.दु.अ.आ पं सु.श्री प्रा.डा एड अधि टे फो मो संख्या.सं लि",
}
#: Abbreviations that may end a sentence.
MAYBE = {
    "en": "etc Ltd Inc Co Corp Bros a.m p.m p.a A.D B.C B.S no No Nos nos Esq Adv LLP",
    "fr": "etc",
    "de": "usw etc n.Chr v.Chr GmbH Mio Mrd",
    "es": "etc S.A S.L a.m p.m",
    "deva": "प्रा.लि इ.स",
}
MONTHS_DE = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Tag Tage Tages Monat Jahr Jahrhundert Kapitel Woche Quartal"
UP = "A-ZÀ-ÖØ-ÞА-ЯΑ-ΩＡ-Ｚ"
#: What may begin a sentence: a capital letter, an opening sign, a provision's number.
START = rf"[{BLANKS}\r\n{INVISIBLE}]*(?:[{OPENERS}]*[{UP}]|[{OPENERS}]|\d+[A-Z]?\.\s|§|[^\W\d_a-zß-öø-ÿ])"

def _latin(*langs: str) -> list[Rule]:
    """Rules of languages in Latin script."""
    never, maybe = (" ".join(x[lang] for lang in langs) for x in (NEVER, MAYBE))
    out = [_rule(False, _words(never))]
    if "en" in langs:
        out += [_rule(False, r"(?:^|[^\w])[Nn]os?\.", r"\s*[\d०-९]"), _rule(True, r"(?:^|[^\w])[Nn]o\.", r"\s")]
    out += [
        _rule(True, _words(maybe), START),
        _rule(False, _words(maybe)),
        _rule(False, r"(?:^|[^\w])[a-zA-Z]\.", r"\s?[a-z]\."),
        # Initials of a name.
        _rule(False, rf"(?:^|[\s.({INVISIBLE}])[{UP}]\.", rf"\s*[{UP}]"),
    ]
    if "de" in langs:  # ordinals
        out.append(_rule(False, r"(?:^|[\s(])\d{1,2}\.", rf"\s+(?:{'|'.join(MONTHS_DE.split())})\b"))
    return out + [
        _rule(True, rf"[{MARKS}][{CLOSERS}{INVISIBLE}]*", r"\s"),
        # The blank after the mark is missing.
        _rule(True, rf"[a-zß-öø-ÿ\d%)][.!?][{CLOSERS}{INVISIBLE}]*", r"[“«„(]?[A-ZÀ-Þ][a-zß-öø-ÿ]*[\s'-]"),
        _rule(True, r"[।॥|‖｜][" + CLOSERS + "]*"),
    ]


TABLES: dict[str, list[Rule]] = {
    "en": _latin("en"),
    "fr": _latin("fr"),
    "de": _latin("de"),
    "es": _latin("es"),
    "latin": _latin("en", "fr", "de", "es"),
    "common": [
        # Marks inside a number, a name of a site, an abbreviation without blanks.
        _rule(False, r"\.", r"[^\sA-ZÀ-Þऀ-ॿ\u3000-鿿“«„(]"),
        # A run of stops that goes on in the same sentence.
        _rule(False, r"(?:\.{2,}|…)[" + CLOSERS + "]*", rf"[{BLANKS}\r\n]*[a-zß-öø-ÿ,;]"),
        # A number or letter that opens a provision.
        _rule(False, rf"^[{OPENERS}{INVISIBLE}]*(?:(?:Art|Sec|Nr|No|art|Artículo|§)\.?[\s{BLANKS}]*)?[\d०-९]+[A-Za-z]?[{INVISIBLE}]*\.[{INVISIBLE}]*", r"\s"),
        _rule(False, rf"^[{INVISIBLE}]*(?:[A-Za-z]|[ivxIVX]{{1,4}}|[क-ह])\.", r"\s"),
        # What is quoted or bracketed goes on with a word of the same sentence.
        _rule(False, rf"[{CLOSERS}][{INVISIBLE}]*", rf"[{BLANKS}\r\n{INVISIBLE}]*[a-zß-öø-ÿ,;:،、，；：]"),
    ],
    "deva": [
        _rule(False, _words(NEVER["deva"] + " " + MAYBE["deva"])),
        _rule(False, r"(?:^|[^\w])[ऀ-ॿ][ा-्ँ-ः]*\.[ऀ-ॿ]{1,3}\."),
        # A question at the start of a sentence, said by someone named after it.
        _rule(False, rf"^[{INVISIBLE}]*[“\"'‘«][^”\"»]*[?!][”\"'’»]", r"\s"),
        _rule(True, rf"[।॥|!?‖¦｜][{CLOSERS}{INVISIBLE}]*"),
        _rule(True, rf"\.[{CLOSERS}{INVISIBLE}]*", r"\s"),
    ],
    "cjk": [
        _rule(False, r"…+"),
        _rule(False, rf"[{CLOSERS}]", r"[とってのをはがもに]"),
        # A question at the start of a sentence, said by someone named after it.
        _rule(False, r"^[“「『\"][^”」』\"]*[？！?!][”」』\"]"),
        _rule(True, rf"[。！？｡!?．][{CLOSERS}{INVISIBLE}]*"),
    ],
    "thai": [
        # Between Thai letters a space stands where clauses meet; beside figures it doesn't.
        _rule(True, r"[ก-ฺเ-๎)”\"" + INVISIBLE + r"][!?.]*", r"[\s]+[(“\"" + INVISIBLE + r"]*[ก-ฺเ-๎]"),
    ],
}

#: The cascade of each script.
CASCADES = {name: TABLES["common"] + rules for name, rules in TABLES.items()}
#: Frequent words that only one of the languages has.
FUNCTION_WORDS = {
    "en": "the of and is shall be by with from this that which was are must or not for an may its under",
    "fr": "le les et est une dans pour que qui par sur au aux du sont ne pas cette doit ou être son",
    "de": "der die das und ist ein eine nicht mit von zu den dem des im auf für wird werden sind hat oder nach",
    "es": "el los las y una por para con del al se es su lo más este debe o ser son están como",
}
_LANGUAGE_OF = {w: lang for lang, own in FUNCTION_WORDS.items() for w in own.split()}
_LOWER_WORD = re.compile(r"[a-zß-öø-ÿ]+")


STOPPED = re.compile(rf"\.[{INVISIBLE}]*\Z")


class Told:
    """The language of a growing piece of text in Latin script by its function words, read once from left to right."""

    def __init__(self, start: int) -> None:
        self.start = self.upto = start
        self.n = {"en": 0, "fr": 0, "de": 0, "es": 0}

    def language(self, text: str, at: int) -> str:
        """The table of ``text`` from the start up to ``at``; "latin" if fewer than two words tell or none leads two to one."""
        end = at
        while end > self.upto and text[end - 1].isalpha() and end < len(text) and text[end].isalpha():
            end -= 1  # a word that goes on is read with the next piece
        for w in _LOWER_WORD.findall(text, self.upto, end):
            if lang := _LANGUAGE_OF.get(w):
                self.n[lang] += 1
        self.upto = max(end, self.upto)
        second, most = sorted(self.n.values())[-2:]
        return max(self.n, key=self.n.__getitem__) if most >= 2 and most >= 2 * second else "latin"


#: A candidate: end marks with what closes after them, or a blank between Thai letters.
CANDIDATE = re.compile(
    rf"[{MARKS}](?:[{INVISIBLE}]*[{MARKS}])*(?:[{INVISIBLE}]*(?:[”’»›）)】」』\]}}]|[{BLANKS}]»|[\"'](?=[\s{INVISIBLE}]|\Z)))*[{INVISIBLE}]*(?:[{BLANKS}]+[।॥|‖](?=\s|\Z))*"
    rf"|(?<=[฀-๿{INVISIBLE})”\"])(?=[ \t\r\n\u00a0\u2007\u202f\u3000])"
)
#: Spans that a break never divides; an unclosed sign opens none.
SPANS = re.compile(
    r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|「[^「」]*」|『[^『』]*』|\"[^\"]*\"|\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]"
)
#: Cyrillic and Greek letters that look like Latin ones; invisible characters.
PLAIN = str.maketrans("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅοναΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTXIJSovaABEZHIKMNOPTYX") | dict.fromkeys(
    [0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, *range(0x202A, 0x202F), *range(0x2061, 0x2065)]
)
LATIN, DEVA, CJK, THAI = "latin", "deva", "cjk", "thai"


def _script(text: str, start: int, end: int) -> str:
    """Table of the last letter before ``end``."""
    for i in range(end - 1, start - 1, -1):
        c = text[i]
        if c.isalpha() or "ऀ" <= c <= "ॿ" or "฀" <= c <= "๿":
            if "ऀ" <= c <= "ॿ":
                return DEVA
            if "฀" <= c <= "๿":
                return THAI
            if "぀" <= c <= "鿿" or "豈" <= c <= "﫿":
                return CJK
            return LATIN
        if "०" <= c <= "९":
            return DEVA
    return LATIN


def fold(text: str) -> str:
    """Plain forms of full-width and look-alike letters, without invisible characters."""
    return unicodedata.normalize("NFKC", text.translate(PLAIN)).replace("...", "…")


def _breaks(text: str, start: int, at: int, end: int, told: Told) -> bool:
    """What the cascade says of the place ``at`` in the unit that began at ``start``."""
    before = text[start:at]
    after = text[at : min(at + 40, end)]
    tail = before[-TAIL:]
    script = _script(text, start, at)
    if script == LATIN and not (tail.isascii() and after.isascii()):
        tail, after = fold(tail), fold(after)
        if len(before) < 40:
            before = tail = fold(before)
    # The languages' tables differ in abbreviations only, which end in a stop.
    if script == LATIN and STOPPED.search(tail):
        script = told.language(text, at)
    for rule in CASCADES[script]:
        if rule.after.match(after) and rule.before.search(before if rule.whole else tail):
            return rule.breaks
    return False


LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)?")
HEADING = re.compile(r"[ \t]*#{1,6}(?=[ \t]|[^#\s])[ \t]*")
RULE_LINE = re.compile(r"[ \t]*(?:-{3,}|\*{3,}|_{3,}|={3,})[ \t]*\Z")
ITEM = re.compile(r"[ \t]*(?:#{1,6}\s|[-*•·]\s)")
ENDED = re.compile(rf"[{MARKS}][{CLOSERS}{INVISIBLE}\s]*\Z")
LOWER = re.compile(rf"[\s{INVISIBLE}]*[a-zß-öø-ÿ,;)]")
#: Scripts that are wrapped at any letter.
UNSPACED = re.compile("[\u0e00-\u0e7f\u3000-\u303f\uff00-\uffef\u3040-\u30ff\u4e00-\u9fff\uf900-\ufaff]")
#: Wrapped lines are no wider; a wider line is a paragraph of its own, and tells nothing of the others.
WIDEST = 110


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Start, end and whether it is a marked heading, of each block of ``text``."""
    lines = []
    for m in LINE.finditer(text):
        if m.end() > m.start():
            body = m.group().rstrip("\r\n")
            lines.append((m.start(), m.start() + len(body), body.rstrip()))
    blank = [not body.strip() or bool(RULE_LINE.match(body)) for _, _, body in lines]
    width = max((len(body) for _, _, body in lines if len(body) <= WIDEST), default=0)
    spaced = any(blank[1:-1])
    inner = sorted(len(x[2]) for x, here, after in zip(lines, blank, blank[1:] + [True]) if not here and not after and len(x[2]) <= WIDEST)
    wide = any(len(body) > WIDEST for _, _, body in lines)
    # Beside wide lines, which weren't wrapped, only what fills the others' width counts as wrapped.
    usual = width if wide else inner[len(inner) // 2] if inner else 0
    start: int | None = None
    for i, (a, b, body) in enumerate(lines):
        if blank[i]:
            continue
        if m := HEADING.match(body):
            yield a + m.end(), b, True
            continue
        if start is None:
            start = a
        soft = i + 1 < len(lines) and not blank[i + 1] and max(len(body), len(lines[i + 1][2])) <= WIDEST and not ITEM.match(lines[i + 1][2])
        if soft and not ENDED.search(body):
            # A short line without an end mark is a heading, or the end of a paragraph.
            word = len(lines[i + 1][2].split(None, 1)[0])
            if wide and UNSPACED.match(lines[i + 1][2].lstrip()):
                word = 1
            if spaced or wide:
                soft = len(body) + 1 + word > 0.6 * usual
            else:
                full = len(body) + 1 + word
                soft = bool(LOWER.match(lines[i + 1][2])) or full > usual and len(inner) > 3 or full > 0.95 * width and 40 <= width <= 95 and word <= 25
        if not soft:
            yield start, b, False
            start = None


def units(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence unit, in code points; none without letters."""
    out: list[tuple[int, int]] = []
    if not text:
        return out

    def add(a: int, b: int) -> None:
        piece = text[a:b]
        lead = len(piece) - len(piece.lstrip())
        piece = piece.strip()
        if any(c.isalnum() for c in piece):
            out.append((a + lead, a + lead + len(piece)))
        elif out and piece and not text[out[-1][1] : a + lead].strip() and "\n" not in text[out[-1][1] : a + lead]:
            # Marks alone belong to the sentence before them.
            out[-1] = (out[-1][0], a + lead + len(piece))

    for start, end, heading in blocks(text):
        if heading:
            add(start, end)
            continue
        spans = [m.span() for m in SPANS.finditer(text, start, end)]
        unit, k = start, 0
        while unit < end and text[unit].isspace():
            unit += 1
        told = Told(unit)
        for m in CANDIDATE.finditer(text, start, end):
            at = m.end()
            if at >= end or at <= unit:
                continue
            while k < len(spans) and spans[k][1] <= m.start():
                k += 1
            if k < len(spans) and spans[k][0] < at < spans[k][1]:
                continue
            if told.start != unit:
                told = Told(unit)
            if _breaks(text, unit, at, end, told):
                add(unit, at)
                unit = at
                while unit < end and text[unit].isspace():
                    unit += 1
        add(unit, end)
    return out if any(c.isalpha() for c in text) else []




SCHEMA = "key string, start_char bigint, end_char bigint"


def split(docs: DataFrame, key: str = "document_id", text: str = "content") -> DataFrame:
    """One row for each sentence unit: ``key``, start_char, end_char.

    Offsets count code points. Null, blank and letterless texts have no units;
    rows that repeat a key are split again, so pass distinct ones. Other columns
    are left out. Texts are never cut: a long one is one row of one task.
    """
    rows = spread(docs.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in units(t):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                ["key", "start_char", "end_char"],
            )

    return rows.mapInArrow(run, SCHEMA).select(F.col("key").cast(docs.schema[key].dataType).alias(key), "start_char", "end_char")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of the documents that were not scanned."""
    docs = read(spark, sf_dir, "parsed_documents")
    return split(docs.where(~F.col("ocr_used")))
