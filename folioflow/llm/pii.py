"""Personal information inside free text and its replacement (problem 8).

Every item is decided by a skip-chain conditional random field over the candidates
of a document. Candidates for addresses of mail and post, phone and identity numbers
come from grammars, those for persons are words that could belong to a name. The
potential of a candidate's label is a log-linear function of its evidence: its
grammar, the label before it, and, fitted on the whole corpus, the shape of a number
(how often numbers of its shape follow labels of each kind) or hashed features of the
form of a word (how much more often they occur in words after cues such as titles).
Neighbours in a name share a potential (chain), and so do equal and similar
candidates anywhere in the document (skip edges): a number that bears its label once
is known wherever it stands. Candidates that overlap exclude one another. Loopy
belief propagation runs on the graphs of all documents of a batch at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .tables import read, spread

# --- grammars ---------------------------------------------------------------

DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
AT = r"(?:\s?[@＠]\s?|\s?[\[(]\s?at\s?[\])]\s?|\sat\s(?=[A-Za-z0-9-]+(?:\sdot\s|\s?[\[(]dot)))"
LOCAL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:(?:\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[A-Za-z0-9_%+-]+)*"
EMAIL = re.compile(rf"{LOCAL}{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)*{DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9])", re.I)
EMAIL_NEAR = re.compile(r"[@＠]|[\[(]\s?at\s?[\])]|\sat\s[A-Za-z0-9-]+\s?[\[( ]\s?dot", re.I)
GLUED = re.compile(r"(?<=[a-z])\.[A-Z][a-z]*\Z")

#: A run of figures with the signs that may divide them, and a letter or two with seven figures. A plus or bracket before the run belongs to it.
FIGURES = re.compile(r"\d(?:(?<![\w.,/+-]\d)|(?<=\+\d)(?<![\w.,/+-]\+\d))[\d ./()\n-]{4,24}\d(?![\w%])")
LETTERED = re.compile(r"[A-Z](?<![\w.,/-][A-Z])[A-Z]? ?\d{7}(?!\w)")
JOINED = re.compile(r"[\w.,/+-]")
COUNTRY = r"(?:(?:\+|00)977[ -]?)?"
PHONE = re.compile(
    rf"{COUNTRY}(?:9[678]\d{{8}}|9[678]\d{{2}}-\d{{2}}-\d{{4}}|9[678]\d-\d{{3}}-\d{{4}}|9[678]\d{{3}}\.\d{{5}}|9[678][ -]\d{{4}}[ -]\d{{4}}|9[678]\d[ -]\d{{7}}"
    rf"|\(0\d{{1,2}}\) ?\d{{6,7}}|0\d{{1,2}}[ -]\d{{6,7}}|(?<=977[ -])[1-9]\d?[ -]\d{{6,7}}|(?<=977)[1-9]\d{{7}})\Z"
)
#: Forms that only identity numbers have.
SURE_ID = re.compile(r"(?:\d{2}-\d{2}-\d{8}|\d{3}-\d{3}-\d{3}-\d|[A-Z]{1,2} ?\d{7})\Z")
#: Forms that identity numbers share with others; they need a label near.
MAYBE_ID = re.compile(r"(?:\d{1,2}[-/]\d{1,2}[-/](?:\d{2}[-/])?\d{4,6}|\d{1,2}/\d{2} ?- ?\d{3,6}|\d{8,11}|\d{3}[- ]\d{3}[- ]\d{3}|\d{2}-\d{2}-\d{2}-\d{5})\Z")
#: Labels of identity numbers.
ID_LABEL = re.compile(
    r"citizenship|passport|reisepass|passeport|pasaporte|licen[cs]e|national\s+id|\bnid\b|\bpan\b|tax\s?payer|tax\s+(?:no|number|id)|identity|personal\s+(?:no|number)"
    r"|the\s+holder\s+of|steuernummer|führerschein|permis\s+de\s+conduire|numéro\s+fiscal|n\.?i\.?f|carné"
    r"|नागरिकता|राहदानी|पासपोर्ट|स्थायी\s+लेखा|अनुमतिपत्र|परिचयपत्र|परिचय\s+पत्र|पहचान\s+पत्र|पैन|लाइसेंस|लाइसेन्स|ना\.?प्र\.?नं|करदाता\s+(?:नं|सं)|护照|身份证|パスポート|หนังสือเดินทาง|บัตรประชาชน",
    re.I,
)
#: Labels of other numbers.
OTHER_LABEL = re.compile(r"(?:isbn|receipt|lot|clause|case|writ|notice|notification|heading|account|tariff|circular|form|volume|invoice|रसिद|मुद्दा|चलानी|शीर्षक|सूचना|वाद|लेखा\s+शीर्ष)\s*(?:no\.?|नं\.?|सं\.?)?\s*\Z", re.I)

NAME = r"[A-Z][a-zà-ÿ]+"
DEVA = r"[ऀ-ॣॱ-ॿ]+"
SEP = r"(?:,[ \t]*\n?[ \t]*|[ \t]*\n[ \t]*)"
SP = r"(?:[ \t]+|[ \t]*\n[ \t]*)"
#: Words for ways, used by the grammar and by the gate before it.
WAYS, D_WAYS = "Marg|Street|Road|Lane|Tole|Apartments|Chowk|Avenue|Path|Municipality", "मार्ग|टोल|गली|सडक|पथ|चोक"
DE_WAYS, FR_WAYS, ES_WAYS = "weg|straße|strasse|gasse|platz|allee", "rue|avenue|place|chemin|boulevard", "Calle|Avenida|Plaza|Camino"
UNIT = rf"(?:House{SP}No\.?{SP}\d+[A-Z]?|Plot{SP}(?:No\.?{SP})?\d+[A-Z]?|Flat{SP}(?:No\.?{SP})?\d*[A-Z]?\d*|Block{SP}[A-Z]\d?|P\.?[ ]?O\.?{SP}Box{SP}(?:No\.?{SP})?\d+|Ward{SP}(?:No\.?{SP})?\d+)"
WAY = rf"(?:(?:\d+[A-Z]?(?:/\d+)?{SP})?{NAME}{SP}(?:(?:{WAYS})(?:(?<=Municipality)-\d+)?))"
TOWN = rf"{NAME}(?:-\d{{1,2}})?(?:[ \t]\d{{5,6}})?"
D_UNIT = r"(?:घर\s?नं\.?\s?\d+|वडा\s?नं\.?\s?\d+|पो\.\s?ब\.\s?नं\.?\s?\d+|मकान\s?(?:सं|नं)\.?\s?\d+(?:/\d+)?|फ्ल्याट\s?(?:नं\.?\s?)?\d+)"
D_WAY = rf"(?:(?:\d+(?:/\d+)?\s)?{DEVA}{SP}(?:{D_WAYS})(?:\s\d+)?|{DEVA}{SP}(?:महानगरपालिका|उपमहानगरपालिका|नगरपालिका|गाउँपालिका)-\d+)"
D_TOWN = rf"{DEVA}(?:-\d{{1,2}})?(?:[ \t]\d{{5,6}})?"
ADDRESS = re.compile(
    rf"(?<!\w)(?:(?:{UNIT}|{WAY})(?:{SEP}(?:{UNIT}|{WAY}))*(?P<town>{SEP}(?!(?:The|A|An|In|No|Name|Phone|PAN|Tel|Email|E|Address|On|At|It|If|For|Any|Every|Who|What|Since|When|Where|Contact|Copy|Dear|Mr|Ms|Dr)\b){TOWN})?"
    rf"|(?:{D_UNIT}|{D_WAY})(?:{SEP}(?:{D_UNIT}|{D_WAY}))*(?P<nagar>{SEP}{D_TOWN})?"
    rf"|{NAME}(?:{DE_WAYS}){SP}\d+[a-z]?{SEP}\d{{5}}{SP}{NAME}"
    rf"|\d+[a-z]?,?{SP}(?:{FR_WAYS}){SP}(?:d[eu]s?{SP})?{NAME}{SEP}\d{{5}}{SP}{NAME}"
    rf"|(?:{ES_WAYS}){SP}(?:del?{SP})?{NAME}{SP}\d+{SEP}\d{{5}}{SP}{NAME})"
)
ADDRESS_NEAR = re.compile(rf"(?:House|Plot|Flat|Block|Box|Ward|{ES_WAYS})\s|{WAYS}|(?:{DE_WAYS})\s+\d|\b(?:{FR_WAYS})\s|घर\s?नं|वडा\s?नं|ब\.\s?नं|मकान|फ्ल्याट|{D_WAYS}|पालिका-")


def emails(text: str) -> list[tuple[int, int]]:
    out = []
    if EMAIL_NEAR.search(text):
        for m in EMAIL.finditer(text):
            end = m.end()
            if g := GLUED.search(m.group()):
                end = m.start() + g.start()
            out.append((m.start(), end))
    return out


_ASCII = str.maketrans("०१२३४५६७८९", "0123456789")


#: A label belongs to a number that begins at most so many characters after the label's end.
REACH = 48
#: Log-odds by what speaks for a number: a form that only identity numbers have, a label, a phone's form; another label, no label.
SURE, LABELLED, DIALLED, OTHERWISE, BARE = 6.0, 4.5, 4.0, -9.0, -5.0


def runs(text: str) -> list[tuple[int, str]]:
    """Start and text of each run of figures, from left to right."""
    lettered = [m.span() for m in LETTERED.finditer(text)]
    out = [(a, text[a:b]) for a, b in lettered]
    own = iter(lettered)
    a, b = next(own, (len(text), len(text)))
    at = 0
    while m := FIGURES.search(text, at):
        start, at = m.start(), m.end()
        while b <= start and b < len(text):
            a, b = next(own, (len(text), len(text)))
        if a < at:
            at = b  # figures of a lettered number
            continue
        before = text[start - 1 : start]
        if before == "+" or before == "(" and not JOINED.match(text[start - 2 : start - 1]):
            start -= 1
        out.append((start, text[start:at]))
    return sorted(out)


def shape(piece: str) -> str:
    """Figures as 9, letters as A, signs as they are."""
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", piece.replace("\n", " ")))


def numbers(text: str) -> list[tuple[int, int, str, float, str]]:
    """Candidates for phone and identity numbers: start, end, kind, log-odds of their evidence, shape."""
    out = []
    for start, raw in runs(text):
        plain = raw if raw.isascii() else raw.translate(_ASCII)
        # A line break or a blank may join two numbers: the longest beginning that is one counts, then the rest.
        at = 0
        while at < len(plain):
            found = None
            spare = None
            for end in [len(plain), *sorted({x.start() + at for x in re.finditer(r"[ \n/.)]", plain[at:])}, reverse=True)]:
                piece = plain[at:end]
                if len(piece) < 6 or end < len(plain) and plain[end].isdigit():
                    continue
                if got := evidence(text, start + at, piece):
                    if got[1] > 0:
                        found = (start + at, start + end, *got, shape(piece))
                        break
                    spare = spare or (start + at, start + end, *got, shape(piece))
            if found:
                out.append(found)
                at = found[1] - start
            elif spare:
                out.append(spare)
            nxt = re.search(r"[ \n]+(?=[+(]?\d)", plain[at:])
            if not nxt:
                break
            at += nxt.end()
    return out


def evidence(text: str, start: int, piece: str) -> tuple[str, float] | None:
    """Kind that a piece could be and the log-odds for it, null if no grammar has it."""
    before = text[max(0, start - REACH) : start]
    one = piece.replace("\n", " ")
    sure, maybe, dialled = SURE_ID.match(one), MAYBE_ID.match(one), PHONE.match(one)
    if not (sure or maybe or dialled):
        return None
    if OTHER_LABEL.search(before):
        return ("phone" if dialled and not sure else "id_number"), OTHERWISE
    if sure:
        return "id_number", SURE
    label = ID_LABEL.search(before)
    if label and maybe and not TOLD.search(before, label.end()):
        return "id_number", LABELLED
    if dialled:
        return "phone", DIALLED
    return "id_number", BARE


#: Labels of phone numbers.
TOLD = re.compile(r"phone|tel\b|tél|फोन|फ़ोन|मोबाइल|mobile|ring|call", re.I)


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    if not ADDRESS_NEAR.search(text):
        return out
    for m in ADDRESS.finditer(text):
        found = m.group()
        parts = re.split(r",|\n", found)
        units = len(re.findall(r"House|Plot|Flat|Box|घर|मकान|ब\.\s?नं|फ्ल्याट", found))
        wards = len(re.findall(r"Ward|वडा|पालिका-\d|Municipality", found))
        ways = len(re.findall(r"Marg\b|Street|Road|Lane|Tole|Apartments|Chowk|Avenue|मार्ग|टोल|गली|सडक|पथ|weg|straße|strasse|gasse|platz|allee|rue|avenue|place|chemin|boulevard|Calle|Avenida|Plaza|Camino", found))
        end = m.end()
        town = m.span("town") if m.group("town") else m.span("nagar") if m.group("nagar") else None
        if town and re.search(r"Municipality|पालिका-", found[: town[0] - m.start()]) and re.search(r"Tole|टोल", found[: town[0] - m.start()]):
            # From a town to a quarter: complete without another town.
            end, town = town[0], None
            parts = parts[:-1]
        if town and m.group("town") and "\n" in text[town[0] : town[1]] and not re.match(r"[ \t]*(?:$|[,;.\n])", text[end : end + 2] or "\n") and not re.search(r"\d", text[town[0] : town[1]]):
            end = town[0]
        if len(parts) < 2 or not (units or ways and (town or wards or re.search(r"\d{5}", found))):
            continue
        if not units and not ways:
            continue
        out.append((m.start(), end))
    return out


# --- names ------------------------------------------------------------------

#: What stands before a name, in Latin letters and in Devanagari; both begin only where a word does.
CUES_LATIN = re.compile(
    r"(?<!\w)(?=[A-Zacimp])(?:(?:Mr|Mrs|Ms|Dr|Prof|Adv|Hr|Sr|Sra|Dra|Mme|Mlle|M|Er|Shri|Smt)\.?|Frau|Herrn?|Name\s?:|Contact(?:o)?\s?:|Ansprechpartner(?:in)?\s?:|issued\s+to|complaint\s+of|parcel\s+for"
    r"|ausgestellt\s+auf|au\s+nom\s+de|a\s+nombre\s+de|match\s+the\s+name|particulars\s+—|Dear|Power\s+of\s+attorney\s?:|in\s+favour\s+of|Yours\s+(?:faithfully|sincerely|truly),)\s+"
)
CUES_DEVA = re.compile(
    r"(?<![ऀ-ॿ])(?=[शसडपनबभआगव])(?:श्री(?:मती)?|सुश्री|डा\.|डॉ\.|प्रा\.|प्रो\.|नाम\s?:|सम्पर्क\s?:|संपर्क\s?:|बोधार्थ\s?:|भएकी|बस्ने|आवेदक|गवाह|निवेदक|साक्षी:?)\s+"
)
DEVA_LETTER = re.compile("[क-ह]")


def cue_ends(text: str) -> list[int]:
    """Where a name may begin: after each cue."""
    out = [m.end() for m in CUES_LATIN.finditer(text)]
    if not text.isascii() and DEVA_LETTER.search(text):
        out += [m.end() for m in CUES_DEVA.finditer(text)]
    return out


#: Words after which no name follows, or that aren't part of one, although written like it.
NOT_NAMES = frozenset(
    "the a an and of for to in on at by or nor if any every who what which when where since although provided nothing no not each both we i you it is are was were "
    "mr mrs ms dr prof adv messrs hr frau herr sr sra mme shri smt act section sec art article chapter part schedule annex rule clause form notice case lot page box ward house plot flat block "
    "board office department tribunal registrar secretary minister officer auditor director general chief court bank committee council unit bureau commission authority treasury fund cell ministry "
    "marg street road lane tole apartments municipality traders pvt ltd pan phone tel email name address contact passport national id citizenship licence taxpayer copy "
    "january february march april may june july august september october november december".split()
)
COMPANY = re.compile(r"\s+(?:Traders|Pvt|Ltd|Limited|Company|Co\.|Bank|Industries|ट्रेडर्स|Municipality|नगरपालिका|नगर\s+निगम|Marg|Street|Road|Lane|Tole|Apartments|मार्ग|टोल|गली)")
#: Postpositions that are written together with a word.
POST = re.compile(r"(?:ले|लाई|को|का|की|मा|बाट|सँग|बीच|द्वारा|प्रति|लगायत|समेत)\Z")
#: Those of them that no name ends in.
SURE_POST = re.compile(r"(?:ले|लाई|बीच|सँग|बाट|द्वारा)\Z")
#: A French title, not an initial.
FRENCH = re.compile(r"\s(?:et|a|ont|est|sera)\s|,\s(?:domicili|demeurant|né)")
WORD = re.compile(r"[A-Z][a-zà-ÿ]+|[A-Z]{3,}|[A-Z]\.(?=\s?[A-Z])|[ऀ-ॣॱ-ॿ]{3,}")
FEATURES = 1 << 19
#: Log-odds: a cue before a word, and after none; two neighbours in one name; two equal words.
CUE, BASE, CHAIN, SKIP = 5.0, -1.8, 1.8, 0.9
#: Words below this are no nodes.
LEAST = -2.5
#: A word beside a name belongs to it down to this belief.
BESIDE = -1.5
#: Share of the occurrences after a cue, of words of names and of others.
NAMED, OTHERS = 0.35, 0.003
ROUNDS = 6


def hashed(texts: list[str]) -> np.ndarray:
    """Bucket of each text by a multiplicative hash over its bytes, all texts at once."""
    data = [t.encode() for t in texts]
    sizes = np.array([len(x) for x in data])
    width = int(sizes.max(initial=0))
    signs = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in data), np.uint8).reshape(len(data), width) if width else np.zeros((len(data), 0), np.uint8)
    h = np.full(len(data), 2166136261, np.uint64)
    for i in range(width):
        step = ((h ^ signs[:, i]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
        h = np.where(sizes > i, step, h)
    return ((h ^ (h >> np.uint64(15))) % np.uint64(FEATURES)).astype(np.int64)


def form_features(words: list[str]) -> np.ndarray:
    """Buckets of the whole, the last and the first letters of words, a row each."""
    low = [w.casefold() for w in words]
    return np.stack([hashed(["=" + w for w in low]), *(hashed([f"${n}" + w[-n:] for w in low]) for n in (4, 3, 5)), hashed(["^3" + w[:3] for w in low])], axis=1)


def cued(text: str) -> Iterator[str]:
    """Words of the names after cues: as far as words of a name's form go on, in Devanagari, where all words have that form, two."""
    for at in cue_ends(text):
        k = 0
        while w := WORD.match(text, at):
            word = w.group()
            if word.casefold() in NOT_NAMES:
                break
            if (post := SURE_POST.search(word)) and post.start() >= 3:
                yield word[: post.start()]
                break
            if not word.endswith("."):
                yield word
            at = w.end()
            if not re.match(r"\s", text[at : at + 1]) or "ऀ" <= word[0] <= "ॿ" and k == 1:
                break
            at += 1
            k += 1


def fit(docs: DataFrame, text: str = "text") -> Field:
    """The field with its potentials fitted on all documents: counts of features in words of names after cues and in all words, of shapes of numbers by label; a fixed number of rows."""
    rows = spread(docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")), 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: Counter[str] = Counter()
        words: Counter[str] = Counter()
        ids: Counter[str] = Counter()
        others: Counter[str] = Counter()
        total = np.zeros((FEATURES, 2), np.int64)

        def empty() -> None:
            for k, c in ((0, names), (1, words)):
                if c:
                    np.add.at(total[:, k], form_features(list(c)), np.array(list(c.values()))[:, None])
                c.clear()
            for k, c in ((0, ids), (1, others)):
                if c:
                    np.add.at(total[:, k], hashed(["#" + x for x in c]), np.array(list(c.values())))
                c.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                names.update(cued(t))
                words.update(WORD.findall(t))
                for _, _, kind, odds, form in numbers(t):
                    if odds == LABELLED:
                        ids[form] += 1
                    elif odds == OTHERWISE or kind == "phone":
                        others[form] += 1
            if len(words) > 300_000:
                empty()
        empty()
        used = np.flatnonzero(total.any(axis=1))
        for i in range(0, len(used), 20_000):
            part = used[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part, 0]), pa.array(total[part, 1])], ["bucket", "names", "words"])

    sums = rows.mapInArrow(run, "bucket bigint, names bigint, words bigint").groupBy("bucket").agg(F.sum("names").alias("names"), F.sum("words").alias("words"))
    got = sums.toPandas()  # at most FEATURES rows
    n = np.zeros((FEATURES, 2), np.int64)
    n[got["bucket"]] = got[["names", "words"]].to_numpy()
    return Field(n)


#: Fields by application and folder, so that finding and redacting share one fit.
_FITTED: dict[tuple[str, str], Field] = {}


def fitted(spark: SparkSession, sf_dir: str) -> Field:
    """The field fitted on the documents of ``sf_dir``, once an application."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _FITTED:
        _FITTED[at] = fit(read(spark, sf_dir, "documents"))
    return _FITTED[at]


class Field:
    """Labels the candidates of batches of texts. Sent to tasks as it is; what it remembers of word types stays with the worker."""

    def __init__(self, counts: np.ndarray):
        self.names, self.words = counts[:, 0], counts[:, 1]
        self.prior = max((self.names.sum() + 1) / (self.words.sum() + 10), 1e-6)
        self.memory: dict[str, float] = {}
        self.types: dict[str, tuple[float, int]] = {}
        self.shapes: dict[str, float] = {}

    def __reduce__(self):
        used = np.flatnonzero((self.names != 0) | (self.words != 0))
        return _field, (used, self.names[used], self.words[used])

    def learn(self, words: set[str]) -> None:
        """Scores word types that weren't seen yet, all at once."""
        if len(self.types) > 400_000:
            self.types.clear()
        new = [w for w in words if w not in self.types and w[-1] != "."]
        stems = {w: w[: p.start()] for w in new if "ऀ" <= w[0] <= "ॿ" and (p := POST.search(w)) and p.start() >= 3}
        self.score([*new, *stems.values()])
        for w in new:
            score, cut = self.memory[w], 0
            if w in stems:
                stem = self.memory[stems[w]]
                if stem > score + 0.5 or stem > 0 and SURE_POST.search(w):
                    score, cut = stem, len(w) - len(stems[w])
            self.types[w] = score + BASE, cut

    def score(self, words: list[str]) -> None:
        """Log of the rate of names among words of each form against the usual rate."""
        if len(self.memory) > 400_000:
            self.memory.clear()
        new = list({w for w in words if w not in self.memory})
        if not new:
            return
        at = form_features(new)
        k, n = self.names[at[:, 1:]], self.words[at[:, 1:]]
        rate = np.where(n > 0, np.log((k + 0.2 * self.prior) / (n + 0.2) / self.prior), 0.0)
        known = (n > 0).sum(axis=1)
        got = np.clip(rate.sum(axis=1) / np.maximum(known, 1), -4.0, 4.0)
        k1, n1 = self.names[at[:, 0]], self.words[at[:, 0]]
        own = k1 * np.log(NAMED / OTHERS) + (n1 - k1) * np.log((1 - NAMED) / (1 - OTHERS))
        got = got + np.clip(0.5 * own, -6.0, 5.0)
        for w, v in zip(new, got.tolist()):
            self.memory[w] = -9.0 if w.casefold() in NOT_NAMES else v

    def of_shape(self, form: str) -> float:
        """Log-odds of an identity number by the shape of a number, between -2 and 2."""
        if form not in self.shapes:
            at = hashed(["#" + form])[0]
            self.shapes[form] = float(np.clip(np.log((self.names[at] + 1) / (self.words[at] + 1)), -2.0, 2.0))
        return self.shapes[form]

    def candidates(self, text: str) -> list[tuple[int, int, str, float, str]]:
        """Candidates that have grammars: start, end, kind, log-odds, and what equal ones share."""
        plain = lambda a, b: " ".join(text[a:b].casefold().split())
        out = [(a, b, "email", MAILED, plain(a, b)) for a, b in emails(text)]
        out += [(a, b, "address", POSTED, plain(a, b)) for a, b in addresses(text)]
        for a, b, kind, odds, form in numbers(text):
            fitted_ = self.of_shape(form)
            out.append((a, b, kind, odds + (fitted_ if kind == "id_number" else -fitted_) * (0.0 if odds == OTHERWISE else 0.5), re.sub(r"\D", "", text[a:b].translate(_ASCII))))
        return out

    def nodes(self, text: str, found: list[re.Match], taken: list[tuple[int, int]]) -> list[tuple[int, int, float, str]]:
        """start, end, unary log-odds and type of the words that could be part of a name."""
        cue_at = set(cue_ends(text))
        out: list[tuple[int, int, float, str]] = []
        types, low = self.types, LEAST - CUE
        for m in found:
            word = m.group()
            if word[-1] == ".":
                score, cut = 0.0, 0
            else:
                score, cut = types[word]
                if score <= low:
                    continue
            start = m.start()
            if start in cue_at:
                score += CUE
            if score <= LEAST or any(a <= start < b for a, b in taken):
                continue
            if word[-1] == ".":
                out.append((start, m.end(), 0.0, ""))
            elif not COMPANY.match(text, m.end()):
                end = m.end() - cut
                out.append((start, end, score, text[start:end].casefold()))
        return out

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """The items of each text: start, end, kind."""
        spans: list[tuple[int, int, int]] = []
        unary: list[float] = []
        edges: list[tuple[int, int, float]] = []
        apart: list[tuple[int, int, float]] = []
        pulls: list[tuple[int, int, float]] = []
        words = [list(WORD.finditer(t)) for t in texts]
        self.learn({m.group() for own in words for m in own})
        fixed = [self.candidates(t) for t in texts]
        for d, (text, own, ruled) in enumerate(zip(texts, words, fixed)):
            found = self.nodes(text, own, [(a, b) for a, b, _, odds, _ in ruled if odds > 0])
            last: dict[str, int] = {}
            near: dict[str, tuple[int, str]] = {}
            for i, (start, end, score, kind) in enumerate(found):
                at = len(spans)
                if i and (gap := text[found[i - 1][1] : start]) in (" ", "\n", ", ", ",\n"):
                    edges.append((at - 1, at, CHAIN if "," not in gap else 0.5 * CHAIN))
                if kind:
                    if kind in last:
                        edges.append((last[kind], at, SKIP))
                    elif len(kind) > 4 and (other := near.get(kind[:4])) and abs(len(other[1]) - len(kind)) < 3:
                        edges.append((other[0], at, LIKE))
                    last[kind] = at
                    near[kind[:4]] = at, kind
                spans.append((d, start, end))
                unary.append(score)
        first = len(spans)
        for d, ruled in enumerate(fixed):
            equal: dict[str, list[int]] = {}
            placed: list[tuple[int, int, int]] = []
            for start, end, kind, odds, same in ruled:
                at = len(unary)
                equal.setdefault(kind + same, []).append(at)
                apart += [(other, at, APART) for other, a, b in placed if a < end and start < b]
                placed.append((at, start, end))
                unary.append(odds)
            for own in equal.values():
                # Equal candidates take from the one with the strongest evidence; lack of evidence is passed to none.
                best = max(own, key=unary.__getitem__)
                if unary[best] > 0:
                    pulls += [(best, at, -AGAIN) for at in own if at != best]
        belief = propagate(np.array(unary), edges, apart + pulls)
        persons = decode(texts, spans, belief[:first])
        out, at = [], first
        for ruled, own in zip(fixed, persons):
            kept = chosen(ruled, belief[at : at + len(ruled)])
            at += len(ruled)
            out.append(sorted([*kept, *((a, b, "person") for a, b in own)]))
        return out


#: Log-odds of what the grammars of mail and post match; of equal candidates, and words alike in their first four letters, having one label; of overlapping ones excluding one another.
MAILED, POSTED, AGAIN, LIKE, APART = 8.0, 6.0, 6.0, 0.3, 6.0


def _field(used: np.ndarray, names: np.ndarray, words: np.ndarray) -> Field:
    counts = np.zeros((FEATURES, 2), np.int64)
    counts[used, 0], counts[used, 1] = names, words
    return Field(counts)


def chosen(ruled: list[tuple[int, int, str, float, str]], belief: np.ndarray) -> list[tuple[int, int, str]]:
    """Candidates labelled as items; of overlapping ones the mail address, then the postal one, the identity number, the phone."""
    order = {"email": 0, "address": 1, "id_number": 2, "phone": 3}
    out: list[tuple[int, int, str]] = []
    for item, odds in sorted(zip(ruled, belief), key=lambda x: (order[x[0][2]], x[0][0])):
        if odds > 0 and all(item[1] <= x[0] or item[0] >= x[1] for x in out):
            out.append(item[:3])
    return out


def propagate(unary: np.ndarray, edges: list[tuple[int, int, float]], apart: list[tuple[int, int, float]] = ()) -> np.ndarray:
    """Beliefs (log-odds) by sum-product on a pairwise binary field: ``edges`` favour equal labels, ``apart`` not both being items, or both where the weight is negative."""
    if not len(unary) or not (edges or apart):
        return unary
    a, b, j = (np.array(x) for x in zip(*edges, *apart))
    src, dst, weight = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([j, j])
    alike = np.arange(len(a)) < len(edges)
    alike = np.concatenate([alike, alike])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros(len(src))
    for _ in range(ROUNDS):
        belief = unary + np.bincount(dst, message, len(unary))
        h = belief[src] - message[back]
        new = np.where(alike, np.logaddexp(weight + h, -weight) - np.logaddexp(h - weight, weight), np.logaddexp(h - weight, 0) - np.logaddexp(h, 0))
        message = 0.5 * message + 0.5 * new
    return unary + np.bincount(dst, message, len(unary))


def decode(texts: list[str], spans: list[tuple[int, int, int]], belief: np.ndarray) -> list[list[tuple[int, int]]]:
    """Names: runs of words labelled so, initials between or before them included."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    sure = belief > 0
    yes = belief > BESIDE
    n = len(spans)
    i = 0
    while i < n:
        d, start, end = spans[i]
        text = texts[d]
        initial = end - start == 2 and text[end - 1] == "."
        if not yes[i] and not initial:
            i += 1
            continue
        run = [i]
        j = i + 1
        while j < n and spans[j][0] == d:
            gap = text[spans[run[-1]][2] : spans[j][1]]
            if gap == "\n" and text[spans[j][1] : spans[j][2]] == text[start : spans[run[0]][2]]:
                break  # the same name once more in the next line
            more = spans[j][2] - spans[j][1] == 2 and text[spans[j][2] - 1] == "."
            if gap in (" ", "\n") and (yes[j] or more):
                run.append(j)
                j += 1
            else:
                break
        while run and text[spans[run[-1]][2] - 1] == "." and len(run) and spans[run[-1]][2] - spans[run[-1]][1] == 2:
            run.pop()
        if not any(sure[r] and text[spans[r][2] - 1] != "." for r in run):
            i = max(j, i + 1)
            continue
        end = spans[run[-1]][2]
        if len(run) > 1 and text[spans[run[0]][1] : spans[run[0]][2]] == "M." and FRENCH.match(text, end):
            run = run[1:]
        start = spans[run[0]][1]
        # "Surname, Given": one word, a comma, and a given name with nothing else before the comma.
        if len(run) == 1 and j < n and spans[j][0] == d and yes[j] and text[end : spans[j][1]] in (", ", ",\n") and text[spans[j][2] - 1] != ".":
            after = spans[j]
            nxt = j + 1
            more = nxt < n and spans[nxt][0] == d and yes[nxt] and text[after[2] : spans[nxt][1]] in (" ", "\n")
            if not more or text[after[2] : spans[nxt][1]] == "\n":
                end = after[2]
                j = nxt
        out[d].append((start, end))
        i = max(j, i + 1)
    return out


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """key, start_char, end_char, kind of each item in ``text``; offsets count code points.

    Null and empty texts have none; repeated rows are searched again. Texts are
    never cut. Other columns are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(field or fit(docs, text))
    rows = spread(docs.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = held.value
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(texts), 500):
                out: list[list] = [[], [], [], []]
                for k, items in zip(keys[i : i + 500], label(texts[i : i + 500])):
                    for a, b, kind in items:
                        for col, v in zip(out, (k, a, b, kind)):
                            col.append(v)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["key", "start_char", "end_char", "kind"])

    found = rows.mapInArrow(run, "key string, start_char bigint, end_char bigint, kind string")
    return found.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "start_char", "end_char", "kind")


def redact(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with placeholders such as [EMAIL] for the items in ``text``; all else stays, null stays null."""
    held = docs.sparkSession.sparkContext.broadcast(field or fit(docs, text))

    @F.pandas_udf(StringType())
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        label = held.value
        for s in batches:
            texts = s.fillna("").tolist()
            out = []
            for t, items in zip(texts, label(texts)):
                parts, at = [], 0
                for a, b, kind in items:
                    parts += [t[at:a], f"[{kind.upper()}]"]
                    at = b
                out.append("".join(parts) + t[at:])
            yield pd.Series(out, dtype=object).where(s.notna().to_numpy(), None)

    return docs.withColumn(text, clean(F.col(text)))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal items in the texts of all documents."""
    return find(read(spark, sf_dir, "documents"), field=fitted(spark, sf_dir))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with placeholders for personal items."""
    return redact(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), field=fitted(spark, sf_dir))
