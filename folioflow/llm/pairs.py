"""Defective prompt and response pairs (problem 5).

Copies are found by compression: the response is compressed with its prompt as a
zstandard dictionary, and the prompt with the response; both come out tiny only
if each gives the other and no more. Empty answers and refusals are recognised
with dictionaries, languages with the model of ``language``. Whether a response
breaks off is decided by its end: open quotes and brackets, abbreviations that
can't end a sentence, and, without an end mark, a terminal-context model: how
often its last words end a sentence in all answers of the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizes import small
from .language import TEMPER, Model, model_for
from .sentences import MARKS, NEVER, _words, units
from .tables import keep, read

#: Words that stand for nothing, as a whole answer.
NOTHING = {"null", "none", "n/a", "na", "nil", "nan", "undefined", "empty", "no answer", "keine", "néant", "ninguno", "कुनै छैन", "शून्य", "无", "なし", "ไม่มี"}
#: Labels before an answer or a repeated question.
LABELS = re.compile(
    r"\A\s*(?:final answer|answer|response|reply|a|antwort|réponse|respuesta|उत्तर|जवाफ|答案|答|回答|คำตอบ)\s*[:：.]\s*", re.I
)
ASKED = (
    "question query q you asked your question your question was the question is frage ihre frage question votre question pregunta su pregunta "
    "प्रश्न तपाईंको प्रश्न आपका प्रश्न 问题 質問 คำถาม"
)
CITE = re.compile(r"\[\s*(?:CITE\s*:[^\]\n]*|\d{1,3}(?:\s*,\s*\d{1,3})*|c\d+)\s*\]", re.I)
TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>|&nbsp;")
MARKUP = re.compile(r"```\w*|[*`#>|~_]+")

#: Sentences that decline or say that nothing was found.
REFUSAL = re.compile(
    r"""
    (?:i(?:'|’)?m|i\s+am|i\s+was)\s+(?:not\s+able|unable|not\s+allowed|not\s+permitted)\s+to
    |\bi\s+(?:cannot|can\s?not|can(?:'|’)t|could\s+not|couldn(?:'|’)t|won(?:'|’)t|will\s+not|may\s+not|must\s+not)\s+
      (?:\w+\s+){0,2}?(?:help|assist|answer|respond|reply|discuss|comment|provide|give|offer|share|find|go\s+into|advise|say|tell|comply)
    |\bi\s+don(?:'|’)t\s+(?:have\s+(?:enough|any|the|sufficient)|know|feel\s+able)
    |\bi\s+(?:must|have\s+to|would\s+have\s+to)\s+(?:decline|refuse|pass)|\bi(?:'|’)ll\s+have\s+to\s+pass|\bi\s+decline
    |\bi(?:'|’)d\s+rather\s+not|\bi\s+would\s+rather\s+not
    |not\s+something\s+(?:that\s+)?i\s+(?:can|may|am)|outside\s+(?:of\s+)?(?:what\s+i|my)|beyond\s+(?:my|what\s+i)|off[\s-]limits\s+for\s+me
    |(?:my|our)\s+(?:policy|policies|guidelines|instructions|rules)\s+(?:prevents?|forbids?|prohibits?|do(?:es)?\s+not\s+allow)
    |(?:not\s+(?:be\s+)?(?:appropriate|possible|right)|inappropriate|impossible)\s+for\s+(?:me|us)\s+to
    |nothing\s+in\s+(?:my|the)\s+(?:sources|documents|index)|no\s+(?:answer|reply|response)\s+can\s+be\s+(?:offered|given|provided)
    |(?:documents?|sources|sections|context)\s+(?:\w+\s+){0,3}?(?:do|does)\s+not\s+(?:mention|contain|say|cover)
    |no\s+(?:relevant\s+)?(?:results?|information|documents?|sections?|matches)\s+(?:\w+\s+){0,2}?(?:found|available|matched)
    |nothing\s+(?:relevant\s+|suitable\s+)?(?:was|were|could\s+be)\s+found|\bno\s+can\s+do\b|\bas\s+an?\s+(?:ai|assistant)\b.*\b(?:cannot|can(?:'|’)t)
    |nicht\s+(?:be)?antworten|keine\s+(?:auskunft|antwort|angaben)\s+(?:\w+\s+)?(?:geben|erteilen|machen)|darf\s+ich\s+nicht|nichts\s+gefunden|kann\s+ich\s+(?:\w+\s+){0,3}nicht\s+helfen
    |je\s+ne\s+(?:peux|suis|saurais|puis)\s+(?:pas\s+)?|rien\s+(?:n(?:'|’)a\s+été\s+)?trouvé|impossible\s+de\s+répondre|aucune?\s+(?:information|résultat|réponse)
    |no\s+(?:puedo|me\s+es\s+posible|estoy)\b|no\s+se\s+(?:encontr|hall)|no\s+(?:hay|tengo)\s+información
    |(?:उत्तर|जवाफ|जानकारी|सल्लाह|सल्लाहा|सहयोग|सहायता|टिप्पणी|केही\s+भन्न|भन्न)\s*(?:\S+\s+){0,3}?(?:दिन\s+|गर्न\s+|दिने\s+)?(?:सक्दिनँ|सक्दिन|सकिँदैन|सकिएन|सक्दैन|मिल्दैन|असमर्थ|हुँदैन|सम्भव\s+छैन|उपयुक्त\s+हुँदैन)
    |केही\s+भन्न\s+(?:सक्दिनँ|सक्दिन|मिल्दैन)|(?:जवाफ|जानकारी|उत्तर)\s+(?:म\s*सँग\s+)?छैन|क्षेत्रभन्दा\s+बाहिर|उल्लेख\s+न(?:भएक|हुन|गरिएक)
    |(?:भेटिएन|पाइएन|फेला\s+परेन|भेटिनँ)|असमर्थ\s+(?:छु|छौं|हूँ|हूं|हैं)|सल्लाह\s+दिन\s+(?:मिल्दैन|सक्दिनँ)
    |(?:उत्तर|जवाब|जानकारी|सलाह|सहायता|मदद|टिप्पणी)\s+(?:\S+\s+){0,3}?(?:नहीं\s+(?:दे|कर|है)|संभव\s+नहीं|सम्भव\s+नहीं|असमर्थ)|उल्लेख\s+नहीं\s+है|नहीं\s+मिल[ाी]|कुछ\s+नहीं\s+कह\s+सकत
    |(?:无法|不能|没有?办法)\s*(?:回答|提供|协助|帮助)|(?:没有|未)找到|抱歉|(?:お答え|回答|お手伝い)(?:は)?(?:でき|いたしかね)|見つかりません|申し訳
    |ไม่สามารถ(?:ตอบ|ให้|ช่วย)|ไม่พบ(?:ข้อมูล|เอกสาร)|ขออภัย
    """,
    re.I | re.X,
)
#: What a refusal may have around it.
COURTESY = re.compile(
    r"""\A\W*(?:
    (?:please|kindly)\s.*|(?:a|an)\s+(?:qualified|professional)\s.*|is\s+there\s+anything\s+else.*|(?:you\s+(?:may|might|could)\s+)?(?:try|ask|consult|contact|rephrase)\b.*
    |thanks?\b.*|thank\s+you.*|(?:i(?:'|’)m|i\s+am|we\s+are)?\s*(?:very\s+|so\s+)?sorry(?:\s+about\s+that)?|apologies|unfortunately|regrettably|hmm
    |(?:let\s+me\s+know|feel\s+free).*|bitte\s.*|leider|veuillez.*|désolée?|merci.*|por\s+favor.*|lo\s+siento|gracias.*
    |कृपया.*|अरू\s+केही.*|अरु\s+केही.*|धन्यवाद.*|(?:माफ|क्षमा)\s*(?:गर्नुहोस्|पाऊँ|करें|कीजिए)?|दुःखका\s+साथ.*|खेद\s+है|और\s+कुछ.*
    |请.*|对不起|すみません|ほかに.*|กรุณา.*
    )\W*\Z""",
    re.I | re.X | re.S,
)
#: Names of languages in requests for one.
LANGUAGE_NAMES = {
    "en": "english|englisch|anglais|inglés|अंग्रेजी|अङ्ग्रेजी|अंग्रेज़ी|英语|英文|英語|ภาษาอังกฤษ",
    "ne": "nepali|nepalesisch|népalais|nepalí|नेपाली|尼泊尔语|ネパール語|ภาษาเนปาล",
    "hi": "hindi|हिन्दी|हिंदी|印地语|ヒンディー語|ภาษาฮินดี",
    "fr": "french|französisch|français|francés|फ्रेन्च|फ़्रेंच|法语|フランス語|ภาษาฝรั่งเศส",
    "de": "german|deutsch|allemand|alemán|जर्मन|德语|ドイツ語|ภาษาเยอรมัน",
    "es": "spanish|spanisch|espagnol|español|स्पेनिश|स्पेनी|西班牙语|スペイン語|ภาษาสเปน",
    "zh": "chinese|chinesisch|chinois|chino|चिनियाँ|चीनी\\s+भाषा|中文|汉语|中国語|ภาษาจีน",
    "ja": "japanese|japanisch|japonais|japonés|जापानी|日语|日本語|ภาษาญี่ปุ่น",
    "th": "thai|thailändisch|thaï|tailandés|थाई|泰语|タイ語|ภาษาไทย",
}
REQUESTS = {k: re.compile(rf"(?<!\w)(?:{v})", re.I) for k, v in LANGUAGE_NAMES.items()}

QUOTED = re.compile(r"«[^»]*»|“[^”]*”|„[^“”]*[“”]|「[^」]*」|\"[^\"\n]*\"|^>.*$", re.M)


def content(answer: str) -> str:
    """The answer without citations, tags, markup and a label."""
    out = MARKUP.sub(" ", TAG.sub(" ", CITE.sub(" ", unicodedata.normalize("NFC", answer))))
    return LABELS.sub("", out).strip()


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = content(answer)
    if not any(c.isalnum() for c in bare):
        return True
    return bare.strip(" .!。।-—–\"'()[]{}").casefold() in NOTHING


def is_refusal(answer: str) -> bool:
    """All that the answer says is that it declines or that nothing was found."""
    text = content(answer)
    found = False
    for a, b in units(text):
        unit = text[a:b]
        if REFUSAL.search(unit) and not re.search(r"\bbut\b(?!\s+(?:i|no|my|this|that|nothing|giving|questions?|there)\b)|(?<!sorry)[:：]\s*\S", unit, re.I):
            found = True
        elif not COURTESY.match(unit):
            return False
    return found


def _norm(text: str) -> bytes:
    text = unicodedata.normalize("NFKC", content(text)).casefold()
    return " ".join(re.findall(r"[\wऀ-ॿ฀-๿]+", text)).encode()


#: A copy and its prompt compress to so many bytes beyond the frame, and one for each so many bytes.
COPY_BYTES, COPY_PER = 11, 40


class Copies:
    """Finds answers that give the query back by compression with a dictionary."""

    def __init__(self) -> None:
        import zstandard

        self.z = zstandard
        self.labels = " ".join(sorted(set(ASKED.split()))).encode()
        self.bare = dict(write_content_size=False, write_checksum=False, write_dict_id=False)

    def cost(self, data: bytes, known: bytes) -> int:
        d = self.z.ZstdCompressionDict(b" " * 8 + known, dict_type=self.z.DICT_TYPE_RAWCONTENT)
        params = self.z.ZstdCompressionParameters.from_level(3, source_size=len(data), dict_size=len(known), min_match=3, **self.bare)
        return len(self.z.ZstdCompressor(dict_data=d, compression_params=params).compress(data)) - 6

    def __call__(self, query: str, answer: str) -> bool:
        q, a = _norm(query), _norm(answer)
        if not q or not a:
            return False
        allowed = lambda x: COPY_BYTES + len(x) // COPY_PER
        return self.cost(a, self.labels + b" " + ASKED.encode() + b" " + q) <= allowed(a) and self.cost(q, a) <= allowed(q)


CLOSED = re.compile(rf"[{MARKS}][\"'”’»›)）\]」』*_\s\u200b-\u200f\u2060\ufeff]*\Z")
DANGLING = re.compile(r"[,;:，、；：(\[（「“„«‘\-–—/]\s*\Z")
NO_END = re.compile(f"(?:{_words(' '.join(NEVER.values()) + ' No no Nos')})\\Z")
ITEM = re.compile(r"^\s*(?:[-*•·]|\d+[.)]|[|])\s*\S|\|\s*$")
PAIRS = [("«", "»"), ("「", "」"), ("『", "』"), ("(", ")"), ("（", "）")]


def _tokens(text: str) -> list[str]:
    return re.sub(r"[\d०-९][\d०-९.,/]*", "0", text.casefold()).split()


def _last(word: str) -> str:
    return word.strip("\"'“”‘’«»()[]*_.,;:!?।॥|。！？")


def ending(answer: str) -> tuple[str, str, str]:
    """("no" | "yes" | "ask" | "short", last two words, last word) of whether the answer breaks off.

    "ask" leaves it to the counts of sentence ends; so does "short", for answers and
    list items that need no end mark, where only a word that ends no sentence tells.
    """
    text = CITE.sub(" ", answer)
    cut_mark = re.search(r"\[(?:C(?:I(?:T(?:E(?::\w*)?)?)?)?)?\Z", text.rstrip())
    if cut_mark and cut_mark.group() != "":
        return "yes", "", ""
    text = re.sub(r"[*_`~\s\u200b-\u200f\u2060\ufeff]+\Z", "", TAG.sub(" ", text)).rstrip()
    last = text.rsplit("\n", 1)[-1]
    # A citation that stood before the end mark leaves a blank there.
    last = re.sub(rf"(?<=[{MARKS}])[\s.]+\Z", "", last)
    if not last:
        return "no", "", ""
    quotes = [("„", "“")] if "„" in last else [("“", "”")]
    if any(last.count(a) > last.count(b) for a, b in quotes + PAIRS) or last.count('"') % 2:
        return "yes", "", ""
    if re.search(r"\w\s?(?:…|\.{3})\Z", last):
        return "yes", "", ""
    words = _tokens(last)
    if CLOSED.search(last):
        return ("yes" if NO_END.search(last) and len(words) > 3 else "no"), "", ""
    if ITEM.match(last) and len(words) < 8 and not DANGLING.search(last):
        return "short", " ".join(map(_last, words[-2:])), _last(words[-1])
    if DANGLING.search(last) and not last.rstrip().endswith("/-"):
        return "yes", "", ""
    if last.rstrip().endswith("/-"):
        return "ask", " ".join(map(_last, words[-2:])), _last(words[-1])
    if re.search(r"[぀-ヿ一-鿿]\Z", last):
        return "yes", "", ""
    if len(words) <= 4 and "\n" not in text.strip() and len(units(text)) <= 1:
        return "short", " ".join(map(_last, words[-2:])), _last(words[-1])
    return "ask", " ".join(map(_last, words[-2:])), _last(words[-1])


def terminal_counts(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, n, ends, bare: how often the ``wanted`` words, and pairs of words (key), occur in answers, and how often they end a sentence, or a short answer or list item without an end mark, there.

    Wanted keys are picked before the shuffle, where they pass the check of their size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: Counter[str] = Counter()
            ends: Counter[str] = Counter()
            bare: Counter[str] = Counter()
            for answer in batch["answer"]:
                text = CITE.sub(" ", answer)
                for line in text.strip().split("\n"):
                    last = _tokens(line)
                    if last and (ITEM.match(line) and len(last) < 8 or len(last) <= 4 and "\n" not in text.strip()) and not CLOSED.search(line):
                        bare[_last(last[-1])] += 1
                for a, b in units(text):
                    unit = text[a:b]
                    closed = bool(CLOSED.search(unit))
                    words = [x for x in map(_last, _tokens(unit)) if x]
                    if not words:
                        continue
                    keys = words + [f"{x} {y}" for x, y in zip(words, words[1:])]
                    n.update(keys)
                    if closed:
                        ends.update([words[-1], " ".join(words[-2:])] if len(words) > 1 else words)
            yield pd.DataFrame({"key": list(n), "n": list(n.values()), "ends": [ends[k] for k in n], "bare": [bare[k] for k in n]})

    counted = pairs.where("answer is not null").select("answer").mapInPandas(run, "key string, n bigint, ends bigint, bare bigint")
    return counted.join(small(wanted), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("bare").alias("bare"))


#: A word that occurs so often and is the end of a sentence, short answer or list item less than in this share ends none.
SURELY, NEVER_ENDS = 20, 0.02
#: Least log-odds by which an answer is in another language than its query.
OTHER = 6.0


def flags(pairs: DataFrame, model: Model) -> DataFrame:
    """src, pair_id, answer's flags: empty, refusal, copy, other_language, ending, bigram, word."""
    held = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = held.value
        copies = Copies()
        for batch in batches:
            queries = batch["query"].fillna("").tolist()
            answers = batch["answer"].tolist()
            own = []
            for a in answers:
                text = content(a or "")
                bare = QUOTED.sub(" ", text)
                own.append(bare if sum(c.isalpha() for c in bare) >= 12 else text)
            # Names of offices, acts and goods from the query don't make a language.
            qs, ans = m.score(queries) * TEMPER, m.score(own) * TEMPER
            out = []
            for i, (src, pid, q, a) in enumerate(zip(batch["src"], batch["pair_id"], queries, answers)):
                empty = is_empty(a)
                row = [src, pid, empty, False, False, False, "no", "", ""]
                if not empty:
                    row[3] = is_refusal(a)
                    row[4] = bool(q.strip()) and copies(q, a)
                    if sum(c.isalpha() for c in own[i]) >= 9 and sum(c.isalpha() for c in q) >= 6:
                        asked = int(qs[i].argmax())
                        said = int(ans[i].argmax())
                        wanted = {k for k, x in REQUESTS.items() if x.search(q)}
                        row[5] = bool(
                            said != asked
                            and m.langs[said] not in wanted
                            and ans[i, said] - ans[i, asked] > OTHER
                            and qs[i, asked] - qs[i, said] > OTHER / 2
                        )
                    if not row[4]:
                        row[6:] = ending(a)
                out.append(row)
            yield pd.DataFrame(out, columns=["src", "pair_id", "empty", "refusal", "copy", "other_language", "ending", "bigram", "word"])

    schema = "src string, pair_id string, empty boolean, refusal boolean, copy boolean, other_language boolean, ending string, bigram string, word string"
    return pairs.select("src", "pair_id", "query", "answer").mapInPandas(run, schema)


def defects(pairs: DataFrame, model: Model) -> DataFrame:
    """One row for each defect of each pair (src, pair_id, query, answer): src, pair_id, defect.

    A null answer is empty. Without a query only defects of the answer alone are
    found. Repeated rows count once.
    """
    pairs = pairs.dropDuplicates(["src", "pair_id", "query", "answer"])
    seen = keep(flags(pairs, model))
    ask = seen.where("ending in ('ask', 'short')").select("src", "pair_id", "ending", "bigram", "word")
    wanted = ask.select(F.explode(F.array("bigram", "word")).alias("key")).distinct()
    # Only keys that some answer ends with are kept of the corpus's counts.
    counts = keep(terminal_counts(pairs, wanted))
    two = counts.select(F.col("key").alias("bigram"), F.col("n").alias("n2"), F.col("ends").alias("e2"))
    one = counts.select(F.col("key").alias("word"), F.col("n").alias("n1"), F.col("ends").alias("e1"), F.col("bare").alias("b1"))
    # The answer's own end is one of the n that are no ends.
    rate = F.when(F.col("n2") > 1, F.col("e2") / (F.col("n2") - 1)).when(F.col("n1") > 1, F.col("e1") / (F.col("n1") - 1)).otherwise(0.0)
    never = (F.col("n1") >= SURELY) & (F.col("e1") + F.col("b1") < NEVER_ENDS * F.col("n1"))
    broken = ask.join(two, "bigram", "left").join(one, "word", "left").where(F.when(F.col("ending") == "ask", rate < 0.3).otherwise(never)).select("src", "pair_id", F.lit("truncated").alias("defect"))
    kinds = F.filter(
        F.array(
            *(F.when(F.col(k), F.lit(k)) for k in ("empty", "refusal", "copy", "other_language")),
            F.when(F.col("ending") == "yes", F.lit("truncated")),
        ),
        lambda x: x.isNotNull(),
    )
    direct = seen.select("src", "pair_id", F.explode(kinds).alias("defect"))
    return direct.unionByName(broken).dropDuplicates(["src", "pair_id", "defect"])


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the two tables: src, pair_id, query, answer."""
    starred = read(spark, sf_dir, "starred_responses").select(F.lit("starred").alias("src"), F.col("id").alias("pair_id"), "query", "answer")
    results = read(spark, sf_dir, "query_results").where("use_llm").select(F.lit("result").alias("src"), F.col("result_id").alias("pair_id"), "query", "answer")
    return starred.unionByName(results)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of all pairs."""
    return defects(pairs_of(spark, sf_dir), model_for(spark, sf_dir))
