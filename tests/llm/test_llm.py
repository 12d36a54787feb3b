"""Operators of the llm package: hand-made cases, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import confusables, language, mixing, pairs, pii, scans, sentences, tokens

VOCABULARY = tokens.tokenizer_path("byte_bpe_50k.json")
DOC = "doc_id bigint, text string"
ODD_TEXTS = [None, "", " ", "\n\n", "\x00\x01\x7f", "\u200b\ufeff", "😀👩\u200d⚖️", "a" * 20_000, "।।।", "...", "﷽"]


def with_clashes(df):
    """The same rows with columns whose names operators use inside."""
    for c in ("key", "n_tokens", "cell_lang", "weight", "kind", "bucket", "n", "pos", "run"):
        df = df.withColumn(c, F.lit(1))
    return df


# --- tokens -----------------------------------------------------------------


@pytest.fixture(scope="module")
def rules():
    return tokens.load(VOCABULARY)


def slow_ids(rules, text: str) -> list[int]:
    import regex

    rank = {}
    for at in np.flatnonzero(rules.rank != tokens.NONE):
        k = int(rules.keys[at])
        rank[k >> 20, k & 0xFFFFF] = (int(rules.rank[at]), int(rules.made[at]))
    out = []
    for w in regex.findall(tokens.SPLIT, text):
        ids = [int(rules.start[b]) for b in w.encode()]
        while True:
            best = min((rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank) if any(p in rank for p in zip(ids, ids[1:])) else None
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [rank[ids[i], ids[i + 1]][1]]
        out += ids
    return out


def test_ids_like_a_loop(rules):
    texts = ["The fee, isn't  it?\n\n  12 naïve", "aaaaaaaaa abab", "कर २०७८", "<|endoftext|>", "x\x85 \x1c y", "中" * 30]
    assert tokens.Encoder(rules)(texts).to_pylist() == [slow_ids(rules, t) for t in texts]


def test_ids_like_a_public_library(rules):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = [x or "" for x in ODD_TEXTS] + ["".join(rng.choice("ab c\n\t'.१कé中😀\u200b") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    assert tokens.Encoder(rules)(texts).to_pylist() == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_ids_of_any_table(spark):
    rows = spark.createDataFrame(list(enumerate(ODD_TEXTS)) + [(0, None)], DOC)
    got = tokens.encode(with_clashes(rows)).collect()
    assert len(got) == len(ODD_TEXTS) + 1 and [r["ids"] for r in got if r["doc_id"] in (0, 1)] == [[], [], []]
    assert tokens.encode(rows.limit(0)).count() == 0


# --- sentences --------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dr. Rai paid Rs. 5.50 at 5 p.m. The Board met.", ["Dr. Rai paid Rs. 5.50 at 5 p.m.", "The Board met."]),
        ('The Minister said, "It is fixed. It will not rise," and left. Stop!', ['The Minister said, "It is fixed. It will not rise," and left.', "Stop!"]),
        ("“Was it filed in time?” asked the Officer. 12. The bank shall pay.", ["“Was it filed in time?” asked the Officer.", "12. The bank shall pay."]),
        ("## Part 1 — Rates\n\nIt ended ... and we left", ["Part 1 — Rates", "It ended ... and we left"]),
        ("(This rule is old.) A new one", ["(This rule is old.)", "A new one"]),
        ("रु. ५०० बुझायो। के भयो? ५. बैंकले दियो|", ["रु. ५०० बुझायो।", "के भयो?", "५. बैंकले दियो|"]),
        ("“विवरण बुझाइयो?” भनी सोधे। सकियो।", ["“विवरण बुझाइयो?” भनी सोधे।", "सकियो।"]),
        ("部长说：“费用已定。今后不上调。”谁缴税？", ["部长说：“费用已定。今后不上调。”", "谁缴税？"]),
        ("大臣は「決まった。上がらない。」と述べた。次だ。", ["大臣は「決まった。上がらない。」と述べた。", "次だ。"]),
        ("ผู้ใดยื่นช้าต้องชำระ 500 บาท ห้ามผู้ใดเก็บน้ำตาล", ["ผู้ใดยื่นช้าต้องชำระ 500 บาท", "ห้ามผู้ใดเก็บน้ำตาล"]),
        ("Vgl. § 3 Abs. 2, d. h. am 3. Tag. Es gilt.", ["Vgl. § 3 Abs. 2, d. h. am 3. Tag.", "Es gilt."]),
        ("1. ", []),
        ("", []),
        (None, []),
        ("---\n***", []),
    ],
)
def test_units(text, want):
    assert [text[a:b] for a, b in sentences.units(text)] == want


def test_units_cover_letters_once():
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["a", "B", ".", "!", " ", "\n", "“", "”", "(", ")", "क", "।", "。", "ก", "1", "\u200b"]) for _ in range(rng.randint(0, 60)))
        u = sentences.units(t)
        assert all(a < b for a, b in u) and all(x[1] <= y[0] for x, y in zip(u, u[1:]))
        left = "".join(t[b:a] for (_, b), (a, _) in zip([(0, 0), *u], [*u, (len(t), len(t))]))
        assert not u or not any(c.isalpha() for c in left)


def test_wrapped_lines():
    t = "The insurer must state the quantity of cardamom and\nthe value. No person shall store timber for more than\na year.\n\nNext part\n\nIt ends"
    assert [t[a:b].replace("\n", " ") for a, b in sentences.units(t)] == [
        "The insurer must state the quantity of cardamom and the value.", "No person shall store timber for more than a year.", "Next part", "It ends",
    ]


def test_units_of_any_table(spark):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(ODD_TEXTS)], "document_id string, content string")
    assert {r["document_id"] for r in sentences.split(with_clashes(rows)).collect()} == {str(ODD_TEXTS.index("a" * 20_000))}


# --- languages --------------------------------------------------------------


def test_language_accuracy(spark, data):
    folder = os.environ.get("TEST_LARGER_DIR", data.replace("sf0.001", "sf0.01"))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    codes = spark.read.parquet(f"{folder}/lang_codes.parquet")
    model = language.fit(docs.where("doc_id % 3 <> 0"), codes)
    # Held out: sentences whose language their script or fixed words show.
    sure = {
        "en": ["The Board shall examine the return within ten days.", "Who pays the levy when goods are lost?"],
        "ne": ["करदाताले विवरण पेश गर्नु पर्नेछ।", "यो नियम लागू भएको हो।"],
        "hi": ["यह नियम लागू है।", "आवेदक को विवरणी प्रस्तुत करनी होगी।"],
        "zh": ["逾期申报的，处以罚款。"], "ja": ["この条は影響を及ぼさない。"], "de": ["Die Bank bewahrt die Erklärung auf."],
        "fr": ["Le contribuable conserve la licence."], "es": ["El banco deberá presentar el informe."], "th": ["มาตรานี้ไม่กระทบต่อการคืนอากร"],
    }
    pairs_ = [(lang, t) for lang, ts in sure.items() for t in ts]
    got = model.score([t for _, t in pairs_]).argmax(axis=1)
    assert np.mean([model.langs[g] == lang for g, (lang, _) in zip(got, pairs_)]) >= 0.9


def test_segments(spark):
    texts = {"en": "The Board shall pay the levy. The bank must file the return.", "fr": "Le conseil doit payer la taxe. La banque conserve le registre."}
    rows = [(t, lang) for lang, t in texts.items() for _ in range(30)]
    codes = spark.createDataFrame([("en", "eng", "English", "Latin"), ("fr", "fra", "French", "Latin"), ("th", "tha", "Thai", "Thai")], "lang string, code3 string, name_en string, script string")
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), codes)
    mixed = texts["en"] + " " + texts["fr"]
    docs = spark.createDataFrame([("a", mixed, False), ("b", None, False), ("c", "", False), ("d", "123 ...", False), ("e", "## Page 1\n" + texts["fr"], True), ("f", "มาตรานี้", False)], "document_id string, content string, ocr_used boolean")
    got = {(r["document_id"], r["segment"]): (r["start_char"], r["lang"]) for r in language.segments(with_clashes(docs), model).collect()}
    assert got == {("a", 0): (0, "en"), ("a", 1): (len(texts["en"]) + 1, "fr"), ("e", 0): (10, "fr"), ("f", 0): (0, "th")}
    assert language.fit(spark.createDataFrame([], "text string, lang string"), codes).score(["มาตรา"]).argmax() == 2


def test_labels(spark):
    codes = spark.createDataFrame([("en", "eng", "English", "Latin")], "lang string, code3 string, name_en string, script string")
    r = [(1, "a", " EN_gb ", "2024-01-01"), (2, "a", "English", "2024-02-01"), (3, "b", "eng", "2024-01-01"), (4, "b", None, "2024-03-01"), (5, "c", "english/nepali", "2024-01-01")]
    req = spark.createDataFrame(r, "request_id bigint, document_id string, language string, requested_at string")
    assert {x["document_id"]: x["named"] for x in language.labels(req, codes).collect()} == {"a": "en", "b": None, "c": None}


# --- look-alikes ------------------------------------------------------------


@pytest.mark.parametrize(
    "word, want",
    [
        ("thе", "the"), ("ѕау", "say"), ("Протокол", "Протокол"), ("ｒｅｓｕｌｔ.", "result."), ("Oﬃce", "Office"), ("más", "más"),
        ("dee\u200ed", "deed"), ("on renewal", "on renewal"), ("गर्\u200dयो", "गर्\u200dयो"), ("गन\u200d", "गन"), ("m²", "m²"), ("“ok”", "“ok”"), ("19９", "199"),
        ("水泥，价格！", "水泥，价格！"), ("ｶﾙﾀﾞ", "カルダ"), ("अाज", "आज"), ("naïve", "naïve"), ("", ""), ("Νο.", "No."), ("7,9 %", "7,9 %"),
    ],
)
def test_spelling(word, want):
    assert confusables.spell(word) == want
    assert confusables.spell(want) == want


def test_runs(spark):
    rows = spark.createDataFrame([("a", "The fее is\r\non\tdeе\u200cd x"), ("b", None), ("c", "")], "document_id string, content string")
    got = [(r["document_id"], r["pos"], r["plain"]) for r in confusables.scan(with_clashes(rows)).orderBy("pos").collect()]
    assert got == [("a", 4, "fee"), ("a", 15, "deed")]
    assert rows.select(confusables.plain_text(F.col("content"))).collect()[0][0] == "The fee is\r\non\tdeed x"


def test_all_documents_and_words_come_out_in_one_form(spark, tmp_path):
    docs = [("a", "the fее", False), ("b", "de\u00ad\nposit de\u00adpot fее\u00ad \r\nx\u00ad", True), ("c", "fее", None), ("d", None, True), ("e", "de\u00ad\nposit", False)]
    spark.createDataFrame(docs, "document_id string, content string, ocr_used boolean").write.parquet(f"{tmp_path}/parsed_documents.parquet")
    got = {r["document_id"]: r["content"] for r in confusables.p4_normalized(spark, str(tmp_path)).collect()}
    assert got == {"a": "the fee", "b": "de\u00ad\nposit depot fee\u00ad \r\nx\u00ad", "c": "fee", "d": None, "e": "de\nposit"}
    pages = [("a", 1, [("fее", 3), None, (None, 4), ("ok", None)]), ("a", 1, [("fее", 3)]), ("b", None, []), ("c", 1, None)]
    spark.createDataFrame(pages, "document_id string, page int, words array<struct<text string, char_offset bigint>>").write.parquet(f"{tmp_path}/word_bboxes.parquet")
    rows = [(r["document_id"], r["page"], r["words"] and [w and tuple(w) for w in r["words"]]) for r in confusables.p4_words(spark, str(tmp_path)).collect()]
    assert sorted(rows, key=str) == sorted([("a", 1, [("fee", 3), None, (None, 4), ("ok", None)]), ("a", 1, [("fee", 3)]), ("b", None, []), ("c", 1, None)], key=str)


# --- pairs ------------------------------------------------------------------


@pytest.mark.parametrize("answer, want", [(None, True), ("", True), ("[CITE:c1]", True), ("**Answer:**", True), ("N/A", True), ("```\n```", True), ("No.", False), ("5", False), ("\u200b", True)])
def test_empty(answer, want):
    assert pairs.is_empty(answer) is want


@pytest.mark.parametrize(
    "answer, want",
    [
        ("I'm sorry, but I can't help with that request. Is there anything else you would like to know?", True),
        ("Regrettably, my policy prevents a reply, so please rephrase.", True),
        ("I could not find anything relevant in the indexed sections.", True),
        ("It would not be appropriate for me to comment on this matter.", True),
        ("माफ गर्नुहोस्, म यस प्रश्नको उत्तर दिन सक्दिनँ।", True),
        ("I'm sorry to say the fee is not refundable: the bank loses Rs. 5 once the form is late.", False),
        ("The Tribunal cannot refuse the bank guarantee if it is complete.", False),
        ("You cannot, unless the Board grants a permit.", False),
        ("No.", False),
    ],
)
def test_refusal(answer, want):
    assert pairs.is_refusal(answer) is want


@pytest.mark.parametrize(
    "answer, want",
    [
        ("Compare the levy on tea and jute", True), ("**COMPARE THE LEVY ON TEA AND JUTE.**", True), ("> Compare  the levy on tea and jute.", True),
        ("You asked: Compare the levy on tea and jute.", True), ("Compare the levy on tea and jute. Compare the levy on tea and jute.", True),
        ("Compare the levy on tea and jute. The answer is NPR 90,800.50, under section 125.", False), ("Tea bears 5 percent.", False), ("No.", False),
    ],
)
def test_copy(answer, want):
    assert pairs.Copies()("Compare the levy on tea and jute.", answer) is want


@pytest.mark.parametrize(
    "answer, want",
    [
        ("The fee is due. The bank must,", "yes"), ("It was fixed at Rs.", "yes"), ("The officer noted: “It is incomplete.", "yes"), ("The fee is due.", "no"), ("186 days", "short"), ("The rate of", "short"),
        ("Conditions:\n- a valid licence\n- payment of NPR 500", "short"), ("The fee is due. [CITE:c3].", "no"), ("The levy on tea was raised by the", "ask"), ("The fee is due. The ba…", "yes"),
        ("Er sagte: „Sie steht fest“, und ging. [CITE:c2][CITE:c4]", "no"),
    ],
)
def test_ending(answer, want):
    assert pairs.ending(answer)[0] == want


def test_copies_of_any_length():
    copies = pairs.Copies()
    query = "Which papers does a trader need for the transit of refined sugar?"
    assert copies(query, " ".join([query] * 5)) and copies(query, query.lower()) and not copies(query, "Papers.")
    assert not copies(query, query + " A trader needs a transit permit, which the customs office gives on request, and the invoice of the goods.")


def test_pairs_table(spark):
    codes = spark.createDataFrame([("en", "eng", "English", "Latin"), ("ne", "nep", "Nepali", "Devanagari")], "lang string, code3 string, name_en string, script string")
    texts = [("The Board shall pay the levy on tea and jute in the month of May.", "en"), ("करदाताले विवरण पेश गर्नु पर्नेछ र दस्तुर बुझाउनु पर्छ।", "ne")] * 20
    model = language.fit(spark.createDataFrame(texts, "text string, lang string"), codes)
    rows = [
        ("s", "1", "Is the levy due in May?", "करदाताले दस्तुर बुझाउनु पर्छ।"), ("s", "2", "Is the levy due in May? Answer in Nepali.", "करदाताले दस्तुर बुझाउनु पर्छ।"),
        ("s", "3", None, None), ("s", "4", "Is the levy due?", "The levy is due in May and the Board shall pay the"), ("s", "5", "Is it due?", "The levy is due. The Board shall pay the levy on tea."), ("s", "5", "Is it due?", "The levy is due. The Board shall pay the levy on tea."),
    ]
    df = spark.createDataFrame(rows, "src string, pair_id string, query string, answer string")
    assert sorted((r["pair_id"], r["defect"]) for r in pairs.defects(with_clashes(df), model).collect()) == [("1", "other_language"), ("3", "empty"), ("4", "truncated")]
    assert pairs.defects(df.limit(0), model).count() == 0


def test_wide_lines_tell_nothing_of_wrapped_ones():
    wrapped = "The board shall fix the levy on all goods that are brought into the land\nfrom any other land. The bank shall pay it to the registrar of the office in\nthe month of May."
    wide = "Every trader who brings goods into the land from any other land shall state the quantity, the value and the place of loading."
    assert len(wide) > sentences.WIDEST
    assert len(sentences.units(wrapped)) == 2 and len(sentences.units(wrapped + "\n" + wide)) == 3


def test_abbreviations_hold_in_their_language():
    german = "Die Frist ist nicht von der Behörde und dem Amt in Abs. Die Gebühr ist fällig."
    english = "The width of the box and the depth of the hole were drawn in the abs. The fee is due."
    assert len(sentences.units(german)) == 1 and len(sentences.units(english)) == 2


# --- scans ------------------------------------------------------------------


def scanned(spark, pages):
    rows = []
    for doc, page, lines in pages:
        i = 0
        block = -1
        for n, (gap, text) in enumerate(lines):
            block += gap
            for t in text.split(" "):
                rows.append((doc, page, i, n, block, t))
                i += 1
    return spark.createDataFrame(rows, "document_id string, page int, index_sort int, line int, block int, text string")


def test_scans(spark):
    pages = []
    for p in range(2, 8):
        body = [(1, "The bank shall pay the levy on refined sugar"), (0, "and the depo-"), (0, "sit of the non-"), (0, "resident dealer is due.")]
        if p == 5:
            body[0] = (1, "The bank shall pay thc levy on refined sugar")
        pages.append(("d", p, [(1, "Road Toll Act, 2050"), *body, (1, f"Page {p} of 9")]))
    pages += [(f"e{i}", 1, [(1, "Land Act, 2051"), (1, "the deposit of a non-resident bank is the levy")]) for i in range(9)]
    w = scanned(spark, pages)
    docs = spark.createDataFrame([("x", "the deposit of the non-resident bank. " * 9, False)], "document_id string, content string, ocr_used boolean")
    words = w.unionByName(w.limit(5))
    found = scans.noisy(with_clashes(words), docs).join(w, ["document_id", "page", "index_sort"]).collect()
    kinds = {}
    for r in found:
        kinds.setdefault(r["kind"], []).append(r["text"])
    assert sorted(set(kinds["header"])) == sorted("Road Toll Act, 2050".split()) and len(kinds["header"]) == 24
    assert sorted(set(kinds["page_number"])) == sorted({"Page", "of", "9", *"234567"}) and kinds["hyphen"] == ["depo-"] * 6 and kinds["misread"] == ["thc"]
    text = {r["page"]: r["text"] for r in scans.paragraphs(words, docs).where("document_id = 'd'").collect()}
    assert text[5] == "The bank shall pay the levy on refined sugar and the deposit of the non-resident dealer is due."
    assert scans.noisy(words.limit(0), docs).count() == 0
    nulls = spark.createDataFrame([("d", 1, 0, None, None, "a"), ("d", 1, 1, None, None, None), (None, 1, 0, 0, 0, "b")], words.schema)
    assert scans.noisy(nulls, docs.limit(0)).count() == 0


def test_stream_over_pages(spark):
    """Words divided over pages, torn ones and run-together ones are mended; a paragraph goes on over a page's end."""
    clean = "the constitution of the state shall bind the government of the land and every officer of it. " * 300
    docs = spark.createDataFrame([("x", clean, False)], "document_id string, content string, ocr_used boolean")
    filler = [("f", p, [(1, "every officer of the state shall bind the land"), (0, "and the government of it.")]) for p in range(1, 9)]
    pages = [
        ("d", 1, [(1, "the govern ment ofthe state and every officer of"), (0, "the land shall bind under the consti-")]),
        ("d", 2, [(1, "tution of the state and every officer. The"), (0, "land shall bind")]),
        ("d", 3, [(1, "the land."), (1, "Every officer of the state shall bind it.")]),
    ]
    words = scanned(spark, filler + pages)
    got = {(r["page"], r["paragraph"]): r["text"] for r in scans.paragraphs(words, docs).where("document_id = 'd'").collect()}
    assert got[1, 0] == "the government of the state and every officer of the land shall bind under the constitution of the state and every officer. The land shall bind the land."
    assert got[3, 1] == "Every officer of the state shall bind it." and len(got) == 2
    kinds = {(r["page"], r["index_sort"]): r["kind"] for r in scans.noisy(words, docs).where("document_id = 'd'").collect()}
    assert kinds == {(1, 1): "merge", (1, 3): "split", (1, 15): "hyphen"}


def test_pages_and_neighbours_are_gone_through_once(spark):
    """Words of many pages are Python objects a few pages at a time, with the same rows; the lattice reads the words twice: for single ones and for pairs."""
    import pyarrow as pa

    class Runs:
        def mapInArrow(self, run, schema):
            return lambda batches: pa.Table.from_batches(run(iter(batches))).to_pylist()

    texts = ["the levy", None, "of the depo-", "", "sit is due", "Page 3", " ", "and re-"]
    rows = [
        {"document_id": f"d{i % 7}", "page": i, "marks": [{"index_sort": 1, "kind": "header"}] if i % 3 == 0 else None, **dict(zip(scans.PARTS, map(list, zip(*own))))}
        for i in range(scans.AT_ONCE + 90)
        if (own := [(w, None if i % 5 == 0 else w // 3, w % 2, t) for n in range(i % 4 + 1) for w, t in enumerate((texts[(i + n) % 8] or "").split(" "), 5 * n)])
    ]
    kinds = pa.struct([("index_sort", pa.int32()), ("kind", pa.string())])
    schema = pa.schema([("document_id", pa.string()), ("page", pa.int32()), ("marks", pa.list_(kinds)), *((c, pa.list_(pa.int32())) for c in scans.PARTS[:3]), ("text", pa.list_(pa.string()))])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    assert batch.num_rows > scans.AT_ONCE and max(x.num_rows for x in scans.few_pages([batch])) == scans.AT_ONCE
    for operator in (scans.tokens, scans.lone_lines):
        run = operator(Runs())
        assert run([batch]) == [r for i in range(batch.num_rows) for r in run([pa.RecordBatch.from_pylist(rows[i : i + 1], schema)])]
    one = [("d", p, [(1, "the govern ment ofthe state")]) for p in range(3)]
    inside = scans.keep(scans.tokens(scans.pages(scanned(spark, one)).withColumn("marks", F.lit(None).cast("array<struct<index_sort: int, kind: string>>"))).where("kind is null"))
    types = scans.keep(spark.createDataFrame([("the", 9, 9), ("govern", 3, 0), ("ment", 3, 0), ("government", 0, 9), ("ofthe", 3, 0), ("of", 9, 9), ("state", 3, 9)], "type string, n bigint, clean bigint"))
    leaves = scans.arcs(inside, types, 100)._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert sum("next_type#" in leaves.apply(i).toString() and "place#" in leaves.apply(i).toString() for i in range(leaves.size())) == 2


def test_furniture_is_the_same_in_a_large_corpus(spark):
    """Heads and feet that stand on few pages are found however many other pages there are."""
    own = [("d", p, [(1, "Road Toll Act, 2050"), (1, "the bank shall"), (0, "pay the levy"), (1, "Ministry of Finance Gazette")]) for p in range(2, 6)]
    own += [("d", 6, [(1, "Road T0ll Act, 2050"), (1, "the bank shall"), (0, "pay the levy"), (1, "Ministry of Fimance Gazette")])]
    few = scanned(spark, own)
    other = spark.range(100_000).selectExpr("concat('z', id % 1000) as document_id", "cast(id div 1000 + 1 as int) as page", "explode(sequence(0, 2)) as i", "id")
    many = other.selectExpr("document_id", "page", "i as index_sort", "i as line", "i as block", "concat('word', conv(id * 3 + i, 10, 36), 'x') as text").selectExpr(
        "document_id", "page", "cast(index_sort as int) index_sort", "cast(line as int) line", "cast(block as int) block", "text"
    )

    def marks(words):
        lines = scans.lone_lines(scans.pages(words))
        return sorted((r["page"], m["index_sort"], m["kind"]) for r in scans.furniture(lines).where("document_id = 'd'").collect() for m in r["marks"])

    alone = marks(few)
    assert len(alone) == 5 * 8 and marks(few.unionByName(many)) == alone


def test_boundaries():
    lines = [("A long line that fills the whole width of it", 0), ("and goes on to the end.", 0), ("Next paragraph that fills the whole width too", 1), ("ends here.", 1)]
    assert scans.boundaries(lines) == [True, False, True, False] and scans.boundaries([]) == []


# --- mixing -----------------------------------------------------------------


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, "levy " * rng.randint(1, 60), ["en", "ne", None][i % 3], ["big", "big", "big", "mid", "small", None][i % 6], ["x", None][i % 2]) for i in range(1200)]
    rows += [(5000, None, "en", "big", "x"), (5001, "", "en", "mid", "x"), (5002, "levy", "en", "untargeted", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, category string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 3), ("small", 0.19, 1), ("gone", 0.01, 5)], "source string, target_share double, max_repeat int")
    sized = mixing.ready(with_clashes(docs))
    used = mixing.mix(with_clashes(docs), targets)
    rep = {r["source"]: r for r in mixing.report(used, sized, targets).collect()}
    assert abs(rep["big"]["reached_share"] / rep["mid"]["reached_share"] - 0.5 / 0.3) < 0.05
    sizes = {s: r["available_tokens"] for s, r in rep.items()}
    _, given = mixing.fill(sizes, [(r["source"], r["target_share"], r["max_repeat"]) for r in targets.collect()])
    largest = {r["source"]: r["m"] for r in sized.groupBy("source").agg(F.max("n_tokens").alias("m")).collect()}
    assert all(abs(rep[s]["tokens"] - given[s]) <= largest[s] for s in ("big", "mid", "small"))
    assert rep["gone"]["tokens"] == 0 and set(rep) == {"big", "mid", "small", "gone"}
    assert used.join(targets, "source").where("repeats > max_repeat").count() == 0
    assert used.where("source is null or doc_id >= 5000").count() == 0 and used.count() == used.select("doc_id").distinct().count()
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


def test_rake_meets_totals():
    rng = np.random.default_rng(0)
    sizes, source = rng.uniform(1, 9, 30), np.arange(30) % 3
    given, most = np.array([40.0, 20.0, 1e6]), np.array([3.0, 1.0, 2.0])
    w = mixing.rake(sizes, source, [np.arange(30) % 5, np.arange(30) % 2], given, most)
    got = np.bincount(source, w * sizes)
    assert np.allclose(got[:2], given[:2]) and np.isclose(got[2], 2 * sizes[source == 2].sum()) and (w <= most[source] + 1e-9).all()


# --- personal information ---------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to a.b+c@x.example. Then", [("a.b+c@x.example", "email")]),
        ("info [at] mail [dot] x [dot] example or d at e dot test", [("info [at] mail [dot] x [dot] example", "email"), ("d at e dot test", "email")]),
        ("set out the @ 18.6% rate", []),
        ("tel. +977 98 0055 5918, or (01) 5521785", [("+977 98 0055 5918", "phone"), ("(01) 5521785", "phone")]),
        ("फोन ९८००५५८११६ वा ०१-५५८२९८८", [("९८००५५८११६", "phone"), ("०१-५५८२९८८", "phone")]),
        ("ISBN 978-0-00-12600-4, Receipt 2078-10-239, Lot 301734567/A, heading 1401.30.00", []),
        ("PAN: 350-165-972", [("350-165-972", "id_number")]),
        ("citizenship No. 26/6/60983, passport PA 2415954", [("26/6/60983", "id_number"), ("PA 2415954", "id_number")]),
        ("at House No. 152, Ward 8, Posha Marg, Rihugaun marked", [("House No. 152, Ward 8, Posha Marg, Rihugaun", "address")]),
        ("The toll road passes Ward 5.", []),
        ("मेरो घर पो.ब.नं. २६९, याबेकोट हो", [("पो.ब.नं. २६९, याबेकोट", "address")]),
        ("wohnhaft Dhuweg 58, 44528 Kahu, legte", [("Dhuweg 58, 44528 Kahu", "address")]),
    ],
)
def test_rules(text, want):
    field = pii.Field(np.zeros((pii.FEATURES, 2), np.int64))
    assert [(text[a:b], k) for a, b, k in field([text])[0] if k != "person"] == want


def test_skip_edges_between_numbers():
    """A number that bears its label once is known where it stands without; one that never does isn't."""
    field = pii.Field(np.zeros((pii.FEATURES, 2), np.int64))
    text = "Citizenship No. 26/6/60983 was shown. Later the clerk wrote down the number that had been shown before by the same man, 26/6/60983 again, and 31/6/11111 beside it."
    assert [text[a:b] for a, b, k in field([text])[0] if k == "id_number"] == ["26/6/60983"] * 2
    both = pii.propagate(np.array([2.0, 1.0]), [], [(0, 1, 30.0)])
    weight = {(0, 0): 1, (1, 0): np.exp(2.0), (0, 1): np.exp(1.0)}
    assert np.allclose(both, [np.log(weight[1, 0] / (1 + weight[0, 1])), np.log(weight[0, 1] / (1 + weight[1, 0]))], atol=0.05)


def test_hashing_of_many_texts():
    texts = ["", "a", "Sharma", "शर्मा", "a" * 40]

    def slow(text):
        h = 2166136261
        for b in text.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return (h ^ (h >> 15)) % pii.FEATURES

    assert pii.hashed(texts).tolist() == [slow(t) for t in texts]


def test_names(spark):
    people = ["Rita Sharel", "Bimal Thokari", "Sujan Dhakel", "Nima Lokari"]
    rows = [(i, f"The Board heard Dr. {people[i % 4]} on the levy. The Office of the Registrar fixed the fee.") for i in range(200)]
    rows += [(900, "Then Rita Sharel paid the fee, and Sharel, Rita left the Office."), (901, None), (902, ""), (903, "The fee is due.")]
    docs = spark.createDataFrame(rows, DOC)
    got = {(r["doc_id"], r["start_char"], r["end_char"]) for r in pii.find(with_clashes(docs)).where("kind = 'person'").collect()}
    text = dict(rows)[900]
    assert (900, 5, 16) in got and (900, text.index("Sharel, Rita"), text.index("Sharel, Rita") + 12) in got
    assert all(d != 903 for d, _, _ in got) and len([1 for d, _, _ in got if d < 200]) == 200
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] == "The Board heard Dr. [PERSON] on the levy. The Office of the Registrar fixed the fee." and clean[901] is None and clean[902] == ""
    assert pii.find(docs.limit(0)).count() == 0


def test_belief_propagation_on_a_tree():
    unary, edges = np.array([1.0, -0.5, 0.2]), [(0, 1, 0.8), (1, 2, 0.6)]
    weight = {}
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                weight[a, b, c] = np.exp(unary @ [a, b, c] + sum(j if x == y else -j for (x, y), j in (((a, b), 0.8), ((b, c), 0.6))))
    exact = [np.log(sum(v for k, v in weight.items() if k[i]) / sum(v for k, v in weight.items() if not k[i])) for i in range(3)]
    old, pii.ROUNDS = pii.ROUNDS, 60
    try:
        assert np.allclose(pii.propagate(unary, edges), exact, atol=1e-6)
    finally:
        pii.ROUNDS = old


# --- queries ----------------------------------------------------------------


def test_queries_run(spark, data):
    from folioflow.llm.queries import QUERIES

    for name, run in QUERIES.items():
        df = run(spark, data)
        rows = df.count()
        assert rows > 0, name
        if name.endswith("_found"):
            assert df.distinct().count() == rows, name
