"""Operators against plain loops and hand-made cases: nulls, empty tables, ties, repeated rows."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import bm25, chunks, hybrid, offsets, studio, trees, upsert, usage, vectors, words
from folioflow.plans import pipelines
from folioflow.sources import files

WORDS = "document_id string, page int, index_sort int, line int, block int, text string, x0 double, y0 double, x2 double, y2 double, space_type int, confidence double"


def word(i, text, line=0, block=0, x0=0.1, y0=0.1, x2=0.2, y2=0.12, space=1, conf=0.9, page=1):
    return ("d", page, i, line, block, text, x0, y0, x2, y2, space, conf)


def test_clean_words(spark):
    rows = [word(0, "a"), word(1, " "), word(2, None), word(3, "---"), word(4, "b", conf=0.49), word(5, "c", conf=0.5), word(6, "d", x2=0.05), word(7, "e", conf=None)]
    got = {r["index_sort"]: r["text"] for r in words.clean(spark.createDataFrame(rows, WORDS)).collect()}
    assert got == {0: "a", 3: "", 5: "c"}


def test_combine_gap_and_colon(spark):
    rows = [word(0, "Name:", x0=0.1, x2=0.2), word(1, "A", x0=0.205, x2=0.22), word(2, "B", x0=0.23, x2=0.24), word(3, "far", x0=0.5, x2=0.6)]
    got = words.combine(spark.createDataFrame(rows, WORDS)).orderBy("phrase").collect()
    assert [r["text"] for r in got] == ["Name:", "A B", "far"]
    assert words.combine(spark.createDataFrame([], WORDS)).count() == 0


def test_reset_lines_like_a_loop(spark):
    rng = random.Random(3)
    rows = [word(i, "w", y0=round(rng.uniform(0, 0.3), 3), y2=0.5) for i in range(40)]
    rows = [(*r[:9], r[7] + 0.02, *r[10:]) for r in rows]
    got = {r["index_sort"]: r["line2"] for r in words.reset_lines(spark.createDataFrame(rows, WORDS)).collect()}
    high = statistics.median(r[9] - r[7] for r in rows)
    key, lines, want = 0.0, [], {}
    for y, i in sorted((r[7], r[2]) for r in rows):
        if y - key >= 0.3 * high * 1.0:
            key = y
        if key not in lines:
            lines.append(key)
        want[i] = lines.index(key)
    assert got == want


def test_word_offsets_like_a_loop(spark):
    text = "The act. the ACT of act"
    own = ["The", "act.", "THE", "missing", "act"]
    got = offsets.word_offsets(spark.createDataFrame([("d", 1, text, own)], "document_id string, page int, markdown string, words array<string>")).orderBy("word_ord").collect()
    at, want = 0, []
    for w in own:
        i = text.find(w, at)
        if i < 0:
            i = text.lower().find(w.lower(), at)
        want.append(i if i >= 0 else at)
        at = i + len(w) if i >= 0 else at
    assert [r["char_offset"] for r in got] == want


def test_word_offsets_of_every_page_like_a_loop(spark):
    box = "document_id string, page int, content string, words array<struct<text:string,char_offset:bigint>>"
    plain, marked = "tax act levy act tax gone act levy tax", "## Page 1\ntax act\n\n---\n\n## Page 12\nno\n## Page 2\nact tax ACT\n"
    rows = [
        ("plain", 1, plain, [("tax", 0), ("act", None), ("levy", 8)]),
        ("plain", 2, plain, [("act", None), ("tax", 17), ("missing", None), ("Gone", 21)]),
        ("plain", 3, plain, [("act", 26), ("levy", 30), ("tax", 35)]),
        ("marked", 1, marked, [("tax", None), ("act", None), ("ACT", None)]),
        ("marked", 2, marked, [("act", None), ("act", None), ("tax", None)]),
    ]
    spans = {("plain", 1): (0, 12), ("plain", 2): (12, 26), ("plain", 3): (26, len(plain)), ("marked", 1): (9, marked.index("## Page 12")), ("marked", 2): (marked.index("## Page 2\n") + 9, len(marked))}
    boxes = spark.createDataFrame(rows, box)
    own = boxes.join(offsets.page_starts(boxes), ["document_id", "page"]).withColumn("words", F.transform("words", lambda x: x["text"]))
    got = {(r["document_id"], r["page"], r["word_ord"]): r["char_offset"] for r in offsets.word_offsets(offsets.page_slices(own)).collect()}
    want = {}
    for d, page, content, ws in rows:
        start, end = spans[d, page]
        t, at = content[start:end], 0
        for k, (x, _) in enumerate(ws):
            i = t.find(x, at)
            i = i if i >= 0 else t.lower().find(x.lower(), at)
            want[d, page, k] = start + (i if i >= 0 else at)
            at = i + len(x) if i >= 0 else at
    assert got == want


def test_word_offsets_has_every_page(spark, data):
    from folioflow.queries import QUERIES

    boxes = spark.read.parquet(f"{data}/word_bboxes.parquet").where(F.size("words") > 0)
    got = {(r["document_id"], r["page"]) for r in QUERIES["word_offsets"](spark, data).select("document_id", "page").distinct().collect()}
    assert got == {(r["document_id"], r["page"]) for r in boxes.select("document_id", "page").distinct().collect()}


def test_parts_like_a_loop(spark):
    texts = {("a-compendium", n): "x" * (n % 5) + str(n) for n in range(1, 12) if n != 7} | {("b", 1): "one"}
    rows = [(d, n, t) for (d, n), t in texts.items()]
    random.Random(1).shuffle(rows)
    got = offsets.parts(spark.createDataFrame(rows, "document_id string, page int, markdown string"), lambda t: t, pages_a_part=4).orderBy("document_id", "part").collect()
    for d, ranges in {"a-compendium": [(1, 4), (5, 8), (9, 11)], "b": [(1, 1)]}.items():
        whole = offsets.SEPARATOR.join(t for (x, _), t in sorted(texts.items()) if x == d)
        own = [r for r in got if r["document_id"] == d]
        assert [(r["part"], r["first_page"], r["last_page"]) for r in own] == [(i, *p) for i, p in enumerate(ranges)]
        assert [whole[r["start_char"] : r["end_char"]] for r in own] == [r["kept"] for r in own]
        assert offsets.SEPARATOR.join(r["kept"] for r in own) == whole


def test_document_parts_has_every_document(spark, data):
    from folioflow.queries import QUERIES

    got = QUERIES["document_parts"](spark, data).collect()
    pages = QUERIES["page_offsets"](spark, data).groupBy("document_id").agg(F.max("end_char").alias("n")).collect()
    ends = {}
    for r in got:
        ends[r["document_id"]] = max(ends.get(r["document_id"], 0), r["end_char"])
    assert ends == {r["document_id"]: r["n"] for r in pages}
    assert any(d.endswith("compendium") for d in ends)
    short = {r["document_id"]: r["digest"] for r in QUERIES["document_markdown"](spark, data).collect()}
    one = {r["document_id"]: r["digest"] for r in got if r["part"] == 0 and r["end_char"] == ends[r["document_id"]]}
    assert all(short[d] == x for d, x in one.items() if d in short)


def test_rotation_keeps_boxes(spark):
    df = spark.createDataFrame([word(0, "a", 0, 0, 10.0, 20.0, 30.0, 40.0)], WORDS)
    r = words.rotate(df, F.lit(90.0), F.lit(100), F.lit(100)).first()
    assert (r["x2"] - r["x0"], r["y2"] - r["y0"]) == (20.0, 20.0)
    turned = words.orient(spark.createDataFrame([word(0, "a", 0, 0, 0.1, 0.2, 0.3, 0.4)], WORDS), F.lit(180)).first()
    assert np.allclose([turned["x0"], turned["y0"], turned["x2"], turned["y2"]], [0.7, 0.6, 0.9, 0.8])


def test_cosine_like_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in v[i]], i % 3) for i in range(60)] + [(60, None, 0), (61, [], 1), (62, [0.0] * 8, 2)]
    points = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    q = points.where("vec_id < 5").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), "label")
    got = {(r["qid"], r["rank"]): r["vec_id"] for r in vectors.top_k(points, q, 4).collect()}
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    for i in range(5):
        assert [got[i, r] for r in range(1, 5)] == sorted(range(60), key=lambda j: (-s[i, j], j))[:4]
    assert vectors.top_k(points, q.limit(0), 4).count() == 0
    assert {r["vec_id"] % 3 for r in vectors.top_k(points, q.where("qid = 1"), 9, same="label").collect()} == {1}


def test_bm25_tokens(spark):
    def tok(t):
        return spark.range(1).select(bm25.tokens(F.lit(t))).first()[0]

    assert tok("Section 12A of the VAT Act, clause (b), 15b") == ["section 12a", "clause (b)", "15b", "of", "the", "vat", "act"]
    assert tok("éab ab") == ["ab"]
    assert tok("") == []


def test_bm25_like_a_loop(spark):
    texts = {1: "alpha beta beta", 2: "beta gamma", 3: "delta", 4: None, 5: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    q = spark.createDataFrame([(7, "beta beta delta"), (8, "nothing")], "qid bigint, query string")
    got = {(r["qid"], r["doc_id"]): r["score"] for r in bm25.search(docs, q, "doc_id", "text").collect()}
    corpus = {i: (t or "").split() for i, t in texts.items()}
    n, avg = len(corpus), sum(map(len, corpus.values())) / len(corpus)
    terms = {w for t in corpus.values() for w in t}
    raw = {w: np.log(n - sum(w in t for t in corpus.values()) + 0.5) - np.log(sum(w in t for t in corpus.values()) + 0.5) for w in terms}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    want = {}
    for i, t in corpus.items():
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in "beta beta delta".split() if w in t)
        if any(w in t for w in ("beta", "delta")):
            want[7, i] = round(s, 6)
    assert got == want


def test_fusion_of_empty_legs(spark):
    one = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.4)], "qid bigint, chunk_id bigint, score double")
    assert [(r["chunk_id"], r["score"]) for r in hybrid.fuse(one, one.limit(0), 5).orderBy("rank").collect()] == [(10, 0.35), (11, 0.28)]
    assert [(r["chunk_id"], r["score"]) for r in hybrid.fuse(one.limit(0), one, 5).orderBy("rank").collect()] == [(10, 0.3), (11, 0.0)]
    assert hybrid.weights(0, 0) == (0.7, 0.3)


def test_merge_and_caps(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k bigint, v string, created int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 9)], "k bigint, v string, created int")
    assert sorted(map(tuple, upsert.merge(old, new, ["k"], ["created"]).collect()), key=str) == [(1, "a", 1), (2, None, 2), (3, "c", 9)]
    rows = spark.createDataFrame([("u", i) for i in range(5)], "u string, t int")
    assert [upsert.newest(rows, ["u"], [F.desc("t")], n).count() for n in (1, -1, 0)] == [1, 5, 0]


def test_costs_and_quota(spark):
    calls = spark.createDataFrame([(1, "flash", 1_000_000, 2_000_000, 0, 0), (2, "nope", 5, 0, 5, 5)], "event_id bigint, model string, input_tokens bigint, cached_tokens bigint, output_tokens bigint, thinking_tokens bigint")
    assert {r["event_id"]: r["cost_usd"] for r in usage.cost(calls).collect()} == {1: 0.075, 2: 0.0}
    allowed, left = usage.quota(F.col("u"), F.col("l"))
    rows = spark.createDataFrame([(5, -1), (10, 10), (3, 10), (0, 0)], "u int, l int").select(allowed, left).collect()
    assert [tuple(r) for r in rows] == [(True, -1), (False, 0), (True, 7), (False, 0)]


def test_tree_end_like_a_loop(spark):
    rng = random.Random(5)
    rows = [("d", i, "t" * rng.randint(1, 5), rng.randint(0, 60), 80) for i in range(25)]
    df = spark.createDataFrame(rows, "document_id string, line_no int, title string, start_char int, total int")
    got = {r["line_no"]: r["end_char"] for r in trees.next_start(df, ["document_id"], "start_char", "title", F.col("total")).collect()}
    assert got == {i: min((s for _, _, _, s, _ in rows if s > a + len(t)), default=80) for _, i, t, a, _ in rows}


def test_anchors(spark):
    text = "Preface\nSection 1 Of the levy\nSection 2 Of the fund"
    rows = [("d", 1, text, "Of the fund", None), ("d", 2, text, "x", "section 2 of"), ("d", 3, text, "", "Sectiom 2 Of teh fund"), ("d", 4, text, None, None)]
    df = spark.createDataFrame(rows, "document_id string, node int, text string, title string, start_text string")
    got = {r["node"]: r["start_char"] for r in trees.anchor_places(df, "text", "title", "start_text").collect()}
    assert got[1] == text.index("Of the fund") and got[2] == text.index("Section 2") and abs(got[3] - text.index("Section 2")) <= 2 and got[4] == -1


def test_chunk_sizes(spark):
    df = spark.createDataFrame([(1, ["a" * 99, "b" * 100, "c" * 2001 + ". " + "d" * 10]), (2, []), (3, None)], "k bigint, pieces array<string>")
    sizes = [len(r["chunk"]) for r in chunks.fit_sizes(df, "k", "pieces").orderBy("chunk_index").collect()]
    assert sizes == [201, 2002, 10]
    assert chunks.fit_sizes(df, "k", "pieces", keep_oversized=True).count() == 4


def test_definitions(spark):
    df = spark.createDataFrame([(1, ['"Levy" means a', "charge.", "Rest.", '"Fee" means a', "more"])], "k bigint, pieces array<string>")
    got = chunks.merge_definitions(df, "k", "pieces").orderBy("chunk_index").collect()
    assert [r["chunk"] for r in got] == ['"Levy" means a charge.', "Rest.", '"Fee" means a', "more"]


def test_windows_end_with_the_text(spark):
    df = spark.createDataFrame([(1, "x" * 2001), (2, "y"), (3, ""), (4, None)], "k bigint, t string")
    got = chunks.windows(df, "k", "t").orderBy("k", "chunk_index").collect()
    assert [(r["k"], r["start_char"], len(r["chunk"])) for r in got] == [(1, 0, 1000), (1, 800, 1000), (1, 1600, 401), (2, 0, 1)]


def test_citations(spark):
    df = spark.createDataFrame([(1, "X [CITE:c1] Y [CITE:c2] [CITE:c1] [CITE:zz]"), (2, None), (3, "none")], "k bigint, a string")
    assert [(r["k"], r["cite"]) for r in studio.cited(df, "k", "a").orderBy("ord").collect()] == [(1, "c1"), (1, "c2"), (1, "zz")]
    uses = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "a", 3), ("q", "b", 4), ("q", "a", 5)], "q string, d string, ord int")
    assert tuple(studio.primary(uses, "q", "d").first()) == ("q", "a", 0.6)
    # Of equally used ones the first in the answer counts.
    assert tuple(studio.primary(uses.limit(4), "q", "d", 0.5).first()) == ("q", "a", 0.5)


@pytest.mark.parametrize(
    "text, sections, chapters",
    [("Chapter 3\nSection 12 ...\nSection 12A ...\nClause (a) ...", ["12", "12A"], ["3"]), ("", [], []), ("Sec. 5 § 4 Part 2", ["4", "5"], ["2"])],
)
def test_metadata(spark, text, sections, chapters):
    r = spark.range(1).select(T.section_numbers(F.lit(text)).alias("s"), T.chapter_numbers(F.lit(text)).alias("c"), T.title_year(F.lit("ऐन_२०७८")).alias("y")).first()
    assert (r["s"], r["c"], r["y"]) == (sections, chapters, "2078")


def test_short_title(spark):
    got = [r[0] for r in spark.createDataFrame([("a" * 56,), ("b" * 57,), (" c  d ",)], "t string").select(T.short_title(F.col("t"))).collect()]
    assert [len(got[0]), len(got[1]), got[2]] == [56, 54, "c d"]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "आर्थिक_ऐन_२०७८.pdf").write_bytes(b"x" * 10)
    (tmp_path / "b.txt").write_text("no")
    found = files.check_files(files.scan_folder(spark, str(tmp_path)))
    assert [(r["year"], r["size"], r["problem"]) for r in found.collect()] == [(2078, 10, None)]
    blob = spark.createDataFrame([("f", bytearray(range(10))), ("g", bytearray())], "file_id string, content binary")
    assert bytes(files.join_file(files.split_file(blob, 4)).first()["content"]) == bytes(range(10))


def test_responses_and_uploads(spark):
    r = spark.createDataFrame([("d", 1, '{"words":[{"text":"a","x0":0.1},{"text":"b"}]}'), ("d", 2, "{broken")], "document_id string, page int, response string")
    assert [(x["index_sort"], x["text"]) for x in files.words_of_responses(r).collect()] == [(0, "a"), (1, "b")]
    b = spark.createDataFrame([("d", "p", "PAGE", None, ["l"]), ("d", "l", "LINE", None, ["w2", "w1", "gone"]), ("d", "w1", "WORD", "one", None), ("d", "w2", "WORD", "two", None)], "document_id string, id string, kind string, text string, children array<string>")
    assert [x["text"] for x in files.block_graph_words(b).orderBy("line", "word").collect()] == ["two", "one"]
    good, bad = files.uploads(spark.createDataFrame([(1, '{"parsed":{"markdown":"# T","language":"en"}}'), (2, '{"parsed":{"markdown":" "}}'), (3, None)], "id int, body string"))
    assert (good.count(), bad.count()) == (1, 2)


def test_tables_and_trees(spark):
    cells = spark.createDataFrame([("t", 1, 1, "a|b"), ("t", 2, 2, "x")], "table_id string, row int, col int, text string")
    assert files.table_to_markdown(cells).first()["markdown"] == "| a\\|b |  |\n| --- | --- |\n|  | x |"
    n = spark.createDataFrame([("1", "T", [1, 2]), ("", "T", None), ("2", " ", None), ("3", "T", [3, 2]), ("4", "T", [1])], "nodeId string, title string, page_range array<int>")
    assert [r["problem"] for r in files.tree_problems(n).collect()] == [None, "no id", "no title", "page range", "page range"]


def test_pipelines(spark, data):
    ocr = spark.read.parquet(f"{data}/ocr_words.parquet").dropDuplicates(["document_id", "page", "index_sort"])
    text, spans = pipelines.to_markdown(ocr.where("document_id not like '%compendium'"))
    joined = spans.join(text, "document_id").where(~F.startswith(F.expr("substring(markdown, start_char + 1, end_char - start_char)"), F.concat(F.lit("## Page "), F.col("page").cast("string"))))
    assert text.count() > 0 and joined.count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet")
    own = pipelines.attach_metadata(pipelines.chunk_documents(docs, "doc_id", "text"), docs, "doc_id", "text")
    assert own.where("quality < 0 or quality > 1").count() == 0 and own.count() > 0
    q = spark.createDataFrame([(1, "levy on timber"), (2, "seal")], "qid bigint, query string")
    assert {r["qid"] for r in pipelines.retrieve(docs, q, "doc_id", "text").collect()} == {1, 2}


def test_same_result_for_any_partitions(spark, data):
    from folioflow.queries import QUERIES

    def rows():
        return sorted(map(repr, QUERIES["bm25_topk"](spark, data).collect()))

    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == rows()


def test_sketch_is_near(spark, data):
    from folioflow.queries import QUERIES

    exact = {r[0]: r[1] for r in spark.read.parquet(f"{data}/events.parquet").groupBy(F.date_format("ts", "yyyy-MM-dd")).agg(F.countDistinct("user_id")).collect()}
    assert all(abs(r["users"] - exact[r["day"]]) <= max(1, 0.05 * exact[r["day"]]) for r in QUERIES["approx_users"](spark, data).collect())
