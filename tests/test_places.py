"""Anchors, highlights, trees, chunks and links against plain loops and values worked out by hand."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import bm25, chunks, highlights, sizes, studio, trees, upsert, vectors, words
from folioflow.plans import pipelines
from folioflow.sources import files
from folioflow.sources.tables import keep


def slow_fuzzy(needle: str, text: str, threshold: float = 0.6) -> int:
    """All windows compared, one after another."""
    n, t = needle.lower(), text.lower()
    if len(n) < 3 or not t:
        return -1
    step = max(1, len(n) // 10)
    ratio = lambda i: SequenceMatcher(None, t[i : i + len(n)], n, autojunk=False).ratio()
    top, at = 0.0, -1
    for i in range(0, max(1, len(t) - len(n) // 2), step):
        if ratio(i) > top:
            top, at = ratio(i), i
    if at >= 0 and top >= 0.9 * threshold:
        for i in range(max(0, at - step), min(len(t) - len(n) // 2, at + step + 1)):
            if ratio(i) > top:
                top, at = ratio(i), i
    return at if top >= threshold else -1


def test_fuzzy_like_a_loop():
    rng = random.Random(11)
    for _ in range(120):
        text = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 90)))
        at = rng.randint(0, max(0, len(text) - 1))
        needle = "".join(c if rng.random() > 0.2 else rng.choice("abx") for c in text[at : at + rng.randint(0, 30)])
        assert trees.fuzzy(needle, text)[0] == slow_fuzzy(needle, text), (needle, text)
    assert trees.fuzzy("ab", "abab") == (-1, 0.0)


@pytest.mark.parametrize(
    "start_text, title, want",
    [
        ("of the LEVY", "", "start_text"), ("Of the levy that is due", "", "start_text"), ("२. Of fund (the) and what else there is", "", "number"), ("Of teh funb and bonk", "", "start_text_like"),
        ("zzzzzzzz", "Preface", "title"), ("", "Prefase", "title_like"), ("", "", "none"), (None, None, "none"), ("xy", "", "none"),
    ],
)
def test_anchor_legs(start_text, title, want):
    text = "Preface\n१. Of the levy, that is due;\n२. Of fund the and so on\nOf the fund and bank"
    at, leg = trees.anchor(start_text, title, text)
    assert leg == want and (at == -1) == (want == "none")


def test_end_texts(spark):
    rows = [(1, "a b. The END, here; c", 2, "the end here", 20), (2, "a b", 0, "zzzz", 3), (3, "a b", -1, "b", -1), (4, None, 0, "b", None), (5, "a b", 0, None, 3)]
    df = spark.createDataFrame(rows, "node int, text string, start bigint, end_text string, end_char bigint")
    got = {r["node"]: r["end_char"] for r in trees.end_places(df, "text", "start", "end_text").collect()}
    assert got == {1: 17, 2: 3, 3: -1, 4: None, 5: 3}


def test_ends_of_nodes_without_a_start(spark):
    df = spark.createDataFrame([("d", 1, "ab", -1, 50), ("d", 2, "ab", 3, 50), ("d", 3, "ab", 9, 50)], "document_id string, n int, title string, start_char int, total int")
    got = {r["n"]: r["end_char"] for r in trees.next_start(df, ["document_id"], "start_char", "title", F.col("total")).collect()}
    assert got == {1: -1, 2: 9, 3: 50}


def test_page_boxes_like_a_loop(spark):
    rng = random.Random(2)
    pages, at = [], 0
    for p in range(1, 40):
        n = rng.choice([0, 10, 900, 5000])
        pages.append(("d", p, at, at + n, 0.0, 10.0, 5.0, 110.0))
        at += n + 7
    nodes = [("d", i, *((-1, -1) if i % 7 == 0 else sorted((rng.randint(0, at), rng.randint(0, at)))), *((None, None) if i % 3 else (rng.randint(1, 30), rng.randint(30, 42)))) for i in range(30)]
    got = {(r["node"], r["page"], r["y0"], r["y2"]) for r in trees.page_boxes(
        spark.createDataFrame(nodes, "document_id string, node int, start_char int, end_char int, first_page int, last_page int"),
        spark.createDataFrame(pages, "document_id string, page int, start_char int, end_char int, x0 double, y0 double, x2 double, y2 double")).collect()}
    want = set()
    for _, n, s, e, a, b in nodes:
        for _, p, ps, pe, _, y0, _, y2 in pages:
            if s >= 0 and e >= 0:
                if ps < e and pe > s and (a is None or a <= p <= b):
                    top, low = ((max(s, ps) - ps) / (pe - ps), (min(e, pe) - ps) / (pe - ps)) if pe > ps else (0.0, 1.0)
                    want.add((n, p, round(y0 + top * (y2 - y0), 6), round(y0 + low * (y2 - y0), 6)))
            elif a is not None and a <= p <= min(b, a + 1):
                want.add((n, p, y0, y2))
    assert got == want


def test_numbering_in_parts(spark):
    rng = random.Random(8)
    paths = sorted({tuple(rng.randint(0, 5) for _ in range(rng.randint(1, 4))) for _ in range(200)})
    df = spark.createDataFrame([(list(p),) for p in rng.sample(paths, len(paths))], "path array<int>")
    assert {tuple(r["path"]): r["id"] for r in trees.depth_first_within(df, 2).collect()} == {p: i for i, p in enumerate(paths)}


def test_nested_trees(spark):
    tree = '{"nodes": [{"nodeId": "a", "title": "A", "children": [{"nodeId": "b", "title": "B"}]}, {"nodeId": "c", "title": "C"}]}'
    got = trees.flatten(spark.createDataFrame([(1, tree), (2, "no"), (3, None), (4, "[]")], "k bigint, t string"), "k", "t").collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["id"])] == [(1, 0, "a", None, 0, "A"), (1, 1, "b", "a", 1, "B"), (1, 2, "c", None, 0, "C")]


def test_navigation(spark):
    nodes = spark.createDataFrame([("a", "Of the levy", "rates on tea"), ("b", "Of the fund", None), ("c", None, None), ("d", "Of jute", "")], "node string, title string, summary string")
    got = trees.navigate(nodes, spark.createDataFrame([(1, "the levy on tea"), (2, ""), (3, "zebra")], "qid bigint, query string"), "node", 2).collect()
    assert {(r["qid"], r["rank"], r["node"]) for r in got} == {(1, 1, "a"), (1, 2, "b")}


def boxed(spark, pages):
    rows = [("d", p, [(t, 10.0 * j, 0.1 * i, 10.0 * j + 5, 0.1 * i + 0.05, i) for i, line in enumerate(lines) for j, t in enumerate(line.split(" "))]) for p, lines in pages]
    return highlights.page_words(spark.createDataFrame(rows, "document_id string, page int, words array<struct<text:string,x0:double,y0:double,x2:double,y2:double,line:int>>"))


def test_anchored_sections(spark):
    pages = boxed(spark, [(1, ["Preface of the act", "1. The levy is due", "in the month of May"]), (2, ["and the bank pays", "2. The fund is held"]), (4, ["The levy is due at once"])])
    nodes = [
        ("d", "same", "The levy is", "of May", 1, 1), ("d", "over", "the levy, is", "bank pays", 1, 2), ("d", "marker", "and the bank", None, 2, 2), ("d", "range", "in the month", "", 1, 2),
        ("d", "slack", "fund is held", "held", 3, 3), ("d", "none", "nothing of the kind at all", "x", 1, 4), ("d", "blank", " ", "x", 1, 1), ("d", "null", None, None, None, None),
    ]
    got: dict[str, list] = {}
    for r in highlights.anchored(spark.createDataFrame(nodes, "document_id string, node string, start_text string, end_text string, first_page int, last_page int"), pages).collect():
        got.setdefault(r["node"], []).append((r["page"], r["ord"], r["how"]))
    span = {k: (min(v)[:2], max(v)[:2], v[0][2], len(v)) for k, v in got.items()}
    assert span == {
        "same": ((1, 5), (1, 13), "end_text", 9), "over": ((1, 5), (2, 3), "end_text:xpage", 13), "marker": ((2, 0), (2, 3), "marker", 4),
        "range": ((1, 9), (2, 8), "range_end", 14), "slack": ((2, 6), (4, 5), "range_end", 9),
    }


def test_titled_sections(spark):
    pages = boxed(spark, [(1, ["Preface of the act", "1. The levy is due", "in May", "2. Fund"]), (2, ["and The levy here", "so on"]), (3, ["Next title stands", "below"])])
    nodes = [("d", "a", "The levy:", None, 1, 1), ("d", "b", "levy here", "Next title", 2, 3), ("d", "c", "zebra", None, 1, 1), ("d", "d", "Fund", None, None, None)]
    got: dict[str, set] = {}
    for r in highlights.titled(spark.createDataFrame(nodes, "document_id string, node string, title string, next_title string, first_page int, last_page int"), pages).collect():
        got.setdefault(r["node"], set()).add((r["page"], round(r["y0"], 2)))
    # "The levy" is sought from the top: "Preface of the act" has no token of it.
    assert got == {"a": {(1, 0.1), (1, 0.2)}, "b": {(2, 0.0), (2, 0.1)}}
    first = spark.createDataFrame([("d", "a", 1, 0.1, 0.1, 0.2, 0.2)], "document_id string, node string, page int, x0 double, y0 double, x2 double, y2 double")
    second = spark.createDataFrame([("d", "a", 1, 0.5, 0.5, 0.6, 0.6), ("d", "b", 2, 0.5, 0.5, 0.6, 0.6)], first.schema)
    sizes_ = spark.createDataFrame([("d", 1, 100, 200)], "document_id string, page int, width int, height int")
    best = {(r["node"], r["source"], round(r["x0"], 3), round(r["y0"], 3)) for r in highlights.best_candidates([first, second], sizes_).collect()}
    assert best == {("a", 1, 10.0, 20.0), ("b", 2, 0.5, 0.5)}


def test_legal_sections_and_sentence_windows(spark):
    text = "Intro\nChapter 1 A\nSection 2A x\nClause (a) y\n§ 3 z\nSchedule\u00a04 s\nदफा १२ क\nखण्ड (ख) ग\n## Head\n#### no\nSection two"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(chunks.legal_sections(F.col("t")).alias("p")).collect()
    assert got[0]["p"] == ["Intro", "Chapter 1 A", "Section 2A x", "Clause (a) y", "§ 3 z", "Schedule\u00a04 s", "दफा १२ क", "खण्ड (ख) ग", "## Head\n#### no\nSection two"]
    assert got[1]["p"] == [] and got[2]["p"] is None
    long = ("The levy is due on tea. " * 70).strip()
    rows = chunks.sentence_windows(spark.createDataFrame([(1, long), (2, "x" * 2500), (3, ""), (4, None)], "k bigint, t string"), "k", "t").orderBy("k", "chunk_index").collect()
    own = [(r["start_char"], r["end_char"]) for r in rows if r["k"] == 1]
    assert all(long[b - 1] == "." for _, b in own) and own[0] == (0, 983) and all(b2 == a1 - 200 or a1 == len(long) for (_, a1), (b2, _) in zip(own, own[1:])) and own[-1][1] == len(long)
    assert [(r["start_char"], r["end_char"]) for r in rows if r["k"] == 2] == [(0, 1000), (800, 1800), (1600, 2500)] and {r["k"] for r in rows} == {1, 2}


def test_definitions(spark):
    own = [['a "levy" means the sum', "that is due.\n", "b"], ['"x" shall mean', "y"], ["plain", "text."], ['means "z"', "w; (a) v"], [], None]
    df = spark.createDataFrame(list(enumerate(own)), "k bigint, c array<string>")
    got: dict[int, list] = {}
    for r in chunks.merge_definitions(df, "k", "c").orderBy("k", "chunk_index").collect():
        got.setdefault(r["k"], []).append(r["chunk"])
    assert got == {0: ['a "levy" means the sum that is due.\n', "b"], 1: ['"x" shall mean', "y"], 2: ["plain", "text."], 3: ['means "z" w; (a) v']}


def test_act_titles(spark):
    rows = [("in the income  tax act of", "/a/b.pdf"), ("x", "/a/customs_rules.pdf"), ("x", "C:\\d\\land-act 2.pdf"), ("यो भूमि ऐन हो", "/a/b.pdf"), ("the Public Weighing Act says", "b"), ("the NEW x Act", "b"), ("none", None), (None, "b.pdf")]
    got = [r["a"] for r in spark.createDataFrame(rows, "c string, n string").select(T.act_title(F.col("c"), F.col("n")).alias("a")).collect()]
    assert got == ["income  tax act", "customs", "Land Act 2", "यो भूमि ऐन", "Public Weighing Act", "NEW x Act", None, None]


def test_colon_pieces(spark):
    def slow(t, space):
        at = [i for i, c in enumerate(t) if c == ":" and (i == 0 or not t[i - 1].isdigit())]
        out = [] if at else [(t, space)]
        for k, i in enumerate(at):
            if k == 0 and i > 0:
                out.append((t[:i], 2))
            out.append((":", 2))
            end, kind = (at[k + 1], 2) if k + 1 < len(at) else (len(t) - 1, space)
            if i + 1 < end:
                out.append((t[i + 1 : end + 1], kind))
        return out

    texts = ["a:b", "a:bc", "::", ":x:yz", "12:30", "१:x", "none", "a:b:cd:", ""]
    df = spark.createDataFrame([(i, t, 0.0, float(len(t)), 1, 5) for i, t in enumerate(texts)], "k bigint, text string, x0 double, x2 double, space_type int, run int")
    got: dict[int, list] = {}
    for r in words.colon_pieces(df).orderBy("k", "piece").collect():
        got.setdefault(r["k"], []).append((r["text"], r["space_type"]))
        if ":" in texts[r["k"]]:
            assert texts[r["k"]][int(r["x0"]) : int(r["x2"])] == r["text"]
    assert got == {i: slow(t, 1) for i, t in enumerate(texts)}


def test_ledger_of_events(spark):
    e = [("s", 2, 1, "in_progress", "t1", None, None), ("s", 3, 1, "failed", "t2", None, "e" * 9000), ("s", 4, 1, "success", "t3", "doc", None), ("r", 1, 1, "success", "a", "x", None), ("r", 5, 1, "failed", None, None, "late")]
    got = {r["source_id"]: tuple(r)[1:] for r in upsert.ledger(spark.createDataFrame(e, "source_id string, at int, seq int, status string, title string, document_id string, error string")).collect()}
    assert got == {"s": ("doc", "t3", "success", None, 2, 4, 4), "r": ("x", None, "failed", "late", 1, 5, 1)}
    half = upsert.ledger(spark.createDataFrame(e[:2], "source_id string, at int, seq int, status string, title string, document_id string, error string")).first()
    assert len(half["error"]) == 8000 and half["ingested_at"] is None


def test_ingest(spark):
    df = spark.createDataFrame([(1, "a" * 1801, 2, 7), (2, " ", None, 7), (3, None, 1, 7)], "k bigint, c string, p int, documents int")
    assert {tuple(r) for r in pipelines.ingest(df, "k", "c").collect()} == {(1, "success", None, 3), (2, "failed", "Empty markdown supplied", 0), (3, "failed", "No content extracted", 0)}
    assert tuple(pipelines.totals(df, F.lit("x"), "c", "p").first()) == ("x", 3, 2, 3, 1802, 3)


def test_links_to_pdf_files(spark):
    html = '<a href="#x.pdf">1</a><A HREF=" a/B.PDF?x=1#f ">2</A><a href="javascript:x.pdf">3</a><a href="/c.pdf">4</a><a href="a/B.PDF?x=1#f">5</a><a href="https://o.example/d.pdf/e">6</a><a>7</a><p href="q.pdf">'
    df = spark.createDataFrame([(1, html, "https://h.example/p"), (2, None, None), (3, "", "x")], "k bigint, html string, at string")
    assert [tuple(r) for r in files.pdf_links(df, "k", "html", "at").orderBy("ord").collect()] == [(1, 0, "https://h.example/p/a/B.PDF?x=1#f"), (1, 1, "https://h.example/c.pdf")]
    page = "see https://cdn.example/media/pdf_upload/a.pdf and var pdf = 'https://cdn.example/media/pdf/b c.pdf'; https://cdn.example/media/pdf/d.PDF https://cdn.example/media/pdf_upload/a.pdf https://other.example/media/pdf/z.pdf"
    got = spark.createDataFrame([(page,)], "h string").select(files.hosted_pdfs(F.col("h"), "cdn.example").alias("u")).first()["u"]
    assert got == ["https://cdn.example/media/pdf_upload/a.pdf", "https://cdn.example/media/pdf/d.PDF", "https://cdn.example/media/pdf/b c.pdf"]


def test_quality_by_hand(spark):
    words_ = [f"w{i}" for i in range(20)]
    rows = [
        (" ".join(words_), 0.7, 0.8), (" ".join(words_[:4] * 5) + " word.", 1.0, 1.0), ("section 1 SECTION\u00a02 Section 3 Section 4 " + " ".join(words_) + ";", 1.0, 0.9),
        ("short.", 1.0, 0.5), ("", 0.0, 0.5), ("\u3000\n", 0.0, 0.5), ("Items:\n 12) ", 0.3, 0.5), ("Items\na)", 0.7, 0.5),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "k bigint, t string").select("k", T.completeness(F.col("t")).alias("a"), T.coherence(F.col("t")).alias("b")).collect()
    want = {i: (a, b) for i, (_, a, b) in enumerate(rows)}
    # "12)" lacks an end mark, its bracket is closed without being opened, and its item is empty.
    want[6] = (0.5, 0.5)
    assert {r["k"]: (r["a"], r["b"]) for r in got} == want


def test_error_classes(spark):
    rows = ["Request timed out after quota", "429", "Invalid argument", "got empty reply", "boom", None]
    got = [r["c"] for r in spark.createDataFrame([(x,) for x in rows], "m string").select(studio.error_class(F.col("m")).alias("c")).collect()]
    assert got[:5] == ["timeout", "rate_limit", "invalid_request", "empty_response", "api_error"]


def test_vectors_like_a_loop(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    own = [(i, [float(x) for x in rng.integers(-2, 3, 4)], int(i % 3), 1) for i in range(300)] + [(900, None, 0, 1), (901, [], 0, 1), (902, [0.0] * 4, 0, 1), (903, [1.0, None, 0.0, 0.0], 0, 1), (904, [1.0, 2.0], 0, 1)]
    points = spark.createDataFrame(own, "vec_id bigint, embedding array<float>, label int, block int")
    asked = points.where("vec_id % 7 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"), "label")
    good = [(i, np.array(v), c) for i, v, c, _ in own if v and None not in v and any(v)]
    for same in (None, "label"):
        got: dict[int, list] = {}
        for r in vectors.top_k(points, asked, 5, same=same).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((r["vec_id"], r["score"]))
        for q, v, c in good:
            if q % 7 == 0:
                want = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), i) for i, w, d in good if i != q and len(w) == len(v) and (same is None or d == c))[:5]
                assert [(i, -s) for s, i in want] == got.get(q, [])
    assert vectors.top_k(points, asked.limit(0), 5).count() == 0 and vectors.top_k(points.limit(0), asked, 5).count() == 0


def test_bm25_counts_in_the_row(spark):
    texts = ["b a b, Section 12 a b", "", None, "zz"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k bigint, t string").select("k", bm25.counted(F.col("t")).alias("c")).collect()
    assert [(x["term"], x["tf"]) for x in got[0]["c"]] == [("section 12", 1)] and got[1]["c"] == got[2]["c"] == [] and [tuple(x) for x in got[3]["c"]] == [("zz", 1)]
    plan = bm25.search(spark.range(5).select(F.col("id").alias("k"), F.lit("levy tea").alias("t")), spark.createDataFrame([(1, "tea")], "qid bigint, query string"), "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan  # texts were tokenised once, before


def test_checked_broadcast(spark):
    plan = lambda df: spark.range(9).join(df, "id").explain
    few, many = sizes.small(spark.range(5), 5), sizes.small(spark.range(6), 5)
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(few) and not hint(many) and plan is not None


def test_kept_tables(spark):
    got = keep(spark.range(3))
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 2] and spark.conf.get("spark.checkpoint.dir") in got.inputFiles()[0].replace("file://", "")
    assert re.search(r"kept-[0-9a-f]{32}", got.inputFiles()[0])
