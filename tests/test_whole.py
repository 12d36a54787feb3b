"""Queries over all rows, dirty ones too, against plain loops with Python's regular expressions."""

from __future__ import annotations

import hashlib
import re

import pytest

from folioflow.queries import QUERIES

DIRTY = [
    "a\u00a0: b\u2003c\r",
    "x:\u2028y\u2029z\nx : last\u0085",
    "\u0130d:\u001c v\nfoo:\u3000bar\nno colon\n:none\nempty: ",
    "see https://a.b/c\u00a0d and https://e.f/g\u3000h,\u2028https://a.b/c\u001fz (http://i.j)\u000bk <https://l.m>",
    "## \u00a0Head\u2003**bold**\u200b text `code`\u0085# mark\n#\u3000Second *it*",
    "one\u001dtwo\u2028three\u202f. [CITE:c1]",
    "\nChapter\u00a07 of it\nSection\u200312\n\u3000\nArt. 5\u0001 end\u0085\n##\u2003Title",
    "<!-- a\u2028b --> kept <!-- not\nclosed --> end\u205f " + "long " * 60 + "\u1680tail",
    "plain",
]
WORDS = ["a::b", "::", ":", "~a:b~", "१२:३", "क:ख", "12:30", "x:", "：:", "a:b:c", "12::x", "none"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("dirty"))
    texts = list(enumerate([*DIRTY, None], 1))
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(f"d{i}", t) for i, t in texts], "document_id string, content string").write.parquet(f"{at}/parsed_documents.parquet")
    spark.createDataFrame([(i, True, t) for i, t in texts], "result_id bigint, use_llm boolean, answer string").write.parquet(f"{at}/query_results.parquet")
    spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(WORDS)], "document_id string, page int, index_sort int, text string").write.parquet(f"{at}/ocr_words.parquet")
    return at


def rows(spark, folder, name, *cols):
    return {tuple(r[c] for c in cols) for r in QUERIES[name](spark, folder).select(*cols).collect()}


def squeeze(t):
    return re.sub(r"\s+", " ", t).strip()


def test_links(spark, folder):
    want = set()
    for i, t in enumerate(DIRTY, 1):
        found = re.findall(r"""https?://[^\s"'<>)]+""", t)
        want |= {(i, u, found.index(u) + 1) for u in found}
    assert rows(spark, folder, "links_extract_whole", "doc_id", "url", "ord") == want


def test_key_values(spark, folder):
    want = {}
    for i, t in enumerate(DIRTY, 1):
        for line in t.split("\n"):
            if m := re.search(r"\A([^:\n]+?):\s*(.+)\Z", line, re.S):
                want[i, m[1].strip().lower()] = m[2].strip()
    assert rows(spark, folder, "kv_fields_whole", "doc_id", "field", "value") == {(*k, v) for k, v in want.items()}


def test_colons(spark, folder):
    want = set()
    for i, t in enumerate(WORDS):
        if ":" in t:
            want.add(("d", 1, i, len([p for p in re.sub(r"(?<=\D):|^:", "\1:\1", t).split("\1") if p])))
    assert rows(spark, folder, "break_colons_whole", "document_id", "page", "index_sort", "pieces") == want


def test_anchors(spark, folder):
    want = {(f"d{i}", squeeze(re.sub(r"<!--.*?-->", "", t))) for i, t in enumerate(DIRTY, 1)}
    assert rows(spark, folder, "anchor_sanitise_whole", "document_id", "anchor") == want


def test_sections(spark, folder):
    want = set()
    for i, t in enumerate(DIRTY, 1):
        legal = f"Chapter {i % 9}\nSection {i % 40}{'A' if i % 3 == 0 else ''} of Income Tax Act {2058 + i % 25}\n{t}"
        cuts = (r"(?=\nChapter\s+[0-9]+)|(?=\nPART\s+[0-9]+)", r"(?=\nSection\s+[0-9]+)|(?=\nArt\. [0-9]+)", r"(?=\n#{1,3}\s+)")
        pieces = ["\n" + legal]
        for cut in cuts:
            pieces = [x for p in pieces for x in re.split(cut, p)]
        own = [p.strip() for p in pieces if p.strip()]
        want.add((i, len(own), hashlib.md5("|".join(own).encode()).hexdigest()))
    assert rows(spark, folder, "section_split_whole", "doc_id", "pieces", "digest") == want


def test_responses(spark, folder):
    want = set()
    for i, t in enumerate(DIRTY, 1):
        a = re.sub(r"([.!?])([A-Z])", r"\1 \2", re.sub(r"\.{3,}", "...", re.sub(r"\s+", " ", t))).strip()
        want.add((i, a, len(a.split(" ")) if a else 0, any(re.search(x, a, re.I) for x in CITED), bool(a) and (a[-1] in ".!?:)}]" or len(a) < 50), any(re.search(x, a) for x in FORMATTED)))
    assert rows(spark, folder, "response_checks_whole", "result_id", "answer", "word_count", "has_citations", "complete", "formatted") == want


def test_previews(spark, folder):
    want = set()
    for i, t in enumerate(DIRTY, 1):
        for pattern, by in ((r"<[^>]+>", ""), (r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"), (r"`([^`]+)`", r"\1"), (r"#{1,6}\s", "")):
            t = re.sub(pattern, by, t)
        want.add((i, squeeze(t)[:120]))
    assert rows(spark, folder, "chat_previews_whole", "result_id", "preview") == want


CITED = (r"Section\s+\d+", r"Act\s+\d+", r"Chapter\s+\d+", r"Article\s+\d+", r"\[.*?Act.*?\]", r"\(.*?Section.*?\)")
FORMATTED = (r"^\d+\.\s", r"^[-*]\s", r"^#{1,6}\s", r"\*\*.*?\*\*", r"_.*?_")
LONG = {"late": "अ, " * 1200 + "\n## Toll of Bridges\nसाल २०६५ and 2051", "early": "# Levy\nin 2060", "out": "x " * 300 + "1999 2049 then 2060", "none": "no year"}


@pytest.fixture(scope="module")
def long_folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(list(LONG.items()), "document_id string, content string").write.parquet(f"{at}/parsed_documents.parquet")
    return at


def test_anchors_late_in_a_text(spark, long_folder):
    # The damaged anchor fits a window that begins one character before the title as well.
    got = dict(rows(spark, long_folder, "tree_anchors", "document_id", "start_char"))
    assert got == {"late": LONG["late"].index("Toll of Bridges") - 1, "early": 1}


def test_normal_forms_of_whole_texts(spark, long_folder):
    signs, digits = str.maketrans(dict.fromkeys(".,:;()[]{}\"'`।॥", " ")), str.maketrans("०१२३४५६७८९", "0123456789")
    want = {(d, t.translate(signs).lower(), t.translate(digits)) for d, t in LONG.items()}
    assert rows(spark, long_folder, "normal_forms_whole", "document_id", "same_length", "digits") == want


def test_years_late_in_a_text(spark, long_folder):
    assert rows(spark, long_folder, "year_guess_filter_whole", "document_id", "year") == {("late", 2065), ("early", 2060)}


@pytest.mark.parametrize(
    "text",
    ["Hauptplatz 3, 10115 Berlin", "Lindenallee 7, 10115 Berlin", "12 avenue Foch, 75016 Paris", "3 place Monge, 75005 Paris", "Plaza Mayor 4, 28012 Madrid", "Camino Real 4, 28012 Madrid", "Bhat Chowk", "Lalitpur Municipality-4", "Block B2", "राम सडक", "फ्ल्याट 3"],
)
def test_gate_of_addresses(text):
    from folioflow.llm import pii

    assert pii.ADDRESS.search(text) and pii.ADDRESS_NEAR.search(text)
