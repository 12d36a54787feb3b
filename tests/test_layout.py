"""Folds over lines, pages and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import layout


def test_wordify(spark):
    rows = [("d", i, t, s, 0.1 * i, 0.0, 0.1 * i + 0.1, 1.0, c) for i, (t, s, c) in enumerate([("ab", 0, 1.0), ("c", 1, 0.4), ("x", 0, 1.0), (":", 0, 1.0), ("y", 0, 1.0)])]
    df = spark.createDataFrame(rows, "document_id string, index_sort int, text string, space_type int, x0 double, y0 double, x2 double, y2 double, confidence double")
    got = layout.wordify(df, ["document_id"]).orderBy("word").collect()
    assert [r["text"] for r in got] == ["abc", "x", ":", "y"] and round(got[0]["confidence"], 6) == 0.8


def test_rendering(spark):
    rows = [("d", 0, 0.0, 0, "ab", 0), ("d", 0, 10.0, 1, "cd", 0), ("d", 0, 40.0, 2, "ef", 1)]
    df = spark.createDataFrame(rows, "document_id string, line int, x0 double, index_sort int, text string, block int")
    assert layout.rendered_lines(df, ["document_id"]).first()["rendered"] == "    ->0<- ab cd ef"
    unit = spark.createDataFrame([("d", 0, 0.1, 0, "abcd", 0), ("d", 0, 0.5, 1, "X", 1)], df.schema)
    assert layout.rendered_lines(unit, ["document_id"]).first()["rendered"] == "    ->0<- Xbcd"


def test_tree_parts(spark):
    t = "x" * 350_010 + "\n# Head\n" + "y" * 10
    got = spark.createDataFrame([(t,), ("short",), (None,), ("z" * 700_001,)], "t string").select(layout.tree_parts(F.col("t")).alias("p")).collect()
    assert [[(x["start"], x["end"]) for x in r["p"]] for r in got] == [[(0, 350_011), (350_011, len(t))], [(0, 5)], [], [(0, 350_000), (350_000, 700_000), (700_000, 700_001)]]


def test_replies(spark):
    rows = ['```json\n{"a": 1}\n```', 'Here: {"a": "}", "b": {"c": 2}} done', "none", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(layout.outer_json(F.col("t"))).collect()]
    assert got == ['{"a": 1}', '{"a": "}", "b": {"c": 2}}', None, None]
    f = [r[0] for r in spark.createDataFrame([('["a","b","c","d"]',), ("{",), (None,)], "t string").select(layout.follow_ups(F.col("t"))).collect()]
    assert f == [["a", "b", "c"], [], []]


def test_html(spark):
    rows = ["<table><tr><td>a|b</td><td>c</td></tr><tr><td>1</td></tr></table>", "<p>no cells</p>", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(layout.html_tables(F.col("t"))).collect()]
    assert got == ["| a\\|b | c |\n| --- | --- |\n| 1 |  |", "```\nno cells\n```", None]


def test_sentence_chunks(spark):
    t = " ".join(f"Sentence {i} has five words." for i in range(10))
    got = layout.sentence_chunks(spark.createDataFrame([(1, t), (2, None), (3, "")], "k bigint, t string"), "k", "t", 20, 5).orderBy("chunk_index").collect()
    assert [r["n_words"] for r in got] == [20, 20, 20] and got[1]["chunk"].startswith("Sentence 3")
