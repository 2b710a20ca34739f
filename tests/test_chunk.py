"""Chunking against small worked cases."""

from pyspark.sql import functions as F

from folioflow.functions.text import CONTINUED
from folioflow.operators import chunk


def blocks(spark, content):
    rows = spark.createDataFrame([(content,)], "t string").select(chunk.heading_blocks(F.col("t")).alias("b")).first()["b"]
    return [(b.heading, b.body) for b in rows]


def merged(spark, pairs):
    df = spark.createDataFrame([([{"heading": h, "body": b} for h, b in pairs],)], f"b {chunk.BLOCK}")
    return [(m.heading, m.prefix, m.body) for m in df.select(chunk.merge_headings("b").alias("m")).first()["m"]]


def test_blocks(spark):
    assert blocks(spark, "x\n### A\nbody\n### B\n") == [("", "x"), ("A", "body"), ("B", "")]
    assert blocks(spark, "  plain ") == [("", "plain")]
    assert blocks(spark, "### A B\nc") == [("A B", "c")]
    assert blocks(spark, "#### deep\nx") == [("", "#### deep\nx")]


def test_merge_waiting_headings(spark):
    assert merged(spark, [("A", ""), ("A", ""), ("B", "b"), ("C", "c"), ("C", "")]) == [("A > B", "### A\n\n### B", "b"), ("C > C", "### C\n\n### C", "c")]
    assert merged(spark, [("A", ""), ("A" + CONTINUED, "x")]) == [("A", "### A" + CONTINUED, "x")]
    assert merged(spark, [("", "x"), ("T", "")]) == [(" > T", "\n\n### T", "x")]
    assert merged(spark, [("A", ""), ("B", "")]) == [("A > B", "### A\n\n### B", "")]
    assert merged(spark, [("", "")]) == []


def segments(spark, body, room):
    return spark.createDataFrame([(body,)], "body string").select(F.expr(chunk.body_segments("body", str(room)))).first()[0]


def test_tables_stay_whole_and_paragraphs_pack(spark):
    table = "<table>" + "x" * 50 + "</table>"
    assert segments(spark, f"aa\n\nbb\n\n{table}\n\ncc", 10) == ["aa\n\nbb", table, "cc"]
    assert segments(spark, "short", 10) == ["short"]
    assert segments(spark, "one.\ntwo three\nfour", 8) == ["one.", "two three\nfour"]
    assert segments(spark, "aaaa\n- b\nin 2. x", 5) == ["aaaa", "- b\nin 2. x"]


def chunks(spark, rows, **options):
    schema = "doc_id int, page_seq int, logical_page array<int>, pdf_page int, chapter string, section string, current_headings array<string>, content string"
    got = chunk.chunk_pages(spark.createDataFrame(rows, schema), **options).orderBy("chunk_seq").collect()
    return [(r.current_heading, r.content) for r in got]


def test_headings_carry_over_pages(spark):
    rows = [(1, 1, [1], 1, "C", "S", [], "text"), (1, 2, [2], 2, "C", "S", [], "  "), (1, 3, [3], 3, "C", "S", [], "### A\nx\n### B"), (1, 4, [4], 4, "C", "S", [], "more"), (1, 5, [5], 5, "C", "S", [], "#### deep\ny"), (1, 6, [6], 6, "C", "S", [], "end")]
    got = chunks(spark, rows)
    assert got == [("S", f"### S{CONTINUED}\n\ntext"), ("A > B", "### A\n\n### B\n\nx"), ("B", f"### B{CONTINUED}\n\nmore"), ("", "#### deep\ny"), ("B", f"### B{CONTINUED}\n\nend")]


def test_fallback_heading(spark):
    assert chunks(spark, [(1, 1, [1], 1, None, "", None, "x")])[0][0] == chunk.UNTITLED


def test_no_text_is_lost(spark):
    text = "\n\n".join(f"paragraph {i} " + "word " * (i % 17) for i in range(60))
    assert "".join("".join(segments(spark, text, 90)).split()) == "".join(text.split())
