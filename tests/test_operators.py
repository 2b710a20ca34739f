"""Contents, layout, pages, enrichment, tables, evaluation, chat, providers."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import chat, enrich, evaluate, hybrid, layout, pages, providers, tables, toc
from folioflow.sources import files


def test_contents_ranges_and_lookup(spark):
    rows = [(1, 0, "Intro", 2, None, None, None), (1, 1, "One", 4, 0, "a", 6), (1, 1, "One", 4, 1, "b", 9), (1, 2, "No start", None, None, None, None), (1, 3, "Two", None, 0, "c", 12)]
    entries = spark.createDataFrame(rows, "doc_id int, chapter_ord int, chapter string, chapter_start int, section_ord int, section string, start int")
    ranges = toc.close_ranges(entries, 20)
    got = [(r.chapter, r.section, r.start, r.end) for r in ranges.orderBy("chapter_ord", "section_ord").collect()]
    assert got == [("Intro", "Intro", 2, 3), ("One", toc.OPENING, 4, 5), ("One", "a", 6, 8), ("One", "b", 9, 11), ("Two", "c", 12, 20)]
    p = spark.createDataFrame([(1, 1, 7, "x"), (1, 2, 1, ""), (1, 3, None, "own")], "doc_id int, page_id int, page int, chapter string")
    assert {r.page_id: (r.toc_section, r.toc_chapter) for r in toc.lookup(p, ranges).collect()} == {1: ("a", "One"), 2: (toc.OUTSIDE, toc.OUTSIDE), 3: ("own", "own")}


def test_layout_state(spark):
    rows = [(1, 1, "C", "S", "### **A**"), (1, 2, "C", "S", "none"), (1, 3, "C", "", "none"), (1, 4, "C", "T", "none"), (1, 5, "C", "T", "```\n### no\n```\n#### deep\n### B")]
    got = layout.carry_h3(spark.createDataFrame(rows, "doc_id int, page_seq int, chapter string, section string, content string"))
    assert [r.current_h3 for r in got.orderBy("page_seq").collect()] == ["A", "A", "A", None, "B"]
    text = "# A\n```\n# code\n```\n## B\n # indented\n### C"
    assert spark.createDataFrame([(text,)], "t string").select(layout.sanitize_headings("t")).first()[0] == "### A\n```\n# code\n```\n### B\n # indented\n### C"
    stack = spark.createDataFrame([([(1, "a"), (3, "b"), (2, "c"), (3, "d"), (3, "e")],)], "s array<struct<level:int,title:string>>").select(layout.open_headings("s")).first()[0]
    assert [(h.level, h.title) for h in stack] == [(1, "a"), (2, "c"), (3, "e")]


def test_spread_mapping(spark):
    plan = spark.createDataFrame([(1, 1, True, 1, None, "Cover"), (1, 2, False, 2, 3, "C")], "doc_id int, pdf_page int, is_cover boolean, left_logical_page int, right_logical_page int, chapter string")
    rows = [(1, 1, 0, "right", "title"), (1, 2, 0, "left", "l1"), (1, 2, 1, "right", "r"), (1, 2, 2, None, "both"), (1, 2, 3, "left", " l2 "), (1, 2, 4, "top", "lost"), (1, 2, 5, "right", "  ")]
    got = pages.map_blocks(spark.createDataFrame(rows, "doc_id int, pdf_page int, seq int, location string, content string"), plan)
    assert [(r.pdf_page, r.logical_page, r.content) for r in got.orderBy("pdf_page", "part").collect()] == [(1, [1], "title"), (2, [2, 3], "both"), (2, [2], "l1\n\nl2"), (2, [3], "r")]


def test_parse_plan(spark):
    rows = [(1, 1, "", "", False), (1, 2, "8\n9", "Risk\n11\n12", True), (1, 3, "x", "ab", False)]
    plan = pages.parse_plan(spark.createDataFrame(rows, "doc_id int, pdf_page int, left_header string, right_header string, has_body boolean")).orderBy("pdf_page").collect()
    assert [(r.left_logical_page, r.right_logical_page, r.chapter, r.has_content) for r in plan] == [(1, None, pages.COVER, True), (8, 12, "Risk", True), (4, 5, "Risk", False)]


def expanded(spark, text, terms):
    t = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(terms)], "ord int, term string, definition string")
    return enrich.expand(spark.createDataFrame([(text,)], "text string"), t).first()["text"]


def test_abbreviations(spark):
    casa = [("CASA", "current")]
    for text in ("CASAđ", "(CASA)", "CASA (x)", "CASA (x)", "xCASA"):
        assert expanded(spark, text, casa) == text
    assert expanded(spark, "CASA, CASA", casa) == "CASA (current), CASA"
    assert expanded(spark, "a R&D b", [("R&D", r"cost $1 \n")]) == r"a R&D (cost $1 \n) b"
    assert expanded(spark, "mass affluent x", [("mass", "many"), ("mass affluent", "a mass of")]) == "mass (many) affluent (a mass of) x"


def test_glossary_tables(spark):
    html = "<table><thead><tr><td>h</td></tr></thead><tbody><tr><td> A </td><td>b<br>c</td><td>odd</td></tr></tbody></table><table><tr><th>x</th><td>y</td><td>z</td><td>w</td></tr></table>"
    rows = spark.createDataFrame([(html,)], "t string").select(enrich.table_rows("t").alias("r"))
    assert rows.first()["r"] == [["A", "bc", "odd"], ["x", "y", "z", "w"]]
    assert [(p.term, p.definition) for p in rows.select(enrich.cell_pairs(F.col("r"))).first()[0]] == [("A", "bc"), ("x", "y"), ("z", "w")]


def test_hybrid_scores_and_filters(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 3.0), (2, 5.0), (2, 5.0)], "g int, s double").select("g", hybrid.min_max(F.col("s"), ["g"]).alias("x"))
    assert sorted((r.g, r.x) for r in df.collect()) == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 1.0), (2, 1.0)]
    docs = spark.createDataFrame([("en",), ("de",)], "lang string")
    assert docs.where(hybrid.metadata_filter({"lang": "en", "x": ""}, docs.columns)).count() == 1
    assert docs.where(hybrid.metadata_filter({"nope": "1"}, docs.columns)).count() == 0
    assert hybrid.parse_filters("filter: lang = en") == {"lang": "en"}


def test_recall(spark):
    q = spark.createDataFrame([(1, [5, 5, 7]), (2, []), (3, [9])], "query_id int, gold array<bigint>")
    r = spark.createDataFrame([(1, 1, [4, 5]), (1, 2, [7]), (2, 1, [1])], "query_id int, rank int, pages array<bigint>")
    got = {x.query_id: (x.first_hit, round(x.recall_1, 3), x.recall_9) for x in evaluate.recall_details(q, r, (1, 9)).collect()}
    assert got == {1: (1, 0.667, 1.0), 2: (None, 0.0, 0.0), 3: (None, 0.0, 0.0)}


def test_tables(spark):
    parts = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"]), (2, []), (3, ["z"])], "part_id int, tokens array<string>")
    wholes = spark.createDataFrame([(7, ["a", "b", "c"]), (8, ["a", "b", "d"]), (9, ["x"])], "whole_id int, tokens array<string>")
    assert [(r.part_id, r.whole_id, r.overlap) for r in tables.best_container(parts, wholes).collect()] == [(1, 7, 0.6)]
    cells = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 20.0, 10.0), (1, 0, 1, None, None, None, None), (1, 1, 0, 0.0, 10.0, 10.0, 20.0), (1, 1, 1, 10.0, 10.0, 20.0, 20.0)], "table_id long, r int, c int, x0 double, y0 double, x1 double, y1 double")
    spans = tables.topology(cells)
    assert sorted((r.r, r.c, r.rowspan, r.colspan) for r in spans.collect()) == [(0, 0, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)]
    assert tables.header_rows(spans).first()["header_rows"] == 1


def _plain_spans(places):
    """(r, c, rowspan, colspan) of one table, place by place; ``places`` has (r, c) and (x0, x1, y1) or None."""
    real = {k: v for k, v in places.items() if v}
    taken, out = set(), []
    for (r, c), (x0, x1, y1) in sorted(real.items()):
        if (r, c) in taken:
            continue
        w = h = 1
        while (r, c + w) not in real and any(k[1] == c + w and a >= x0 - tables.FIT and b <= x1 + tables.FIT for k, (a, b, _) in real.items()):
            w += 1
        while (r + h, c) not in real and any(k[0] == r + h for k in real) and max(v[2] for k, v in real.items() if k[0] == r + h) <= y1 + tables.FIT:
            h += 1
        taken |= {(r + i, c + j) for i in range(h) for j in range(w)}
        out.append((r, c, h, w))
    return out


def test_topology_of_many_tables(spark):
    rng = random.Random(4)
    near = lambda x: x + rng.choice((0.0, 1.0, -1.0, 2.0))
    known = {}
    for table in range(500):
        at = [(r, c) for r in range(rng.randint(1, 5)) for c in range(rng.randint(1, 5)) if rng.random() < 0.9] or [(0, 0)]
        share = rng.choice((0.2, 0.5, 0.8))
        known[table] = {(r, c): None if rng.random() < share else (near(10.0 * c), near(10.0 * c + rng.choice((10, 20, 30))), near(10.0 * r + rng.choice((10, 20, 30)))) for r, c in at}
    # A table that goes on over many Arrow batches, and one without an id.
    known[500] = {(r, c): None if c == 1 and r % 2 == 0 else (10.0 * c, 20.0 if r % 2 == 0 else 10.0 * c + 10, 10.0 * r + 10) for r in range(8000) for c in range(2)}
    known[None] = {(0, 0): (0.0, 10.0, 20.0), (1, 0): None, (1, 1): (10.0, 20.0, 20.0)}
    rows = [(t, r, c, *((v[0], 0.0, *v[1:]) if v else [None] * 4)) for t, places in known.items() for (r, c), v in places.items()]
    rng.shuffle(rows)
    cells = spark.createDataFrame(rows, "table_id long, r int, c int, x0 double, y0 double, x1 double, y1 double")
    plan = tables.topology(cells)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan  # no call for each table
    got = {}
    for x in tables.topology(cells).collect():
        got.setdefault(x.table_id, []).append((x.r, x.c, x.rowspan, x.colspan))
    small = [t for t in known if t != 500]
    assert {t: sorted(got.get(t, [])) for t in small} == {t: _plain_spans(known[t]) for t in small}
    assert sorted(got[500]) == [(r, c, 1, 2 if r % 2 == 0 else 1) for r in range(8000) for c in range(2) if r % 2 or not c]
    assert tables.topology(cells.limit(0)).count() == 0


def test_chat(spark):
    turns = spark.createDataFrame([("s", i, "user" if i % 2 == 0 else "model", f"t{i}") for i in range(6)], "session_id string, turn int, role string, text string")
    got = [r.history for r in chat.history(turns).orderBy("turn").collect()]
    assert got[0] == "" and got[5].split("\n")[0].endswith("t1") and len(got[5].split("\n")) == 4
    assert spark.createDataFrame([(' "q" ',)], "t string").select(chat.unquoted(F.col("t"))).first()[0] == "q"


def test_provider_retries():
    calls, waits = [], []

    def flaky(texts):
        calls.append(len(texts))
        if len(texts) > 10 or len(calls) < 4:
            raise providers.QuotaError("retry in 30s")
        return [t.upper() for t in texts]

    assert providers.call(flaky, ["a"] * 12, sleep=waits.append) == ["A"] * 12
    assert calls[:2] == [12, 6] and waits and waits[0] == 32.0


def test_sources(spark, tmp_path):
    (tmp_path / "toc.json").write_text('{"A": [["x", [1, 2]], ["y", [3, 5]]], "B": [["z", [6, 6]]]}')
    got = [(r.chapter, r.section, r.start, r.end) for r in files.read_contents(spark, str(tmp_path / "toc.json")).orderBy("chapter_ord", "section_ord").collect()]
    assert got == [("A", "x", 1, 2), ("A", "y", 3, 5), ("B", "z", 6, 6)]
    (tmp_path / "q.json").write_text('[{"id": "q1", "gold_printed_pages": [1, 2], "answerable": true}, {"id": "q2"}]')
    assert [(r.seq, r.id, r.gold_printed_pages) for r in files.read_json_array(spark, str(tmp_path / "q.json"), files.QUESTION).collect()] == [(0, "q1", [1, 2]), (1, "q2", None)]
    rows = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, None), (3, [1.0])], "chunk_id int, embedding array<double>")
    assert sorted(r.chunk_id for r in files.completed_prefix(rows).collect()) == [0, 1]
    files.write_index(rows.where("chunk_id < 2").withColumn("chapter", F.lit("c")), str(tmp_path / "index"))
    assert files.read_index(spark, str(tmp_path / "index")).count() == 2
    assert files.is_current(spark, str(tmp_path / "index"), 2) and not files.is_current(spark, str(tmp_path / "none"), 2)
    with pytest.raises(ValueError):
        files.required({"a": ""}, ["a"])


def test_incremental_index(spark, tmp_path):
    from folioflow.streaming.index_stream import index_new

    args = (spark, str(tmp_path / "in"), "id long, text string", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    for part in (["a b", "c"], ["d"]):
        spark.createDataFrame([(i, t) for i, t in enumerate(part)], "id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
        index_new(*args)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
