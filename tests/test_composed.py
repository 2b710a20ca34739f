"""The composed paths: tables set right, ingest, index, search, conversations, report, command line."""

import json

import pytest
from pyspark.sql import functions as F

from folioflow import cli
from folioflow.operators import chat, evaluate, hybrid, ingest, providers, search, tables
from folioflow.operators import reconcile as R
from folioflow.sources import files


def grid(x0, y0, rows, wide=50.0, high=10.0):
    """A detected table of equal cells; None is a covered place, and a text may span what follows."""
    cells = []
    for r, row in enumerate(rows):
        own = []
        for c, text in enumerate(row):
            span = 1
            while text is not None and c + span < len(row) and row[c + span] is None:
                span += 1
            own.append((None, "") if text is None else (R.Box(x0 + c * wide, y0 + r * high, x0 + (c + span) * wide, y0 + (r + 1) * high), text))
        cells.append(own)
    return R.Detected(R.Box(x0, y0, x0 + len(rows[0]) * wide, y0 + len(rows) * high), cells)


def page(found, words=(), drawings=()):
    return R.Page(R.Box(0.0, 0.0, 400.0, 800.0), 400.0, list(found), [(R.Box(*w[:4]), w[4]) for w in words], [R.Box(*d) for d in drawings])


SCAN = "intro <table><thead><tr><th>Name</th><th>Value</th></tr></thead><tbody><tr><td>alpha</td><td>1O</td></tr><tr><td>beta</td><td>20</td></tr></tbody></table> outro"


def test_detected_table_replaces_scanned_one():
    text, left = R.reconciled(SCAN, page([grid(10, 100, [["Name", "Value"], ["alpha", "10"], ["beta", "20"]])]))
    assert left == 0
    assert text == "intro <table><thead><tr><th>Name</th><th>Value</th></tr></thead><tbody><tr><td>alpha</td><td>10</td></tr><tr><td>beta</td><td>20</td></tr></tbody></table> outro"


def test_spans_and_headers_of_several_rows():
    found = grid(0, 100, [["2024", None, "Sum"], ["Bank", "Group", "x"], ["1", "2", "3"]])
    assert [[x[:2] for x in row] for row in found.placed()][0] == [(1, 2), (1, 1)]
    tall = R.Detected(R.Box(0, 0, 100, 30), [[(R.Box(0, 0, 50, 20), "A"), (R.Box(50, 0, 100, 10), "B")], [(None, ""), (R.Box(50, 10, 100, 20), "C")], [(R.Box(0, 20, 50, 30), "1"), (R.Box(50, 20, 100, 30), "2 <")]])
    assert tall.placed()[0] == [(2, 1, "A"), (1, 1, "B")]
    # The header's first cell reaches down a row, so both rows are the header, and become one.
    assert R.rendered(page([tall]), [tall], 1) == "<table><thead><tr><th>A</th><th>B - C</th></tr></thead><tbody><tr><td>1</td><td>2 &lt;</td></tr></tbody></table>"
    assert R.names([[(1, 2, "a"), (2, 1, "c")], [(1, 1, "a"), (1, 1, "b")]]) == ["a", "a - b", "c"]
    flat = R.Scanned.of(R.TABLE.search("<table><thead><tr><th colspan='2'>a</th></tr><tr><th>b</th><th>c</th></tr></thead></table>"))
    assert "<th>a - b</th><th>a - c</th>" in R.reconciled("<table><thead><tr><th colspan='2'>a</th></tr><tr><th>b</th><th>c</th></tr></thead></table>", page([]))[0] and flat.head == 2


def test_parts_are_joined_with_the_text_between():
    a, b = grid(10, 100, [["Name", "Value"], ["alpha", "10"]]), grid(10, 140, [["beta", "20"]])
    text, left = R.reconciled(SCAN, page([b, a], [(12, 125, 40, 133, "Sub"), (42, 125, 80, 133, "total")]))
    assert left == 0 and '<tr><td colspan="2">Sub total</td></tr><tr><td>beta</td>' in text
    far = grid(10, 200, [["beta", "20"]])
    same = grid(10, 100, [["Name", "Value"], ["alpha", "1O"]])
    assert R.reconciled(SCAN, page([same, far]))[1] == 1  # too far below to be one table: the first of equals stays
    # A part with few common tokens goes with its neighbour, if edges, gap and columns agree.
    rest = grid(10, 125, [["beta", "99,9"], ["gamma", "7"], ["20", "8"]])
    groups = R.matched(page([a, rest]), [R.Scanned.of(R.TABLE.search(SCAN))])
    assert [t for _, t in groups[0]] == [a, rest]
    for other in (grid(20, 125, [["beta", "x9"], ["y9", "z9"]]), grid(10, 125, [["beta", "x9", "y9"]], 100 / 3), grid(10, 300, [["beta", "x9"]])):
        assert [t for _, t in R.matched(page([a, other]), [R.Scanned.of(R.TABLE.search(SCAN))])[0]] == [a]


def test_policies_for_tables_without_a_scan():
    own, other = grid(10, 200, [["Name", "Value"], ["alpha", "10"], ["beta", "20"]]), grid(10, 100, [["zz", "yy"]])
    on, stay, every = (R.reconciled(SCAN, page([own, other]), k) for k in (1, 2, 3))
    assert on[1] == stay[1] == every[1] == 1
    assert "<td>10</td>" in on[0] and "zz" not in on[0] and stay[0] == SCAN
    assert every[0].index("zz") < every[0].index("alpha") and every[0].startswith("intro ") and every[0].endswith(" outro")
    assert R.reconciled("no table", page([other]), 3)[0].startswith("no table<table>")


def test_row_ratio():
    tall = grid(10, 100, [["Name", "Value"], *[["alpha", "20"]] * 12])
    assert R.reconciled(SCAN, page([tall]))[0].count("<tr>") == 3  # more than three times the scanned rows


def line(y, *texts, x=10.0):
    out = []
    for t in texts:
        for w in t.split():
            out.append((x, y, x + 6.0 * len(w), y + 8, w))
            x += 6.0 * len(w) + 4
        x += 20
    return out


def test_locate_takes_the_chain_in_order():
    rows = [["Header one", "Value"], ["first row", "111"], ["middle row", "222"], ["third row", "333"], ["final row", "444"]]
    table = R.Scanned((0, 0), [[(1, 1, t) for t in r] for r in rows], 1)
    body = [w for k, r in enumerate(rows) for w in line(200 + 20 * k, *r)]
    # Above it stand a header and a footer that enclose the middle rows in the wrong order.
    decoy = line(70, "Header one") + line(90, "third row") + line(110, "first row")
    box = R.locate(page([], decoy + body), table)
    assert 190 < box.y0 < 200 and 280 < box.y1 < 300
    lines = [(5.0, 195.0, 205.0, 196.0), (5.0, 292.0, 205.0, 293.0), (5.0, 600.0, 205.0, 601.0)]
    snapped = R.locate(page([], body, lines), table)
    assert snapped == R.Box(5.0, 193.5, 205.0, 294.5)
    # Texts that stand nowhere on the page: the detected tables that have them.
    top, end = grid(10, 300, [["Header one", "Value"]]), grid(10, 330, [["final row", "444"]])
    assert R.locate(page([top, end]), table) == R.Box(8.0, 298.0, 112.0, 342.0)
    assert R.locate(page([]), table) is None
    # A table too wide for half a page is none.
    wide = line(200, "Header one") + line(220, "final row", x=330.0)
    assert R.locate(page([], wide), R.Scanned((0, 0), [[(1, 1, "Header one")], [(1, 1, "final row")]], 1)) is None


def test_reconcile_rows(spark):
    cell = lambda x, y, t: (x, y, x + 50.0, y + 10.0, t)
    t = [(10.0, 100.0, 110.0, 130.0, [[cell(10.0, 100.0 + 10 * r, a), cell(60.0, 100.0 + 10 * r, b)] for r, (a, b) in enumerate((("Name", "Value"), ("alpha", "10"), ("beta", "20")))])]
    geometry = spark.createDataFrame([(1, 3, 400.0, 800.0, t, [], [])], f"doc_id int, pdf_page int, {R.GEOMETRY}")
    blocks = spark.createDataFrame([(1, 3, 0, "left", SCAN), (1, 3, 1, "right", SCAN), (1, 4, 0, None, SCAN), (1, 4, 1, "all", None)], "doc_id int, pdf_page int, seq int, location string, content string")
    got = {(r.pdf_page, r.seq): r for r in R.reconcile(blocks, geometry).collect()}
    assert "<td>10</td>" in got[3, 0].content and got[3, 1].content == SCAN and got[4, 0].content == SCAN and got[4, 1].content == ""
    assert R.reconcile(blocks.limit(0), geometry).count() == 0
    with pytest.raises(ValueError):
        R.reconcile(blocks, geometry, 4)


def test_ingest(spark):
    scans = spark.createDataFrame([(1, p, "", "Risk" if p == 3 else "", p != 6, p == 4) for p in range(1, 9)], "doc_id int, pdf_page int, left_header string, right_header string, has_body boolean, has_table boolean")
    contents = spark.createDataFrame([(1, 0, "One", 6, 0, "a", 8), (1, 1, "Two", None, 0, "b", 12)], "doc_id int, chapter_ord int, chapter string, chapter_start int, section_ord int, section string, start int")
    asked = []

    def reader(prompts):
        asked.extend(prompts)
        if "(##): b" in prompts[0]:
            raise OSError("no service")
        return ['```json\n{"blocks": [{"location": "left", "content": "# Top\\nx"}, {"location": "all", "content": ""}, {"location": "right", "content": "y"}]}\n```']

    plan = ingest.routed(ingest.pages.parse_plan(scans.drop("has_table")), ingest.toc.close_ranges(contents, 16))
    # Cover, contents, the page without a body and the page that opens a chapter are not read.
    assert [(r.pdf_page, r.chapter, r.section) for r in plan.orderBy("pdf_page").collect()] == [(3, "Risk", "Risk"), (5, "One", "a"), (7, "Two", "b"), (8, "Two", "b")]
    got = ingest.ingest(scans, contents, reader).orderBy("pdf_page", "part").collect()
    rows = [(r.pdf_page, r.logical_page, r.chapter, r.section, r.current_headings, r.content) for r in got]
    assert rows[:4] == [(3, [4], "Risk", "Risk", ["Top"], "### Top\nx"), (3, [5], "Risk", "Risk", ["Top"], "y"), (5, [8], "One", "a", ["Top"], "### Top\nx"), (5, [9], "One", "a", ["Top"], "y")]
    assert [r[5] for r in rows[4:]] == [ingest.FAILURE + "no service"] * 2 and rows[4][1] == [12, 13]
    # A later run keeps the pages before its start, and its prompt names the heading that they leave open.
    earlier = ingest.ingest(scans, contents, reader, end_page=5)
    again = ingest.ingest(scans, contents, reader, earlier=earlier, start_page=7).orderBy("pdf_page", "part").collect()
    assert [r.content for r in again] == [r.content for r in got]
    state = spark.createDataFrame([("C", "S", [(3, "open one")], True), ("C", "S", [], False)], "chapter string, section string, open array<struct<level:int,title:string>>, has_table boolean")
    one, two = (r.prompt for r in ingest.prompts(state).collect())
    assert "open one" in one and one.endswith("---") and ingest.USER_PROMPT in two and "CHỈ DẪN TRÍCH XUẤT" not in two and "BẮT BUỘC" in two
    assert ingest.quarantine(ingest.ingest(scans, contents, reader)).count() == 0


def chunks(spark, n=12):
    rows = [(i, [i, i + 1], i, "ch" if i % 2 else "other", "s", f"h{i}", f"alpha w{i} number {i}" if i != 5 else "  alpha beta\n" * 8) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id int, logical_page array<int>, pdf_page int, chapter string, section string, current_heading string, content string")


def test_index_resumes(spark, tmp_path):
    path, seen = str(tmp_path / "index"), str(tmp_path / "calls")

    def counted(texts):
        with open(seen, "a") as f:
            f.write("x" * len(texts))
        return providers.stub_embedding(texts)

    assert ingest.index_chunks(spark, chunks(spark), path, counted, limit=4) == 4
    assert ingest.index_chunks(spark, chunks(spark), path, counted) == 12
    assert ingest.index_chunks(spark, chunks(spark), path, counted) == 12
    with open(seen) as f:
        assert len(f.read()) == 12
    assert files.read_index(spark, path).count() == 12


def test_search_and_conversation(spark):
    engine = search.HybridSearch(providers.embed(chunks(spark).withColumn("text", F.col("content"))).drop("text"))
    q = spark.createDataFrame([(1, "w7 number"), (2, "beta")], "query_id int, query string")
    got = engine.search(q, 3).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in got if r["rank"] == 1] == [7, 5] and len(got) == 6
    assert {r.chapter for r in engine.search(q, 20, {"chapter": "ch", "section": ""}).collect()} == {"ch"}
    assert engine.search(q, 3, {"nothing": "x"}).count() == 0
    asked = []

    def rewrite(prompts):
        if any("fail" in p for p in prompts):
            raise OSError("down")
        return ['"w7 number"'] * len(prompts)

    turns = spark.createDataFrame([("a", 0, " beta "), ("a", 5, "and it?"), ("b", 0, "w3"), ("b", 1, "fail w4 number 4"), ("c", 0, "w9")], "session_id string, turn int, question string")
    out = {(r.session_id, r.turn): r for r in search.converse(turns, engine, rewrite, providers.stub_answer, 2).collect()}
    assert {k: r.search_query for k, r in out.items()} == {("a", 0): "beta", ("a", 5): "w7 number", ("b", 0): "w3", ("b", 1): "fail w4 number 4", ("c", 0): "w9"}
    assert out["a", 5].answer.startswith("[Trang 7, 8 |") and out["a", 0].sources.startswith("• [Trang [5, 6]] (Score: 1.0000) ch > h5\n")
    none = spark.createDataFrame([], "session_id string, turn int, role string, text string")
    answers, history = search.ask(turns.where("turn = 0").select("session_id", "question"), none, engine, rewrite, lambda p: 1 / 0, 2)
    assert {r.answer[:10] for r in answers.collect()} == {"Xin lỗi, đ"} and history.count() == 6
    del asked


def test_report(spark, tmp_path):
    engine = search.HybridSearch(providers.embed(chunks(spark).withColumn("text", F.col("content"))).drop("text"))
    q = spark.createDataFrame([("q1", "w7", "c", True, [8], "x"), ("q2", "w3", "c", False, [], ""), ("q3", "beta", "c", None, [5, 99], "")], "query_id string, question string, category string, answerable boolean, gold array<int>, gold_answer string")
    assert evaluate.levels(5) == (1, 3, 5)
    rep = evaluate.report(q, engine.search(q.select("query_id", F.col("question").alias("query")), 5), "set", 5)
    r = rep.first()
    assert (r.dataset, r.total_questions, r.evaluated_questions) == ("set", 3, 2)
    assert [d.id for d in r.per_query_details] == ["q1", "q2", "q3"] and r.per_query_details[1].metrics is None
    first = r.per_query_details[0]
    assert first.first_hit_rank == 1 and first.retrieved_top_k[0].chunk_id == 7 and first.retrieved_top_k[0].is_relevant and first.metrics.recall_at_1 == 1.0
    assert r.aggregated_metrics.recall_at_1 == 0.75 and len(first.retrieved_top_k) == 5
    files.write_json_array(rep, str(tmp_path / "r.json"), ["dataset"])
    text = "".join(p.read_text() for p in (tmp_path / "r.json").glob("part-*"))
    assert json.loads(text)[0]["per_query_details"][2]["metrics"]["recall_at_5"] == 0.5


def test_filters_and_payload(spark):
    assert hybrid.parse_filters('filter: chapter="A, B"') == {"chapter": "A, B"}
    assert hybrid.parse_filters("filter: a=b=c") == {"a": "b=c"} and hybrid.parse_filters("filter: nothing") == {}
    row = hybrid.payload(spark.createDataFrame([(1, None)], "chunk_id int, chapter string")).first()
    assert (row.chapter, row.logical_page, row.pdf_page, row.content) == ("", [], 0, "")


def test_holding(spark):
    docs = spark.createDataFrame([(1, "say Alpha beta gamma now"), (2, "alpha beta gamma"), (3, "xAlpha beta gammay"), (4, None)], "id int, text string")
    index = search.Index(docs.where("text IS NOT NULL"), "id", F.col("text"))
    p = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "beta"), (3, "nowhere at all"), (4, "Alpha b")], "pid int, t string")
    got = sorted((r.query_id, r.id) for r in index.holding(p, docs, "pid", "t", "id", "text").collect())
    assert got == [(1, 1), (1, 3), (2, 1), (2, 2), (2, 3), (4, 1), (4, 3)]


def test_report_file(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, [4, 5], 3, "C", "S", "text", True, True), ("d", 2, [6], 4, "C", "S", "", False, False)], "doc_id string, page_seq int, logical_page array<int>, pdf_page int, chapter string, section string, content string, new_chapter boolean, new_section boolean")
    files.write_markdown(pages, str(tmp_path / "m"), {"stem": "book", "name": "book.pdf", "time": "now", "first": 1, "last": 4, "total": 9, "model": "m"})
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert text.startswith("# book\n") and "\n# C\n\n## S\n\n<!-- Trang logic 4, 5 (PDF Trang 3) -->\n\ntext\n\n---\n" in text and files.NO_TEXT in text
    stats = files.run_stats(pages, pages, "x").first()
    assert (stats.input_pages, stats.output_chunks) == (2, 2)
    s = spark.createDataFrame([("\n a\nb\nc ",)], "t string").select(files.snippet(F.col("t"), 2)).first()[0]
    assert s == "a\nb\n..."


def test_header_rows_are_bounded(spark):
    spans = spark.createDataFrame([(1, 0, 0, 2, 1), (1, 0, 1, 1, 1), (1, 1, 1, 1, 1), (2, 0, 0, 1, 1)], "table_id long, r int, c int, rowspan int, colspan int")
    assert {r.table_id: r.header_rows for r in tables.header_rows(spans, 1).collect()} == {1: 2, 2: 1}
    assert {r.table_id: r.header_rows for r in tables.header_rows(spans, 5).collect()} == {1: 2, 2: 1}


def test_command_line(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    scans = spark.createDataFrame([(1, p, "", "", True, False) for p in range(1, 7)], "doc_id int, pdf_page int, left_header string, right_header string, has_body boolean, has_table boolean")
    scans.write.parquet(at("scans"))
    spark.createDataFrame([(1, 0, "One", None, 0, "a", 1)], "doc_id int, chapter_ord int, chapter string, chapter_start int, section_ord int, section string, start int").write.parquet(at("contents"))
    run = lambda *a: cli.main(list(a), spark)
    assert run("ingest", "--input", at("scans"), "--contents", at("contents"), "--output", at("pages"), "--report", at("report")) == 0
    assert run("chunk", "--input", at("pages"), "--output", at("chunks")) == 0
    spark.createDataFrame([(0, "left", "not right")], "ord int, term string, definition string").write.parquet(at("terms"))
    assert run("enrich", "--input", at("chunks"), "--abbreviations", at("terms"), "--output", at("rich")) == 0
    assert spark.read.parquet(at("rich")).where("content LIKE '%left (not right)%'").count() == 4
    assert run("index", "--input", at("rich"), "--output", at("index"), "--limit", "3") == 0
    assert run("index", "--input", at("rich"), "--output", at("index")) == 0
    assert run("search", "--index", at("index"), "--query", "left text", "--filter", "filter: chapter='One'", "--top-k", "2") == 0
    assert "[#1]" in capsys.readouterr().out
    spark.createDataFrame([("s", 0, "left"), ("s", 1, "right")], "session_id string, turn int, question string").write.parquet(at("questions"))
    assert run("chat", "--input", at("questions"), "--index", at("index"), "--output", at("answers")) == 0
    assert spark.read.parquet(at("answers")).count() == 2
    (tmp_path / "q.json").write_text('[{"id": "a", "question": "left text", "gold_printed_pages": [4]}, {"id": "b", "question": "x", "answerable": false}]')
    assert run("eval", "--input", at("q.json"), "--index", at("index"), "--output", at("eval")) == 0
    assert run("ingest", "--input", at("scans"), "--contents", at("contents"), "--output", at("x"), "--action", "1", "--start", "3") == 0
    spark.createDataFrame([], spark.read.parquet(at("index")).schema).write.parquet(at("empty"))
    assert run("search", "--index", at("empty"), "--query", "x") == 2
    assert chat.stub_rewrite(["a\nb"]) == ["b"]
