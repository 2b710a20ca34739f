"""Registered queries over the driver's tables; ``sql.py`` has their DuckDB counterparts.

The tables hold no pages of scanned documents, so some inputs are derived from
them by an expression that both sides use: a mark before every line that begins
with A to M makes headings, a document's source and language stand for chapter
and section, a conversation's turns for the blocks of a spread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import chat, chunk, enrich, evaluate, hybrid, ingest, layout, lexical, pages, providers, search, tables, toc, vector
from folioflow.plans import sql
from folioflow.sources import files
from folioflow.sources.scratch import spread

TOP_K = 10
RECALL_AT = (1, 3, 5, 10)
ROOM = 600
ABBREVIATIONS = (("the", "definite"), ("of", "from"), ("and", "plus"), ("in", "within"), ("de", "of"), ("la", "the"), ("der", "the"), ("und", "and"), ("definite", "fixed"), ("que", "that"))
GLOSSARY = (("NIM", "Net margin"), ("Doanh nghiệp vừa (SME)", "ignored"), ("ROE", ""), ("NIM", "Net interest margin"), ("Thuật ngữ", "Định nghĩa"), (" CASA ", " Current accounts "), ("", "nothing"), ("Bank (HO)", ""))
HEADER_CELLS = ((1, 0, 0, "2", "1", "Item"), (1, 0, 1, "1", "2", "2024"), (1, 0, 2, "1", "2", "2025"), (1, 1, 0, "1", "1", "Bank"), (1, 1, 1, "1", "1", "Group"), (1, 1, 2, "1", "1", "Bank"), (1, 1, 3, "1", "1", "Group"), (2, 0, 0, "x", "1", "A"), (2, 0, 1, "1", "1", "B"), (2, 1, 0, "1", "1", "A"), (2, 1, 1, "1", "1", "C"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _marked(mark: str) -> Column:
    return F.regexp_replace("text", "(^|\n)([A-M])", f"$1{mark}$2")


def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document."""
    t = spread(_read(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


def _index(spark: SparkSession, d: str) -> lexical.Index:
    return lexical.Index(spread(_read(spark, d, "documents").select("doc_id", "text")).where(F.col("text").isNotNull()), "doc_id", F.col("text"))


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).scores(_read(spark, d, "benchmark"), "item_id", "text")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten best documents for every benchmark text by BM25."""
    return lexical.top_k(_bm25(spark, d), TOP_K).select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), "score")


def _semantic(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "embeddings")
    asked = _read(spark, d, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("qv"))
    return vector.cosine(asked, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors for the vector of every benchmark item."""
    best = lexical.top_k(_semantic(spark, d), TOP_K, "semantic")
    return best.select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), "score")


def minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    """Prices scaled to 0..1 within every order."""
    li = _read(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(hybrid.min_max(F.col("l_extendedprice"), ["l_orderkey"]), 6).alias("scaled"))


def _hybrid(spark: SparkSession, d: str, filters: dict[str, str | int | None]) -> DataFrame:
    docs = _read(spark, d, "documents").where(F.col("text").isNotNull())
    keep = docs.where(hybrid.metadata_filter(filters, docs.columns)).select(F.col("doc_id").alias("id"))
    fused = hybrid.fuse(_semantic(spark, d).join(keep, "id"), _bm25(spark, d))
    best = hybrid.top_k(fused, TOP_K)
    return best.select(F.col("query_id").alias("item_id"), F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), "score", "lexical", "semantic")


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten best documents by the fused score, among those with a vector."""
    return _hybrid(spark, d, {})


def hybrid_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same among English documents; the empty filter is ignored."""
    return _hybrid(spark, d, {"lang": "en", "source": ""})


def _details(spark: SparkSession, d: str) -> DataFrame:
    items, docs = _read(spark, d, "benchmark"), _read(spark, d, "documents").where(F.col("text").isNotNull())
    index = _index(spark, d)
    holds = index.holding(items, docs, "item_id", "text", "doc_id", "text").groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("gold"))
    questions = evaluate.evaluated(holds.select("query_id", "gold", F.lit(True).alias("answerable")))
    ranked = lexical.top_k(index.scores(items, "item_id", "text"), max(RECALL_AT)).select("query_id", "rank", F.array("id").alias("pages"))
    return evaluate.recall_details(questions, ranked, RECALL_AT)


def eval_details(spark: SparkSession, d: str) -> DataFrame:
    """First hit and recall of BM25 for every passage that some document holds."""
    x = _details(spark, d)
    return x.select(F.col("query_id").alias("item_id"), F.col("first_hit").cast("long").alias("first_hit"), *(F.round(f"recall_{k}", 4).alias(f"recall_{k}") for k in RECALL_AT))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall over all evaluated passages."""
    return evaluate.mean_recall(_details(spark, d))


def _segments(spark: SparkSession, d: str, expression: str) -> DataFrame:
    docs = spread(_read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    return docs.select("doc_id", F.posexplode(F.expr(expression)).alias("seq", "segment")).select("doc_id", F.col("seq").cast("long").alias("seq"), F.length("segment").cast("long").alias("n"), F.md5("segment").alias("digest"))


def sentence_line_split(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every document packed to a soft maximum, cut at sentence ends."""
    return _segments(spark, d, chunk.line_segments("body", str(ROOM)))


def paragraph_pack(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs (lines, set apart by blank lines) of every document packed to a soft maximum."""
    return _segments(spark, d, chunk.paragraph_segments(r"replace(body, '\n', '\n\n')", str(ROOM)))


def heading_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Heading and body of every block of documents with derived headings."""
    docs = spread(_read(spark, d, "documents").select("doc_id", "text")).where(F.col("text").isNotNull()).select("doc_id", F.posexplode(chunk.heading_blocks(_marked("### "))).alias("block", "b"))
    return docs.select("doc_id", F.col("block").cast("long").alias("block"), F.col("b.heading").alias("heading"), F.md5("b.body").alias("digest"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(_read(spark, d, "documents"))
    return docs.select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("page_seq"), F.array(F.col("doc_id").cast("int")).alias("logical_page"), F.col("doc_id").cast("int").alias("pdf_page"),
        F.col("source").alias("chapter"), F.col("lang").alias("section"), F.array().cast("array<string>").alias("current_headings"), F.when(F.col("text").startswith("T"), F.col("text")).otherwise(_marked("### ")).alias("content"),
    )


def heading_carry(spark: SparkSession, d: str) -> DataFrame:
    """Heading that every page of a source begins under."""
    x = chunk.carry_headings(_pages(spark, d))
    return x.select(F.col("doc_id").alias("source"), F.col("page_seq").alias("doc_id"), F.when(F.col("continued"), F.col("inherited")).alias("inherited"), F.md5("text").alias("digest"))


def chunk_document(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of all sources."""
    x = files.numbered(chunk.chunk_pages(_pages(spark, d)))
    return x.select(F.col("doc_id").alias("source"), F.col("chunk_id").cast("long").alias("chunk_id"), "pdf_page", "section", "current_heading", F.md5("content").alias("digest"))


def heading_merge(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every document after headings without a body joined the next."""
    docs = spread(_read(spark, d, "documents").select("doc_id", "text")).where(F.col("text").isNotNull()).withColumn("blocks", chunk.heading_blocks(_marked("### ")))
    x = docs.select("doc_id", F.posexplode(chunk.merge_headings("blocks")).alias("block", "m"))
    return x.select("doc_id", F.col("block").cast("long").alias("block"), F.md5("m.heading").alias("heading"), F.md5("m.prefix").alias("prefix"), F.md5("m.body").alias("body"))


def layout_h3(spark: SparkSession, d: str) -> DataFrame:
    """Open level-3 heading after every turn, with the role as section."""
    c = _read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_seq"), F.lit("").alias("chapter"), F.col("role").alias("section"), _marked("### ").alias("content"))
    return layout.carry_h3(c).select(F.col("doc_id").alias("conv_id"), F.col("page_seq").alias("turn"), "current_h3")


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").where(F.col("source").isNotNull() & F.col("lang").isNotNull())
    order = F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1))
    entries = docs.select(F.col("source").alias("doc_id"), order.alias("chapter_ord"), F.col("lang").alias("chapter"), F.lit(None).cast("long").alias("chapter_start"), F.col("doc_id").alias("section_ord"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("section"), F.col("doc_id").alias("start"))
    return toc.close_ranges(entries, 2000)


def toc_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Closed page ranges of a table of contents made of every source's documents."""
    return _ranges(spark, d).select(F.col("doc_id").alias("source"), "chapter", F.col("section_ord").cast("long").alias("section_ord"), "section", "start", "end")


def toc_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Section and chapter of every document's page, three pages before its own."""
    p = _read(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_id"), (F.col("doc_id") - 3).alias("page"), F.lit("").alias("chapter"))
    return toc.lookup(p, _ranges(spark, d)).select("page_id", "toc_section", "toc_chapter")


def spread_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Logical pages of conversations: the role is a block's place on the spread."""
    c = _read(spark, d, "conversations")
    place = F.when(F.col("role") == "system", "all").when(F.col("role") == "user", "left").otherwise("right")
    blocks = c.select(F.lit(1).alias("doc_id"), (F.col("conv_id") + 2).alias("pdf_page"), F.col("turn").alias("seq"), place.alias("location"), F.col("text").alias("content"))
    plan = c.select("conv_id").distinct().select(F.lit(1).alias("doc_id"), (F.col("conv_id") + 2).alias("pdf_page"), F.lit(False).alias("is_cover"), (F.col("conv_id") * 2).alias("left_logical_page"), (F.col("conv_id") * 2 + 1).alias("right_logical_page"), F.lit("c").alias("chapter"))
    x = pages.map_blocks(blocks, plan)
    return x.select("pdf_page", F.col("part").cast("long").alias("part"), F.array_join(F.col("logical_page").cast("array<string>"), ",").alias("logical_page"), F.md5("content").alias("digest"))


def heading_sanitize(spark: SparkSession, d: str) -> DataFrame:
    """Documents with derived level-1 headings and fences, with the headings lowered."""
    fenced = F.regexp_replace(_marked("# "), "(^|\n)(T)", "$1```\n$2")
    docs = spread(_read(spark, d, "documents").select("doc_id", "text")).where(F.col("text").isNotNull()).select("doc_id", fenced.alias("content"))
    return docs.select("doc_id", F.md5(layout.sanitize_headings("content")).alias("digest"))


def abbrev_expand(spark: SparkSession, d: str) -> DataFrame:
    """Common words of all documents written out once, as abbreviations would be."""
    terms = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(ABBREVIATIONS)], "ord int, term string, definition string")
    docs = spread(_read(spark, d, "documents").select("doc_id", "text")).where(F.col("text").isNotNull())
    return enrich.expand(docs, terms).select("doc_id", F.md5("text").alias("digest"))


def abbrev_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary of a glossary's cell pairs."""
    pairs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(GLOSSARY)], "seq long, term string, definition string")
    return enrich.dictionary(pairs)


def containment_match(spark: SparkSession, d: str) -> DataFrame:
    """Document that holds most of every benchmark text's tokens."""
    parts = _read(spark, d, "benchmark").select(F.col("item_id").alias("part_id"), T.token_set(F.col("text")).alias("tokens"))
    wholes = spread(_read(spark, d, "documents").select("doc_id", "text")).where(F.col("text").isNotNull()).select(F.col("doc_id").alias("whole_id"), T.token_set(F.col("text")).alias("tokens"))
    x = tables.best_container(parts, wholes)
    return x.select(F.col("part_id").alias("item_id"), F.col("whole_id").alias("doc_id"), F.round("overlap", 6).alias("overlap"))


def adjacency_groups(spark: SparkSession, d: str) -> DataFrame:
    """Runs of every user's events without a gap of over an hour."""
    e = _read(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    x = tables.adjacency_groups(e, ["user_id"], "at", "at", ["at", "event_id"], 3_600_000_000)
    return x.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def header_flatten(spark: SparkSession, d: str) -> DataFrame:
    """One header row from rows of cells with spans."""
    cells = spark.createDataFrame(HEADER_CELLS, "table_id int, r int, cell_seq int, rowspan string, colspan string, text string")
    return tables.flatten_headers(cells)


def rect_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping boxes within every order."""
    li = _read(spark, d, "lineitem")
    box = lambda p: li.select("l_orderkey", F.col("l_linenumber").alias(f"{p}id"), F.col("l_partkey").alias(f"{p}part"), (F.col("l_linenumber") * 10.0).alias(f"{p}x0"), (F.col("l_linenumber") * 10.0 + F.col("l_quantity")).alias(f"{p}x1"), (F.col("l_discount") * 100).alias(f"{p}y0"), (F.col("l_discount") * 100 + 2).alias(f"{p}y1"))
    x = tables.rect_pairs(box("l_"), box("r_"), ["l_orderkey"]).where(F.col("l_id") < F.col("r_id"))
    return x.groupBy("l_orderkey").agg(F.count("*").alias("n_pairs"))


def contextual_text(spark: SparkSession, d: str) -> DataFrame:
    """Text that an index holds for every document."""
    x = T.contextual_text(F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.col("text"))
    return _read(spark, d, "documents").select("doc_id", F.md5(x).alias("digest"))


def context_format(spark: SparkSession, d: str) -> DataFrame:
    """Context of every conversation's turns, as if they were retrieved chunks."""
    c = _read(spark, d, "conversations")
    block = chat.context_block(F.array("conv_id", "turn"), F.col("role"), F.lit("h"), F.coalesce("text", F.lit("")))
    x = chat.context(c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), block.alias("block")))
    return x.select(F.col("query_id").alias("conv_id"), F.md5("context").alias("digest"))


def history_window(spark: SparkSession, d: str) -> DataFrame:
    """Last four entries before every turn."""
    c = _read(spark, d, "conversations").withColumnRenamed("conv_id", "session_id")
    return chat.history(c).select(F.col("session_id").alias("conv_id"), "turn", F.md5("history").alias("digest"))


def checkpoint_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Documents before the first one without a vector."""
    docs, e = _read(spark, d, "documents"), _read(spark, d, "embeddings")
    rows = docs.join(e, F.col("doc_id") == F.col("vec_id"), "left").select(F.col("doc_id").alias("chunk_id"), "embedding")
    return files.completed_prefix(rows).select(F.col("chunk_id").alias("doc_id"))


def markdown_change_flags(spark: SparkSession, d: str) -> DataFrame:
    """Where a report of every source prints a new chapter (language) or section (first letter)."""
    p = _read(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_seq"), F.col("lang").alias("chapter"), F.substring("text", 1, 1).alias("section"))
    return layout.change_flags(p).select(F.col("page_seq").alias("doc_id"), "new_chapter", "new_section")


def json_tolerant_parse(spark: SparkSession, d: str) -> DataFrame:
    """Properties of all events, from fenced JSON, bare JSON, and JSON within prose."""
    p = F.col("props")
    raw = F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(F.col("event_type") == "error", F.concat(F.lit("Here it is: "), p, F.lit(" as asked"))).otherwise(p)
    x = _read(spark, d, "events").withColumn("j", T.parse_json(raw, "k long"))
    return x.select("event_id", F.col("j.k").alias("k"))


def html_heading_text(spark: SparkSession, d: str) -> DataFrame:
    """Length and digest of every page's level-1 heading, as written."""
    h = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
    return _read(spark, d, "pages").select("page_id", F.length(h).cast("long").alias("n"), F.md5(h).alias("digest"))


def table_topology(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a grid of cells made of every order's lines; each second place of a row is covered."""
    li = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").repartition("l_orderkey").distinct()  # one shuffle serves the tables too
    r, c = F.floor((F.col("l_linenumber") - 1) / 2).cast("int"), ((F.col("l_linenumber") - 1) % 2).cast("int")
    covered = (c == 1) & (r % 2 == 0)
    at = lambda x: F.when(~covered, x.cast("double"))
    wide = F.when((c == 0) & (r % 2 == 0), 20.0).otherwise(10.0)
    cells = li.select(F.col("l_orderkey").alias("table_id"), r.alias("r"), c.alias("c"), at(c * 10.0).alias("x0"), at(r * 10.0).alias("y0"), at(c * 10.0 + wide).alias("x1"), at(r * 10.0 + 10).alias("y1"))
    return tables.topology(cells)


def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents' contextual texts from the offline provider."""
    docs = _read(spark, d, "documents").select("doc_id", T.contextual_text(F.col("source"), F.col("lang"), F.lit(""), F.col("text")).alias("text"))
    return providers.embed(docs).select("doc_id", "embedding")


def layout_context(spark: SparkSession, d: str) -> DataFrame:
    """Prompt context after every document with derived headings."""
    h = layout.headings(_marked("### "), 3)
    state = _read(spark, d, "documents").select("doc_id", F.col("source").alias("chapter"), F.col("lang").alias("section"), h.alias("all")).withColumn("open", layout.open_headings("all"))
    return layout.prompt_context(state).select("doc_id", F.md5("context").alias("digest"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs, e = _read(spark, d, "documents").where(F.col("text").isNotNull()), _read(spark, d, "embeddings")
    return docs.join(e, F.col("doc_id") == F.col("vec_id")).select(
        F.col("doc_id").alias("chunk_id"), F.array(F.col("doc_id").cast("int")).alias("logical_page"), F.col("doc_id").cast("int").alias("pdf_page"),
        F.col("source").alias("chapter"), F.col("lang").alias("section"), F.lit("").alias("current_heading"), F.col("text").alias("content"), F.col("embedding").cast("array<double>").alias("embedding"),
    )


def _dot_vector(texts: list[str]) -> list[list[float]]:
    """A query's vector, of the width of the embeddings, from its words."""
    return providers.stub_embedding(texts, 64)


def chat_answers(spark: SparkSession, d: str) -> DataFrame:
    """Two turns of conversations whose questions are benchmark texts: rewritten, searched, answered."""
    q = _read(spark, d, "benchmark").where("item_id < 20").select((F.col("item_id") % 10).alias("session_id"), F.col("item_id").alias("turn"), F.col("text").alias("question"))
    got = search.converse(q, search.HybridSearch(_chunks(spark, d), _dot_vector), chat.stub_rewrite, providers.stub_answer)
    return got.select("session_id", "turn", "answer", F.md5("search_query").alias("search_query"), F.md5("context").alias("context"), "sources")


def eval_report(spark: SparkSession, d: str) -> DataFrame:
    """Report of a search for every benchmark text, nested."""
    docs, items = _read(spark, d, "documents").where(F.col("text").isNotNull()), _read(spark, d, "benchmark")
    engine = search.HybridSearch(_chunks(spark, d), _dot_vector)
    gold = engine.index.holding(items, docs, "item_id", "text", "doc_id", "text").groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("gold"))
    q = items.join(gold, F.col("item_id") == F.col("query_id"), "left").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit("benchmark").alias("category"), F.lit(True).alias("answerable"), F.coalesce("gold", F.array().cast("array<bigint>")).alias("gold"), F.lit("").alias("gold_answer"))
    return evaluate.report(q, engine.search(q.select("query_id", F.col("question").alias("query")), 20), "benchmark", 20)


def ingest_pages(spark: SparkSession, d: str) -> DataFrame:
    """Logical pages of books made of conversations: a page for each, read by the offline provider, with a detected table a spread."""
    c = _read(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.count("*").alias("n"))
    scans = c.select(F.lit(1).alias("doc_id"), (F.col("conv_id") + 1).cast("int").alias("pdf_page"), F.lit("").alias("left_header"), F.concat(F.lit("Part "), F.floor(F.col("conv_id") / 20).cast("string")).alias("right_header"), (F.col("n") > 1).alias("has_body"), (F.col("conv_id") % 2 == 0).alias("has_table"))
    contents = c.where("conv_id % 20 = 5").select(F.lit(1).alias("doc_id"), F.col("conv_id").cast("int").alias("chapter_ord"), F.concat(F.lit("Chapter "), F.col("conv_id").cast("string")).alias("chapter"), (2 * F.col("conv_id") - 2).cast("int").alias("chapter_start"), F.lit(0).alias("section_ord"), F.lit("Section").alias("section"), (2 * F.col("conv_id")).cast("int").alias("start"))
    got = ingest.ingest(scans, contents, providers.stub_page)
    return got.select("doc_id", "pdf_page", "part", F.array_join(F.col("logical_page").cast("array<string>"), ",").alias("logical_page"), "chapter", "section", F.array_join("current_headings", ",").alias("current_headings"), F.md5("content").alias("digest"))


def incremental_index(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a stream indexed as they arrived, each of them once."""
    from folioflow.sources.scratch import written
    from folioflow.streaming.index_stream import index_new

    source = written(_read(spark, d, "documents").select("doc_id", "text"), "arrived")
    base = source.inputFiles()[0].rsplit("/", 1)[0]
    index_new(spark, base, "doc_id long, text string", base + "-index", base + "-checkpoint")
    index_new(spark, base, "doc_id long, text string", base + "-index", base + "-checkpoint")
    return spark.read.parquet(base + "-index").select("doc_id", F.md5("text").alias("digest"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    tokenize_stats, bm25_topk, cosine_topk, minmax_scores, hybrid_topk, hybrid_filtered_topk, eval_details, recall_at_k, sentence_line_split, paragraph_pack, heading_blocks, heading_carry, heading_merge, chunk_document, layout_h3, layout_context,
    toc_ranges, toc_lookup, spread_mapping, heading_sanitize, abbrev_expand, abbrev_dictionary, containment_match, adjacency_groups, header_flatten, table_topology, rect_intersection, contextual_text, context_format, history_window, checkpoint_prefix,
    markdown_change_flags, json_tolerant_parse, html_heading_text, embed_documents, chat_answers, eval_report, ingest_pages, incremental_index,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, for those that SQL can express."""
    return sql.statements(ABBREVIATIONS, GLOSSARY, HEADER_CELLS, ROOM)
