"""Command line: ``python -m folioflow.cli STEP --input ... --output ...``; each step reads and writes tables.

Models outside are named by ``--provider module:function``, a batch provider (see
``operators/providers.py``); without it the deterministic stubs are used.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import chat, chunk, enrich, evaluate, hybrid, ingest, layout, providers, search
from folioflow.sources import files
from folioflow.sources.code import ship


def provider_of(name: str | None, stub: providers.Provider) -> providers.Provider:
    """The provider that ``module:function`` names, or the stub."""
    if not name:
        return stub
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read Parquet, or files that hold one JSON array each, with their order as ``seq``."""
    return files.read_json_array(spark, path, schema) if schema and path.rstrip("/").endswith(".json") else spark.read.parquet(path)


def chunked(spark: SparkSession, a: argparse.Namespace) -> None:
    """Logical pages to numbered chunks, and the counts of the run."""
    pages = read_table(spark, a.input, files.PAGE)
    if "doc_id" not in pages.columns:
        pages = pages.withColumn("doc_id", F.lit("document"))
    if "page_seq" not in pages.columns:
        pages = pages.withColumn("page_seq", F.col("seq") if "seq" in pages.columns else F.col("pdf_page") * 3 + F.col("part"))
    chunks = files.numbered(chunk.chunk_pages(pages, a.max_chars)).drop("chunk_seq")
    chunks.write.mode("overwrite").parquet(a.output)
    files.run_stats(pages, spark.read.parquet(a.output), a.output).show(truncate=False)


def abbreviations(spark: SparkSession, a: argparse.Namespace) -> None:
    """The glossary's pages to a dictionary."""
    pages = read_table(spark, a.input, files.PAGE)
    targets = enrich.glossary_pages(files.read_contents(spark, a.contents)).select(F.col("page").alias("_page"))
    held = pages.withColumn("_page", F.explode("logical_page")).join(targets, "_page", "left_semi").select("pdf_page", "content").distinct()
    own = pages.where(enrich.is_glossary(F.col("chapter"))).select("pdf_page", "content")
    cells = held.union(own).distinct().select("pdf_page", F.posexplode(enrich.cell_pairs(enrich.table_rows("content"))).alias("k", "p"))
    enrich.dictionary(cells.select((F.col("pdf_page").cast("long") * 100_000 + F.col("k")).alias("seq"), "p.term", "p.definition")).write.mode("overwrite").parquet(a.output)


def enriched(spark: SparkSession, a: argparse.Namespace) -> None:
    """Chunks with abbreviations written out, but for the glossary's own."""
    chunks = read_table(spark, a.input, files.CHUNK)
    enrich.expand(chunks, spark.read.parquet(a.abbreviations), "content", enrich.is_glossary(F.col("chapter"))).write.mode("overwrite").parquet(a.output)


def indexed(spark: SparkSession, a: argparse.Namespace) -> None:
    """Chunks to an index with vectors; a run that was broken off goes on."""
    n = ingest.index_chunks(spark, spark.read.parquet(a.input), a.output, provider_of(a.provider, providers.stub_embedding), a.limit, a.batch)
    print(f"{n} chunks are indexed in {a.output}")


def _engine(spark: SparkSession, a: argparse.Namespace) -> search.HybridSearch:
    return search.HybridSearch(files.read_index(spark, a.index), provider_of(a.provider, providers.stub_embedding))


def searched(spark: SparkSession, a: argparse.Namespace) -> None:
    """Print the best chunks for a query."""
    filters = {k: v for text in a.filter or [] for k, v in hybrid.parse_filters(text).items()}
    found = _engine(spark, a).search(spark.createDataFrame([(0, a.query)], "query_id int, query string"), a.top_k, filters)
    for r in found.withColumn("snippet", files.snippet(F.col("content"))).orderBy("rank").collect():  # top_k rows
        print(f"[#{r['rank']}] Score: {r.score:.4f} (Semantic: {r.semantic:.4f} | Lexical: {r.lexical:.2f})\n  Trang {r.logical_page} (PDF {r.pdf_page})\n  {r.chapter} > {r.section} > {r.current_heading}\n{r.snippet}\n")


def chatted(spark: SparkSession, a: argparse.Namespace) -> None:
    """Answer the questions of conversations (session_id, turn, question)."""
    answers = search.converse(spark.read.parquet(a.input), _engine(spark, a), provider_of(a.rewriter, chat.stub_rewrite), provider_of(a.answerer, providers.stub_answer), a.top_k)
    answers.write.mode("overwrite").parquet(a.output)


def evaluated(spark: SparkSession, a: argparse.Namespace) -> None:
    """Search a question file and write the report as one JSON array."""
    q = files.read_json_array(spark, a.input, files.QUESTION)
    q = q.select(F.col("id").alias("query_id"), "question", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("answerable", F.lit(True)).alias("answerable"), F.col("gold_printed_pages").alias("gold"), F.coalesce("gold_answer", F.lit("")).alias("gold_answer"))
    found = _engine(spark, a).search(q.select("query_id", F.col("question").alias("query")), a.top_k)
    report = evaluate.report(q, found, a.input, a.top_k)
    files.write_json_array(report, a.output, ["dataset"])
    report.select("total_questions", "evaluated_questions", "aggregated_metrics.*").show(truncate=False)


def ingested(spark: SparkSession, a: argparse.Namespace) -> None:
    """Scanned pages to logical pages and a Markdown report; tables that need a look go beside."""
    scans = spark.read.parquet(a.input)
    geometry = spark.read.parquet(a.geometry) if a.geometry else None
    earlier = spark.read.parquet(a.earlier) if a.earlier else None
    pages = ingest.ingest(scans, spark.read.parquet(a.contents), provider_of(a.provider, providers.stub_page), geometry, earlier, a.start, a.end, a.action)
    pages.write.mode("overwrite").parquet(a.output)
    pages = spark.read.parquet(a.output)
    ingest.quarantine(pages).write.mode("overwrite").parquet(a.output.rstrip("/") + ".quarantine")
    if a.report:
        flagged = layout.change_flags(pages.withColumn("page_seq", F.col("pdf_page") * 3 + F.col("part")))
        n = scans.agg(F.max("pdf_page")).first()[0] or 0
        files.write_markdown(flagged, a.report, {"stem": "report", "name": a.input, "time": "", "first": a.start, "last": a.end or n, "total": n, "model": a.provider or "stub"})


#: Step, what runs it, and its options besides --input and --output: (name, settings).
STEPS = {
    "ingest": (ingested, [("--contents", {"required": True}), ("--geometry", {}), ("--earlier", {}), ("--provider", {}), ("--start", {"type": int, "default": 1}), ("--end", {"type": int}), ("--action", {"type": int, "choices": (1, 2, 3), "default": 1}), ("--report", {})]),
    "chunk": (chunked, [("--max-chars", {"type": int, "default": 2000})]),
    "abbreviations": (abbreviations, [("--contents", {"required": True})]),
    "enrich": (enriched, [("--abbreviations", {"required": True})]),
    "index": (indexed, [("--provider", {}), ("--limit", {"type": int}), ("--batch", {"type": int, "default": 25})]),
    "search": (searched, [("--index", {"required": True}), ("--query", {"required": True}), ("--filter", {"action": "append"}), ("--provider", {}), ("--top-k", {"type": int, "default": 10})]),
    "chat": (chatted, [("--index", {"required": True}), ("--provider", {}), ("--rewriter", {}), ("--answerer", {}), ("--top-k", {"type": int, "default": chat.CHAT_TOP_K})]),
    "eval": (evaluated, [("--index", {"required": True}), ("--provider", {}), ("--top-k", {"type": int, "default": 20})]),
}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one step; return 0, or 2 for settings that are missing or wrong."""
    parser = argparse.ArgumentParser(prog="folioflow", description=__doc__)
    steps = parser.add_subparsers(dest="step", required=True)
    for name, (run, options) in STEPS.items():
        step = steps.add_parser(name, help=run.__doc__)
        if name != "search":
            step.add_argument("--input", required=True)
            step.add_argument("--output", required=True)
        for option, settings in options:
            step.add_argument(option, **settings)
    chosen = parser.parse_args(arguments)
    session = spark or SparkSession.builder.appName("folioflow").getOrCreate()
    ship(session)
    try:
        STEPS[chosen.step][0](session, chosen)
    except ValueError as error:
        print(f"folioflow {chosen.step}: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
