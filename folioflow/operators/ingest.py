"""From the pages of scanned documents to logical pages, and from chunks to an index."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import contextual_text
from folioflow.operators import layout, pages, providers, reconcile, toc
from folioflow.sources import files
from folioflow.sources.scratch import written

#: The page that holds the contents, the prompt, what is added where a page has tables, and a failure's text.
CONTENTS_PAGE = 2
USER_PROMPT = "Hãy đọc toàn bộ hình ảnh trang tài liệu và trích xuất tất cả các khối nội dung sang định dạng JSON theo đúng quy tắc trên."
TABLE_PROMPT = "--- CHỈ DẪN TRÍCH XUẤT BẢNG BIỂU TỪ HÌNH ẢNH ---\nTrang này có chứa bảng biểu số liệu. Hãy tập trung quan sát kỹ hình ảnh để trích xuất bảng chính xác 100%.\n--- HẾT CHỈ DẪN BẢNG ---"
FAILURE = "Lỗi OCR: "
BLOCKS = T.ArrayType(T.StructType([T.StructField("location", T.StringType()), T.StructField("content", T.StringType())]))


def routed(plan: DataFrame, ranges: DataFrame) -> DataFrame:
    """Return the plan's pages that are read, with the chapter and section that their contents put them in.

    Covers, the page of contents, pages without a body and the pages that open a chapter
    are left out, before anything is read; a page is looked up by its left number, else
    by its right one.
    """
    body = plan.where(~F.col("is_cover") & (F.col("pdf_page") != CONTENTS_PAGE) & (F.col("pdf_page") != 1) & F.col("has_content"))
    asked = body.withColumn("page", F.coalesce("left_logical_page", "right_logical_page")).withColumn("page_id", F.col("pdf_page"))
    found = toc.lookup(asked, ranges).where(F.col("toc_section") != toc.OPENING)
    active = F.when(F.col("toc_chapter").isin("", toc.OUTSIDE), F.col("chapter")).otherwise(F.coalesce("toc_chapter", "chapter"))
    return found.withColumn("chapter", active).withColumn("section", F.col("toc_section")).drop("page", "page_id", "toc_section", "toc_chapter")


def prompts(rows: DataFrame) -> DataFrame:
    """Add ``prompt`` to pages (chapter, section, open, has_table): what to do, where it stands, how to read tables."""
    state = layout.prompt_context(rows)
    parts = F.concat_ws("\n\n", F.lit(USER_PROMPT), F.expr("nullif(context, '')"), F.when(F.col("has_table"), F.lit(TABLE_PROMPT)))
    return state.withColumn("prompt", parts).drop("context")


def parsed_blocks(text: str) -> list[dict[str, str]]:
    """The blocks of an answer: JSON that may be fenced or have prose around it, {"blocks": [...]} or a list."""
    bare = re.sub(r"\A```(?:json)?|```\Z", "", text.strip()).strip()
    for piece in (bare, *(m[0] for m in [re.search(r"[\[{].*[\]}]", bare, re.S)] if m)):
        try:
            found = json.loads(piece)
        except ValueError:
            continue
        found = found.get("blocks", []) if isinstance(found, dict) else found
        if isinstance(found, list):
            return [{"location": b.get("location") or "all", "content": b.get("content") or ""} for b in found if isinstance(b, dict)]
    raise ValueError("the answer holds no blocks")


def read_pages(rows: DataFrame, provider: providers.Provider) -> DataFrame:
    """Return the blocks (doc_id, pdf_page, seq, location, content) that a provider reads from ``prompt``.

    A page whose reading or answer fails is one block over both pages with the error's text.
    """

    def blocks(inputs: list[str]) -> list:
        out = []
        for i in inputs:
            try:
                out.append(parsed_blocks(provider([i])[0]))
            except providers.QuotaError:
                raise
            except Exception as error:  # a page that can't be read does not end the run
                out.append([{"location": "all", "content": FAILURE + str(error)}])
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [providers.call(blocks, [p])[0] for p in frame["prompt"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "pdf_page": frame["pdf_page"], "blocks": got})

    read = rows.select("doc_id", "pdf_page", "prompt").mapInPandas(run, T.StructType([rows.schema["doc_id"], rows.schema["pdf_page"], T.StructField("blocks", BLOCKS)]))
    return read.select("doc_id", "pdf_page", F.posexplode("blocks").alias("seq", "b")).select("doc_id", "pdf_page", "seq", "b.location", "b.content")


def ingest(scans: DataFrame, contents: DataFrame, provider: providers.Provider, geometry: DataFrame | None = None, earlier: DataFrame | None = None, start_page: int = 1, end_page: int | None = None, action: int = 1) -> DataFrame:
    """Return the logical pages (doc_id, pdf_page, part, logical_page, chapter, section, current_headings, content, unassigned).

    ``scans`` is (doc_id, pdf_page, left_header, right_header, has_body, has_table), a row
    for each physical page, ``contents`` the entries of close_ranges(), and ``geometry``
    what reconcile() needs.  ``earlier`` pages, of a run before, are kept up to
    ``start_page``, and give the open heading that this run begins with.

    Pages are read independently of each other, so a prompt names the chapter and section
    of its page, and, of the headings that earlier pages leave open, those of ``earlier``.
    """
    last = scans.agg(F.max("pdf_page")).first()[0] or 0
    ranges = written(toc.close_ranges(contents, 2 * last), "ranges")
    plan = routed(pages.parse_plan(scans.select("doc_id", "pdf_page", "left_header", "right_header", "has_body"), start_page, end_page), ranges)
    plan = written(plan.join(scans.select("doc_id", "pdf_page", "has_table"), ["doc_id", "pdf_page"]), "plan")
    kept = None if earlier is None else earlier.where(F.col("pdf_page") < start_page)
    none = F.array().cast("array<struct<level:int,title:string>>")
    if kept is None:
        state = plan.withColumn("open", none)
    else:
        at_end = kept.groupBy("doc_id").agg(F.max_by(F.struct("chapter", "section", F.try_element_at("current_headings", F.lit(-1)).alias("h3")), F.struct("pdf_page", "part")).alias("e"))
        same = (F.col("e.chapter") == F.col("chapter")) & (F.col("e.section") == F.col("section")) & F.col("e.h3").isNotNull()
        state = plan.join(at_end, "doc_id", "left").withColumn("open", F.when(same, F.array(F.struct(F.lit(3).alias("level"), F.col("e.h3").alias("title")))).otherwise(none)).drop("e")
    blocks = read_pages(prompts(state), provider).withColumn("content", layout.sanitize_headings("content"))
    if geometry is None:
        blocks = blocks.withColumn("unassigned", F.lit(0))
    else:
        blocks = reconcile.reconcile(blocks, geometry, action)
    blocks = written(blocks, "blocks")
    mapped = pages.map_blocks(blocks.drop("unassigned"), plan.drop("section", "has_table", "has_content"))
    open_tables = blocks.groupBy("doc_id", "pdf_page").agg(F.max("unassigned").alias("unassigned"))
    asked = mapped.withColumn("page", F.try_element_at("logical_page", F.lit(1))).withColumn("page_id", F.col("pdf_page"))
    placed = toc.lookup(asked, ranges).withColumn("chapter", F.col("toc_chapter")).withColumn("section", F.col("toc_section")).drop("page", "page_id", "toc_chapter", "toc_section")
    new = placed.join(open_tables, ["doc_id", "pdf_page"]).select("doc_id", "pdf_page", "part", "logical_page", "chapter", "section", "content", "unassigned")
    if kept is not None:
        old = kept.select("doc_id", "pdf_page", "part", "logical_page", "chapter", "section", "content", "unassigned")
        new = new.unionByName(old)
    # A page's place in its document: three parts at most.
    carried = layout.carry_h3(written(new, "logical").withColumn("page_seq", F.col("pdf_page") * 3 + F.col("part")))
    headings = F.when(F.col("current_h3").isNull(), F.array().cast("array<string>")).otherwise(F.array("current_h3"))
    return carried.select("doc_id", "pdf_page", "part", "logical_page", "chapter", "section", headings.alias("current_headings"), "content", "unassigned")


def quarantine(logical: DataFrame) -> DataFrame:
    """The logical pages with detected tables that stand for no scanned one: worth a look by a person."""
    return logical.where(F.col("unassigned") > 0)


def index_chunks(spark: SparkSession, chunks: DataFrame, path: str, provider: providers.Provider = providers.stub_embedding, limit: int | None = None, batch: int = 25) -> int:
    """Embed the chunks (chunk_id, ...) that the index at ``path`` lacks, append them, and return its number of rows.

    ``limit`` takes the chunks with smaller ids only.  The append is one committed write,
    so a run that was broken off is resumed by the next one.
    """
    rows = chunks.where(F.col("chunk_id") < limit) if limit is not None and limit > 0 else chunks
    if files.is_there(spark, path):
        done = spark.read.parquet(path).where(F.col("embedding").isNotNull()).select("chunk_id")
        rows = rows.join(done, "chunk_id", "left_anti")
    text = contextual_text(F.col("chapter"), F.col("section"), F.col("current_heading"), F.col("content"))
    fresh = providers.embed(rows.withColumn("_text", text), "_text", provider, batch).drop("_text")
    fresh.write.mode("append").partitionBy("chapter").parquet(path)
    return spark.read.parquet(path).count()
