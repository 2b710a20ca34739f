"""From scanned spreads to logical pages: the parse plan and the mapping of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import strip

#: The chapter of the cover, and the header band of a page in points.
COVER, HEADER = "Bìa tài liệu", 60.0


def parse_plan(pages: DataFrame, start_page: int = 1, end_page: int | None = None) -> DataFrame:
    """Return the plan of physical pages (doc_id, pdf_page, left_header, right_header, has_body).

    Spread numbers are read from the headers: the first line of digits on the left,
    the last on the right, else twice the page's index.  The chapter is the last
    longer line of the right header and carries forward; the first page is the
    cover.  The carry starts at the first page, whatever ``start_page`` is.
    """
    lines = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), strip)
    digits = lambda x: x.rlike(r"^\d+$")
    cover = F.col("pdf_page") == 1
    left = F.expr("try_element_at(_left, 1)").cast("int")
    right = F.expr("try_element_at(_right, -1)").cast("int")
    index = F.col("pdf_page") - 1
    p = pages.withColumn("_left", F.filter(lines(F.col("left_header")), digits)).withColumn("_right", F.filter(lines(F.col("right_header")), digits))
    name = F.try_element_at(F.filter(lines(F.col("right_header")), lambda x: ~digits(x) & (F.length(x) > 2)), F.lit(-1))
    p = p.withColumn("_chapter", F.when(cover, F.lit(COVER)).otherwise(name))
    upto = Window.partitionBy("doc_id").orderBy("pdf_page").rowsBetween(Window.unboundedPreceding, 0)
    plan = p.select(
        "doc_id", "pdf_page", cover.alias("is_cover"), F.when(cover, 1).otherwise(F.coalesce(left, index * 2)).alias("left_logical_page"), F.when(~cover, F.coalesce(right, index * 2 + 1)).alias("right_logical_page"),
        F.last("_chapter", True).over(upto).alias("chapter"), (cover | F.col("has_body")).alias("has_content"),
    )
    plan = plan.where(F.col("pdf_page") >= start_page)
    return plan if end_page is None else plan.where(F.col("pdf_page") <= end_page)


def has_body(words: DataFrame, images: DataFrame, drawings: DataFrame) -> DataFrame:
    """Return (doc_id, pdf_page) of pages with text below the header, a real image there, or a drawing.

    All three are rows of rectangles (x0, y0, x1, y1).  An image counts over 20 x 20,
    a drawing over 10 in height or 50 in width, if it reaches below the header.
    """
    keys = ["doc_id", "pdf_page"]
    below = F.col("y1") > HEADER
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    found = words.where(below).select(*keys).union(images.where(below & (wide > 20) & (high > 20)).select(*keys)).union(drawings.where(below & ((high > 10) | (wide > 50))).select(*keys))
    return found.distinct()


def map_blocks(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """Return logical pages (doc_id, pdf_page, part, logical_page, chapter, content) of scanned blocks.

    ``blocks`` is (doc_id, pdf_page, seq, location, content).  A spread gives up to
    three rows, in this order: blocks over both pages with both numbers, the left
    page's, the right page's; contents are joined by blank lines.  Blank blocks and
    unknown locations are dropped, a missing location means both pages; all of a
    cover is page 1.
    """
    part = F.when(F.col("is_cover"), 0).when(F.coalesce("location", F.lit("all")) == "all", 0).when(F.col("location") == "left", 1).when(F.col("location") == "right", 2)
    rows = blocks.join(plan, ["doc_id", "pdf_page"]).withColumn("content", strip(F.coalesce("content", F.lit("")))).where(F.col("content") != "")
    rows = rows.withColumn("part", part).where(F.col("part").isNotNull())
    both = F.array_compact(F.array("left_logical_page", "right_logical_page"))
    number = F.when(F.col("is_cover"), F.array(F.lit(1))).when(F.col("part") == 0, both).when(F.col("part") == 1, F.array_compact(F.array("left_logical_page"))).otherwise(F.array_compact(F.array("right_logical_page")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "\n\n")
    return rows.withColumn("logical_page", number).groupBy("doc_id", "pdf_page", "part", "logical_page", "chapter").agg(joined.alias("content"))
