"""Tables of contents: closed page ranges and the lookup of a page in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import strip

#: The section put before a chapter's first one, and the name of what lies outside.
OPENING, OUTSIDE = "Mở đầu chương", "Nội dung"


def close_ranges(entries: DataFrame, last_page: int = 400) -> DataFrame:
    """Return (doc_id, chapter_ord, chapter, section_ord, section, start, end).

    ``entries`` has doc_id, chapter_ord, chapter, chapter_start and a row for each
    section (section_ord, section, start), or one with null section.  A section
    ends before the next one, a chapter's last before the next chapter, the last
    of all at ``last_page``; no range ends before it starts.  A chapter without
    sections is its own section; one without any start is dropped; of repeated
    titles the last one's ranges stay, at the place of the first.
    """
    base = entries.select("doc_id", "chapter_ord", strip(F.col("chapter")).alias("chapter"), "chapter_start", "section_ord", strip(F.col("section")).alias("section"), "start")
    real = base.where((F.col("section") != "") & F.col("start").isNotNull())
    chapters = base.groupBy("doc_id", "chapter_ord", "chapter").agg(F.first("chapter_start", True).alias("chapter_start"), F.min(F.when((F.col("section") != "") & F.col("start").isNotNull(), F.col("start"))).alias("least"))
    alone = chapters.where(F.col("least").isNull() & F.col("chapter_start").isNotNull()).select("doc_id", "chapter_ord", "chapter", "chapter_start", F.lit(0).alias("section_ord"), F.col("chapter").alias("section"), F.col("chapter_start").alias("start"))
    opener = chapters.where(F.col("chapter_start") < F.col("least")).select("doc_id", "chapter_ord", "chapter", "chapter_start", F.lit(-1).alias("section_ord"), F.lit(OPENING).alias("section"), F.col("chapter_start").alias("start"))
    rows = real.unionByName(alone).unionByName(opener)
    within = Window.partitionBy("doc_id", "chapter_ord").orderBy("start", "section_ord")
    rows = rows.withColumn("next", F.lead("start").over(within)).withColumn("section_seq", F.row_number().over(within) - 1)
    starts = chapters.where(F.col("least").isNotNull() | F.col("chapter_start").isNotNull()).select("doc_id", "chapter_ord", F.coalesce("chapter_start", "least").alias("at"))
    following = starts.withColumn("next_chapter", F.lead("at").over(Window.partitionBy("doc_id").orderBy("chapter_ord"))).drop("at")
    end = F.greatest("start", F.coalesce(F.col("next") - 1, F.col("next_chapter") - 1, F.lit(last_page)))
    closed = rows.join(following, ["doc_id", "chapter_ord"]).withColumn("end", end)
    title = Window.partitionBy("doc_id", "chapter")
    closed = closed.withColumn("place", F.min("chapter_ord").over(title)).withColumn("kept", F.max("chapter_ord").over(title)).where(F.col("chapter_ord") == F.col("kept"))
    return closed.select("doc_id", F.col("place").alias("chapter_ord"), "chapter", F.col("section_seq").alias("section_ord"), "section", "start", "end")


def lookup(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Add ``toc_section`` and ``toc_chapter`` to pages (doc_id, page_id, page, chapter).

    The first range in table order that holds the page wins.  Ranges are expanded
    to the pages that they hold, which makes the lookup a hash join on the page;
    pages outside of all ranges get their own chapter for both, or a default.
    """
    held = ranges.where(F.col("start") <= F.col("end")).select("doc_id", F.explode(F.sequence("start", "end")).alias("page"), "chapter_ord", "section_ord", F.col("section").alias("toc_section"), F.col("chapter").alias("toc_chapter"))
    first = held.groupBy("doc_id", "page").agg(F.min_by(F.struct("toc_section", "toc_chapter"), F.struct("chapter_ord", "section_ord")).alias("hit"))
    own = F.coalesce(F.expr("nullif(chapter, '')"), F.lit(OUTSIDE))
    return pages.join(first, ["doc_id", "page"], "left").withColumn("toc_section", F.coalesce("hit.toc_section", own)).withColumn("toc_chapter", F.coalesce("hit.toc_chapter", own)).drop("hit")
