"""Heading state of pages in reading order, from windows instead of a running object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import TABLE, quoted, strip

FENCE = r"```[\s\S]*?```"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _lines(content: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(content, F.lit("")), TABLE, ""), FENCE, "")
    return F.transform(F.split(bare, LINE_END), strip)


def _title(line: Column, pattern: str, group: int) -> Column:
    return strip(F.regexp_replace(strip(F.regexp_extract(line, pattern, group)), r"^\*\*|\*\*$", ""))


def h3_titles(content: Column) -> Column:
    """The level-3 headings of a page, outside of tables and fences."""
    pattern = r"(?Ud)^###\s+([^#\s].*)$"
    return F.filter(F.transform(F.filter(_lines(content), lambda x: x.rlike(pattern)), lambda x: _title(x, pattern, 1)), lambda t: t != "")


def headings(content: Column, least: Column | int = 1) -> Column:
    """All headings of a page as (level, title); levels above ``least`` are lowered to it."""
    pattern = r"(?Ud)^(#{1,6})\s+(.+)$"
    found = F.transform(
        F.filter(_lines(content), lambda x: x.rlike(pattern)),
        lambda x: F.struct(F.greatest(F.length(F.regexp_extract(x, pattern, 1)), F.lit(least) if isinstance(least, int) else least).alias("level"), _title(x, pattern, 2).alias("title")),
    )
    return F.filter(found, lambda h: h["title"] != "")


def open_headings(stack: str) -> Column:
    """The headings still open after a list of (level, title): each closes those as deep or deeper."""
    return F.expr(f"aggregate({stack}, cast(array() AS array<struct<level:int,title:string>>), (s, h) -> concat(filter(s, o -> o.level < h.level), array(h)))")


def _changed(column: str, order: Window) -> Column:
    """Whether a value differs from the last non-empty one before it; an empty one never does."""
    now = F.expr(f"nullif({column}, '')")
    before = F.last(now, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(now != before, F.lit(False))


def carry_h3(pages: DataFrame) -> DataFrame:
    """Add ``current_h3``: a page's last level-3 heading, else the one before it in the same chapter and section.

    Rows are ordered by page_seq within doc_id, which tell them apart; rows that only
    set the context (a spread's event, with null content) take part and may be filtered
    afterwards.  Only headings go through the windows, not the contents.
    """
    order = Window.partitionBy("doc_id").orderBy("page_seq")
    narrow = pages.select("doc_id", "page_seq", "chapter", "section", h3_titles(F.col("content")).alias("_titles")).withColumn("_own", F.expr("try_element_at(_titles, -1)")).drop("_titles")
    runs = narrow.withColumn("_new", (_changed("chapter", order) | _changed("section", order)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("doc_id", "_run").orderBy("page_seq").rowsBetween(Window.unboundedPreceding, 0)
    state = runs.select(F.col("doc_id").alias("_doc"), F.col("page_seq").alias("_page"), F.last("_own", True).over(within).alias("current_h3"))
    return pages.join(state, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("page_seq") == F.col("_page"))).drop("_doc", "_page")


def sanitize_headings(content: str) -> Column:
    """Turn level-1 and level-2 heading lines into level 3, except within fences.

    A fold keeps whether a fence is open; fence lines themselves stay as they are.
    """
    heading = quoted(r"(?Ud)^#{1,2}\s+(.+)$")
    line = f"if(s.fenced, x, regexp_replace(x, {heading}, '### $1'))"
    fence = f"startswith(regexp_replace(x, {quoted(r'(?U)^[\s\x1c-\x1f]+')}, ''), '```')"
    step = f"(s, x) -> named_struct('fenced', if({fence}, NOT s.fenced, s.fenced), 'out', concat(s.out, array(if({fence}, x, {line}))))"
    start = "named_struct('fenced', false, 'out', cast(array() AS array<string>))"
    return F.expr(f"array_join(aggregate(split({content}, '\\n'), {start}, {step}, s -> s.out), '\\n')")


def change_flags(pages: DataFrame) -> DataFrame:
    """Add ``new_chapter`` and ``new_section``: whether a report prints them before a page."""
    order = Window.partitionBy("doc_id").orderBy("page_seq")
    first = ~F.col("chapter").eqNullSafe(F.lag("chapter").over(order)) | (F.row_number().over(order) == 1)
    section = first | ~F.col("section").eqNullSafe(F.lag("section").over(order))
    return pages.withColumn("new_chapter", first).withColumn("new_section", section)


#: The lines that end a context, with a section and without.
BOUND_RULES = (
    "* HƯỚNG DẪN ĐỀ MỤC BẮT BUỘC:",
    "  + TUYỆT ĐỐI KHÔNG dùng '#' hoặc '##' (đã dành riêng cho Chương và Ý chính).",
    "  + Nếu nội dung trang này là phần viết tiếp của tiểu mục trước: tiếp tục trình bày nội dung, không lặp lại đề mục '###'.",
    "  + Nếu xuất hiện ý nhỏ mới trong trang: bắt buộc dùng '###' (hoặc '####' cho phân cấp sâu hơn).",
)
FREE_RULES = (
    "* Hướng dẫn kế thừa phân cấp:",
    "  + Nếu trang hiện tại là nội dung tiếp nối, hãy gán cấp độ đề mục phù hợp tương ứng theo phân cấp trên.",
    "  + Nếu trang hiện tại bắt đầu một chủ đề lớn mới hoặc chương mới, hãy sử dụng đề mục # cô đọng độc lập tương ứng.",
)


def prompt_context(state: DataFrame) -> DataFrame:
    """Add ``context``: a short text of the headings that are open after a page, and how to go on from them.

    ``state`` has chapter, section and ``open``, an array of (level, title).
    """
    mark = lambda h: F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["title"])
    last = F.expr("try_element_at(open, -1)")
    path = F.array_join(F.transform("open", lambda h: F.concat(F.lit("H"), h["level"].cast("string"))), " > ")
    h3 = F.expr("try_element_at(filter(open, h -> h.level = 3), -1).title")
    h1 = F.expr("try_element_at(filter(open, h -> h.level = 1), 1).title")
    fixed = F.concat_ws(
        "\n", F.lit("[NGỮ CẢNH PHÂN CẤP TÀI LIỆU]:"), F.concat(F.lit("- Chương (#): "), F.expr("nullif(chapter, '')")), F.concat(F.lit("- Ý chính (##): "), F.col("section")),
        F.concat(F.lit("- Tiểu mục cấp 3 (###) đang mở từ trang trước: "), h3), F.when(F.size("open") > 0, F.concat(F.lit("- Cây phân cấp hiện tại: "), F.when(F.expr("nullif(chapter, '')").isNotNull(), F.lit("H1 (#) > ")).otherwise(F.lit("")), F.lit("H2 (##) > "), path)),
        F.concat(F.lit("- Đề mục gần nhất vừa hoàn thành: "), mark(last)), *map(F.lit, BOUND_RULES),
    )
    free = F.concat_ws("\n", F.lit("[NGỮ CẢNH ĐỀ MỤC TỪ CÁC TRANG TRƯỚC]:"), F.concat(F.lit("- Đề mục cấp 1 (#) đang mở: "), F.coalesce(F.concat(F.lit("# "), h1), F.lit("Không có"))), F.concat(F.lit("- Cây phân cấp hiện tại: "), path), F.concat(F.lit("- Đề mục gần nhất vừa hoàn thành: "), mark(last)), *map(F.lit, FREE_RULES))
    return state.withColumn("context", F.when(F.col("section").isNotNull(), fixed).when(F.size("open") > 0, free).otherwise(F.lit("")))
