"""Conversational retrieval: history frames, context and prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import strip

#: History entries that a rewrite and an answer see, results of a chat, labels.
REWRITE_ENTRIES, ANSWER_ENTRIES, CHAT_TOP_K = 4, 6, 7
USER_LABEL, OTHER_LABEL = "Người dùng", "Trợ lý"
REFUSAL = "Tôi không đủ thông tin để trả lời câu hỏi này."


def history(turns: DataFrame, entries: int = REWRITE_ENTRIES) -> DataFrame:
    """Add ``history``: the labelled entries before each turn (session_id, turn, role, text)."""
    frame = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-entries, -1)
    line = F.concat(F.when(F.col("role") == "user", USER_LABEL).otherwise(OTHER_LABEL), F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.withColumn("history", F.array_join(F.collect_list(line).over(frame), "\n"))


def context_block(pages: Column, chapter: Column, heading: Column, content: Column) -> Column:
    """One retrieved chunk under a line that says where it stands."""
    numbers = F.array_join(pages.cast("array<string>"), ", ")
    return F.concat(F.lit("[Trang "), numbers, F.lit(" | Chương: "), chapter, F.lit(" | Tiêu đề: "), heading, F.lit("]\n"), strip(content))


def context(ranked: DataFrame) -> DataFrame:
    """Return (query_id, context): the blocks (query_id, rank, block) in order, between rules."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n" + "-" * 40 + "\n\n")
    rule = F.lit("\n\n" + "=" * 50 + "\n\n")
    return ranked.groupBy("query_id").agg(F.concat(rule, joined, rule).alias("context"))


def needs_rewrite(turn: Column) -> Column:
    """Whether a question has a history to be rewritten with: all but the first one."""
    return turn > 0


def unquoted(text: Column) -> Column:
    """A rewritten query without the quotes that a model may put around it."""
    return F.regexp_replace(strip(text), "^[\"']+|[\"']+$", "")


def stub_rewrite(prompts: list[str]) -> list[str]:
    """The question as it stands in a rewrite's prompt, for tests."""
    return [(p or "").rstrip().split("\n")[-1] for p in prompts]


def source_line(ranked: DataFrame, first: int = 3) -> DataFrame:
    """Return (query_id, sources): a line for each of the first results (query_id, rank, logical_page, score, chapter, current_heading)."""
    pages = F.concat(F.lit("["), F.array_join(F.col("logical_page").cast("array<string>"), ", "), F.lit("]"))
    text = F.concat(F.lit("• [Trang "), pages, F.lit("] (Score: "), F.format_string("%.4f", "score"), F.lit(") "), F.col("chapter"), F.lit(" > "), F.col("current_heading"))
    lines = ranked.where(F.col("rank") <= first).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("s"))
    return lines.select("query_id", F.array_join(F.transform("s", lambda x: x["t"]), "\n").alias("sources"))
