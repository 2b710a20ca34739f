"""Retrieval evaluation: page-coverage recall, first hits and averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_details(questions: DataFrame, ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Return (query_id, first_hit, recall_k...) for each question (query_id, gold array).

    ``ranked`` is (query_id, rank, pages array).  Recall at k is the share of the
    gold entries, repeats included, that the pages of the first k results cover;
    it is 0 without gold.  A question without results has recall 0 and no hit.
    """
    pages = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pages"))).alias("hits"))
    both = questions.select("query_id", "gold").join(pages, "query_id", "left")

    def recall(k: int):
        seen = F.flatten(F.transform(F.filter("hits", lambda h: h["rank"] <= k), lambda h: h["pages"]))
        covered = F.size(F.filter("gold", lambda p: F.array_contains(F.coalesce(seen, F.array().cast("array<bigint>")), p)))
        return F.when(F.size("gold") > 0, covered / F.size("gold")).otherwise(0.0).alias(f"recall_{k}")

    first = F.array_min(F.transform(F.filter("hits", lambda h: F.arrays_overlap(h["pages"], F.col("gold"))), lambda h: h["rank"]))
    return both.select("query_id", first.alias("first_hit"), *map(recall, ks))


def mean_recall(details: DataFrame, digits: int = 4) -> DataFrame:
    """Return one row: the number of questions and the mean of each recall, rounded."""
    names = [c for c in details.columns if c.startswith("recall_")]
    return details.agg(F.count("*").alias("n_questions"), *(F.round(F.avg(c), digits).alias(c) for c in names))


def evaluated(questions: DataFrame) -> DataFrame:
    """Keep questions that are answerable (by default) and have gold pages."""
    return questions.where(F.coalesce(F.col("answerable"), F.lit(True)) & (F.size("gold") > 0))


def levels(top_k: int, ks: tuple[int, ...] = (1, 3, 5, 10, 20)) -> tuple[int, ...]:
    """The levels of recall that a search of ``top_k`` results can show."""
    return tuple(k for k in ks if k <= top_k)


def result_rows(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Return (query_id, retrieved): a question's results in order, shaped for a report.

    ``ranked`` is a search's result.  Scores are rounded to 4, 4 and 2 digits, contents
    are cut to their first 200 characters, and a result is relevant if one of its pages
    is gold.
    """
    both = ranked.join(questions.select("query_id", "gold"), "query_id")
    row = F.struct(
        "rank", "chunk_id", F.round("score", 4).alias("score"), F.round("semantic", 4).alias("semantic_score"), F.round("lexical", 2).alias("lexical_score"), "logical_page", "pdf_page", "chapter",
        F.col("current_heading").alias("heading"), F.coalesce(F.arrays_overlap(F.col("logical_page").cast("array<bigint>"), F.col("gold").cast("array<bigint>")), F.lit(False)).alias("is_relevant"), F.substring("content", 1, 200).alias("content_snippet"),
    )
    return both.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("retrieved"))


def report(questions: DataFrame, ranked: DataFrame, dataset: str, top_k: int = 20) -> DataFrame:
    """Return one row: a whole evaluation, with the means over evaluated questions and all details nested.

    ``questions`` is (query_id, question, category, answerable, gold, gold_answer).  The
    row holds every question, so this is for question sets, not for corpora.
    """
    ks = levels(top_k)
    hits = ranked.where(F.col("rank") <= top_k)
    pages = hits.select("query_id", "rank", F.col("logical_page").cast("array<bigint>").alias("pages"))
    details = recall_details(questions.select("query_id", F.coalesce(F.col("gold").cast("array<bigint>"), F.array().cast("array<bigint>")).alias("gold")), pages, ks)
    counts = F.coalesce(F.col("answerable"), F.lit(True)) & (F.coalesce(F.size("gold"), F.lit(0)) > 0)
    rows = questions.join(details, "query_id").join(result_rows(questions, hits), "query_id", "left").withColumn("counts", counts)
    metrics = F.when(F.col("counts"), F.struct(*(F.round(f"recall_{k}", 4).alias(f"recall_at_{k}") for k in ks)))
    detail = F.struct(F.col("query_id").alias("id"), "question", "category", "answerable", F.col("gold").alias("gold_printed_pages"), "gold_answer", F.col("first_hit").alias("first_hit_rank"), metrics.alias("metrics"), F.col("retrieved").alias("retrieved_top_k"))
    means = F.struct(*(F.round(F.avg(F.when(F.col("counts"), F.col(f"recall_{k}"))), 4).alias(f"recall_at_{k}") for k in ks))
    return rows.agg(F.lit(dataset).alias("dataset"), F.count("*").alias("total_questions"), F.count_if("counts").alias("evaluated_questions"), means.alias("aggregated_metrics"), F.array_sort(F.collect_list(detail), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("per_query_details"))
