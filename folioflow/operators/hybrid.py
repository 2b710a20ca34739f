"""Hybrid retrieval: min-max scaled lexical and semantic scores, fused linearly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources.scratch import written

ALPHA, BETA = 0.4, 0.6


def min_max(score: Column, group: list[str]) -> Column:
    """Scale a score to 0..1 within its group; where all are equal, 1."""
    w = Window.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / (high - low))


def metadata_filter(filters: dict[str, str | int | None], columns: list[str]) -> Column:
    """All non-empty filters as equalities; an unknown column matches nothing."""
    keep = F.lit(True)
    for name, value in filters.items():
        if value:
            keep = keep & ((F.col(name) == F.lit(value)) if name in columns else F.lit(False))
    return keep


def parse_filters(text: str) -> dict[str, str]:
    """Parse ``filter: key=value`` as typed by a user: one pair, cut at its first ``=``; quotes around the value go."""
    body = text[len("filter:") :] if text.startswith("filter:") else text
    key, equals, value = body.strip().partition("=")
    return {key.strip(): value.strip().strip("'\"")} if equals else {}


def fuse(candidates: DataFrame, lexical: DataFrame, alpha: float = ALPHA, beta: float = BETA, digits: int = 6) -> DataFrame:
    """Return (query_id, id, score, lexical, semantic) of candidates (query_id, id, semantic).

    Both scores are rounded before they are scaled, so that equal texts tie.  The
    pairs are written once; their bounds are one row for each query.
    """
    both = candidates.join(lexical, ["query_id", "id"], "left")
    both = written(both.select("query_id", "id", F.round("semantic", digits).alias("semantic"), F.round(F.coalesce("lexical", F.lit(0.0)), digits).alias("lexical")), "pairs")
    names = ("lexical", "semantic")
    bounds = both.groupBy("query_id").agg(*(f(c).alias(f"{k}_{c}") for c in names for k, f in (("low", F.min), ("high", F.max))))
    scaled = lambda c: F.when(F.col(f"high_{c}") == F.col(f"low_{c}"), F.lit(1.0)).otherwise((F.col(c) - F.col(f"low_{c}")) / (F.col(f"high_{c}") - F.col(f"low_{c}")))
    score = alpha * scaled("lexical") + beta * scaled("semantic")
    return both.join(bounds, "query_id").select("query_id", "id", "semantic", "lexical", F.round(score, digits).alias("score"))


def payload(chunks: DataFrame) -> DataFrame:
    """Return what a search hands out for each chunk (chunk_id first), with defaults for what is missing."""
    has = {c.lower() for c in chunks.columns}
    own = lambda name, value: (F.coalesce(F.col(name), value) if name in has else value).alias(name)
    none = F.array().cast("array<int>")
    return chunks.select("chunk_id", own("logical_page", none), own("pdf_page", F.lit(0)), *(own(c, F.lit("")) for c in ("chapter", "section", "current_heading", "content")))


def top_k(fused: DataFrame, k: int) -> DataFrame:
    """Keep the k best of each query: by score, then semantic score, then id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("semantic").desc(), "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
