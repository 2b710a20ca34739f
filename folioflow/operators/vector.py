"""Exact vector similarity: cosine in double precision, every query against all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of queries that are broadcast at most; more are taken in a shuffled join.
BROADCAST_QUERIES = 4096


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays, added up in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def with_norm(df: DataFrame, column: str, name: str = "norm") -> DataFrame:
    """Add the length of a vector, once a row."""
    return df.withColumn(name, F.sqrt(dot(F.col(column), F.col(column))))


def cosine(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Return (query_id, id, semantic) of (query_id, qv) against (id, v); zero vectors score 0.

    A stated query set meets all rows; it is broadcast if its rows, counted up to
    a bound, are few.
    """
    q = with_norm(queries.select("query_id", "qv"), "qv", "qn")
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    both = with_norm(rows, "v").crossJoin(F.broadcast(q) if few else q)
    length = F.col("norm") * F.col("qn")
    return both.select("query_id", "id", F.when(length > 0, dot(F.col("v"), F.col("qv")) / length).otherwise(0.0).alias("semantic"))
