"""BM25 (Okapi) over a corpus of any size: an index of tokens, statistics and scores.

The corpus is split into tokens once, and the tokens are written with each text's
length.  Document frequencies are counted over all of them, as the mean idf needs
the whole vocabulary; postings are only made of the terms that queries ask for.
Terms that more than half of the documents have would get a negative idf, and get
EPSILON times the mean idf of the vocabulary instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import tokens
from folioflow.sources.scratch import written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Distinct (query, term) pairs that are broadcast at most; more are joined by a shuffle.
BROADCAST_TERMS = 100_000


class Index:
    """The tokens of a corpus, with what all queries share."""

    def __init__(self, corpus: DataFrame, id_col: str, text: Column):
        split = corpus.select(F.col(id_col).alias("id"), tokens(text).alias("tokens"))
        self.tokens = written(split.select("id", F.size("tokens").alias("dl"), "tokens"), "tokens")
        #: One row: documents and their mean length.
        self.size = self.tokens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        terms = self.tokens.select(F.explode(F.array_distinct("tokens")).alias("term"))
        df = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(self.size))  # one row
        self.frequencies = written(df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"), "avgdl"), "frequencies")

    def weights(self) -> DataFrame:
        """Return (term, df, idf, avgdl); the last is the same in every row."""
        mean = self.frequencies.agg(F.avg("raw").alias("mean"))
        return self.frequencies.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")

    def postings(self, terms: DataFrame) -> DataFrame:
        """Return (id, term, tf, dl) of the given terms (term), which are distinct."""
        few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        one = self.tokens.select("id", "dl", F.explode("tokens").alias("term")).join(F.broadcast(terms) if few else terms, "term", "left_semi")
        return one.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))

    def scores(self, queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
        """Return (query_id, id, lexical) for every pair that shares a term.

        A query's repeated tokens count each time; all other pairs score 0.
        """
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        asked = written(asked.join(self.weights(), "term"), "asked")
        few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        hit = self.postings(asked.select("term").distinct()).join(F.broadcast(asked) if few else asked, "term")
        norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
        part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / norm
        return hit.groupBy("query_id", "id").agg(F.sum(part).alias("lexical"))

    def holding(self, passages: DataFrame, corpus: DataFrame, passage_id: str, passage: str, id_col: str, text_col: str) -> DataFrame:
        """Return (query_id, id) of the passages and the texts that have them within, letter by letter.

        A passage's tokens but the first and last are tokens of a text that holds it,
        so texts with the rarest of them are the candidates; the few passages without
        such a token meet all texts, and are broadcast.
        """
        own = passages.select(F.col(passage_id).alias("query_id"), F.col(passage).alias("passage")).where("passage IS NOT NULL")
        inner = own.withColumn("inner", tokens(F.col("passage"))).withColumn("inner", F.slice("inner", 2, F.greatest(F.size("inner") - 2, F.lit(0))))
        rare = inner.select("query_id", F.explode("inner").alias("term")).join(self.frequencies.select("term", "df"), "term", "left")
        rare = written(rare.groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term")).join(own, "query_id"), "rare")
        texts = corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        near = self.postings(rare.select("term").distinct()).select("id", "term").join(rare, "term").select("query_id", "passage", "id")
        found = near.join(texts, "id").where(F.contains("text", "passage")).select("query_id", "id")
        short = inner.where(F.size("inner") == 0).select("query_id", "passage")
        few = short.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        rest = texts.join(F.broadcast(short) if few else short, F.contains("text", "passage")).select("query_id", "id")
        return found.union(rest)


def top_k(scored: DataFrame, k: int, score: str = "lexical", digits: int = 6) -> DataFrame:
    """Return (query_id, rank, id, score): the k best of each query, rounded, ties to the smaller id."""
    rounded = scored.select("query_id", "id", F.round(score, digits).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
