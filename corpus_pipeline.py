"""Corpus pipeline: quality rules, near duplicates, secrets, source mix, token ids.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one
before kept.  All but the last return the columns of documents, and further columns
of any name pass through them.  An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import piece_bpe, quality_rules, secret_ledger
from folioflow.llm.mixing import Mix
from folioflow.llm.queries import tokenizer_model
from folioflow.llm.shared import materialize
from folioflow.llm.sketch_join import ParitySketchJoin


def _sized(docs: DataFrame) -> DataFrame:
    """Bring n_chars in line with a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rules or the certified cutoffs reject.

    Null and empty texts, and texts of fewer than 20 words, go; repeated rows are judged
    alike; without labels only the base rules hold.
    """
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five words, 0.8): that of the smallest id, null ids last.

    Documents without a word are all kept; of rows with equal id and text one stays.
    """
    return ParitySketchJoin(docs, "doc_id", "text", width=5, num=80, den=100).one_per_component(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; n_chars follows the text.  Null texts stay null, repeated rows are kept."""
    return _sized(secret_ledger.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the mix of sources: documents are repeated, cut or left out to meet the targets.

    Documents without a word are not drawn; a null source is a source of its own; repeated
    rows are separate documents.
    """
    return _sized(Mix(docs).rows(docs).select(*docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text; one row for each drawn document, with the end id alone for an empty or null text."""
    rows = piece_bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_model())
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("secret_scan", secrets), ("source_mix", mix), ("sentencepiece", tokens)]

#: Shingle verdicts, cutoffs fitted on labels and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
