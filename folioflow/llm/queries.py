"""Registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import chat_repair, collision_ann, license_scan, pair_rank, piece_bpe, ppm_langid, quality_rules, secret_ledger
from folioflow.llm.mixing import Mix
from folioflow.llm.shared import new_path
from folioflow.llm.sketch_join import jaccard_components


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired role, action and rendered text of every turn of every conversation."""
    got = chat_repair.repair(_table(spark, sf_dir, "conversations"))
    return got.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "pos", "role", "action", "inserted", "new_role", "rendered")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every document at 4 words and 85 %."""
    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, num=85, den=100).select("doc_id", F.col("n_shingles").cast("long"), "component_id")


#: Links by shared shingles, then the smallest reachable id.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + 3), ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all documents, by a classifier that templates confirm."""
    docs = _table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.LicenseModel(spark, docs))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 150 % mix of the sources takes from every document."""
    return Mix(_table(spark, sf_dir, "documents")).taken()


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the certified verdict for every document."""
    verdict = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, scanned through a ledger that starts empty."""
    found = secret_ledger.scan_history(_table(spark, sf_dir, "documents"), new_path(spark, "ledger"), ["doc_id"])
    return secret_ledger.digest(found)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by frozen context trees."""
    docs = _table(spark, sf_dir, "documents")
    got = ppm_langid.predict(docs, ppm_langid.fit(docs))
    return got.select("doc_id", ppm_langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every 50th vector among all."""
    return collision_ann.neighbours(_table(spark, sf_dir, "embeddings"))


def op10_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise-learned quality score of every document."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    got = pair_rank.score(docs, pair_rank.fit(docs, labels))
    return got.select("doc_id", ppm_langid.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def tokenizer_model() -> str:
    """Path of the public merge-type model; every machine has it at this place."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text for every document."""
    return piece_bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_model())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    found = (op1_chat_repair, op2_ngram_jaccard, op3_license_scan, op4_source_mix, op5_quality_rules, op6_secret_scan, op7_language_id, op8_sentencepiece, op9_collision_ann, op10_quality_ranking)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, for the queries that SQL can express."""
    return {"op2_ngram_jaccard": OP2_SQL}
