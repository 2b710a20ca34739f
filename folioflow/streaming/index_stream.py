"""Incremental indexing: new chunks are embedded as they arrive, each of them once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.operators.providers import Provider, embed, stub_embedding


def index_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, text_col: str = "text", provider: Provider = stub_embedding) -> None:
    """Embed the Parquet files in ``source`` that no run has seen, and append them to ``target``.

    A stream with ``availableNow`` keeps what has been read in its checkpoint; the
    Parquet sink writes each batch once, also when a run is repeated after a loss.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    query = embed(rows, text_col, provider).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

