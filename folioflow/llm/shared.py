"""Written tables in the cluster's shared folder, used to cut lineage.

A table goes below ``spark.checkpoint.dir`` of the session, so that it survives
lost executors.  Only where that setting is absent (local tests) is a folder in
the warehouse directory used instead.  Operators that send texts to Python lower the
session's rows of an Arrow batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Return the base folder that the driver and all executors can reach."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """Return an unused path in the shared folder; it goes when the JVM ends."""
    path = f"{shared_folder(spark)}/folioflow/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


#: Rows of an Arrow batch: texts of ten thousand rows at a time are tens of MB in every buffer on the way.
BATCH_ROWS, _BATCH_KEY, _SPARKS_OWN = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch, unless it has a setting of its own."""
    if spark.conf.get(_BATCH_KEY) == _SPARKS_OWN:
        spark.conf.set(_BATCH_KEY, BATCH_ROWS)


def give_back() -> None:
    """Return a worker's freed memory to the machine at the end of a task, as workers are kept for later ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._folioflow_path = path
    return written


def keep(df: DataFrame) -> DataFrame:
    """Keep a table that is read a few times on the executors' disks; what a lost one held is worked out again.

    It cuts no lineage, and plans over kept tables hold theirs, so what loops hand on is
    written by materialize().
    """
    kept = df.persist(StorageLevel.DISK_ONLY)
    kept._folioflow_rows = kept.count()
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() and keep() that nothing reads any more."""
    for table in tables:
        if table.storageLevel != StorageLevel.NONE:
            table.unpersist()
        path = getattr(table, "_folioflow_path", None)
        if path:
            spark = table.sparkSession
            hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
