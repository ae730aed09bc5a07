"""Helpers shared by the operators: scratch tables, word patterns, hashing splits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the query contracts: a word, and the lower-casing of A-Z only.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has none (local tests) a temporary folder is set instead."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evidex-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder per application."""
    return f"{shared_dir(spark)}/evidex/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: it outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n.  A null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


_keeper: list = [None, None]


def worker_memory(owner: str, forget=None) -> None:
    """Called by a task's function in a Python worker, at its start and end.

    Workers outlive tasks: what one operator keeps there for its next task (``forget`` drops it) must
    not lie beside the next operator's memory, and freed memory goes back to the system."""
    import ctypes

    import pyarrow as pa

    if _keeper[0] not in (None, owner) and _keeper[1]:
        _keeper[1]()
    _keeper[:] = [owner, forget]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
