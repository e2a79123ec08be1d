"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    kept = sc._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    own = tempfile.mkdtemp(prefix="folioloom-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder; reads of it survive the loss of any executor."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again (columns of it can then be pruned)."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches_of(df: DataFrame, rows: int) -> DataFrame:
    """``df``, from now on handed to Python in batches of ``rows``: whole texts are long, and both sides hold a batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with lines in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parts_of(df: DataFrame, size: int = 16 << 20) -> int:
    """Partitions for the rows of ``df``: one for each ``size`` bytes that the optimizer expects, and as many as shuffles have at least."""
    expected = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = expected < 1 << 50  # what is not read from files has no size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-expected // size) if known else 1)


def give_back() -> None:
    """Returns what a Python worker no longer uses to the system: workers outlive tasks, and other stages need the memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library
