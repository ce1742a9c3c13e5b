"""Shared folder and lineage helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Options of the writer for rows of megabytes. By default it first looks at its size behind 100 rows.
WIDE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}

#: Bytes of the batches that go to Python where rows are long; by default Spark sends 64 MB at a time.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The session's ``spark.checkpoint.dir`` names it.  Only a local session without
    that setting falls back to a temporary folder: on a cluster such a folder would
    not outlive the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="ticketloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder (with these options of the writer) and read it back.

    Cuts the lineage before iterative work; a lost executor costs a re-read, not a
    recomputation of everything before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends ``BATCH_BYTES`` at a time to Python, so tasks hold less beside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
