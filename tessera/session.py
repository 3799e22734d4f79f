"""Session helpers: table access and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read lazily so that Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and the master is local (tests, notebooks) a temporary folder takes its
    place.  Elsewhere executors would write to disks of their own, so it is an
    error.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_DIR} is unset; it must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(CHECKPOINT_DIR, named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: For rows of megabytes: pages and row groups are else as large as a hundred rows, and buffers outside of the heap as large as pages.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(16 << 20)}


def written(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with files that survive a lost executor, and keeps a
    result that several later steps read from being computed again.
    ``options`` are those of the files' writer.
    """
    path = scratch(df.sparkSession, label)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run within hand Python workers Arrow batches of ``most`` bytes, or of one row; a lower setting stays.

    By default a batch has 10,000 rows, however large they are: one of a
    partition's size, in the executor outside of its heap and in the worker.
    """
    was = spark.conf.get(BATCH_BYTES, None)
    set_bytes = int(re.sub("[bB]$", "", was)) if was and re.fullmatch("[0-9]+[bB]?", was) else None
    spark.conf.set(BATCH_BYTES, str(min(most, set_bytes or most)))
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, was)
