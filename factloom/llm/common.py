"""Shared storage for intermediate tables.

Executors and the driver share no local folder, so whatever one job leaves for the next goes to the
folder that the cluster names in spark.checkpoint.dir, as Parquet or as an operator's own files.
Reading such a table back also cuts the lineage: a lost executor costs its tasks, not the whole history.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that Python gets at once in arrow_batches(), in bytes.  By default Spark counts rows alone, 10,000 of them.
BATCH_BYTES = 6 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

#: The folders made in each open scratch().
_made: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one is set only where none is and all runs on this machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/factloom-{label}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Folders made inside are removed at the end, but for those that frames given to the yielded function still read."""
    _made.append([])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(path.rsplit("/", 2)[-2] for path in df.inputFiles())
        return df

    try:
        yield keep
    finally:
        made = _made.pop()
        left = [path for path in made if path.rsplit("/", 1)[-1] in kept]
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in set(made) - set(left):
            folder = hadoop.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        if _made:
            _made[-1].extend(left)


@contextmanager
def arrow_batches(spark: SparkSession, octets: int = BATCH_BYTES) -> Iterator[None]:
    """What runs inside hands rows to Python in batches of about so many bytes, or one longer row; a value that the session has set stands."""
    if spark.conf.get(_BATCH_CONF, None) is not None:
        yield
        return
    spark.conf.set(_BATCH_CONF, f"{octets}b")
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_CONF)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which a worker that waits for its next task gives back the memory that Arrow has freed but holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
