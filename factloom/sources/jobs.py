"""Ingestion as jobs: files become tables of documents and chunks, and an audit log.

A folder is ingested at once, or as a stream that remembers which files it has read: a run that ended early goes on
where it stopped.  Every batch is written under its own number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources import files

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def tables_of(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, audit) of files (path, length, content)."""
    blocks = files.blocks_of(found)
    chunks = files.chunks(blocks).withColumn("chunk_id", F.concat(F.lit("chunk_"), F.substring(F.sha2(F.concat_ws("|", "path", "ordinal", "part", F.sha2("text", 256)), 256), 1, 32)))
    documents = found.select("path", F.concat(F.lit("doc_"), F.substring(F.sha2("content", 256), 1, 24)).alias("doc_id"), "length", F.lit(True).alias("active"))
    status = F.when(F.bool_or(F.col("kind") == "failed"), "failed").when(F.bool_or(F.col("kind") == "unsupported"), "unsupported").otherwise("parsed")
    audit = blocks.groupBy("path").agg(status.alias("status"), F.count(F.lit(1)).alias("blocks"))
    return documents, chunks, audit


def write(found: DataFrame, out: str, number: int = 0) -> None:
    documents, chunks, audit = tables_of(found)
    documents.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
    chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
    audit.write.mode("overwrite").partitionBy("status").json(f"{out}/audit/batch={number}")


def ingest(spark: SparkSession, folder: str, out: str) -> None:
    """All files below a folder."""
    write(files.accepted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)), out)


def ingest_new(spark: SparkSession, folder: str, out: str, checkpoint: str, per_batch: int = 1000) -> None:
    """The files that no earlier run has read."""
    found = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    query = files.accepted(found).writeStream.foreachBatch(lambda batch, number: write(batch, out, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
