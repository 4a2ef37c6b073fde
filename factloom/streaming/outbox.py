"""The outbox and resumable ingestion as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def read_events(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder, so many at a time.  The query's checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need instants."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first event of each dedupe key; keys are forgotten after the delay, so state is bounded."""
    return _timed(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def windowed(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events and their value by hour and type; a window is final once the watermark passes it."""
    return _timed(events).withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _states(events: DataFrame) -> DataFrame:
    """What a batch says about each key: its first event, its last with the payload, and how many there are."""
    return events.groupBy("user_id", "event_type").agg(
        F.min(F.struct("ts", "event_id")).alias("first"), F.max(F.struct("ts", "event_id", "props")).alias("last"), F.count(F.lit(1)).alias("version")
    )


def run_outbox(events: DataFrame, path: str, checkpoint: str) -> None:
    """Append what each batch says about its keys, one folder for each batch; newest() merges them.

    A batch writes as much as it reads, however large the outbox is, and one that is run again after a failure
    writes the same folder.
    """

    def append(batch: DataFrame, number: int) -> None:
        _states(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The outbox: for each key the id of its first event by (ts, event_id), the payload of its last, whatever batch they came in; pending again."""
    states = spark.read.parquet(path).groupBy("user_id", "event_type").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("version").alias("version"))
    return states.select("user_id", "event_type", F.col("first.event_id").alias("event_id"), F.col("last.props").alias("payload"), F.lit("pending").alias("status"), "version")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Merge the batches of an outbox into one folder of another, which can be read and appended to alike."""
    states = spark.read.parquet(path).groupBy("user_id", "event_type").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("version").alias("version"))
    states.write.parquet(f"{target}/batch=-1")
