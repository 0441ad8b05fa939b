"""ST2: running sentiment counts per video and day over a comment stream.

The stream keeps no state: each micro-batch writes the counts of its own rows to a fresh path and commits
it to the result's log. The reader adds up what the log names, so it sees whole batches, each once: after a crash at
any point, when a batch runs again, and when several streams (or one with a new checkpoint) add to one result. Work
per batch follows the batch; entries are folded as the log says, which keeps the paths to read few.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.log import CommitLog, writer_of

SCHEMA = "day timestamp_ntz, videoId long, sentiment string, n long"


def daily_counts(rows: DataFrame, ts_col: str = "publishingDate") -> DataFrame:
    """Counts per (day, videoId, sentiment); rows without a date have a NULL day."""
    day = F.date_trunc("day", F.col(ts_col)).cast("timestamp_ntz")
    return rows.groupBy(day.alias("day"), "videoId", "sentiment").agg(F.count(F.lit(1)).alias("n"))


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("day", "videoId", "sentiment").agg(F.sum("n").alias("n"))


def publish_counts(spark: SparkSession, result: str, batch: DataFrame, writer: str, batch_id: int) -> None:
    """Add one batch of a stream to the result, once."""
    log = CommitLog(spark, result)
    if log.done(writer, batch_id):
        return
    path = f"data/{uuid.uuid4().hex}"
    daily_counts(batch).write.parquet(f"{result}/{path}")
    log.append({"writer": writer, "batch": batch_id, "path": path})

    def write(entries: list[dict], first: bool) -> dict:
        path = f"data/{uuid.uuid4().hex}"
        _added(spark.read.schema(SCHEMA).parquet(*[f"{result}/{e['path']}" for e in entries])).write.parquet(f"{result}/{path}")
        return {"path": path}

    log.fold(write)


def start_daily_counts(spark: SparkSession, landing: str, schema: T.StructType, result: str,
                       checkpoint: str, max_files_per_trigger: int | None = None):
    """Start the running-count query over Parquet files landing in ``landing``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))

    def publish(batch: DataFrame, batch_id: int) -> None:
        publish_counts(spark, result, batch, writer_of(spark, checkpoint), batch_id)

    return (reader.parquet(landing).writeStream.foreachBatch(publish)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_daily_counts(spark: SparkSession, result: str) -> DataFrame:
    """The counts of all batches committed so far."""
    live = CommitLog(spark, result).state()[1]
    if not live:
        return spark.createDataFrame([], SCHEMA)
    return _added(spark.read.schema(SCHEMA).parquet(*[f"{result}/{e['path']}" for e in live]))


def run_daily_counts(spark: SparkSession, landing: str, schema: T.StructType, result: str,
                     checkpoint: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Process everything landed so far, then return the result table."""
    q = start_daily_counts(spark, landing, schema, result, checkpoint, max_files_per_trigger)
    q.awaitTermination()
    return read_daily_counts(spark, result)
