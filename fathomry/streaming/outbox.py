"""Structured Streaming: update events keep an index of content hashes current; a sweep repairs what events missed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "doc_id long, version long, hash string, ts timestamp"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (doc_id, version) once; the state of keys older than the watermark is dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["doc_id", "version"])


def latest(rows: DataFrame) -> DataFrame:
    """The newest version of each document."""
    newest = F.max_by(F.struct("version", "hash"), F.struct("version", "hash")).alias("n")
    return rows.groupBy("doc_id").agg(newest).select("doc_id", "n.version", "n.hash")


def upsert_into(path: str):
    """A foreachBatch sink: each batch's newest versions go to a folder of its own, so that a repeated batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """The index after all batches so far: doc_id, version, hash."""
    return latest(spark.read.parquet(path).select("doc_id", "version", "hash"))


def start(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all that is there and stop; running it again goes on from the checkpoint.

    Repeated events do no harm, as the newest version counts, and neither do late ones: no watermark decides what is indexed.
    """
    return events.writeStream.foreachBatch(upsert_into(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(events: DataFrame, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and the documents they touch in each window of event time; the same on a stream and on a table."""
    touched = F.approx_count_distinct("doc_id").alias("documents")
    return events.withWatermark("ts", delay).groupBy(F.window("ts", length)).agg(F.count(F.lit(1)).alias("events"), touched)


def sequence_gaps(events: DataFrame) -> DataFrame:
    """doc_id, after, before: versions that no event brought, between two that came (lost events)."""
    last = F.lag("version").over(Window.partitionBy("doc_id").orderBy("version"))
    rows = events.select("doc_id", "version").distinct().withColumn("after", last)
    return rows.where("version > after + 1").select("doc_id", "after", F.col("version").alias("before"))
