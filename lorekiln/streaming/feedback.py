"""Feedback events as a stream: each event key once, and counts in windows of event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, glob: str = "*") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 64).parquet(path)


def once(events: DataFrame, key: str = "event_key", ts: str = "ts", late: str = "40 days") -> DataFrame:
    """Each key once within the watermark; the state is dropped as the watermark passes."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def run_to_end(stream: DataFrame, mode: str, out_dir: str, checkpoint: str) -> None:
    """Process what is there and stop; files and checkpoint make a restart continue where it ended."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def upserted(stream: DataFrame, keys: list[str], out_dir: str, checkpoint: str) -> DataFrame:
    """The latest row of each key of a stream that has been run over all that is there.

    Each batch writes the rows that it changed to a folder of its own, as a whole, so a batch that is tried again leaves the same files; state
    goes as the watermark passes, and what is read back is the last batch's row of each key.
    """
    out = f"{out_dir}/changes"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    changes = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), "batch").alias("_last"))
    return last.select(*keys, "_last.*")


def collected(stream: DataFrame, spark: SparkSession, mode: str = "complete") -> DataFrame:
    """The result table of a stream that has been run over all that is there (for tests and small results)."""
    name = f"stream_{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def ingest_new(batch: DataFrame, seen: DataFrame, key: str = "content_hash") -> DataFrame:
    """For foreachBatch: the rows of a batch whose content is not known yet, once each."""
    return batch.dropDuplicates([key]).join(seen.select(key), key, "left_anti")
