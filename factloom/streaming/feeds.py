"""The same operators over streams: files as a stream, late rows within a watermark,
repeated rows dropped, daily windows, sessions, and appends written once per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how late the analytics source delivers.
LATE = "1 hour"


def file_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(stream: DataFrame, key: list[str], at: str, late: str = LATE) -> DataFrame:
    """Rows of a key once, as long as repeats come within the watermark; state older than
    that is dropped, so it does not grow with the stream."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def daily_counts(stream: DataFrame, by: str, at: str, late: str = LATE) -> DataFrame:
    counted = stream.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("day"), by, "n")


def sessions(stream: DataFrame, by: str, at: str, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Sessions split by more than the gap; a gap of exactly that much does not split."""
    s = stream.withWatermark(at, late).groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("calls"), F.min(at).alias("started_at"), F.max(at).alias("ended_at"))
    return s.select(by, "started_at", "ended_at", "calls")


def append_once(stream: DataFrame, folder: str, checkpoint: str):
    """A query that writes each batch to its own folder, by overwriting: a batch that is
    run again after a failure replaces what it had written."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={n:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
