"""Live append to the tick table, and live counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidegate.schema import TICK_COLUMNS


def append_stream(
    stream: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Append a live stream to a table exactly once.

    Without an interval everything available is written and the query ends.  A failed
    write surfaces through `awaitTermination`; the intake is bounded by the source's own
    rate limit (`maxFilesPerTrigger`, `maxOffsetsPerTrigger`).
    """
    return write_stream(stream.select(*TICK_COLUMNS), path, checkpoint, interval)


def write_stream(
    stream: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def count_reasons(
    results: DataFrame, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Keep outcome counts per trigger under `path`; a repeated trigger overwrites its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("symbol", "reason").agg(F.count("*").alias("quotes"))
        counts.write.mode("overwrite").parquet(f"{path}/trigger={batch_id}")

    writer = results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def reason_totals(spark: SparkSession, path: str) -> DataFrame:
    """Counts so far per symbol and outcome."""
    return spark.read.parquet(path).groupBy("symbol", "reason").agg(F.sum("quotes").alias("quotes"))
