"""The stored tick table: append, count what was written, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegate.schema import TICK_COLUMNS, TICK_SCHEMA

DEFAULT_BATCH = 1_000_000


def append_ticks(ticks: DataFrame, path: str, batch_size: int = DEFAULT_BATCH) -> int:
    """Append to the table at `path`, creating it if absent; returns the rows written.

    `batch_size` bounds the rows of one file.  The count is observed during the write
    itself, so the input is read once.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    seen = Observation()
    rows = ticks.select(*TICK_COLUMNS).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("append").option("maxRecordsPerFile", batch_size).parquet(path)
    return int(seen.get["rows"])


def scan_ticks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TICK_SCHEMA).parquet(path)
