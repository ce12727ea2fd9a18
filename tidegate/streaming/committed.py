"""Live append by trigger with a commit record, so that a repeated trigger changes nothing,
and compaction of the small files that live loads leave.

A trigger writes its rows into a folder of its own, named by writer and batch id, and then
its commit record.  Rows without a record are not read.  A trigger that runs again, after a
failure at any point, writes the same folder and the same record again.  Compaction copies
small batches into one and records, in one write, the new batch and those it replaces; until
that record is there, readers see the old batches, from then on the new one.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidegate.schema import TICK_COLUMNS, TICK_SCHEMA
from tidegate.sources.ticks import DEFAULT_BATCH

# A batch is (writer, batch); a record names it, its rows, and the batch that replaced it.
_COMMITS = "writer string, batch bigint, rows bigint, replaced_by string"
_WHERE = ["writer", "batch"]


def _write_rows(rows: DataFrame, path: str, writer: str, batch: int, file_rows: int) -> int:
    seen = Observation()
    counted = rows.select(*TICK_COLUMNS).observe(seen, F.count(F.lit(1)).alias("rows"))
    folder = f"{path}/rows/writer={writer}/batch={batch}"
    counted.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(folder)
    return int(seen.get["rows"])


def _record(records: DataFrame, path: str, writer: str, batch: int) -> None:
    records.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{writer}-{batch}")


def append_batch(rows: DataFrame, path: str, writer: str, batch: int, file_rows: int = DEFAULT_BATCH) -> int:
    """Append one batch; the same writer and batch again leave the table as it is."""
    spark = rows.sparkSession
    written = _write_rows(rows, path, writer, batch, file_rows)
    _record(spark.createDataFrame([(writer, batch, written, None)], _COMMITS), path, writer, batch)
    return written


def append_committed(
    stream: DataFrame, path: str, checkpoint: str, interval: str | None = None, writer: str | None = None
) -> StreamingQuery:
    """Append a live stream trigger by trigger.  A writer is known by its checkpoint, so
    another stream into the same table, or one with a new checkpoint, never overwrites it."""
    name = writer or hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(rows: DataFrame, batch: int) -> None:
        append_batch(rows, path, name, batch)

    started = stream.select(*TICK_COLUMNS).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    started = started.trigger(processingTime=interval) if interval else started.trigger(availableNow=True)
    return started.start()


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Batches that are part of the table now: writer, batch, rows."""
    records = spark.read.schema(_COMMITS).option("recursiveFileLookup", True).parquet(f"{path}/commits")
    replaced = F.max("replaced_by").alias("replaced_by")
    latest = records.groupBy(*_WHERE).agg(F.max("rows").alias("rows"), replaced)
    return latest.where("replaced_by is null").drop("replaced_by")


def scan_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches."""
    return _rows_of(spark, path, commits(spark, path)).select(*TICK_COLUMNS)


def _rows_of(spark: SparkSession, path: str, batches: DataFrame) -> DataFrame:
    schema = TICK_SCHEMA.simpleString()[7:-1].replace(":", " ")
    rows = spark.read.schema(f"{schema}, writer string, batch bigint").parquet(f"{path}/rows")
    return rows.join(batches.select(*_WHERE), _WHERE, "left_semi")


def compact(
    spark: SparkSession, path: str, small_rows: int = DEFAULT_BATCH, file_rows: int = DEFAULT_BATCH
) -> int:
    """Copy the batches with fewer than `small_rows` rows into one; returns how many they were."""
    small = commits(spark, path).where(F.col("rows") < small_rows)
    count, total = small.agg(F.count("*"), F.sum("rows")).first()
    if count < 2:
        return 0
    name = f"compact-{uuid.uuid4().hex[:16]}"
    rows = _rows_of(spark, path, small).repartition(max(1, -(-total // file_rows)))
    written = _write_rows(rows, path, name, 0, file_rows)
    if written != total:
        raise ValueError(f"{written} rows copied of {total}; the table is left as it was")
    replaced = small.withColumn("replaced_by", F.lit(name))
    whole = spark.createDataFrame([(name, 0, written, None)], _COMMITS)
    _record(whole.unionByName(replaced), path, name, 0)
    return count
